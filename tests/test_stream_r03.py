"""Stored ids grow with every batch; no task may hold them all."""

from spanlens.streaming import scoring


def test_stored_ids_are_not_broadcast(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    row = lambda i, p: (i, p, "A", "t", "r")
    put = lambda *rows: spark.createDataFrame(rows, scoring.PREDICTION_SCHEMA)
    write = scoring._append_batch(out)
    write(put(row("1", "A"), row("1", "A"), row("2", "B")), 0)
    second = put(row("2", "A"), row("3", "A"), row("3", "A"), row("4", None), row(None, "A"))
    seen = []
    monkeypatch.setattr(type(second.write), "parquet", lambda self, path: seen.append(self._df))
    write(second, 1)
    assert [(r.id, r.prediction) for r in seen[0].collect()] == [("3", "A")]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
