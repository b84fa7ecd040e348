import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanlens.functions import numeric, timetext
from spanlens.operators import metrics, retrieve, vectorsearch, windows
from spanlens.sources import jsonl, store
from spanlens.streaming import scoring


def test_rounding_equals_the_stored_value(spark):
    rng = random.Random(3)
    values = [2.675, 0.03125, 0.12345, 2.5, 0.5, 1e-9, 1.005] + [rng.random() * 10 ** rng.randint(-3, 4) for _ in range(500)] + [rng.randint(0, 10**6) / 64 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 3, 6):
        got = [tuple(r) for r in df.select(numeric.exact_round("x", digits), numeric.exact_round(F.col("x"), digits)).collect()]
        assert got == [(round(v, digits), round(v, digits)) for v in values]


def test_time_spans(spark):
    cases = {
        "from 1:02 to 2:02": (62.0, 122.0, "range"), "between 5 and 3 around 1:10": (70.0, 70.0, "point"), "that 5": (5.0, 5.0, "point"),
        "from 2:00 to 1:00 then at 3": (3.0, 3.0, "point"), "nothing": None, "during 0:10:05 - 1:00:00": (605.0, 3600.0, "range"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", timetext.parse_time_span(F.col("q")).alias("s")).collect()
    assert {r.q: tuple(r.s) if r.s else None for r in rows} == cases


def test_digits_of_every_script_are_read(spark):
    zeros = [chr(c) for c in range(128, 0x110000) if unicodedata.decimal(chr(c), None) == 0]
    assert len(zeros) > 50
    runs = spark.createDataFrame([("".join(chr(ord(z) + i) for i in range(10)),) for z in zeros], "t string")
    assert {r.a for r in runs.select(timetext.ascii_digits(F.col("t")).alias("a")).collect()} == {"0123456789"}
    # Bengali, Thai, Tibetan, and mathematical bold, whose digits are two code units each.
    for zero in "\u09e6\u0e50\u0f20\U0001d7ce":
        d = [chr(ord(zero) + i) for i in range(10)]
        text = f"from {d[1]}:{d[0]}{d[2]} to {d[2]}:{d[3]}{d[0]}"
        got = spark.createDataFrame([(text,)], "t string").select(timetext.parse_time_span(F.col("t")).alias("s")).first().s
        assert tuple(got) == (62.0, 150.0, "range")


@pytest.mark.parametrize("width", [7.0, 300.0])
def test_interval_retrieval_equals_all_pairs(spark, width):
    rng = random.Random(int(width))
    chunks = [(v, f"{v}_{i}", s := rng.randint(0, 200) / 2, s + rng.randint(1, 80) / 2, i) for v in ("a", "b") for i in range(60)]
    asked = [(f"q{i}", rng.choice("ab"), s := rng.randint(0, 260) / 2, s + (0 if i % 2 else rng.randint(0, 90) / 2), "point" if i % 2 else "range") for i in range(80)]
    c = spark.createDataFrame(chunks, "video_id string, chunk_id string, start_seconds double, end_seconds double, ord int")
    q = spark.createDataFrame(asked, "qa_uid string, video_id string, asked_start double, asked_end double, asked_kind string")
    got = {}
    for hits in (retrieve.retrieve_ranges(q, c, 4, width), retrieve.retrieve_points(q, c, 4, width)):
        for r in hits.collect():
            got.setdefault(r.qa_uid, []).append((r.rank, r.chunk_id))
    for uid, video, a, b, kind in asked:
        rows = []
        for v, name, s, e, i in chunks:
            if v != video:
                continue
            if kind == "range" and max(a, s) < min(b, e):
                rows.append((-(min(b, e) - max(a, s)) / (max(b, e) - min(a, s)), i, name))
            if kind == "point":
                rows.append((-(1.0 if s <= a <= e else 1 / (1 + min(abs(a - s), abs(a - e)))), i, name))
        assert [n for _, n in sorted(got.get(uid, []))] == [n for _, _, n in sorted(rows)[:4]]


def test_blocked_search_equals_one_block(spark, sf_dir):
    from spanlens.catalog import search

    q, index = search.query_rows(spark, sf_dir), search.index_rows(spark, sf_dir)
    pick = lambda **kw: sorted(tuple(r) for r in vectorsearch.cosine_top_k(q, index, 3, **kw).select("qa_uid", "rank", "chunk_id").collect())
    assert pick(left_rows=9, right_rows=11) == pick()
    assert pick(within_recording=False, left_rows=100, right_rows=70) == pick(within_recording=False)


def test_window_and_clip_facts(spark):
    v = spark.createDataFrame([("a", 95.0)], "video_id string, duration_seconds double")
    assert [(r.start_seconds, r.end_seconds) for r in windows.time_windows(v).orderBy("window_index").collect()] == [(0, 30), (30, 60), (60, 90), (90, 95)]
    with pytest.raises(ValueError):
        windows.time_windows(v, 30, 0)
    v = spark.createDataFrame([("a", 130.0)], "video_id string, duration_seconds double")
    assert [r.sampled_frame_count for r in windows.clips_of_plans(windows.plan_clips(v)).orderBy("clip_index").collect()] == [64, 64, 2]
    v = spark.createDataFrame([("a", 10000.0)], "video_id string, duration_seconds double")
    capped = windows.clips_of_plans(windows.plan_clips(v, "capped")).orderBy("clip_index").collect()
    assert len(capped) == 113 and capped[0].end_seconds == 88.889 and capped[-1].sample_end_index == 7200
    assert windows.clips_of_plans(windows.plan_clips(v)).count() == 157
    picks = spark.range(1).select(windows.even_positions(F.lit(87), 10)).first()[0]
    assert picks == [0, 10, 19, 29, 38, 48, 57, 67, 76, 86]


def test_token_f1_edges(spark):
    rows = [("a", "the cat", "The cat sat"), ("b", "", ""), ("c", "x", ""), ("d", "y", None), ("e", "手术 刀", "手术")]
    df = spark.createDataFrame(rows, "id string, prediction string, reference string")
    got = {r.id: r.token_f1 for r in metrics.with_token_f1(df).collect()}
    assert got["a"] == pytest.approx(0.8) and got["b"] == 1.0 and got["c"] == 0.0 and got["d"] is None and got["e"] == pytest.approx(2 / 3)


def test_stream_restart_counts_once(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    row = lambda i, p: (str(i), p, "A", "t", "r")
    put = lambda rows: spark.createDataFrame(rows, scoring.PREDICTION_SCHEMA).coalesce(1).write.mode("append").json(src)
    put([row(1, "A"), row(2, "B"), row(2, "B"), row(3, None)])
    scoring.score_stream(spark, src, out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    put([row(2, "A"), row(3, "A")])
    scoring.score_stream(spark, src, out, cp).awaitTermination()
    scoring.score_stream(spark, src, out, cp).awaitTermination()
    assert sorted((r.id, r.prediction) for r in spark.read.parquet(out).collect()) == [("1", "A"), ("2", "B"), ("3", "A")]
    # A batch written again keeps its rows.
    again = spark.createDataFrame([row(2, "A"), row(3, "A")], scoring.PREDICTION_SCHEMA)
    last = max(r.batch for r in spark.read.parquet(out).select("batch").distinct().collect())
    scoring._append_batch(out)(again, last)
    assert spark.read.parquet(out).count() == 3
    overall = [r for r in scoring.current_report(spark, out).collect() if r.slice == "overall"][0]
    assert overall["count"] == 3 and overall.exact_match == pytest.approx(2 / 3)


def test_files_round_trip(spark, sf_dir, tmp_path):
    from spanlens.catalog import search

    rows = spark.createDataFrame([("a", None), ("b", 1)], "id string, n int")
    jsonl.write_jsonl(rows, str(tmp_path / "x"))
    assert sorted(map(tuple, jsonl.read_jsonl(spark, str(tmp_path / "x"), "id string, n int").collect()), key=str) == [("a", None), ("b", 1)]
    (tmp_path / "bad.json").write_text('{"id": "a"}\n{"id"\n')
    bad = jsonl.read_jsonl(spark, str(tmp_path / "bad.json"), "id string", fail_fast=False)
    assert [r[jsonl.CORRUPT] for r in bad.collect()] == [None, '{"id"']
    index = search.index_rows(spark, sf_dir)
    store.save_index(index, str(tmp_path / "index"), buckets=4)
    assert store.load_index(spark, str(tmp_path / "index")).count() == index.count()
    store.write_graph({"nodes": index}, str(tmp_path / "graph"), 4)
    with pytest.raises(Exception, match="exist"):
        store.write_graph({"nodes": index}, str(tmp_path / "graph"), 4)


@pytest.mark.parametrize("name", ["range_retrieval", "point_retrieval", "graph_edges", "recovered_evidence", "clip_events", "normalized_questions"])
def test_plans_have_no_pairing_of_everything(spark, sf_dir, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "EvalPython" not in plan
