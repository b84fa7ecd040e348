"""Graphs are published as a whole or not at all, and checked when loaded."""

import pytest
from pyspark.sql import functions as F

from spanlens.sources import store


def tables(spark, types=("temporal_event", "segment")):
    nodes = spark.createDataFrame([("v", f"n{i}", t) for i, t in enumerate(types)], "video_id string, id string, node_type string")
    return {"nodes": nodes, "edges": spark.createDataFrame([("v", "n0", "n1")], "video_id string, source string, target string")}


def test_a_broken_table_leaves_nothing_visible(spark, tmp_path):
    path, good = str(tmp_path / "graph"), tables(spark)
    broken = good["edges"].withColumn("x", F.raise_error(F.lit("third table breaks")).cast("int"))
    with pytest.raises(Exception, match="third table breaks"):
        store.write_graph({**good, "events": broken}, path, 2)
    with pytest.raises(FileNotFoundError):
        store.load_graph(spark, path)
    store.write_graph(good, path, 2)
    read = store.load_graph(spark, path)
    assert {n: sorted(map(tuple, df.collect())) for n, df in read.items()} == {n: sorted(map(tuple, df.collect())) for n, df in good.items()}
    with pytest.raises(FileExistsError):
        store.write_graph(good, path, 2)


def test_a_graph_without_events_is_refused(spark, tmp_path):
    path = str(tmp_path / "graph")
    store.write_graph(tables(spark, ("segment", "segment")), path, 2)
    with pytest.raises(ValueError, match="graphs without events"):
        store.load_graph(spark, path)
    assert store.load_graph(spark, path, check=False)["nodes"].count() == 2
