"""Rows travel once per tile, work is dealt by rows, and nothing is worked out that a query does not read."""

from pyspark.sql import functions as F

from spanlens.catalog import inputs
from spanlens.catalog.questions import query_texts
from spanlens.operators import clusterindex, graph, normalize, vectorsearch
from spanlens.plans import blocks, pruned
from spanlens.session import spread
from tests.test_clusterindex import frames, picked, unit_rows


def test_tiles_grow_instead_of_their_number(spark):
    n = [1, 8_000, 8_001, 128_000, 600_000, 1_024_001]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select(blocks.tiles(F.col("n"), 500, 16).alias("t"))
    assert [r.t for r in rows.collect()] == [1, 1, 2, 16, 16, 17]


def test_blocks_of_a_tile_share_one_answer(spark, monkeypatch):
    queries, index = frames(spark, unit_rows())
    want = picked(vectorsearch.cosine_top_k(queries, index, 5, False))
    plan = []
    real = blocks.top_per_group
    monkeypatch.setattr(blocks, "top_per_group", lambda df, *a: plan.append(df) or real(df, *a))
    assert picked(vectorsearch.cosine_top_k(queries, index, 5, False, left_rows=10, right_rows=20)) == want
    # 30 blocks of the index lie in 4 tiles.
    assert plan[0].count() <= 4 * 5 * 150


def test_left_rows_travel_once_per_tile(spark, monkeypatch):
    queries, index = frames(spark, unit_rows())
    want = picked(vectorsearch.cosine_top_k(queries, index, 5, False))
    monkeypatch.setattr(blocks, "RIGHT_BLOCK_ROWS", 15)  # tiles of 120 rows
    seen = []
    real = blocks.best_in_cells
    monkeypatch.setattr(blocks, "best_in_cells", lambda lc, rc, left, *a, **b: seen.append(left) or real(lc, rc, left, *a, **b))
    built = clusterindex.build_clusters(index, False, block_rows=5)
    assert picked(clusterindex.pruned_top_k(queries, built, 5)) == want
    tiles = pruned.placed(built.rings, built.keys).select(F.explode("at.tile").alias("t")).distinct().count()
    assert 1 < tiles <= 6
    for left in seen:
        assert left.groupBy("qa_uid").count().agg(F.max("count")).first()[0] <= tiles


def test_a_full_split_among_empty_ones_is_dealt_anew(spark):
    rows = spark.range(0, 1000, 1, 1).union(spark.range(0, 0, 1, 100))
    out = spread(rows, "id")
    assert out.count() == 1000
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 500


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_actions_do_not_need_attributes(spark, sf_dir):
    clips = normalize.normalize_clips(inputs.clip_descriptions(spark, sf_dir))
    assert "map_filter" in _optimized(clips.select("mentions"))
    assert "map_filter" not in _optimized(clips.select("actions"))


def test_nodes_without_metadata_write_no_json(spark, sf_dir):
    clips = normalize.normalize_clips(inputs.clip_descriptions(spark, sf_dir))
    kept = "supporting_clip_ids concepts predicates merge_scores merge_details support_mode support_components representative_action_coverage representative_entity_coverage representatives".split()
    events = clips.select("video_id", F.col("clip_id").alias("event_id"), F.col("clip_id").alias("label"), F.lit(1.0).alias("structural_support_score"), *[F.lit("x").alias(c) for c in kept])
    nodes = graph.build_nodes(clips, events)
    assert "to_json" not in _optimized(nodes.select("video_id", "id", "node_type"))
    said = {r.node_type: r.metadata for r in nodes.filter("id LIKE '%c7' OR id LIKE '%:c7:%'").collect()}
    assert '"observation"' in said["segment"] and '"source_field"' in said["entity_mention"] and '"original_action"' in said["action_event"]


def test_times_are_read_once_for_query_texts(spark, sf_dir):
    assert "regexp_extract" not in _optimized(query_texts(spark, sf_dir)).lower()
