"""What the queries of FINDINGS_r04.md write to disk and let travel."""

import os

from pyspark.sql import functions as F

from spanlens import session
from spanlens.operators import graphquery
from spanlens.plans import overlap


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_cut_tables_are_small_on_disk_and_whole(spark):
    told = F.concat(F.lit("a tool grasps tissue near vessel "), F.col("id") % 7)
    rows = spark.range(20000).select(
        "id", F.array_repeat(F.struct(told.alias("said"), F.lit(None).cast("double").alias("none")), 20).alias("facts"), F.create_map(F.lit("k"), F.col("id") * 0.5).alias("m")
    )
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        spark.sparkContext.setCheckpointDir(session.shared_folder(spark))
        folder = spark.sparkContext.getCheckpointDir()
    folder = folder.removeprefix("file:")
    before = _bytes(folder)
    cut = session.cut_lineage(rows)
    # 20,000 rows of 20 facts are over 20 MB as rows.
    assert _bytes(folder) - before < 2_000_000
    assert cut.schema.simpleString() == rows.schema.simpleString()
    assert cut.select(F.bit_xor(F.xxhash64("id", "facts"))).first() == rows.select(F.bit_xor(F.xxhash64("id", "facts"))).first()
    assert cut.filter("m['k'] = 0.5 * id").count() == 20000


def test_groups_below_the_last_place_stay_in_their_tile(spark):
    """A tile hands on no more groups than can be ranked; ties stay, and ranks are those of all groups."""
    events = [("v", i, f"e{i}", float(i), i + 1.0, ["cut"] if i % 3 == 0 else ["hold"], ["mesh"] if i % 2 else ["organ"], [], [f"w{i % 7}"], i % 5 / 5, 0.5, 0.5) for i in range(40)]
    table = spark.createDataFrame(
        events,
        "video_id string, event_index bigint, event_id string, start_seconds double, end_seconds double, predicates array<string>, concepts array<string>, "
        "attribute_values array<string>, tokens array<string>, structural_support_score double, representative_action_coverage double, representative_entity_coverage double",
    )
    asked = [("v", f"q{i}", ["cut"], [1.5], ["mesh"], [1.2], [], [f"w{i}", "w3"], [None, "after", "before"][i % 3]) for i in range(6)]
    asked = spark.createDataFrame(
        asked + asked[:1],  # a question that comes twice
        "video_id string, question_id string, query_predicates array<string>, predicate_weights array<double>, query_concepts array<string>, concept_weights array<double>, "
        "query_attributes array<string>, query_tokens array<string>, relation string",
    )
    seeds = spark.createDataFrame([("v", f"q{i}", f"e{(i * 5 + j) % 40}", j + 1) for i in range(6) for j in range(20)], "video_id string, question_id string, event_id string, seed_rank int")
    every = graphquery.event_groups(asked, table, seeds)
    few = graphquery.event_groups(asked, table, seeds, best=3)
    a, b = (sorted(map(str, graphquery.rank_groups(g, 3).collect())) for g in (every, few))
    assert a == b and len(a) == 18
    assert few.count() < every.count()
    twice = [r.event_ids for r in every.filter("question_id = 'q0'").collect()]
    assert all(ids[::2] == ids[1::2] for ids in twice)


def test_short_spans_are_not_dealt_to_meet_the_common_time(spark):
    spans = spark.createDataFrame([(i % 3, float(i), i + (5.0 if i % 10 else 90_000.0)) for i in range(60)], "v int, s double, e double")
    common = spark.createDataFrame([(0, 0.0, 600.0), (1, 0.0, 600.0)], "v int, _from double, _to double")
    rows = overlap.in_buckets(spans, common, ["v"], "s", "e", 300.0, "_first")
    want = [(v, s, b) for v, s, e in spans.collect() for b in range(int(s // 300), int((e if e - s < 10 else min(e, 600.0)) // 300) + 1) if e - s < 10 or v < 2]
    assert sorted((r.v, r.s, r._bucket) for r in rows.collect()) == sorted(want)
    assert "_part" not in rows._jdf.queryExecution().analyzed().toString()


def test_only_items_near_a_point_reach_the_join_of_positions(spark):
    items = spark.range(3000).select(F.lit(1).alias("v"), F.col("id").alias("ord"), (F.col("id") * 20.0).alias("t"))
    points = spark.createDataFrame([(1, 7, 1010.0), (1, 8, 30_000.0)], "v int, q int, p double")
    for side, want in (("before", {(7, i) for i in range(47, 51)} | {(8, i) for i in range(1496, 1500)}), ("after", {(7, i) for i in range(51, 55)} | {(8, i) for i in range(1501, 1505)})):
        near = overlap.ranked_neighbours(points, items, "v", "q", "p", "t", "ord", 4, side)
        assert {(r.q, r.ord) for r in near.collect()} == want
        assert "_other" in near._jdf.queryExecution().analyzed().toString()
