import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.operators import clusterindex, vectorsearch

FIELDS = "chunk_id bigint, video_id int, ord bigint, start_seconds double, end_seconds double, vec array<float>"


def unit_rows(n=600, groups=12, dim=16, spread=0.05, seed=4):
    """Vectors around a few directions; every fifth repeats the one before, so scores tie."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, dim))
    out = []
    for i in range(n):
        v = heads[rng.integers(groups)] / np.linalg.norm(heads[0]) + spread * rng.normal(size=dim)
        out.append(out[-1] if i % 5 == 4 else (v / np.linalg.norm(v)).astype(np.float32))
    # One recording holds two thirds of all rows, others are tiny.
    return [(i, 0 if i % 3 else 1 + i % 40, i, float(i), float(i + 1), [float(x) for x in v]) for i, v in enumerate(out)]


def frames(spark, rows):
    index = spark.createDataFrame(rows, FIELDS)
    queries = spark.createDataFrame([(r[0], r[1], r[5]) for r in rows if r[0] % 4 == 0], "qa_uid bigint, video_id int, vec array<double>")
    return queries, index


def picked(hits):
    return sorted((r.qa_uid, r.rank, r.chunk_id, r.score, r.video_id, r.start_seconds) for r in hits.collect())


@pytest.mark.parametrize("within", [True, False])
def test_pruned_search_equals_all_blocks_and_meets_few(spark, within, tmp_path):
    queries, index = frames(spark, unit_rows())
    built = clusterindex.build_clusters(index, within, block_rows=25)
    assert built.rows.count() == 600
    sizes = built.rows.groupBy("video_id" if within else "_all", "cell", "ring", "part").count().agg(F.max("count")).first()[0]
    assert sizes <= 50
    clusterindex.save_clusters(built, str(tmp_path / "index"), 4)
    loaded = clusterindex.load_clusters(spark, str(tmp_path / "index"))
    want = picked(vectorsearch.cosine_top_k(queries, index, 5, within))
    assert picked(clusterindex.pruned_top_k(queries, loaded, 5, left_rows=20)) == want
    if not within:
        report = clusterindex.pruning_report(queries, loaded, 5).first()
        assert 0 < report.scored_meetings < report.all_meetings / 3


def test_vectors_without_clusters_zero_and_not_a_number(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 0, i, 0.0, 1.0, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(80, 8)))]
    rows[7] = (*rows[7][:5], [0.0] * 8)
    rows[9] = (*rows[9][:5], [float("nan")] * 8)
    queries, index = frames(spark, rows)
    for k in (3, 200):  # more than there are rows: everything is met
        want = picked(vectorsearch.cosine_top_k(queries, index, k, False))
        assert picked(clusterindex.pruned_top_k(queries, clusterindex.build_clusters(index, False, block_rows=10), k)) == want


def test_empty_index_and_unknown_recordings(spark):
    queries, index = frames(spark, unit_rows(20))
    for within in (True, False):
        assert clusterindex.pruned_top_k(queries, clusterindex.build_clusters(index.limit(0), within), 3).count() == 0
        assert clusterindex.pruned_top_k(queries.limit(0), clusterindex.build_clusters(index, within), 3).count() == 0
    same = index.select(F.col("chunk_id").alias("qa_uid"), "video_id", F.col("vec").cast("array<double>").alias("vec"))
    assert clusterindex.pruned_top_k(same, clusterindex.build_clusters(index, True, block_rows=4), 1).count() == 20
    lost = queries.withColumn("video_id", F.lit(777))
    assert clusterindex.pruned_top_k(lost, clusterindex.build_clusters(index, True, block_rows=4), 3).count() == 0
