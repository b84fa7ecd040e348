"""Exact cosine search over a stored cluster index: blocks that cannot hold a best row are never met.

Rows near one centre form a cell, rows at similar distance from it a ring, and a ring is cut into parts of bounded size. By the triangle
inequality a query at distance d from the centre is at least ``max(0, d - far, near - d)`` away from every row of a ring, which bounds its
scores. The nearest rings of a query are scored first; its k-th best score there decides which other rings can still matter. The bounds only
save work: results equal those of the search over all blocks, whatever the centres are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions import vectors
from spanlens.operators.vectorsearch import SCORE_DIGITS, _cosine_block
from spanlens.plans import blocks, pruned
from spanlens.session import cut_lineage
from spanlens.sources import store

# Centres are held by every task: at most this many, whatever the size of the index.
MAX_CELLS = 256
RINGS = 16
# Centres are fitted to about this many rows, chosen by hash. Every row is indexed.
SAMPLE_ROWS = 50_000
# Distances come from dot products of doubles; near zero their square root is good to this much only.
DISTANCE_SLACK = 1e-6
SCORE_SLACK = 2.0 * 10**-SCORE_DIGITS
# The cell of a recording that fits into one block: it has no centre and no bound.
WHOLE = -1


class ClusterIndex(NamedTuple):
    """``rows``: index rows with cell, ring, part. ``rings``: (keys, cell, ring, parts, n, near, far, square). ``centres``: (cell, centre)."""

    rows: DataFrame
    rings: DataFrame
    centres: DataFrame
    keys: tuple[str, ...]


def _distances(centres: np.ndarray, normalize: bool):
    """Column function: distances of a vector to all centres."""
    squares = (centres * centres).sum(axis=1) if len(centres) else np.zeros(0)

    @F.pandas_udf("array<double>")
    def measure(vec: pd.Series) -> pd.Series:
        if not len(centres) or vec.empty:
            return pd.Series([[] for _ in vec], dtype=object)
        rows = np.stack(vec.to_numpy()).astype(np.float64)
        if normalize:
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), vectors.NORM_FLOOR)
        square = (rows * rows).sum(axis=1)[:, None] + squares[None, :] - 2 * rows @ centres.T
        return pd.Series(list(np.sqrt(np.maximum(square, 0.0))))

    return measure


def _centre_matrix(centres: DataFrame) -> np.ndarray:
    rows = sorted(centres.collect(), key=lambda r: r.cell)  # at most MAX_CELLS
    return np.array([r.centre for r in rows], dtype=np.float64)


def _keyed(df: DataFrame, within_recording: bool) -> DataFrame:
    return df if within_recording else df.withColumn("_all", F.lit(0))


def build_clusters(index: DataFrame, within_recording: bool = True, block_rows: int = blocks.RIGHT_BLOCK_ROWS, seed: int = 1) -> ClusterIndex:
    """Cluster index of unit vectors (chunk_id, video_id, ord, start_seconds, end_seconds, vec), for search per recording or over all.

    An empty index gives an empty cluster index. Rows with NaN entries make rings without a bound, which are always met.
    """
    keys = ("video_id",) if within_recording else ("_all",)
    index = _keyed(index.select("chunk_id", "video_id", "ord", "start_seconds", "end_seconds", "vec"), within_recording)
    total = index.count()
    spark = index.sparkSession
    wanted = max(1, min(MAX_CELLS, -(-total // block_rows)))
    finite = F.forall("vec", lambda x: ~F.isnan(x))
    sample = index.filter(finite & (F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, total // SAMPLE_ROWS))) == 0))
    sample = cut_lineage(sample.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")))
    found = KMeans(k=wanted, seed=seed, maxIter=8).fit(sample).clusterCenters() if wanted > 1 and sample.count() > 1 else []
    matrix = np.array(found, dtype=np.float64)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centre array<double>")

    sizes = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = index.withColumn("_d", _distances(matrix, False)("vec")).join(sizes, list(keys))
    whole = (F.col("_n") <= block_rows) | (F.size("_d") == 0)
    nearest = F.array_position("_d", F.array_min("_d")).cast("int") - 1
    placed = placed.withColumn("cell", F.when(whole, F.lit(WHOLE)).otherwise(nearest))
    placed = placed.withColumn("_at", F.coalesce(F.get("_d", F.col("cell")), F.lit(0.0))).drop("_n", "_d")
    placed = cut_lineage(placed)

    # Rings of equal width; a cell of one block is one ring.
    cells = placed.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_near"), F.max("_at").alias("_far"))
    cells = cells.withColumn("_rings", F.least(F.lit(RINGS), F.ceil(F.col("_n") / block_rows)).cast("int"))
    width = (F.col("_far") - F.col("_near")) / F.col("_rings")
    ring = F.when(width > 0, F.least(F.col("_rings") - 1, F.floor((F.col("_at") - F.col("_near")) / width).cast("int"))).otherwise(0)
    ringed = placed.join(cells, [*keys, "cell"]).withColumn("ring", F.coalesce(ring, F.lit(0))).drop("_n", "_near", "_far", "_rings")
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rings = ringed.groupBy(*keys, "cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("near"), F.max("_at").alias("far"), F.max(square).alias("square")
    )
    unbounded = F.col("cell") == WHOLE
    rings = rings.withColumn("far", F.when(unbounded, F.lit(float("inf"))).otherwise(F.col("far"))).withColumn(
        "parts", F.ceil(F.col("n") / block_rows).cast("int")
    )
    rings = cut_lineage(rings)
    parts = rings.select(*keys, "cell", "ring", "parts")
    rows = ringed.join(parts, [*keys, "cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.col("parts").cast("long")).cast("int"))
    return ClusterIndex(rows.drop("parts", "_at"), rings, centres, keys)


def save_clusters(index: ClusterIndex, path: str, buckets: int = 64) -> None:
    """Write rows, rings and centres under ``path``; centres come last and existing output is refused."""
    store.write_table(index.rows, f"{path}/rows", buckets)
    index.rings.write.mode("errorifexists").parquet(f"{path}/rings")
    index.centres.write.mode("errorifexists").parquet(f"{path}/centres")


def load_clusters(spark: SparkSession, path: str) -> ClusterIndex:
    rings = spark.read.parquet(f"{path}/rings")
    keys = ("_all",) if "_all" in rings.columns else ("video_id",)
    return ClusterIndex(store.load_index(spark, f"{path}/rows"), rings, spark.read.parquet(f"{path}/centres"), keys)


def _asked(queries: DataFrame, index: ClusterIndex, query_id: str) -> DataFrame:
    """Queries with their distances to all centres."""
    within = index.keys == ("video_id",)
    # New column identities: queries may be derived from the index rows they are later grouped with.
    names = [query_id, *(["video_id"] if within else []), "vec"]
    asked = _keyed(queries.select(*[F.col(c).alias(c) for c in names]), within)
    return cut_lineage(asked.withColumn("_d", _distances(_centre_matrix(index.centres), True)("vec")))


def _with_rings(asked: DataFrame, index: ClusterIndex, k: int) -> DataFrame:
    """Adds ``_rings``, nearest first with an upper bound of their scores, and ``_first`` (see ``pruned``).

    A key has at most (MAX_CELLS + 1) * RINGS rings, so the array in a row is bounded.
    """
    packed = index.rings.groupBy(*index.keys).agg(F.collect_list(F.struct("cell", "ring", "parts", "n", "near", "far", "square", "at")).alias("_rings"))

    def bounded(r: Column) -> Column:
        d = F.coalesce(F.get("_d", r["cell"]), F.lit(0.0))
        gap = F.greatest(F.lit(0.0), d - r["far"] - DISTANCE_SLACK, r["near"] - d - DISTANCE_SLACK)
        upper = (1.0 + r["square"] - gap * gap) / 2
        return F.struct(gap.alias("gap"), d.alias("d"), r["cell"].alias("cell"), r["ring"].alias("ring"), r["parts"].alias("parts"), r["n"].alias("n"), upper.alias("upper"), r["at"].alias("at"))

    near = asked.join(packed, list(index.keys)).withColumn("_rings", F.array_sort(F.transform("_rings", bounded)))
    return pruned.with_first(near, k)


def _carry(index: ClusterIndex) -> list[str]:
    return ["start_seconds", "end_seconds", *([] if index.keys == ("video_id",) else ["video_id"])]


def _tiled(index: ClusterIndex) -> ClusterIndex:
    """The index with the tiles its blocks travel in."""
    rings = cut_lineage(pruned.placed(index.rings, index.keys))
    return index._replace(rows=pruned.in_tiles(index.rows, rings, index.keys), rings=rings)


def _search(index: ClusterIndex, k: int, query_id: str, left_rows: int) -> tuple:
    """What ``pruned`` takes after the queries."""
    listed = lambda asked: _with_rings(asked, index, k)
    return listed, index.rows, list(index.keys), query_id, "chunk_id", ["ord"], _carry(index), ["vec"], _cosine_block, k, left_rows, SCORE_SLACK


def pruned_top_k(queries: DataFrame, index: ClusterIndex, k: int, query_id: str = "qa_uid", left_rows: int = blocks.LEFT_BLOCK_ROWS) -> DataFrame:
    """Best ``k`` chunks per query by cosine, equal to ``vectorsearch.cosine_top_k`` over the same rows; ties go to the lower ``ord``."""
    hits = pruned.pruned_best(_asked(queries, index, query_id), *_search(_tiled(index), k, query_id, left_rows))
    return hits.select(query_id, "video_id", "rank", "chunk_id", "start_seconds", "end_seconds", "score", F.lit("visual").alias("source"))


def pruning_report(queries: DataFrame, index: ClusterIndex, k: int, query_id: str = "qa_uid", left_rows: int = blocks.LEFT_BLOCK_ROWS) -> DataFrame:
    """One row: meetings of a query with a block in the search over all blocks, and those the bounds leave."""
    index, asked = _tiled(index), _asked(queries, index, query_id)
    met = pruned.meetings(asked, *_search(index, k, query_id, left_rows))
    every = _with_rings(asked, index, k).select(F.explode("_rings").alias("_ring")).agg(F.coalesce(F.sum("_ring.parts"), F.lit(0)).alias("all_meetings"))
    return every.join(met, how="full_outer", on=F.lit(True))
