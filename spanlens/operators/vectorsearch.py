"""Vector pooling, index building and exact cosine search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions import vectors
from spanlens.plans import blocks

# Scores closer than this many decimals are ties and fall back to the index order.
SCORE_DIGITS = 9


def pool_chunks(frames: DataFrame, chunk_id: str = "chunk_id", vector: str = "vec", normalize_first: bool = True) -> DataFrame:
    """Mean frame vector per chunk, scaled to length one.

    The mean is a partial aggregate on whole vectors, so one vector per (chunk, task) is shuffled and
    a chunk with very many frames is summed up where its frames are.
    """
    value = vectors.unit(F.col(vector)) if normalize_first else F.col(vector).cast("array<double>")
    pooled = frames.groupBy(chunk_id).agg(
        Summarizer.mean(array_to_vector(value)).alias("_mean"), F.count(F.lit(1)).alias("frames")
    )
    return pooled.withColumn("_mean", vector_to_array("_mean")).select(
        chunk_id, "frames", vectors.unit(F.col("_mean")).alias(vector)
    )


def build_index(chunks: DataFrame, chunk_vectors: DataFrame, vector: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Index rows with unit vectors, and the chunk ids that do not have exactly one vector."""
    counted = chunk_vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"), F.any_value(vector).alias(vector))
    both = chunks.join(counted, "chunk_id", "full_outer")
    bad = both.filter((F.coalesce("_n", F.lit(0)) != 1) | F.col("video_id").isNull()).select(
        "chunk_id", F.coalesce("_n", F.lit(0)).alias("vectors")
    )
    good = both.filter((F.col("_n") == 1) & F.col("video_id").isNotNull()).drop("_n")
    return good.withColumn(vector, vectors.unit(F.col(vector)).cast("array<float>")), bad


def dimension_report(queries: DataFrame, index: DataFrame, vector: str = "vec") -> DataFrame:
    """Smallest and largest dimension on both sides and whether they agree."""
    sides = queries.select(F.lit("query").alias("side"), F.size(vector).alias("d")).unionByName(
        index.select(F.lit("index").alias("side"), F.size(vector).alias("d"))
    )
    return sides.agg(
        F.min("d").alias("min_dimension"), F.max("d").alias("max_dimension"), (F.min("d") == F.max("d")).alias("dimensions_match")
    )


def _cosine_block(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    queries = np.stack(left["vec"].to_numpy()).astype(np.float64)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), vectors.NORM_FLOOR)
    return np.round(queries @ np.stack(right["vec"].to_numpy()).astype(np.float64).T, SCORE_DIGITS)


def cosine_top_k(
    queries: DataFrame, index: DataFrame, k: int, within_recording: bool = True, query_id: str = "qa_uid", **sizes: int
) -> DataFrame:
    """Best ``k`` chunks per query by cosine; ties go to the lower ``ord``.

    ``queries`` has (video_id, qa_uid, vec) and ``index`` unit vectors with (chunk_id, video_id, ord,
    start_seconds, end_seconds, vec). The search is exact: blocks of both sides are multiplied and only
    the best ``k`` per block travel on.
    """
    carry = ["start_seconds", "end_seconds"]
    right = index.select("chunk_id", "video_id", "ord", *carry, "vec")
    if within_recording:
        left = queries.select(query_id, "video_id", "vec")
        keys = ["video_id"]
    else:
        left = queries.select(query_id, "vec")
        keys = []
        carry = [*carry, "video_id"]
    hits = blocks.blocked_top_k(left, right, keys, query_id, "chunk_id", ["ord"], _cosine_block, k, carry, **sizes)
    return hits.select(query_id, "video_id", "rank", "chunk_id", *carry[:2], "score", F.lit("visual").alias("source"))
