"""Stored tables: vector index and evidence graph.

Tables are laid out by a hash bucket of the recording id, not by the id itself: a directory per
recording would drown the file system, and one recording may hold a third of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators import checks

BUCKET = "video_bucket"


def add_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))


def bucket_of_recording(video_id: str, buckets: int):
    """Partition filter for one recording."""
    return F.col(BUCKET) == F.pmod(F.xxhash64(F.lit(video_id)), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists", order: str | None = None) -> None:
    """Write partitioned by recording bucket; the row-level split keeps one recording in many files."""
    out = add_bucket(df, buckets)
    if order:
        out = out.sortWithinPartitions(BUCKET, "video_id", order)
    out.write.mode(mode).partitionBy(BUCKET).parquet(path)


def save_index(chunk_vectors: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    write_table(chunk_vectors, path, buckets, mode, "ord")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


MANIFEST = "manifest"


def published(spark: SparkSession, path: str) -> str | None:
    """Folder of the published tables under ``path``, nothing before the first publication."""
    try:
        rows = spark.read.schema("folder string").json(f"{path}/{MANIFEST}").collect()  # one row
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return f"{path}/{rows[0].folder}" if rows else None


def write_graph(tables: Mapping[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Write observations, events, nodes, edges, … under one folder, all or nothing; existing output is refused.

    The tables go to a folder of their own name; only after the last one a manifest names that folder, and
    readers follow the manifest. A table that fails leaves the others unnamed, so no reader sees half a graph, and the
    next attempt writes to another folder.
    """
    spark = next(iter(tables.values())).sparkSession
    if published(spark, path) is not None:
        raise FileExistsError(f"a graph exists at {path}")
    folder = f"tables-{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, f"{path}/{folder}/{name}", buckets)
    # One file, renamed into place by the commit of the job; an earlier publication by someone else is refused here.
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")


def load_graph(spark: SparkSession, path: str, names=("nodes", "edges"), check: bool = True) -> dict[str, DataFrame]:
    """Tables of a published graph. With ``check``, a recording whose nodes hold no temporal event is an error."""
    folder = published(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no published graph at {path}")
    out = {name: spark.read.parquet(f"{folder}/{name}").drop(BUCKET) for name in names}
    if check and "node_type" in getattr(out.get("nodes"), "columns", []):
        checks.raise_on_violation(checks.graphs_without_events(out["nodes"]), "graphs without events")
    return out
