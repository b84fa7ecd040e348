"""Frame inventories: which listed frame files exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files under a folder; the content column is pruned, so no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def manifest_frames(manifest: DataFrame) -> DataFrame:
    """(video_id, clip_id, frame_paths) from manifests that nest clips in one record per recording."""
    return manifest.select("video_id", F.explode("clips").alias("c")).select(
        "video_id", F.col("c.id").alias("clip_id"), F.col("c.frame_paths").alias("frame_paths")
    )


def listed_frames(chunks: DataFrame, chunk_id: str = "chunk_id", paths: str = "frame_paths") -> DataFrame:
    """One row per listed frame with its position."""
    return chunks.select("video_id", chunk_id, F.posexplode(paths).alias("position", "path"))


def keep_existing_frames(
    chunks: DataFrame, inventory: DataFrame, chunk_id: str = "chunk_id", paths: str = "frame_paths"
) -> tuple[DataFrame, DataFrame]:
    """Chunks with only their existing frames, and an audit row for each chunk that has none left."""
    known = inventory.select("path").distinct()
    found = (
        listed_frames(chunks, chunk_id, paths)
        .join(known, "path", "left_semi")
        .groupBy("video_id", chunk_id)
        .agg(F.array_sort(F.collect_list(F.struct("position", "path"))).alias("_found"))
        .select("video_id", chunk_id, F.col("_found.path").alias("_existing"))
    )
    judged = chunks.join(found, ["video_id", chunk_id], "left")
    kept = judged.filter(F.col("_existing").isNotNull()).withColumn(paths, F.col("_existing")).drop("_existing")
    audit = judged.filter(F.col("_existing").isNull()).select(
        chunk_id, "video_id", F.lit("no_existing_decodable_frames").alias("reason")
    )
    return kept, audit


def missing_frames(chunks: DataFrame, inventory: DataFrame, chunk_id: str = "chunk_id", paths: str = "frame_paths") -> DataFrame:
    """Listed frames that do not exist."""
    return listed_frames(chunks, chunk_id, paths).join(inventory.select("path").distinct(), "path", "left_anti")


def cache_complete(clips: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per recording: does every clip list as many frames as planned, all of them existing?"""
    known = inventory.select("path").distinct().withColumn("_there", F.lit(1))
    frames = (
        listed_frames(clips, "clip_id")
        .join(known, "path", "left")
        .groupBy("video_id", "clip_id")
        .agg(F.count_if(F.col("_there").isNull()).alias("_absent"))
    )
    judged = clips.join(frames, ["video_id", "clip_id"], "left")
    ok = (F.size("frame_paths") == F.col("sampled_frame_count")) & (F.coalesce("_absent", F.lit(0)) == 0)
    return judged.groupBy("video_id").agg(F.bool_and(ok).alias("complete"))


def positional_regroup(frames: DataFrame, group_size: int, order: str = "position") -> DataFrame:
    """Slot (chunk_index, sample_index) of the k-th frame of a recording; ``position`` counts from 0."""
    k = F.col(order)
    return frames.withColumn("chunk_index", F.floor(k / group_size).cast("long")).withColumn(
        "sample_index", (k % group_size).cast("int")
    )


def regroup_into_chunks(frames: DataFrame, chunk_counts: DataFrame, group_size: int) -> DataFrame:
    """Frame lists per chunk from consecutive frames; frames beyond the last chunk are dropped."""
    slots = positional_regroup(frames, group_size).join(chunk_counts, "video_id")
    return (
        slots.filter(F.col("chunk_index") < F.col("chunk_count"))
        .groupBy("video_id", "chunk_index")
        .agg(F.array_sort(F.collect_list(F.struct("sample_index", "path"))).alias("_f"))
        .select("video_id", "chunk_index", F.col("_f.path").alias("frame_paths"))
    )


def decoder_choice(primary: DataFrame, fallback: DataFrame, expected: int, threshold: float | None) -> DataFrame:
    """Per recording the decoder to keep, by its share of incomplete chunks.

    The fallback is tried from ``threshold`` on and kept only if its share is strictly lower. Both
    tables hold (video_id, chunk_id, frame_paths).
    """

    def share(df: DataFrame, name: str) -> DataFrame:
        bad = (F.size("frame_paths") < max(1, expected)).cast("int")
        return df.groupBy("video_id").agg((F.sum(bad) / F.count(F.lit(1))).alias(name))

    both = share(primary, "primary_ratio").join(share(fallback, "fallback_ratio"), "video_id", "left")
    tried = F.lit(False) if threshold is None else F.col("primary_ratio") >= threshold
    taken = F.coalesce(tried & (F.col("fallback_ratio") < F.col("primary_ratio")), F.lit(False))
    return both.select(
        "video_id",
        F.when(taken, "fallback").otherwise("primary").alias("decoder"),
        F.when(taken, F.col("fallback_ratio")).otherwise(F.col("primary_ratio")).alias("incomplete_ratio"),
    )


def decode_summary(plans: DataFrame, primary: DataFrame, fallback: DataFrame, threshold: float | None) -> DataFrame:
    """Per recording: decoded frames, incomplete ratio and duration drift for fixed-rate extraction.

    ``plans`` has (video_id, expected_frames, duration_seconds, annotation_duration_seconds); here the
    fallback wins if it decoded *more* frames.
    """

    def decoded(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("video_id").agg(F.sum(F.size("frame_paths")).cast("long").alias(name))

    rows = plans.join(decoded(primary, "_p"), "video_id", "left").join(decoded(fallback, "_f"), "video_id", "left")
    rows = rows.withColumn("_p", F.coalesce("_p", F.lit(0))).withColumn("_f", F.coalesce("_f", F.lit(0)))
    expected = F.col("expected_frames")
    tried = F.lit(False) if threshold is None else (expected - F.col("_p")) / expected >= threshold
    taken = tried & (F.col("_f") > F.col("_p"))
    kept = F.when(taken, F.col("_f")).otherwise(F.col("_p"))
    return rows.select(
        "video_id",
        F.when(taken, "fallback").otherwise("primary").alias("decoder"),
        kept.alias("decoded_sampled_frames"),
        ((expected - kept) / expected).alias("incomplete_ratio"),
        (F.col("duration_seconds") - F.col("annotation_duration_seconds")).alias("duration_delta_seconds"),
    )
