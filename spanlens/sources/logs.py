"""Run logs: resume, retry, replace, error isolation, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completed(log: DataFrame, key: str = "id", value: str | None = "prediction") -> DataFrame:
    """Distinct keys that already have a result; rows without a value count as open."""
    done = log.filter(F.col(key).isNotNull())
    if value:
        done = done.filter(F.col(value).isNotNull())
    return done.select(F.col(key).cast("string").alias(key)).distinct()


def pending(candidates: DataFrame, log: DataFrame, key: str = "id", value: str | None = "prediction") -> DataFrame:
    """Candidates still to do."""
    done = completed(log, key, value)
    return candidates.join(done, candidates[key].cast("string") == done[key], "left_anti")


def missing_from(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known elsewhere (completeness and routing checks)."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def retry_selection(errors: DataFrame, minimum_ratio: float) -> DataFrame:
    """Recordings to run again: every hard error, and decode warnings from a given share of bad chunks."""
    share = F.col("incomplete_chunks") / F.greatest(F.lit(1), F.col("total_chunks"))
    hard = F.col("error").isNotNull()
    soft = ~hard & (F.col("warning") == "incomplete_frame_decode") & (share >= minimum_ratio)
    return errors.filter(hard | soft).select("video_id").distinct()


def replace_recordings(existing: DataFrame, replacement: DataFrame) -> DataFrame:
    """Existing rows with whole recordings swapped for their new rows. Write the result to a new path."""
    ids = replacement.select("video_id").distinct()
    return existing.join(ids, "video_id", "left_anti").unionByName(replacement)


def split_outcomes(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows and failed rows; a failed row names the first check it breaks."""
    failure = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    judged = df.withColumn("error_type", failure)
    return judged.filter(F.col("error_type").isNull()).drop("error_type"), judged.filter(F.col("error_type").isNotNull())


def run_summary(candidates: DataFrame, log: DataFrame, new_ok: DataFrame, new_failed: DataFrame, key: str = "id") -> DataFrame:
    """One row: candidate, completed-before, scheduled, new and failed counts with the final status."""
    ids = candidates.select(F.col(key).cast("string").alias(key)).distinct()
    done = completed(log, key).withColumn("_done", F.lit(1))
    flags = ids.join(done, key, "left").select(
        F.lit(1).alias("candidate"), F.coalesce("_done", F.lit(0)).alias("done"), F.lit(0).alias("ok"), F.lit(0).alias("bad")
    )
    zero = [F.lit(0).alias("candidate"), F.lit(0).alias("done")]
    rows = flags.unionByName(new_ok.select(*zero, F.lit(1).alias("ok"), F.lit(0).alias("bad"))).unionByName(
        new_failed.select(*zero, F.lit(0).alias("ok"), F.lit(1).alias("bad"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        total("candidate").alias("candidate_questions"),
        total("done").alias("completed_before"),
        (total("candidate") - total("done")).alias("scheduled_questions"),
        total("ok").alias("new_predictions"),
        total("bad").alias("failed_questions"),
        F.when(total("bad") > 0, "completed_with_failures").otherwise("completed").alias("status"),
    )
