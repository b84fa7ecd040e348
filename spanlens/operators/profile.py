"""Profile of an annotation set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions.numeric import exact_round, ratio


def known(column: str):
    """Null and empty values count as ``unknown``."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def recording_report(recordings: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: recordings, durations and questions per recording."""
    d = F.col("duration_seconds").cast("double")
    videos = recordings.agg(
        F.count(F.lit(1)).alias("videos"),
        F.count(d).alias("with_duration"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("total_duration_seconds"),
        F.avg(d).alias("average_duration_seconds"),
    ).withColumn("_one", F.lit(1))
    asked = questions.agg(F.count(F.lit(1)).alias("questions")).withColumn("_one", F.lit(1))
    both = videos.join(asked, "_one").drop("_one")
    both = both.withColumn("questions_per_video", ratio(F.col("questions"), F.col("videos")))
    rounded = {"total_duration_seconds", "average_duration_seconds", "questions_per_video"}
    return both.select(*[exact_round(c, 3).alias(c) if c in rounded else F.col(c) for c in both.columns])


def category_counts(questions: DataFrame, columns=("task_name", "task_class", "category")) -> DataFrame:
    """Question counts per value of each column, in one pass over the table."""
    rows = questions.select(*[known(c).alias(c) for c in columns])
    sets = rows.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("questions"))
    return sets.select(
        F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]).alias("dimension"),
        F.coalesce(*columns).alias("value"),
        "questions",
    )


def question_type_counts(questions: DataFrame) -> DataFrame:
    """Counts of question types; if no question has any, one ``unknown`` row with all questions."""
    counts = questions.select(F.explode_outer("question_type").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    # One row per type remains here; the null row only counts when it is the only one.
    typed = counts.agg(F.count("t").alias("_typed")).withColumn("_one", F.lit(1))
    joined = counts.withColumn("_one", F.lit(1)).join(typed, "_one")
    return joined.filter(F.col("t").isNotNull() | (F.col("_typed") == 0)).select(
        F.coalesce("t", F.lit("unknown")).alias("question_type"), F.col("n").alias("questions")
    )
