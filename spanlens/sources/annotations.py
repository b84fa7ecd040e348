"""Annotation files: one JSON object per line, a recording with its questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions.text import resolve_path

# The known keys of a record and of a question; all other keys are kept as metadata.
RECORDING_KEYS = (
    "key dataset video_path num_frames fps duration_seconds organ scene_type duration_tier split qa"
).split()
QUESTION_KEYS = "uid question answer options task_id task_name task_class category question_type".split()


@dataclass(frozen=True)
class Annotations:
    recordings: DataFrame
    questions: DataFrame
    rejects: DataFrame


def scan_annotations(spark: SparkSession, path: str, video_root: str | None = None) -> Annotations:
    """Read annotation files; ``source`` names the file of each line."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))
    return parse_annotation_lines(lines, video_root=video_root)


def _rest(record: Column, known: list[str]) -> Column:
    return F.map_filter(record, lambda k, _: ~k.isin(known))


def string_list(value: Column) -> Column:
    """A JSON list stays a list, a scalar becomes a list of one, null becomes an empty list."""
    parsed = F.from_json(value, "array<string>")
    return (
        F.when(value.isNull(), F.array().cast("array<string>"))
        .when(value.startswith("["), F.coalesce(parsed, F.array(value)))
        .otherwise(F.array(value))
    )


def parse_annotation_lines(
    lines: DataFrame, line: str = "line", carry: tuple[str, ...] = ("source",), video_root: str | None = None
) -> Annotations:
    """Split JSON lines into recordings, flattened questions and rejects.

    Blank lines are skipped. A line that is no JSON object, or lacks ``key`` or ``video_path``, and a
    question without ``uid`` or ``question`` end up in ``rejects`` with the reason and the text, so one
    bad line neither stops the job nor disappears.
    """
    carry = tuple(c for c in carry if c in lines.columns)
    record = F.when(
        F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.from_json(line, "map<string,string>")
    )
    parsed = lines.filter(F.trim(line) != "").select(*carry, line, record.alias("_r"))
    has = lambda name: F.map_contains_key("_r", name)
    reason = (
        F.when(F.col("_r").isNull(), F.lit("invalid_json"))
        .when(~has("key"), F.lit("missing_key"))
        .when(~has("video_path"), F.lit("missing_video_path"))
    )
    parsed = parsed.withColumn("_reason", reason)
    good = parsed.filter(F.col("_reason").isNull())
    get = lambda name: F.try_element_at("_r", F.lit(name))
    root = F.lit(video_root) if video_root else None
    recordings = good.select(
        get("key").alias("video_id"),
        F.coalesce(get("dataset"), F.lit("unknown")).alias("dataset"),
        resolve_path(get("video_path"), root).alias("video_path"),
        get("num_frames").try_cast("double").cast("long").alias("num_frames"),
        get("fps").try_cast("double").alias("fps"),
        get("duration_seconds").try_cast("double").alias("duration_seconds"),
        *[get(c).alias(c) for c in ("organ", "scene_type", "duration_tier", "split")],
        _rest(F.col("_r"), RECORDING_KEYS).alias("metadata"),
        *carry,
    )
    asked = good.select(
        *carry,
        line,
        get("key").alias("video_id"),
        resolve_path(get("video_path"), root).alias("video_path"),
        F.posexplode(F.from_json(get("qa"), "array<map<string,string>>")).alias("qa_position", "_q"),
    )
    q_has = lambda name: F.map_contains_key("_q", name)
    complete = F.coalesce(q_has("uid") & q_has("question"), F.lit(False))
    q = lambda name: F.try_element_at("_q", F.lit(name))
    questions = asked.filter(complete).select(
        q("uid").alias("qa_uid"),
        "video_id",
        "video_path",
        "qa_position",
        q("question").alias("question"),
        q("answer").alias("answer"),
        string_list(q("options")).alias("options"),
        *[q(c).alias(c) for c in ("task_id", "task_name", "task_class", "category")],
        string_list(q("question_type")).alias("question_type"),
        _rest(F.col("_q"), QUESTION_KEYS).alias("metadata"),
        *carry,
    )
    rejects = (
        parsed.filter(F.col("_reason").isNotNull())
        .select(*carry, F.col(line).alias("line"), F.col("_reason").alias("reason"))
        .unionByName(
            asked.filter(~complete).select(
                *carry, F.col(line).alias("line"), F.lit("question_without_uid_or_text").alias("reason")
            )
        )
    )
    return Annotations(recordings, questions, rejects)


def scan_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a question table into usable rows and rows without id or question."""
    ok = (F.coalesce(F.col("question_id"), F.lit("")) != "") & (F.coalesce(F.col("question"), F.lit("")) != "")
    return rows.filter(ok), rows.filter(~ok)


def inline_questions(spark: SparkSession, questions: list[str], name: str) -> DataFrame:
    """Question table from a short list; several questions are numbered ``name-000`` and on."""
    ids = [name] if len(questions) == 1 else [f"{name}-{i:03d}" for i in range(len(questions))]
    return spark.createDataFrame(list(zip(ids, questions)), "question_id string, question string")
