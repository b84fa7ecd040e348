"""Operator inputs derived from the given tables, in Spark and in SQL. All rows are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators.normalize import DESCRIPTION_TYPE
from spanlens.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Windows and clips are made and sorted in the task of their recording: seconds of all recordings of a task, a million windows at a stride of 20.
TASK_SECONDS = 20_000_000


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recordings whose duration in seconds is their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    seconds = docs.agg(F.sum("n_chars")).first()[0] or 0
    return spread(docs, "doc_id", least=int(seconds // TASK_SECONDS)).select(F.col("doc_id").alias("video_id"), F.col("n_chars").cast("double").alias("duration_seconds"))


# Question texts of every kind of time expression, from the events table.
QUESTION_SQL = """
SELECT event_id AS qa_uid, event_id // 100 AS video_id, event_id AS ord, event_type, value, event_id % 6 AS k,
       event_id % 86400 AS s
FROM events"""


def _clock(seconds: str, div: str, pad: str) -> str:
    return f"CAST({div.format(a=seconds, b=3600)} AS STRING) || ':' || {pad.format(x=div.format(a=f'({seconds} % 3600)', b=60))} || ':' || {pad.format(x=f'({seconds} % 60)')}"


SPARK_DIV, SPARK_PAD = "({a} div {b})", "lpad(CAST({x} AS STRING), 2, '0')"
DUCK_DIV, DUCK_PAD = "({a} // {b})", "lpad(CAST({x} AS VARCHAR), 2, '0')"


def question_text(div: str, pad: str, s: str = "s", k: str = "k") -> str:
    """SQL text of a question; the same template serves both dialects."""
    start, end = _clock(s, div, pad), _clock(f"({s} + 90)", div, pad)
    string = "STRING" if div == SPARK_DIV else "VARCHAR"
    text = (
        f"CASE {k} WHEN 0 THEN 'What happened from ' || {start} || ' to ' || {end} || '?' "
        f"WHEN 1 THEN 'Which tool is seen around ' || {start} || ' then?' "
        f"WHEN 2 THEN 'Which phase begins after the grasping of tissue?' "
        f"WHEN 3 THEN 'What is visible between second ' || CAST({s} AS STRING) || ' and second ' || CAST({s} + 45 AS STRING) || ' before cutting?' "
        f"WHEN 4 THEN 'Which Grasp-Phase follows, near ' || CAST({s} AS STRING) || '.5 or so?' "
        f"ELSE 'Does the view phase show tool ' || CAST({s} % 7 AS STRING) || '?' END"
    )
    return text.replace("AS STRING", f"AS {string}")


def time_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per event: clock range, clock point, no time, second range, second point, no time.

    Recordings are runs of 100 events. Phase questions carry options and an answer; every fifth
    question also has an older wording that states a clock range.
    """
    e = spread(table(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").alias("qa_uid"),
        F.expr("event_id div 100").alias("video_id"),
        F.col("event_id").alias("ord"),
        "event_type",
        "value",
        F.expr("event_id % 6").alias("k"),
        F.expr("event_id % 86400").alias("s"),
    )
    older = F.expr("CASE WHEN qa_uid % 5 = 0 THEN map('question_original', " + older_text(SPARK_DIV, SPARK_PAD) + ") ELSE CAST(map() AS map<string,string>) END")
    return e.withColumn("question", F.expr(question_text(SPARK_DIV, SPARK_PAD))).select(
        "qa_uid",
        "video_id",
        "ord",
        "question",
        F.expr("CASE WHEN k IN (0, 3) THEN 'Action Recognition' WHEN qa_uid % 4 = 0 THEN NULL ELSE event_type END").alias("task_name"),
        F.expr("CASE WHEN qa_uid % 2 = 0 THEN 'b' ELSE 'A' END").alias("answer"),
        F.expr("array('A. ' || event_type || ' phase', 'B) Grasp Phase')").alias("options"),
        older.alias("metadata"),
    )


def older_text(div: str, pad: str, s: str = "s") -> str:
    start, end = _clock(s, div, pad), _clock(f"({s} + 30)", div, pad)
    text = f"'Seen during ' || {start} || ' - ' || {end}"
    return text if div == SPARK_DIV else text.replace("AS STRING", "AS VARCHAR")


TIME_QUESTIONS_SQL = f"""
SELECT qa_uid, video_id, ord, {question_text(DUCK_DIV, DUCK_PAD)} AS question,
       CASE WHEN k IN (0, 3) THEN 'Action Recognition' WHEN qa_uid % 4 = 0 THEN NULL ELSE event_type END AS task_name,
       CASE WHEN qa_uid % 2 = 0 THEN 'b' ELSE 'A' END AS answer, event_type,
       CASE WHEN qa_uid % 5 = 0 THEN {older_text(DUCK_DIV, DUCK_PAD)} END AS older
FROM ({QUESTION_SQL})"""


# Clip descriptions from events: recordings are runs of 100 events, wording changes every few clips so
# that neighbours often agree.
_ANATOMY = ["reddish tissue", "tubular structure", "blood vessel", "membranous layer", "tissue surface", "dark cavity wall"]
_TOOLS = ["metal forceps", "grasper", "needle-like instrument", "scissors", "suction tube", "probe", "metal tool"]
_OBJECTS = ["blue thread-like material", "white mesh", "clip", "red fluid pool", "gloved hand", "small white square object", "plastic device"]
_ACTIONS = {
    "click": "grasps and pulls",
    "view": "passes through tissue",
    "purchase": "tightens",
    "signup": "holds",
    "error": "unclear motion",
}


def _pick(values: list[str], index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


def _clip_columns(div: str) -> dict[str, str]:
    group = div.format(a="event_id", b=3)
    pair = div.format(a="event_id", b=6)
    action = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items()) + " ELSE 'unclear motion' END"
    target = f"CASE WHEN event_id % 4 = 0 THEN 'thread-like material' ELSE {_pick(_ANATOMY, f'{group} % 6')} END"
    return {
        "clip_id": "'c' || CAST(event_id AS STRING)",
        "video_id": f"CAST({div.format(a='event_id', b=100)} AS STRING)",
        "clip_index": "event_id % 100",
        "start_seconds": "CAST(64 * (event_id % 100) AS DOUBLE) + CASE WHEN event_id % 37 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        "end_seconds": "CAST(64 * (event_id % 100 + 1) AS DOUBLE)",
        "anatomy": _pick(_ANATOMY, f"{group} % 6"),
        "tool": _pick(_TOOLS, f"{group} % 7"),
        "object": f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE {_pick(_OBJECTS, f'{pair} % 7')} END",
        "subject": f"CASE WHEN event_id % 5 = 0 THEN 'blue thread' ELSE {_pick(_TOOLS, f'{group} % 7')} END",
        "action": action,
        "target": target,
        "summary": f"'A tool ' || {action} || ' near ' || {target} || CASE WHEN event_id % 13 = 0 THEN ', possibly during repair' ELSE '' END",
    }


CLIPS_SQL = (
    "SELECT event_id, "
    + ", ".join(f"{v.replace('AS STRING', 'AS VARCHAR')} AS {k}" for k, v in _clip_columns(DUCK_DIV).items())
    + " FROM events"
)


def clip_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One described clip per event."""
    flat = spread(table(spark, sf_dir, "events"), "event_id").selectExpr("event_id", *[f"{v} AS {k}" for k, v in _clip_columns(SPARK_DIV).items()])
    description = f"""CAST(named_struct(
        'summary', summary,
        'observed_facts', named_struct(
            'visible_anatomy', array(anatomy, 'smooth tissue'),
            'visible_instruments', array(tool),
            'visible_objects', CASE WHEN object IS NULL THEN CAST(array() AS array<string>) ELSE array(object) END,
            'actions', array(named_struct('subject', subject, 'action', action, 'target', target)),
            'state_changes', CAST(array() AS array<string>),
            'visual_evidence', array(summary)),
        'medical_inferences', CASE WHEN event_id % 3 = 0 THEN array(named_struct('inference', 'i', 'basis', 'b', 'confidence', 'low'))
            ELSE array() END,
        'uncertainties', array()) AS {DESCRIPTION_TYPE})"""
    return flat.select("clip_id", "video_id", "clip_index", "start_seconds", "end_seconds", F.expr(description).alias("description"))
