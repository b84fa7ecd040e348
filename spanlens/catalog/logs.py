"""Annotation scans, run logs and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.catalog import query
from spanlens.catalog.inputs import table
from spanlens.functions.text import resolve_path, safe_key
from spanlens.operators import checks, profile
from spanlens.sources import logs
from spanlens.sources.annotations import parse_annotation_lines, scan_questions

# One annotation line per event: some broken, some without a key, some questions without a uid.
_LINE = """CASE WHEN event_id % 17 = 0 THEN concat('{"key": "v', event_id, '", "video_path"') WHEN event_id % 19 = 0 THEN concat('{"video_path": "p', event_id, '"}')
  WHEN event_id % 23 = 0 THEN '  ' ELSE concat('{"key": "v', event_id, '", "video_path": "p/', event_id, '.mp4", "fps": 25.5, "num_frames": ', event_id * 3, ', "duration_seconds": ', CASE WHEN event_id % 4 = 0 THEN 'null' ELSE CAST(event_id % 50 AS STRING) END,
  ', "site": "', event_type, '", "qa": [{"uid": ', event_id, ', "question": "What?", "answer": "A", "options": ["A. x", "B. y"], "task_name": "', event_type, '", "category": "", "question_type": ', CASE WHEN event_id % 2 = 0 THEN '["t1", "t2"]' ELSE '"t3"' END, ', "note": "n"}',
  CASE WHEN event_id % 5 = 0 THEN ', {"question": "no uid"}' ELSE '' END, ']}') END"""
_OK = "event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0"


def _annotations(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr("event_id AS source", _LINE + " AS line")
    return parse_annotation_lines(lines, video_root="/data")


@query(
    "annotation_recordings",
    f"SELECT 'v' || event_id AS video_id, 'unknown' AS dataset, '/data/p/' || event_id || '.mp4' AS video_path, event_id * 3 AS num_frames, 25.5::DOUBLE AS fps, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 50 AS DOUBLE) END AS duration_seconds, event_type AS site FROM events WHERE {_OK}",
)
def annotation_recordings(spark, sf_dir):
    r = _annotations(spark, sf_dir).recordings
    return r.select("video_id", "dataset", "video_path", "num_frames", "fps", "duration_seconds", F.col("metadata")["site"].alias("site"))


@query(
    "annotation_questions",
    f"SELECT CAST(event_id AS VARCHAR) AS qa_uid, 'v' || event_id AS video_id, 0 AS qa_position, 'What?' AS question, 'A. x|B. y' AS options, event_type AS task_name, CASE WHEN event_id % 2 = 0 THEN 't1|t2' ELSE 't3' END AS question_type, 'n' AS note FROM events WHERE {_OK}",
)
def annotation_questions(spark, sf_dir):
    q = _annotations(spark, sf_dir).questions
    return q.select(
        "qa_uid", "video_id", "qa_position", "question", F.array_join("options", "|").alias("options"), "task_name", F.array_join("question_type", "|").alias("question_type"),
        F.col("metadata")["note"].alias("note"),
    )


@query(
    "annotation_rejects",
    f"""SELECT event_id AS source, CASE WHEN event_id % 17 = 0 THEN 'invalid_json' ELSE 'missing_key' END AS reason FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0
        UNION ALL SELECT event_id, 'question_without_uid_or_text' FROM events WHERE {_OK} AND event_id % 5 = 0""",
)
def annotation_rejects(spark, sf_dir):
    return _annotations(spark, sf_dir).rejects.select("source", "reason")


@query(
    "recording_report",
    f"""SELECT count(*) AS videos, count(d) AS with_duration, sum(d) AS total_duration_seconds, round(avg(d), 3) AS average_duration_seconds, count(*) AS questions, 1.0::DOUBLE AS questions_per_video
        FROM (SELECT CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 50 AS DOUBLE) END AS d FROM events WHERE {_OK})""",
)
def recording_report(spark, sf_dir):
    a = _annotations(spark, sf_dir)
    return profile.recording_report(a.recordings, a.questions)


@query(
    "category_counts",
    f"""SELECT 'task_name' AS dimension, event_type AS value, count(*) AS questions FROM events WHERE {_OK} GROUP BY 2 UNION ALL SELECT 'task_class', 'unknown', count(*) FROM events WHERE {_OK}
        UNION ALL SELECT 'category', 'unknown', count(*) FROM events WHERE {_OK}""",
)
def category_counts(spark, sf_dir):
    return profile.category_counts(_annotations(spark, sf_dir).questions)


@query(
    "question_type_counts",
    f"SELECT t AS question_type, count(*) AS questions FROM (SELECT unnest(CASE WHEN event_id % 2 = 0 THEN ['t1', 't2'] ELSE ['t3'] END) AS t FROM events WHERE {_OK}) GROUP BY 1",
)
def question_type_counts(spark, sf_dir):
    return profile.question_type_counts(_annotations(spark, sf_dir).questions)


@query("safe_keys", "SELECT page_id, left(CASE WHEN k = '' THEN 'video' ELSE k END, 80) || '_' || left(sha1(url), 10) AS safe_key FROM (SELECT *, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS k FROM pages)")
def safe_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_key(F.col("url")).alias("safe_key"))


@query("resolved_paths", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/abs/' || p_name ELSE '/root/videos/' || p_name END AS path FROM part")
def resolved_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("_p", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/abs/"), "p_name")).otherwise(F.col("p_name")))
    return p.select("p_partkey", resolve_path(F.col("_p"), F.lit("/root/videos/")).alias("path"))


@query("question_scan", "SELECT event_id AS question_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS usable FROM events")
def question_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS question_id", "CASE WHEN event_id % 7 = 0 THEN '' ELSE 'q' END AS question")
    good, bad = scan_questions(rows)
    return good.select(F.col("event_id").alias("question_id"), F.lit(True).alias("usable")).unionByName(bad.select(F.col("event_id").alias("question_id"), F.lit(False).alias("usable")))


# Orders are the work to do; line items are the log of what was done (a zero discount stands for a failed row).
@query("pending_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount <> 0)")
def pending_ids(spark, sf_dir):
    work = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    log = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "CASE WHEN l_discount <> 0 THEN l_discount END AS prediction")
    return logs.pending(work, log)


@query("missing_from_manifest", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_from_manifest(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return logs.missing_from(table(spark, sf_dir, "orders").select("o_orderkey"), known, ["o_orderkey"])


@query("retry_selection", "SELECT DISTINCT event_id % 997 AS video_id FROM events WHERE event_type = 'error' OR (event_type = 'view' AND (event_id % 10) / greatest(1, event_id % 12) >= 0.5)")
def retry_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id % 997 AS video_id", "CASE WHEN event_type = 'error' THEN 'x' END AS error", "CASE event_type WHEN 'view' THEN 'incomplete_frame_decode' WHEN 'click' THEN 'other' END AS warning",
        "event_id % 10 AS incomplete_chunks", "event_id % 12 AS total_chunks",
    )
    return logs.retry_selection(rows, 0.5)


@query(
    "replaced_recordings",
    "SELECT l_orderkey AS video_id, CAST(l_linenumber AS BIGINT) AS row_no FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 3 = 0",
)
def replaced_recordings(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS video_id", "CAST(l_linenumber AS BIGINT) AS row_no")
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS video_id", "CAST(-1 AS BIGINT) AS row_no")
    return logs.replace_recordings(old, new)


@query("outcomes_split", "SELECT event_id, CASE WHEN NOT (value > 10) OR value IS NULL THEN 'low_value' WHEN event_type = 'error' THEN 'error_event' END AS error_type FROM events")
def outcomes_split(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    good, bad = logs.split_outcomes(e, {"low_value": F.col("value") > 10, "error_event": F.col("event_type") != "error"})
    return good.select("event_id", F.lit(None).cast("string").alias("error_type")).unionByName(bad.select("event_id", "error_type"))


@query(
    "run_summary",
    """SELECT (SELECT count(*) FROM orders) AS candidate_questions, d AS completed_before, (SELECT count(*) FROM orders) - d AS scheduled_questions, n AS new_predictions, f AS failed_questions,
       CASE WHEN f > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM (SELECT count(*) AS d FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
       (SELECT count(*) FILTER (event_type <> 'error') AS n, count(*) FILTER (event_type = 'error') AS f FROM events)""",
)
def run_summary(spark, sf_dir):
    work = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    log = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "1 AS prediction")
    e = table(spark, sf_dir, "events")
    return logs.run_summary(work, log, e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"))


@query("duplicate_clip_ids", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_clip_ids(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dangling_edges",
    "SELECT source, target, source AS missing_id FROM (SELECT 's' || l_suppkey AS source, 'o' || l_orderkey AS target FROM lineitem) WHERE source NOT IN (SELECT 's' || s_suppkey FROM supplier) UNION ALL SELECT source, target, target FROM (SELECT 's' || l_suppkey AS source, 'o' || l_orderkey AS target FROM lineitem) WHERE target NOT IN (SELECT 'o' || o_orderkey FROM orders)",
)
def dangling_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr("'all' AS video_id", "concat('s', l_suppkey) AS source", "concat('o', l_orderkey) AS target", "'part_of' AS relation")
    nodes = table(spark, sf_dir, "orders").selectExpr("'all' AS video_id", "concat('o', o_orderkey) AS id").unionByName(table(spark, sf_dir, "supplier").selectExpr("'all' AS video_id", "concat('s', s_suppkey) AS id"))
    return checks.dangling_edges(edges, nodes).select("source", "target", "missing_id")


@query(
    "edge_violations",
    "SELECT CAST(l_orderkey AS VARCHAR) AS target, CASE WHEN l_linenumber = 1 THEN 'unknown_relation' ELSE 'confidence' END AS violations FROM lineitem WHERE l_linenumber = 1 OR l_quantity > 40",
)
def edge_violations(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr(
        "'all' AS video_id", "'s' AS source", "CAST(l_orderkey AS STRING) AS target", "CASE WHEN l_linenumber = 1 THEN 'made_of' ELSE 'uses' END AS relation",
        "CASE WHEN l_linenumber > 1 AND l_quantity > 40 THEN 1.5D ELSE 0.5D END AS confidence", "array(named_struct('video_id', 'all')) AS evidence",
    )
    return checks.edge_violations(edges).select("target", F.array_join("violations", ",").alias("violations"))
