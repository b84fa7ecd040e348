"""Time expressions in question texts and evidence recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.catalog import query
from spanlens.catalog.inputs import TIME_QUESTIONS_SQL, table, time_questions
from spanlens.functions import timetext
from spanlens.operators import evidence, metrics
from spanlens.session import cut_lineage

# Checked with patterns written out for the SQL side; the engine is RE2 there.
_RC = r"(?i)(?:from|between|spanning|during|interval|at)\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*(?:to|and|-)\s*(\d{1,2}:\d{2}(?::\d{2})?)"
_RS = r"(?i)(?:from|between|spanning|during|interval|at)\s+(?:second(?:s)?\s*)?(\d+(?:\.\d+)?)\s*(?:to|and|-)\s*(?:second(?:s)?\s*)?(\d+(?:\.\d+)?)"
_PC = r"(?i)(?:around|near|about|at)\s+(\d{1,2}:\d{2}(?::\d{2})?)"
_PS = r"(?i)(?:around|near|about|at)\s+(?:second(?:s)?\s*)?(\d+(?:\.\d+)?)"


def _sec(code: str) -> str:
    return (
        f"CASE len(string_split({code}, ':')) WHEN 2 THEN CAST(string_split({code}, ':')[1] AS DOUBLE) * 60 + CAST(string_split({code}, ':')[2] AS DOUBLE) "
        f"WHEN 3 THEN CAST(string_split({code}, ':')[1] AS DOUBLE) * 3600 + CAST(string_split({code}, ':')[2] AS DOUBLE) * 60 + CAST(string_split({code}, ':')[3] AS DOUBLE) END"
    )


def spans_sql(base: str, text: str) -> str:
    """Adds a, b, kind of the first stated span of ``text``."""
    x = lambda p, g: f"nullif(regexp_extract({text}, '{p}', {g}), '')"
    return f"""SELECT *, CASE WHEN rb >= ra THEN ra WHEN sb >= sa THEN sa ELSE coalesce(pa, qa) END AS a,
    CASE WHEN rb >= ra THEN rb WHEN sb >= sa THEN sb ELSE coalesce(pa, qa) END AS b,
    CASE WHEN rb >= ra OR sb >= sa THEN 'range' WHEN coalesce(pa, qa) IS NOT NULL THEN 'point' END AS kind FROM (
      SELECT *, {_sec('rc1')} AS ra, {_sec('rc2')} AS rb, CAST(rs1 AS DOUBLE) AS sa, CAST(rs2 AS DOUBLE) AS sb, {_sec('pc1')} AS pa, CAST(ps1 AS DOUBLE) AS qa
      FROM (SELECT *, {x(_RC, 1)} AS rc1, {x(_RC, 2)} AS rc2, {x(_RS, 1)} AS rs1, {x(_RS, 2)} AS rs2, {x(_PC, 1)} AS pc1, {x(_PS, 1)} AS ps1 FROM ({base})))"""


_INNER = "ra, rb, sa, sb, pa, qa, rc1, rc2, rs1, rs2, pc1, ps1"
STATED_SQL = f"""SELECT *, CASE WHEN kind IS NOT NULL THEN 'question' WHEN kind2 IS NOT NULL THEN 'question_original' END AS field,
  coalesce(kind, kind2) AS k, CASE WHEN kind IS NOT NULL THEN a ELSE a2 END AS s, CASE WHEN kind IS NOT NULL THEN b ELSE b2 END AS e FROM (
  SELECT q.* EXCLUDE ({_INNER}), o.a AS a2, o.b AS b2, o.kind AS kind2 FROM ({spans_sql(TIME_QUESTIONS_SQL, 'question')}) q
  JOIN (SELECT qa_uid, a, b, kind FROM ({spans_sql(TIME_QUESTIONS_SQL, 'older')})) o USING (qa_uid))"""


@query("stated_spans", f"SELECT qa_uid, video_id, field, s AS start_seconds, e AS end_seconds, k AS kind FROM ({STATED_SQL})")
def stated_spans(spark, sf_dir):
    out = evidence.with_stated_span(time_questions(spark, sf_dir))
    return out.select(
        "qa_uid",
        "video_id",
        F.col("stated.field").alias("field"),
        *[F.col(f"stated.span.{c}").alias(c) for c in ("start_seconds", "end_seconds", "kind")],
    )


_STRIP = (
    r"regexp_replace(regexp_replace(regexp_replace(question, '\s+from\s+\d{1,2}:\d{2}(?::\d{2})?\s+to\s+\d{1,2}:\d{2}(?::\d{2})?', '', 'gi'), "
    r"'\s+from\s+second\s+\d+(?:\.\d+)?\s+to\s+second\s+\d+(?:\.\d+)?', '', 'gi'), "
    r"'\s+(?:between|during)\s+\d{1,2}:\d{2}(?::\d{2})?\s+(?:and|to|-)\s+\d{1,2}:\d{2}(?::\d{2})?', '', 'gi')"
)
_TIDY = rf"trim(regexp_replace(regexp_replace({_STRIP}, '\s+([;,?.!])', '\1', 'g'), '\s{{2,}}', ' ', 'g'))"


@query(
    "stripped_questions",
    rf"""SELECT qa_uid, stripped, regexp_matches(stripped, '(?i)\b(?:onset|begins?|transition|opening moments?)\b') AS onset,
        CASE WHEN regexp_matches(lower(question), '\b(?:after|following)\b') THEN 'after' WHEN regexp_matches(lower(question), '\b(?:before|prior to|preceding)\b') THEN 'before'
             WHEN regexp_matches(lower(question), '\b(?:then|followed by|sequence|order)\b') THEN 'sequence' END AS relation
        FROM (SELECT qa_uid, question, {_TIDY} AS stripped FROM ({TIME_QUESTIONS_SQL}))""",
)
def stripped_questions(spark, sf_dir):
    q = time_questions(spark, sf_dir).withColumn("stripped", timetext.strip_time_range(F.col("question")))
    return q.select(
        "qa_uid",
        "stripped",
        timetext.is_onset_question(F.col("stripped")).alias("onset"),
        timetext.temporal_relation(F.lower("question")).alias("relation"),
    )


@query(
    "leaking_questions",
    f"SELECT qa_uid, stripped FROM ({spans_sql(f'SELECT qa_uid, {_TIDY} AS stripped FROM ({TIME_QUESTIONS_SQL})', 'stripped')}) WHERE kind IS NOT NULL",
)
def leaking_questions(spark, sf_dir):
    return evidence.leaking_questions(time_questions(spark, sf_dir)).select("qa_uid", "stripped")


# The option texts are "A. <event_type> phase" and "B) Grasp Phase".
_FOLD = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
_PHASES = f"""SELECT video_id, ord, s, e, {_FOLD.format(x="CASE lower(answer) WHEN 'a' THEN event_type || ' phase' ELSE 'Grasp Phase' END")} AS phase_key
  FROM ({STATED_SQL}) WHERE task_name = 'Action Recognition' AND k = 'range'"""
_TEXTS = f"""SELECT video_id, qa_uid, {_FOLD.format(x="question || ' ' || coalesce(older, '')")} AS folded FROM ({STATED_SQL}) WHERE k IS NULL"""
_ANCHORS = f"""SELECT t.video_id, t.qa_uid, p.phase_key, p.windows, p.first_seen FROM ({_TEXTS}) t
  JOIN (SELECT video_id, phase_key, count(*) AS windows, min(ord) AS first_seen FROM ({_PHASES}) WHERE length(phase_key) >= 4 GROUP BY 1, 2) p
  ON p.video_id = t.video_id AND contains(t.folded, p.phase_key)"""
EVIDENCE_SQL = f"""SELECT q.video_id, q.qa_uid, q.task_name, q.question, q.older,
  CASE WHEN k IS NOT NULL THEN 'direct_' || k WHEN n IS NOT NULL THEN 'phase_anchor' ELSE 'unresolved' END AS method,
  CASE WHEN k IS NOT NULL THEN 'high' WHEN n IS NOT NULL THEN 'weak' ELSE 'none' END AS confidence, s AS start_seconds, e AS end_seconds,
  CASE WHEN k IS NOT NULL THEN field END AS source_field, CASE WHEN k IS NULL THEN phase END AS phase,
  CASE WHEN k IS NULL THEN coalesce(n, 0) ELSE 0 END AS candidate_count
  FROM ({STATED_SQL}) q LEFT JOIN (SELECT video_id, qa_uid, CAST(sum(windows) AS BIGINT) AS n, string_agg(phase_key, ', ' ORDER BY phase_key) AS phase
  FROM ({_ANCHORS}) GROUP BY 1, 2) a ON a.video_id = q.video_id AND a.qa_uid = q.qa_uid"""


@query(
    "recovered_evidence",
    f"SELECT video_id, qa_uid, task_name, method, confidence, start_seconds, end_seconds, source_field, phase, candidate_count FROM ({EVIDENCE_SQL})",
)
def recovered_evidence(spark, sf_dir):
    out = evidence.recover_evidence(time_questions(spark, sf_dir))
    first = F.try_element_at("windows", F.lit(1))
    return out.select(
        "video_id", "qa_uid", "task_name", "method", "confidence", first["start_seconds"].alias("start_seconds"),
        first["end_seconds"].alias("end_seconds"), "source_field", "phase", "candidate_count",
    )


@query(
    "phase_anchor_windows",
    f"""SELECT a.video_id, a.qa_uid, a.phase_key, a.first_seen, p.ord AS window_ord, p.s AS start_seconds, p.e AS end_seconds
        FROM ({_ANCHORS}) a JOIN ({_PHASES}) p ON p.video_id = a.video_id AND p.phase_key = a.phase_key""",
)
def phase_anchor_windows(spark, sf_dir):
    stated = evidence.with_stated_span(time_questions(spark, sf_dir))
    spans = evidence.phase_windows(stated)
    out = evidence.anchor_windows(evidence.phase_anchors(stated, spans), spans)
    return out.select("video_id", "qa_uid", "phase_key", "first_seen", "window_ord", "start_seconds", "end_seconds")


@query(
    "recovery_report",
    f"""SELECT method, confidence, task_name, count(*) AS questions, count(*) FILTER (method <> 'unresolved') AS recovered_any,
        count(*) FILTER (confidence = 'high') AS recovered_high_confidence, count(*) FILTER (confidence = 'weak') AS recovered_weak_anchor,
        count(*) FILTER (method = 'unresolved') AS unresolved FROM (SELECT method, confidence, coalesce(task_name, 'unknown') AS task_name FROM ({EVIDENCE_SQL}))
        GROUP BY GROUPING SETS ((), (method), (confidence), (task_name, method))""",
)
def recovery_report(spark, sf_dir):
    return evidence.recovery_report(evidence.recover_evidence(time_questions(spark, sf_dir)))


@query(
    "query_texts",
    f"""SELECT qa_uid, source_field, CASE WHEN source_field = 'question' THEN question ELSE older END AS query_text,
        source_field <> 'question' AS time_missing FROM ({EVIDENCE_SQL}) WHERE method IN ('direct_range', 'direct_point')""",
)
def query_texts(spark, sf_dir):
    q = time_questions(spark, sf_dir)
    # Read twice, and reading time out of texts is the dear part.
    direct = cut_lineage(evidence.direct_subset(evidence.recover_evidence(q)))
    out = evidence.with_query_text(direct, q, "evidence_source")
    missing = evidence.direct_subset(direct, only_missing_from_question=True).select("qa_uid", F.lit(True).alias("time_missing"))
    return out.join(missing, "qa_uid", "left").select("qa_uid", "source_field", "query_text", F.coalesce("time_missing", F.lit(False)).alias("time_missing"))


@query(
    "protocol_partitions",
    f"""SELECT CASE WHEN method LIKE 'direct%' AND source_field = 'question' THEN 'explicit_time' WHEN method LIKE 'direct%' THEN 'implicit_time'
        ELSE 'no_reliable_time' END AS partition, count(*) AS questions FROM ({EVIDENCE_SQL}) GROUP BY 1""",
)
def protocol_partitions(spark, sf_dir):
    e = evidence.recover_evidence(time_questions(spark, sf_dir))
    part = metrics.protocol_partition(F.col("method"), F.col("source_field"))
    return e.groupBy(part.alias("partition")).agg(F.count(F.lit(1)).alias("questions"))


@query(
    "report_compatibility",
    f"""SELECT name, n AS expected_direct_time_questions, r AS reported_direct_time_questions, n = r AS matches_current_protocol,
        CASE WHEN n <> r THEN 'report_from_other_evidence_version' END AS warning
        FROM (SELECT count(*) FILTER (method LIKE 'direct%') AS n FROM ({EVIDENCE_SQL})),
             (SELECT event_type AS name, count(*) AS r FROM events GROUP BY 1)""",
)
def report_compatibility(spark, sf_dir):
    reports = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("name"))
        .agg(F.count_if(F.col("value") >= 10).alias("direct_range_questions"), F.count_if(~(F.col("value") >= 10)).alias("direct_point_questions"))
    )
    return metrics.compatibility(reports, evidence.recover_evidence(time_questions(spark, sf_dir)))
