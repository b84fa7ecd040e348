"""Model replies and answer metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlens.catalog import query
from spanlens.catalog.inputs import CLIPS_SQL, clip_descriptions, table, time_questions
from spanlens.catalog.questions import EVIDENCE_SQL
from spanlens.functions import text, vocab
from spanlens.operators import checks, evidence, metrics, responses

_OPTIONS = "['A. ' || event_type, 'plain', 'c) x', ' d9： y']"


def _events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").selectExpr("event_id", *columns)


@query("choice_labels", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'A,B,C,D9' END AS labels, CASE WHEN event_id % 4 <> 0 THEN 'A' END AS prediction, CASE WHEN event_id % 4 = 0 THEN 'options_required' END AS error FROM events")
def choice_labels(spark, sf_dir):
    e = _events(spark, sf_dir, "CASE WHEN event_id % 4 = 0 THEN CAST(array() AS array<string>) ELSE array(concat('A. ', event_type), 'plain', 'c) x', ' d9： y') END AS options")
    out = responses.first_choice(e)
    return out.select("event_id", F.array_join(text.choice_labels(F.col("options")), ",").alias("labels"), "prediction", "error")


_REPLY = """CASE event_id % 6 WHEN 0 THEN '```json\n{"choice": " b ", "rationale": "seen"}\n```' WHEN 1 THEN 'no json here' WHEN 2 THEN '["A"]'
  WHEN 3 THEN '{"rationale": "x"}' WHEN 4 THEN '{"choice": "Z"}' ELSE 'I say {"choice": "a", "k": {"n": 1}} done' END"""


@query(
    "read_choices",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'B' WHEN 5 THEN 'A' END AS prediction, CASE event_id % 6 WHEN 0 THEN 'seen' WHEN 5 THEN '' END AS rationale,
       CASE event_id % 6 WHEN 1 THEN 'no_json_object' WHEN 2 THEN 'no_json_object' WHEN 3 THEN 'no_choice' WHEN 4 THEN 'choice_not_offered' END AS error FROM events""",
)
def read_choices(spark, sf_dir):
    e = _events(spark, sf_dir, _REPLY + " AS reply", "array('A. x', 'B. y') AS options")
    return responses.read_choices(e).select("event_id", "prediction", "rationale", "error")


@query(
    "description_checks",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'missing:summary,uncertainties' WHEN 2 THEN 'observed_facts_not_an_object' WHEN 3 THEN 'observed_missing:actions,visual_evidence' END AS error FROM events""",
)
def description_checks(spark, sf_dir):
    full = '"visible_anatomy": [], "visible_instruments": [], "visible_objects": [], "state_changes": []'
    reply = f"""CASE event_id % 4 WHEN 0 THEN '{{"summary": "s", "observed_facts": {{{full}, "actions": [], "visual_evidence": []}}, "medical_inferences": [], "uncertainties": []}}'
      WHEN 1 THEN '{{"observed_facts": {{}}, "medical_inferences": []}}' WHEN 2 THEN '{{"summary": "s", "observed_facts": [], "medical_inferences": [], "uncertainties": []}}'
      ELSE '{{"summary": "s", "observed_facts": {{{full}}}, "medical_inferences": [], "uncertainties": []}}' END"""
    return responses.check_descriptions(_events(spark, sf_dir, reply + " AS reply")).select("event_id", "error")


@query(
    "summary_violations",
    "SELECT clip_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(s), '\\b{t}\\b') THEN '{t}' END" for t in vocab.SUMMARY_FORBIDDEN_TERMS)
    + f"], lambda x: x IS NOT NULL), ',') AS terms FROM (SELECT clip_id, summary || CASE WHEN event_id % 7 = 0 THEN ' Blood in the surgical field may dry.' ELSE '' END AS s FROM ({CLIPS_SQL}))",
)
def summary_violations(spark, sf_dir):
    c = clip_descriptions(spark, sf_dir)
    n = F.substring("clip_id", 2, 20).cast("bigint")
    s = F.concat("description.summary", F.when(n % 7 == 0, " Blood in the surgical field may dry.").otherwise(""))
    return c.select("clip_id", F.array_join(text.forbidden_terms(s), ",").alias("terms"))


@query(
    "scrubbed_errors",
    "SELECT doc_id, left(regexp_replace(text || ' data:image/png;base64,AAb+/= tail', 'data:image/[^;]+;base64,[A-Za-z0-9+/=]+', '<image-data>', 'g'), 2000) AS message FROM documents",
)
def scrubbed_errors(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.scrub_error(F.concat("text", F.lit(" data:image/png;base64,AAb+/= tail"))).alias("message"))


@query(
    "repaired_event_ids",
    """SELECT 'q' || event_id AS question_id, CASE event_id % 4 WHEN 0 THEN 'event:v' || v || ':00007,event:v' || v || ':00003' WHEN 1 THEN 'event:v' || v || ':00012' WHEN 2 THEN 'event:v' || v || ':00001' ELSE '' END AS event_ids,
       CASE WHEN event_id % 4 = 3 THEN 'no_valid_event_ids' END AS error FROM (SELECT event_id, event_id // 100 AS v FROM events)""",
)
def repaired_event_ids(spark, sf_dir):
    # Known events are numbered 0..99 in each recording: the events themselves.
    known = table(spark, sf_dir, "events").selectExpr("concat('v', event_id div 100) AS video_id", "concat('event:v', event_id div 100, ':', lpad(CAST(event_id % 100 AS STRING), 5, '0')) AS event_id")
    reply = """CASE event_id % 4 WHEN 0 THEN concat('{"event_ids": ["event:', v, ':7", "event:', v, ':00003", "event:', v, ':00007", "event:', v, ':00009"]}')
      WHEN 1 THEN concat('{"event_ids": "event:', v, ':0012"}') WHEN 2 THEN concat('maybe event:', v, ':00001 and event:zz:00002') ELSE '{"event_ids": ["event:none:1"]}' END"""
    replies = table(spark, sf_dir, "events").selectExpr("event_id", "concat('v', event_id div 100) AS v").selectExpr("concat('q', event_id) AS question_id", "v AS video_id", reply + " AS reply")
    out = responses.repair_event_ids(replies, known, 2)
    return out.select("question_id", F.array_join("event_ids", ",").alias("event_ids"), "error")


@query(
    "merged_rewrites",
    """SELECT event_id AS clip_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS summary, CASE WHEN event_id % 3 = 0 THEN '[1]' ELSE '[]' END AS medical_inferences, event_id % 3 = 0 AS rewritten FROM events""",
)
def merged_rewrites(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.select(F.col("event_id").alias("clip_id"), F.col("event_type").alias("summary"), F.lit("[]").alias("medical_inferences"))
    again = e.filter("event_id % 3 < 2").selectExpr(
        "event_id AS clip_id", """CASE WHEN event_id % 3 = 0 THEN '{"summary": "new", "medical_inferences": [1]}' ELSE '{"summary": "lost"}' END AS reply"""
    )
    return responses.merge_rewrites(first, again)


_TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
_PAIRS = """SELECT conv_id, turn, text AS prediction, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations"""
_F1 = f"""SELECT p.conv_id, p.turn, CASE WHEN np = 0 OR nr = 0 THEN CASE WHEN np = 0 AND nr = 0 THEN 1.0::DOUBLE ELSE 0 END
  WHEN coalesce(o, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * (o / np) * (o / nr) / (o / np + o / nr) END AS token_f1
  FROM (SELECT conv_id, turn, CAST(len({_TOK.format(c='prediction')}) AS DOUBLE) AS np, CAST(len({_TOK.format(c='reference')}) AS DOUBLE) AS nr FROM ({_PAIRS}) WHERE reference IS NOT NULL) p
  LEFT JOIN (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS o FROM
    (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({_TOK.format(c='prediction')}) AS t FROM ({_PAIRS})) GROUP BY 1, 2, 3) a JOIN
    (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({_TOK.format(c='reference')}) AS t FROM ({_PAIRS})) GROUP BY 1, 2, 3) b
    ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t GROUP BY 1, 2) o ON o.conv_id = p.conv_id AND o.turn = p.turn"""


@query("token_f1", f"SELECT conv_id, turn, round(token_f1, 9) AS token_f1 FROM ({_F1})")
def token_f1(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("prediction"), nxt.alias("reference"))
    out = metrics.with_token_f1(pairs, ["conv_id", "turn"]).filter(F.col("reference").isNotNull())
    return out.select("conv_id", "turn", F.round("token_f1", 9).alias("token_f1"))


_LAB = "SELECT l.doc_id AS id, CAST(quality AS VARCHAR) AS lq, CAST(toxic AS VARCHAR) AS tx, CAST(n_chars % 2 AS VARCHAR) AS ref, lang, source FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark, sf_dir, column: str):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return both.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col(column).cast("string").alias("prediction"),
        (F.col("n_chars") % 2).cast("string").alias("reference"), F.col("lang").alias("task_name"), F.col("source").alias("route"),
    )


@query(
    "answer_report",
    " UNION ALL ".join(
        f"SELECT '{s}' AS slice, {v} AS value, count(*) AS count, round(avg(CASE WHEN lq = ref THEN 1.0 ELSE 0 END), 9) AS exact_match, round(avg(CASE WHEN lq = ref THEN 1.0 ELSE 0 END), 9) AS token_f1 FROM ({_LAB}) GROUP BY {g}"
        for s, v, g in (("overall", "'overall'", "ALL"), ("task_name", "lang", "lang"), ("route", "source", "source"))
    ),
)
def answer_report(spark, sf_dir):
    out = metrics.answer_report(metrics.with_token_f1(_labelled(spark, sf_dir, "quality")))
    return out.select("slice", "value", "count", F.round("exact_match", 9).alias("exact_match"), F.round("token_f1", 9).alias("token_f1"))


_PAIRED = f"SELECT lang, CASE WHEN id % 10 = 1 THEN 'left_only' WHEN id % 10 = 2 THEN 'right_only' WHEN lq = ref AND tx = ref THEN 'both_correct' WHEN lq = ref THEN 'left_only_correct' WHEN tx = ref THEN 'right_only_correct' ELSE 'both_wrong' END AS o FROM ({_LAB})"


def _paired_sql(name: str, group: str, overall: bool) -> str:
    n = "count(*) FILTER (o NOT IN ('left_only', 'right_only'))"
    share = lambda side: f"round(count(*) FILTER (o IN ('both_correct', '{side}_only_correct')) / {n}, 9)"
    only = lambda side: f"count(*) FILTER (o = '{side}_only')" if overall else "NULL"
    return f"""SELECT {name} AS task_name, {n} AS paired_questions, count(*) FILTER (o = 'both_correct') AS both_correct, count(*) FILTER (o = 'left_only_correct') AS left_only_correct,
    count(*) FILTER (o = 'right_only_correct') AS right_only_correct, count(*) FILTER (o = 'both_wrong') AS both_wrong, {share('left')} AS left_accuracy, {share('right')} AS right_accuracy,
    {only('left')} AS left_only_ids, {only('right')} AS right_only_ids FROM ({_PAIRED}) GROUP BY {group} HAVING {n} > 0"""


@query("paired_report", _paired_sql("'overall'", "ALL", True) + " UNION ALL " + _paired_sql("lang", "lang", False))
def paired_report(spark, sf_dir):
    left = _labelled(spark, sf_dir, "quality").filter("id % 10 <> 2")
    # A second, earlier row per id must lose against the later one.
    stale = left.withColumn("ord", F.col("ord") - 1).withColumn("prediction", F.lit("stale"))
    right = _labelled(spark, sf_dir, "toxic").filter("id % 10 <> 1")
    out = metrics.paired_report(metrics.pair_predictions(left.unionByName(stale), right))
    return out.withColumns({c: F.round(c, 9) for c in ("left_accuracy", "right_accuracy")})


@query(
    "naturally_ordered_ids",
    "SELECT id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN regexp_matches(id, '^\\d+$') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(id, '^\\d+$') THEN CAST(id AS HUGEINT) END, id) AS position FROM (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_name || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part)",
)
def naturally_ordered_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_brand", "CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, p_partkey) ELSE CAST(p_partkey AS STRING) END AS id")
    w = Window.partitionBy("p_brand").orderBy(*metrics.natural_order("id"))
    return p.select("id", F.row_number().over(w).alias("position"))


_PARTS = f"SELECT CAST(qa_uid AS BIGINT) AS id, CASE WHEN method LIKE 'direct%' AND source_field = 'question' THEN 'explicit_time' WHEN method LIKE 'direct%' THEN 'implicit_time' ELSE 'no_reliable_time' END AS partition FROM ({EVIDENCE_SQL})"


@query(
    "partition_metrics",
    f"""SELECT c.condition, p.partition, p.n AS expected_questions, coalesce(m.n, 0) AS available_predictions, coalesce(m.n, 0) AS count, coalesce(round(m.em, 9), 0) AS exact_match
        FROM (SELECT DISTINCT event_type AS condition FROM events) c, (SELECT partition, count(*) AS n FROM ({_PARTS}) GROUP BY 1) p
        LEFT JOIN (SELECT event_type, partition, count(*) AS n, avg(CASE WHEN event_id % 3 = event_id % 2 THEN 1.0 ELSE 0 END) AS em FROM events JOIN ({_PARTS}) ON id = event_id GROUP BY 1, 2) m
        ON m.event_type = c.condition AND m.partition = p.partition""",
)
def partition_metrics(spark, sf_dir):
    e = evidence.recover_evidence(time_questions(spark, sf_dir))
    p = table(spark, sf_dir, "events").selectExpr("event_type AS condition", "event_id AS id", "CAST(event_id % 3 AS STRING) AS prediction", "CAST(event_id % 2 AS STRING) AS reference", "CAST(0 AS DOUBLE) AS token_f1")
    out = metrics.partition_metrics(e, p)
    return out.select("condition", "partition", "expected_questions", "available_predictions", "count", F.round("exact_match", 9).alias("exact_match"))


@query(
    "run_report",
    f"""SELECT 'overall' AS route, (SELECT count(*) FROM documents) AS requested, count(*) AS completed, (SELECT count(*) FROM documents) - count(*) AS failed, count(*) FILTER (lq = ref) AS correct, round(count(*) FILTER (lq = ref) / count(*), 9) AS accuracy FROM ({_LAB})
        UNION ALL SELECT source, NULL, count(*), NULL, count(*) FILTER (lq = ref), round(count(*) FILTER (lq = ref) / count(*), 9) FROM ({_LAB}) GROUP BY source""",
)
def run_report(spark, sf_dir):
    out = metrics.run_report(table(spark, sf_dir, "documents"), _labelled(spark, sf_dir, "quality"))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query("prediction_counts", f"SELECT lq AS prediction, count(*) AS n FROM ({_LAB}) GROUP BY 1")
def prediction_counts(spark, sf_dir):
    return metrics.prediction_counts(_labelled(spark, sf_dir, "quality"))


def _desc_sql(side: str, summary: str, inf: str, sec: str, tries: str) -> str:
    bad = " OR ".join(f"regexp_matches(lower({summary}), '\\b{t}\\b')" for t in vocab.SUMMARY_FORBIDDEN_TERMS)
    return f"""SELECT '{side}' AS condition, count(*) AS clips, count(*) FILTER ({bad}) AS summary_rule_violation_count, count(*) FILTER ({inf}) AS nonempty_medical_inference_count, 0 AS nonempty_uncertainty_count,
    round(avg(len(string_split_regex(trim({summary}), '\\s+'))), 3) AS mean_summary_words, round(avg({sec}), 3) AS mean_elapsed_seconds, CAST(sum({tries}) AS BIGINT) AS total_generation_attempts FROM ({CLIPS_SQL}) WHERE event_id % 4 <> 1"""


@query(
    "description_report",
    _desc_sql("baseline", "summary", "event_id % 3 = 0", "CAST(event_id % 8 AS DOUBLE)", "1 + event_id % 2") + " UNION ALL " + _desc_sql("candidate", "'A ' || target", "false", "0.0::DOUBLE", "1"),
)
def description_report(spark, sf_dir):
    d = F.col("description")
    c = clip_descriptions(spark, sf_dir).withColumn("_n", F.substring("clip_id", 2, 20).cast("bigint"))
    base = c.select(
        "clip_id", "clip_index", "start_seconds", "end_seconds", d["summary"].alias("summary"), d["medical_inferences"].alias("medical_inferences"), d["uncertainties"].alias("uncertainties"),
        (F.col("_n") % 8).cast("double").alias("elapsed_seconds"), (1 + F.col("_n") % 2).alias("generation_attempts"),
    )
    cand = c.filter("_n % 4 <> 1").select(
        "clip_id", "clip_index", "start_seconds", "end_seconds", F.concat(F.lit("A "), d["observed_facts"]["actions"][0]["target"]).alias("summary"),
        F.filter(d["medical_inferences"], lambda _: F.lit(False)).alias("medical_inferences"), d["uncertainties"].alias("uncertainties"),
        F.lit(None).cast("double").alias("elapsed_seconds"), F.lit(None).cast("bigint").alias("generation_attempts"),
    )
    return metrics.description_report(metrics.description_pairs(base, cand))


@query(
    "evidence_set_metrics",
    """SELECT event_id AS question_id, CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0 END AS evidence_recall, event_id % 3 = 0 AS evidence_set_complete,
       CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS hard_negative_precision, event_id % 2 = 0 AS correct, event_id % 6 = 0 AS grounded_correct FROM events""",
)
def evidence_set_metrics(spark, sf_dir):
    # Two needed spans and one hard negative per question; retrieval finds both, one plus the negative, or nothing.
    e = table(spark, sf_dir, "events").selectExpr("event_id AS question_id", "CAST(event_id div 100 AS STRING) AS video_id", "event_id % 3 AS k", "event_id % 2 AS h")
    span = lambda a, b, neg: f"named_struct('start_seconds', CAST({a} AS DOUBLE), 'end_seconds', CAST({b} AS DOUBLE), 'is_negative', {neg})"
    gold = e.select("question_id", "video_id", F.expr(f"inline(array({span(0, 10, 'false')}, {span(20, 30, 'false')}, {span(50, 60, 'true')}))"))
    found = e.filter("k < 2").select(
        "question_id", "video_id", F.expr(f"inline(CASE k WHEN 0 THEN array({span(0, 10, 'false')}, {span(18, 30, 'false')}) ELSE array({span(1, 10, 'false')}, {span(50, 61, 'false')}) END)")
    ).drop("is_negative")
    answers = e.select("question_id", F.col("h").cast("string").alias("prediction"), F.lit("0").alias("reference"))
    return metrics.evidence_set_metrics(gold, found, answers)


@query("path_accuracy", "SELECT count(*) AS questions, round(avg(CASE WHEN event_id % 4 < 2 THEN 1.0 ELSE 0 END), 9) AS path_accuracy FROM events")
def path_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    want = e.selectExpr("event_id AS question_id", "array('e1', 'e2') AS events")
    got = e.filter("event_id % 4 < 3").selectExpr("event_id AS question_id", "CASE event_id % 4 WHEN 0 THEN array('e1', 'e2') WHEN 1 THEN array('x', 'e1', 'y', 'e2') ELSE array('e2', 'e1') END AS events")
    out = metrics.path_accuracy(want, got)
    return out.select("questions", F.round("path_accuracy", 9).alias("path_accuracy"))


@query(
    "graph_question_violations",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 5 WHEN 1 THEN 'reasoning_type' WHEN 2 THEN 'too_little_evidence' WHEN 3 THEN 'foreign_evidence' ELSE 'multi_hop_count' END AS violations FROM events WHERE event_id % 5 <> 0""",
)
def graph_question_violations(spark, sf_dir):
    span = lambda v: f"named_struct('video_id', {v}, 'start_seconds', 0D, 'end_seconds', 1D)"
    e = table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS id", "'v' AS video_id", "'q' AS question", "'a' AS answer",
        "CASE event_id % 5 WHEN 1 THEN 'guess' WHEN 4 THEN 'multi_hop' ELSE 'single_hop' END AS reasoning_type",
        "CASE event_id % 5 WHEN 2 THEN 2 ELSE 1 END AS required_evidence_count",
        f"CASE event_id % 5 WHEN 3 THEN array({span("'w'")}) ELSE array({span("'v'")}) END AS evidence",
        f"slice(array({span("'v'")}), 1, 0) AS hard_negative_evidence",
    )
    return checks.graph_question_violations(e).select("id", F.array_join("violations", ",").alias("violations"))
