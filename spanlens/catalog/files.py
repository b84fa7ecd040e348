"""File surface, broken inputs, far times, other scripts and hot recordings.

Files are written to the shared folder of the session and read back, so results depend on the given
tables alone. Hot recordings hold a third of all events; the others follow the users.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanlens.catalog import query
from spanlens.catalog.inputs import table
from spanlens.catalog.logs import _LINE, _OK
from spanlens.functions import timetext, vocab
from spanlens.operators import checks, graphquery, responses, retrieve
from spanlens.plans.ordered import with_previous
from spanlens.plans.overlap import overlap_join
from spanlens.session import shared_folder
from spanlens.sources import annotations, frames, jsonl, store
from spanlens.streaming import scoring


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT event_id, event_type, value FROM events")
def jsonl_round_trip(spark, sf_dir):
    path = _place(spark, "jsonl")
    jsonl.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return jsonl.read_jsonl(spark, path, "event_id bigint, event_type string, value double")


@query("first_events", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 100")
def first_events(spark, sf_dir):
    return jsonl.first_in_source_order(table(spark, sf_dir, "events"), ["ts", "event_id"], 100).select("event_id", "user_id")


@query("stored_index", "SELECT event_id AS chunk_id, event_id // 100 AS video_id, value AS first, 2 AS width FROM events")
def stored_index(spark, sf_dir):
    path = _place(spark, "index")
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS chunk_id", "event_id div 100 AS video_id", "event_id AS ord", "array(value, value * 2) AS vec")
    store.save_index(rows, path, buckets=8)
    return store.load_index(spark, path).select("chunk_id", "video_id", F.col("vec")[0].alias("first"), F.size("vec").alias("width"))


@query(
    "stored_graph",
    "SELECT 'nodes' AS part, o_custkey AS video_id, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'edges', l_suppkey, count(*) FROM lineitem GROUP BY 2",
)
def stored_graph(spark, sf_dir):
    path = _place(spark, "graph")
    tables = {
        "nodes": table(spark, sf_dir, "orders").selectExpr("o_custkey AS video_id", "o_orderkey AS id"),
        "edges": table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS video_id", "l_orderkey AS source", "l_linenumber AS target"),
    }
    store.write_graph(tables, path, 8)
    parts = [df.groupBy(F.lit(name).alias("part"), "video_id").agg(F.count("*").alias("rows")) for name, df in store.load_graph(spark, path).items()]
    return parts[0].unionByName(parts[1])


@query(
    "manifest_clip_frames",
    "SELECT event_id // 100 AS video_id, 'c' || event_id AS clip_id, CAST(event_id % 4 AS INT) AS frames FROM events",
)
def manifest_clip_frames(spark, sf_dir):
    clips = table(spark, sf_dir, "events").selectExpr(
        "event_id div 100 AS video_id", "named_struct('id', concat('c', event_id), 'frame_paths', array_repeat('f', CAST(event_id % 4 AS INT))) AS clip"
    )
    manifest = clips.groupBy("video_id").agg(F.collect_list("clip").alias("clips"))
    return frames.manifest_frames(manifest).select("video_id", "clip_id", F.size("frame_paths").alias("frames"))


@query("listed_files", "SELECT DISTINCT event_type, 1 AS files FROM events")
def listed_files(spark, sf_dir):
    path = _place(spark, "frames")
    table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("value"), "event_type").repartition("event_type").write.partitionBy("event_type").text(path)
    kind = F.regexp_extract("path", "event_type=([^/]+)/part-", 1)
    return frames.frame_inventory(spark, path).groupBy(kind.alias("event_type")).agg(F.count("*").cast("int").alias("files"))


@query("scanned_annotations", f"SELECT 'v' || event_id AS video_id, event_type AS site, event_id * 3 AS num_frames FROM events WHERE {_OK}")
def scanned_annotations(spark, sf_dir):
    path = _place(spark, "annotations")
    table(spark, sf_dir, "events").selectExpr(_LINE + " AS value").write.text(path)
    found = annotations.scan_annotations(spark, path).recordings
    return found.select("video_id", F.col("metadata")["site"].alias("site"), "num_frames")


@query("unroutable_questions", "SELECT event_id AS question_id FROM events WHERE (event_id // 100) % 3 = 0")
def unroutable_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "events").selectExpr("event_id AS question_id", "event_id div 100 AS video_id")
    known = asked.filter("video_id % 3 <> 0").select("video_id").distinct()
    return graphquery.unroutable(asked, known).select("question_id")


@query(
    "graph_question_rejects",
    "SELECT event_id AS question_id, CASE WHEN event_id % 7 = 0 THEN 'empty_question' ELSE 'unknown_recording' END AS reason FROM events WHERE event_id % 7 = 0 OR (event_id // 100) % 3 = 0",
)
def graph_question_rejects(spark, sf_dir):
    asked = table(spark, sf_dir, "events").selectExpr("event_id AS question_id", "event_id div 100 AS video_id", "CASE WHEN event_id % 14 = 0 THEN NULL WHEN event_id % 7 = 0 THEN ' 　' ELSE 'q' END AS question")
    known = asked.filter("video_id % 3 <> 0").select("video_id").distinct()
    return graphquery.rejected_questions(asked, known).select("question_id", "reason")


@query(
    "result_violations",
    """SELECT event_id AS question_id, 'empty_identity' AS violations FROM events WHERE event_id % 29 = 0
       UNION ALL SELECT event_id, 'foreign_evidence' FROM events WHERE event_id % 31 = 0""",
)
def result_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    results = e.selectExpr("event_id AS question_id", "CASE WHEN event_id % 29 = 0 THEN '' ELSE concat('v', event_id div 100) END AS video_id")
    proof = e.selectExpr("event_id AS question_id", "CASE WHEN event_id % 31 = 0 THEN 'other' WHEN event_id % 29 = 0 THEN '' ELSE concat('v', event_id div 100) END AS video_id")
    return checks.result_violations(results, proof).select("question_id", F.array_join("violations", ",").alias("violations"))


@query(
    "broken_nodes",
    """SELECT event_id AS row, v AS violations FROM (SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'empty_id' END, CASE WHEN event_id % 13 = 0 THEN 'empty_label' END,
       CASE WHEN event_id % 17 = 0 THEN 'unknown_type' END, CASE WHEN event_id % 19 = 0 THEN 'confidence' END) AS v FROM events) WHERE v <> ''""",
)
def broken_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").selectExpr(
        "event_id AS row", "'v' AS video_id", "CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(event_id AS STRING) END AS id", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'l' END AS label",
        f"CASE WHEN event_id % 17 = 0 THEN 'thing' ELSE '{vocab.NODE_TYPES[0]}' END AS node_type", "CASE WHEN event_id % 19 = 0 THEN 1.5D ELSE 1.0D END AS confidence",
    )
    found = checks.broken(nodes, checks.node_tests())
    return found.select("row", F.array_join("violations", ",").alias("violations"))


@query("ungrounded_nodes", "SELECT event_id // 100 AS video_id, event_id AS id FROM events WHERE event_type = 'error'")
def ungrounded_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").selectExpr("event_id div 100 AS video_id", "event_id AS id", "event_type")
    return checks.ungrounded_nodes(nodes, nodes.filter("event_type <> 'error'"))


@query("missing_edge_ends", "SELECT l_orderkey AS source, l_partkey AS missing_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def missing_edge_ends(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr("0 AS video_id", "concat('o', l_orderkey) AS source", "concat('p', l_partkey) AS target", "'uses' AS relation", "l_orderkey")
    nodes = table(spark, sf_dir, "orders").selectExpr("0 AS video_id", "concat('o', o_orderkey) AS id").unionByName(table(spark, sf_dir, "part").filter("p_size >= 10").selectExpr("0 AS video_id", "concat('p', p_partkey) AS id"))
    found = checks.dangling_edges(edges, nodes)
    return found.select(F.substring("source", 2, 20).cast("long").alias("source"), F.substring("missing_id", 2, 20).cast("long").alias("missing_id"))


@query(
    "broken_clip_plans",
    """SELECT event_id AS row, v AS violations FROM (SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'empty_identity' END, CASE WHEN event_id % 13 = 0 THEN 'negative_index' END,
       CASE WHEN event_id % 17 = 0 THEN 'sample_count' END, CASE WHEN event_id % 19 = 0 THEN 'duration' END, CASE WHEN event_id % 23 = 0 THEN 'rate' END) AS v FROM events) WHERE v <> ''""",
)
def broken_clip_plans(spark, sf_dir):
    clips = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(event_id AS STRING) AS video_id", "CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('c', event_id) END AS clip_id", "CASE WHEN event_id % 13 = 0 THEN -1 ELSE 0 END AS clip_index",
        "0 AS sample_start_index", "64 AS sample_end_index", "CASE WHEN event_id % 17 = 0 THEN 63 ELSE 64 END AS sampled_frame_count", "0.0D AS start_seconds",
        "CASE WHEN event_id % 19 = 0 THEN 0.0D ELSE 64.0D END AS end_seconds", "CASE WHEN event_id % 23 = 0 THEN 0.0D ELSE 1.0D END AS effective_fps",
    )
    return checks.clip_plan_violations(clips).select(F.col("video_id").cast("long").alias("row"), F.array_join("violations", ",").alias("violations"))


@query(
    "stream_report",
    """SELECT event_type AS value, count(*) AS count, round(avg(CASE WHEN user_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact_match FROM events WHERE event_id % 7 <> 0 GROUP BY 1""",
)
def stream_report(spark, sf_dir):
    """Predictions arrive as files, some twice and some without an answer; the stream is run twice."""
    log, out, state = _place(spark, "log"), _place(spark, "scored"), _place(spark, "stream")
    rows = table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS id", "CASE WHEN event_id % 7 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'A' ELSE 'B' END AS prediction", "'A' AS reference", "event_type AS task_name", "'r' AS route"
    )
    for part in (rows, rows.filter("user_id % 2 = 0")):
        part.write.mode("append").json(log)
        scoring.score_stream(spark, log, out, state).awaitTermination()
    report = scoring.current_report(spark, out).filter("slice = 'task_name'")
    return report.select("value", "count", F.round("exact_match", 6).alias("exact_match"))


# Full-width digits and ideographic spaces, as in texts of mixed scripts.
_WIDE = "translate(CAST({x} AS {string}), '0123456789', '０１２３４５６７８９')"


@query("wide_digit_spans", "SELECT event_id, CAST(event_id AS DOUBLE) AS start_seconds, CAST(event_id + 30 AS DOUBLE) AS end_seconds FROM events")
def wide_digit_spans(spark, sf_dir):
    a, b = (_WIDE.format(x=x, string="STRING") for x in ("event_id", "(event_id + 30)"))
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"concat('手术From　second　', {a}, '　to second ', {b}, '　?') AS question")
    span = timetext.parse_time_span(F.col("question"))
    return rows.select("event_id", span["start_seconds"].alias("start_seconds"), span["end_seconds"].alias("end_seconds"))


@query(
    "padded_choices",
    "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'B' END AS prediction, CASE WHEN event_id % 3 = 2 THEN 'choice_not_offered' END AS error FROM events",
)
def padded_choices(spark, sf_dir):
    replies = table(spark, sf_dir, "events").selectExpr(
        "event_id", """CASE event_id % 3 WHEN 0 THEN '{"choice": "B\\\\n"}' WHEN 1 THEN '{"choice": "　b "}' ELSE '{"choice": "C"}' END AS reply""", "array('A. x', 'B. y') AS options"
    )
    return responses.read_choices(replies).select("event_id", "prediction", "error")


@query(
    "same_question_ids",
    "SELECT 'q' || event_id % 50 AS question_id, event_id // 50 AS video_id, 'event:' || event_id // 50 || ':' || lpad(CAST(event_id % 50 AS VARCHAR), 5, '0') AS event_ids FROM events",
)
def same_question_ids(spark, sf_dir):
    """Every recording asks questions of the same ids; each gets the event of its own recording."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "concat('q', event_id % 50) AS question_id", "event_id div 50 AS video_id", "concat('event:', event_id div 50, ':', lpad(CAST(event_id % 50 AS STRING), 5, '0')) AS event_id"
    )
    replies = rows.select("question_id", "video_id", F.concat(F.lit('{"event_ids": ["'), "event_id", F.lit('"]}')).alias("reply"))
    return responses.repair_event_ids(replies, rows.select("video_id", "event_id"), 3).select("question_id", "video_id", F.array_join("event_ids", ",").alias("event_ids"))


@query(
    "far_range_hits",
    """SELECT q.event_id AS qa_uid, count(*) AS hits FROM events q JOIN events c ON q.event_id // 100 = c.event_id // 100
       WHERE 64.0 * (c.event_id % 100 + 1) > q.event_id % 100 GROUP BY 1""",
)
def far_range_hits(spark, sf_dir):
    """Each event asks from its second to one far beyond any recording."""
    e = table(spark, sf_dir, "events")
    text = "concat('from second ', event_id % 100, ' to second 99999999999999') AS question"
    asked = retrieve.ask(e.selectExpr("event_id AS qa_uid", "event_id div 100 AS video_id", text))
    clips = e.selectExpr("event_id AS chunk_id", "event_id div 100 AS video_id", "64.0D * (event_id % 100) AS start_seconds", "64.0D * (event_id % 100 + 1) AS end_seconds")
    met = overlap_join(asked.select("qa_uid", "video_id", "asked_start", "asked_end"), clips, ["video_id"], ("asked_start", "asked_end"), ("start_seconds", "end_seconds"))
    return met.groupBy("qa_uid").agg(F.count("*").alias("hits"))


_HOT = "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END"


@query("hot_neighbours", f"SELECT event_id, lag(event_id) OVER (PARTITION BY {_HOT} ORDER BY event_id) AS previous FROM events")
def hot_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"CAST({_HOT} AS STRING) AS video_id", "event_id AS clip_index", "CAST(event_id AS STRING) AS clip_id")
    out = with_previous(rows, "video_id", "clip_index", "clip_id", ["event_id"], width=64)
    return out.select("event_id", F.col("previous.event_id").alias("previous"))


@query(
    "hot_point_hits",
    f"""WITH r AS (SELECT event_id, {_HOT} AS v, floor(epoch(ts)) AS t FROM events)
        SELECT q.event_id AS qa_uid, (SELECT list(c.event_id ORDER BY CASE WHEN c.t <= q.t AND q.t <= c.t + 30 THEN 0 ELSE least(abs(q.t - c.t), abs(q.t - c.t - 30)) END, c.event_id)[1]
        FROM r c WHERE c.v = q.v AND c.t BETWEEN q.t - 60 AND q.t + 60) AS chunk_id FROM r q""",
)
def hot_point_hits(spark, sf_dir):
    """Every event asks about its own moment in its recording, a third of them in one."""
    r = table(spark, sf_dir, "events").selectExpr("event_id", f"{_HOT} AS video_id", "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS DOUBLE) AS t")
    asked = r.selectExpr("event_id AS qa_uid", "video_id", "t AS asked_start", "t AS asked_end", "'point' AS asked_kind")
    items = r.selectExpr("video_id", "event_id AS chunk_id", "t AS start_seconds", "t + 30 AS end_seconds", "event_id AS ord")
    return retrieve.retrieve_points(asked, items, 1).select("qa_uid", "chunk_id")
