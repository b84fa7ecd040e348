"""Interval and vector retrieval with its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.catalog import query
from spanlens.catalog.inputs import recordings, table
from spanlens.catalog.questions import spans_sql
from spanlens.catalog.timeline import windows_sql
from spanlens.operators import clusterindex, metrics, retrieve, vectorsearch, windows

K = 8
_SPANS = """SELECT doc_id AS qa_uid, doc_id AS video_id, CAST(n_chars AS DOUBLE) / 4 AS a, CAST(n_chars AS DOUBLE) / 2 AS b, CAST(n_chars AS DOUBLE) / 3 AS p FROM documents"""
_IOU = "greatest(0, least(b, end_seconds) - greatest(a, start_seconds)) / (greatest(b, end_seconds) - least(a, start_seconds))"
_CHUNKS = windows_sql(60, 20)
_RANGE_HITS = f"""SELECT * FROM (SELECT q.qa_uid, w.window_index, w.start_seconds, w.end_seconds, {_IOU} AS score,
  row_number() OVER (PARTITION BY q.qa_uid ORDER BY {_IOU} DESC, w.window_index) AS rank
  FROM ({_SPANS}) q JOIN ({_CHUNKS}) w USING (video_id) WHERE greatest(a, start_seconds) < least(b, end_seconds)) WHERE rank <= {K}"""
_PSCORE = "CASE WHEN start_seconds <= p AND p <= end_seconds THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1 + least(abs(p - start_seconds), abs(p - end_seconds))) END"
_POINT_HITS = f"""SELECT * FROM (SELECT q.qa_uid, w.window_index, w.start_seconds, w.end_seconds, {_PSCORE} AS score,
  row_number() OVER (PARTITION BY q.qa_uid ORDER BY {_PSCORE} DESC, w.window_index) AS rank
  FROM ({_SPANS}) q JOIN ({_CHUNKS}) w USING (video_id)) WHERE rank <= {K}"""


def _chunks(spark, sf_dir):
    out = windows.time_windows(recordings(spark, sf_dir), 60, 20)
    return out.select("video_id", F.col("window_index").alias("chunk_id"), "start_seconds", "end_seconds", F.col("window_index").alias("ord"))


def _asked(spark, sf_dir):
    v = recordings(spark, sf_dir)
    d = F.col("duration_seconds")
    ranges = v.select(F.col("video_id").alias("qa_uid"), "video_id", (d / 4).alias("asked_start"), (d / 2).alias("asked_end"), F.lit("range").alias("asked_kind"))
    points = v.select(F.col("video_id").alias("qa_uid"), "video_id", (d / 3).alias("asked_start"), (d / 3).alias("asked_end"), F.lit("point").alias("asked_kind"))
    return ranges, points


def _shown(hits):
    return hits.select("qa_uid", "rank", F.col("chunk_id").alias("window_index"), "start_seconds", "end_seconds", F.round("score", 9).alias("score"))


@query("range_retrieval", f"SELECT qa_uid, rank, window_index, start_seconds, end_seconds, round(score, 9) AS score FROM ({_RANGE_HITS})")
def range_retrieval(spark, sf_dir):
    ranges, _ = _asked(spark, sf_dir)
    return _shown(retrieve.retrieve_ranges(ranges, _chunks(spark, sf_dir), K))


@query("point_retrieval", f"SELECT qa_uid, rank, window_index, start_seconds, end_seconds, round(score, 9) AS score FROM ({_POINT_HITS})")
def point_retrieval(spark, sf_dir):
    _, points = _asked(spark, sf_dir)
    return _shown(retrieve.retrieve_points(points, _chunks(spark, sf_dir), K))


def _evidence(asked):
    window = F.array(F.struct(F.col("asked_start").alias("start_seconds"), F.col("asked_end").alias("end_seconds")))
    return asked.select("qa_uid", "video_id", F.concat(F.lit("direct_"), "asked_kind").alias("method"), window.alias("windows"))


_AT = "coalesce(max({v}) FILTER (rank <= {k}), 0)"
_RANGE_DETAILS = f"""SELECT q.qa_uid, 'direct_range' AS method, {', '.join(_AT.format(v='score', k=k) + f' AS i{k}' for k in (1, 4, 8))}
  FROM ({_SPANS}) q LEFT JOIN ({_RANGE_HITS}) h USING (qa_uid) GROUP BY 1"""
_POINT_DETAILS = f"""SELECT q.qa_uid, 'direct_point' AS method, {', '.join(_AT.format(v='CASE WHEN start_seconds <= p AND p <= end_seconds THEN 1 ELSE 0 END', k=k) + f' AS i{k}' for k in (1, 4, 8))}
  FROM ({_SPANS}) q LEFT JOIN ({_POINT_HITS}) h USING (qa_uid) GROUP BY 1"""


def _details(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    ranges, points = _asked(spark, sf_dir)
    d1 = metrics.retrieval_details(_evidence(ranges), retrieve.retrieve_ranges(ranges, chunks, K))
    d2 = metrics.retrieval_details(_evidence(points), retrieve.retrieve_points(points, chunks, K))
    return d1.unionByName(d2)


@query(
    "retrieval_details",
    f"""SELECT qa_uid, method, round(i1, 9) AS best_iou_at_1, round(i4, 9) AS best_iou_at_4, round(i8, 9) AS best_iou_at_8, i8 >= 0.3 AS hit_at_8, NULL AS point_hit_at_1, NULL AS point_hit_at_8 FROM ({_RANGE_DETAILS})
        UNION ALL SELECT qa_uid, method, NULL, NULL, NULL, NULL, i1 = 1, i8 = 1 FROM ({_POINT_DETAILS})""",
)
def retrieval_details(spark, sf_dir):
    return _details(spark, sf_dir).select(
        "qa_uid", "method", *[F.round(f"best_iou_at_{k}", 9).alias(f"best_iou_at_{k}") for k in (1, 4, 8)], "hit_at_8", "point_hit_at_1", "point_hit_at_8"
    )


_REPORT = " UNION ALL ".join(
    f"""SELECT {k} AS top_k, (SELECT count(*) FROM documents) AS direct_range_questions, (SELECT count(*) FROM documents) AS direct_point_questions,
    (SELECT round(avg(CASE WHEN i{k} >= 0.3 THEN 1.0 ELSE 0.0 END), 9) FROM ({_RANGE_DETAILS})) AS recall,
    (SELECT round(avg(i{k}), 9) FROM ({_RANGE_DETAILS})) AS mean_best_iou, (SELECT round(avg(i{k}), 9) FROM ({_POINT_DETAILS})) AS point_hit"""
    for k in (1, 4, 8)
)


@query("retrieval_metrics", _REPORT)
def retrieval_metrics(spark, sf_dir):
    out = metrics.retrieval_report(_details(spark, sf_dir))
    return out.select(
        "top_k", "direct_range_questions", "direct_point_questions", *[F.round(c, 9).alias(c) for c in ("recall", "mean_best_iou", "point_hit")]
    )


# Vectors: the recording is the label, the index order the vector id.
_UNIT = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS v FROM embeddings"""
_DOT = "round(list_dot_product(q.v, CAST(CAST(x.v AS FLOAT[]) AS DOUBLE[])), 9)"


def _top_sql(same: str) -> str:
    return f"""SELECT qa_uid, rank, chunk_id, round(s, 6) AS score FROM (SELECT q.vec_id AS qa_uid, x.vec_id AS chunk_id, {_DOT} AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, x.vec_id) AS rank FROM ({_UNIT}) q JOIN ({_UNIT}) x ON {same}) WHERE rank <= 5"""


def index_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    chunks = e.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("video_id"), F.col("vec_id").alias("ord"),
        (F.col("vec_id") * 30.0).alias("start_seconds"), (F.col("vec_id") * 30.0 + 30).alias("end_seconds"),
    )
    good, _ = vectorsearch.build_index(chunks, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")))
    return good


def query_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qa_uid"), F.col("label").alias("video_id"), F.col("embedding").cast("array<double>").alias("vec")
    )


@query("vector_top_k_in_recording", _top_sql("q.label = x.label"))
def vector_top_k_in_recording(spark, sf_dir):
    hits = vectorsearch.cosine_top_k(query_rows(spark, sf_dir), index_rows(spark, sf_dir), 5)
    return hits.select("qa_uid", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("vector_top_k_global", _top_sql("true"))
def vector_top_k_global(spark, sf_dir):
    hits = vectorsearch.cosine_top_k(query_rows(spark, sf_dir), index_rows(spark, sf_dir), 5, within_recording=False)
    return hits.select("qa_uid", "rank", "chunk_id", F.round("score", 6).alias("score"))


# Small blocks, so that the given tables make many cells; 4,000 rows are the default.
CLUSTER_BLOCK_ROWS = 50


@query("vector_top_k_pruned_global", _top_sql("true"))
def vector_top_k_pruned_global(spark, sf_dir):
    index = clusterindex.build_clusters(index_rows(spark, sf_dir), False, CLUSTER_BLOCK_ROWS)
    hits = clusterindex.pruned_top_k(query_rows(spark, sf_dir), index, 5)
    return hits.select("qa_uid", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("vector_top_k_pruned_in_recording", _top_sql("q.label = x.label"))
def vector_top_k_pruned_in_recording(spark, sf_dir):
    index = clusterindex.build_clusters(index_rows(spark, sf_dir), True, CLUSTER_BLOCK_ROWS)
    hits = clusterindex.pruned_top_k(query_rows(spark, sf_dir), index, 5)
    return hits.select("qa_uid", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _pool_sql(first: bool) -> str:
    base = _UNIT if first else "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
    return f"""SELECT chunk_id, frames, array_to_string(list_transform(m, lambda x: CAST(CAST(round(x / n * 10000) AS BIGINT) AS VARCHAR)), ',') AS vec FROM (
    SELECT chunk_id, frames, m, greatest(sqrt(list_dot_product(m, m)), 1e-12) AS n FROM (
    SELECT chunk_id, max(frames) AS frames, list(mean ORDER BY pos) AS m FROM (
    SELECT chunk_id, pos, avg(x) AS mean, count(*) AS frames FROM (SELECT vec_id // 8 AS chunk_id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos FROM ({base}))
    GROUP BY 1, 2) GROUP BY 1))"""


def _pool(first: bool):
    def run(spark, sf_dir):
        f = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("chunk_id"), F.col("embedding").alias("vec"))
        out = vectorsearch.pool_chunks(f, normalize_first=first)
        whole = F.transform("vec", lambda x: F.round(x * 10000, 0).cast("bigint").cast("string"))
        return out.select("chunk_id", "frames", F.array_join(whole, ",").alias("vec"))

    return run


query("pooled_unit_frames", _pool_sql(True))(_pool(True))
query("pooled_raw_frames", _pool_sql(False))(_pool(False))


@query(
    "index_build",
    f"""SELECT vec_id AS chunk_id, 'indexed' AS status, round(list_dot_product(v, v), 4) AS squared_norm FROM ({_UNIT}) WHERE vec_id % 10 <> 3 AND vec_id % 10 <> 4
        UNION ALL SELECT vec_id, 'vectors:' || CASE WHEN vec_id % 10 = 3 THEN 2 ELSE 0 END, NULL FROM embeddings WHERE vec_id % 10 IN (3, 4)""",
)
def index_build(spark, sf_dir):
    # Ids ending in 3 have two vectors, ids ending in 4 none: both must be reported.
    e = table(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("video_id"))
    vecs = e.withColumn("n", F.expr("CASE vec_id % 10 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END")).select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), F.explode(F.expr("array_repeat(1, CAST(n AS INT))")).alias("x")
    ).drop("x")
    good, bad = vectorsearch.build_index(chunks, vecs)
    squared = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return good.select("chunk_id", F.lit("indexed").alias("status"), F.round(squared, 4).alias("squared_norm")).unionByName(
        bad.select("chunk_id", F.concat(F.lit("vectors:"), F.col("vectors").cast("string")).alias("status"), F.lit(None).cast("double").alias("squared_norm"))
    )


@query(
    "vector_dimensions",
    "SELECT min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension, min(len(embedding)) = max(len(embedding)) AS dimensions_match FROM embeddings",
)
def vector_dimensions(spark, sf_dir):
    return vectorsearch.dimension_report(query_rows(spark, sf_dir), index_rows(spark, sf_dir))


# Questions over vectors: a third asks for a range, a third for a point, a third has no time.
_VQ = """SELECT vec_id AS qa_uid, label AS video_id, CASE vec_id % 3 WHEN 0 THEN 'Seen from second ' || vec_id * 30 || ' to second ' || (vec_id * 30 + 50) || '?'
  WHEN 1 THEN 'Seen near ' || (vec_id * 30 + 7) || ' s?' ELSE 'What is shown?' END AS question FROM embeddings"""
_VC = "SELECT vec_id AS chunk_id, label AS video_id, vec_id * 30.0::DOUBLE AS start_seconds, vec_id * 30.0::DOUBLE + 30 AS end_seconds FROM embeddings"
_VA = f"SELECT qa_uid, video_id, a, b, a AS p, kind FROM ({spans_sql(_VQ, 'question')})"
HYBRID_SQL = f"""
SELECT qa_uid, video_id, 'temporal' AS route, rank, chunk_id, start_seconds, end_seconds, score FROM (SELECT q.qa_uid, q.video_id, w.chunk_id, start_seconds, end_seconds, {_IOU} AS score,
  row_number() OVER (PARTITION BY q.qa_uid ORDER BY {_IOU} DESC, w.chunk_id) AS rank FROM ({_VA}) q JOIN ({_VC}) w USING (video_id)
  WHERE kind = 'range' AND greatest(a, start_seconds) < least(b, end_seconds)) WHERE rank <= 5
UNION ALL SELECT qa_uid, video_id, 'temporal', rank, chunk_id, start_seconds, end_seconds, score FROM (SELECT q.qa_uid, q.video_id, w.chunk_id, start_seconds, end_seconds, {_PSCORE} AS score,
  row_number() OVER (PARTITION BY q.qa_uid ORDER BY {_PSCORE} DESC, w.chunk_id) AS rank FROM ({_VA}) q JOIN ({_VC}) w USING (video_id) WHERE kind = 'point') WHERE rank <= 5
UNION ALL SELECT t.qa_uid, e.label, 'visual', rank, chunk_id, chunk_id * 30.0::DOUBLE, chunk_id * 30.0::DOUBLE + 30, score FROM ({_top_sql('q.label = x.label')}) t
  JOIN embeddings e ON e.vec_id = t.qa_uid WHERE t.qa_uid % 3 = 2"""


def hybrid(spark, sf_dir):
    text = F.expr(
        "CASE vec_id % 3 WHEN 0 THEN concat('Seen from second ', vec_id * 30, ' to second ', vec_id * 30 + 50, '?') "
        "WHEN 1 THEN concat('Seen near ', vec_id * 30 + 7, ' s?') ELSE 'What is shown?' END"
    )
    q = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qa_uid"), F.col("label").alias("video_id"), text.alias("question"), F.col("embedding").cast("array<double>").alias("vec")
    )
    return retrieve.retrieve_hybrid(q, index_rows(spark, sf_dir), 5)


@query("hybrid_retrieval", f"SELECT qa_uid, route, rank, chunk_id, round(score, 6) AS score FROM ({HYBRID_SQL})")
def hybrid_retrieval(spark, sf_dir):
    _, hits = hybrid(spark, sf_dir)
    return hits.select("qa_uid", "route", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("route_counts", f"SELECT CASE WHEN kind IS NULL THEN 'visual' ELSE 'temporal' END AS route, count(*) AS questions FROM ({_VA}) GROUP BY 1")
def route_counts(spark, sf_dir):
    asked, _ = hybrid(spark, sf_dir)
    return retrieve.route_counts(asked)


@query(
    "assembled_evidence",
    f"""SELECT q.qa_uid, CASE WHEN kind IS NULL THEN 'visual' ELSE 'temporal' END AS route, CASE WHEN kind = 'range' THEN 1 ELSE n END AS entries,
        CASE WHEN kind = 'range' THEN 'temporal_' || video_id || '_' || printf('%.3f', a) || '_' || printf('%.3f', b) ELSE first_id END AS chunk_id,
        CASE WHEN kind = 'range' THEN ids ELSE '' END AS chunk_ids, round(top, 6) AS score
        FROM ({_VA}) q JOIN (SELECT qa_uid, count(*) AS n, string_agg(chunk_id, ',' ORDER BY rank) AS ids, max(score) AS top,
        CAST(min(chunk_id) FILTER (rank = 1) AS VARCHAR) AS first_id FROM ({HYBRID_SQL}) GROUP BY 1) h USING (qa_uid)""",
)
def assembled_evidence(spark, sf_dir):
    out = retrieve.assemble_evidence(*hybrid(spark, sf_dir))
    first = F.try_element_at("evidence", F.lit(1))
    return out.select(
        "qa_uid", "route", F.size("evidence").alias("entries"), first["chunk_id"].alias("chunk_id"),
        F.array_join(first["chunk_ids"], ",").alias("chunk_ids"), F.round(first["score"], 6).alias("score"),
    )


@query(
    "extractive_answers",
    f"""SELECT q.qa_uid, CASE WHEN h.qa_uid IS NULL THEN '未检索到与问题相关的视频证据。' ELSE '根据最相关视频片段（' || printf('%.1f', start_seconds) || 's–' || printf('%.1f', end_seconds) ||
        's），需要由医学语言模型结合该片段内容给出最终回答。' END AS prediction FROM ({_VQ}) q LEFT JOIN (SELECT * FROM ({HYBRID_SQL}) WHERE rank = 1) h USING (qa_uid)""",
)
def extractive_answers(spark, sf_dir):
    asked, hits = hybrid(spark, sf_dir)
    return retrieve.extractive_answers(asked, hits).select("qa_uid", "prediction")


@query("question_only_control", "SELECT vec_id AS qa_uid, 'question_only' AS route, 0 AS entries FROM embeddings")
def question_only_control(spark, sf_dir):
    out = retrieve.question_only(query_rows(spark, sf_dir))
    return out.select("qa_uid", "route", F.size("evidence").alias("entries"))
