"""Windows, samples and clip plans over documents as recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.catalog import query
from spanlens.catalog.inputs import recordings, table
from spanlens.functions.rules import once
from spanlens.operators import checks, windows
from spanlens.sources import frames

_VIDEOS = "SELECT doc_id AS video_id, CAST(n_chars AS DOUBLE) AS d FROM documents WHERE n_chars > 0"


def windows_sql(window: int, stride: int) -> str:
    return f"""
SELECT video_id, i AS window_index, CAST(i * {stride} AS DOUBLE) AS start_seconds,
       least(CAST(i * {stride} + {window} AS DOUBLE), d) AS end_seconds
FROM (SELECT video_id, d, unnest(generate_series(0, CAST(ceil(d / {stride}) AS BIGINT) - 1)) AS i FROM ({_VIDEOS}))"""


def _windows(window: int, stride: int):
    def run(spark, sf_dir):
        out = windows.time_windows(recordings(spark, sf_dir), window, stride)
        return out.select("video_id", "window_index", "start_seconds", "end_seconds")

    return run


for _name, _w, _s in (("time_windows_tumbling", 30, 30), ("time_windows_sliding", 60, 20), ("time_windows_gapped", 20, 50)):
    query(_name, windows_sql(_w, _s))(_windows(_w, _s))


@query(
    "window_chunks",
    f"""SELECT CAST(video_id AS VARCHAR) || '_' || lpad(CAST(window_index AS VARCHAR), 5, '0') AS chunk_id, video_id,
        start_seconds, end_seconds, 8 AS expected_frames FROM ({windows_sql(30, 30)})""",
)
def window_chunks(spark, sf_dir):
    out = windows.window_chunks(windows.time_windows(recordings(spark, sf_dir)))
    return out.select("chunk_id", "video_id", "start_seconds", "end_seconds", "expected_frames")


@query(
    "sample_target_frames",
    f"""SELECT video_id, frame_number, chunk_index, sample_index FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY chunk_index DESC, sample_index DESC) AS rn
        FROM (SELECT video_id, window_index AS chunk_index, j AS sample_index,
              CAST(round_even((start_seconds + (end_seconds - start_seconds) * (j + 0.5::DOUBLE) / 8) * 0.5::DOUBLE, 0) AS BIGINT) AS frame_number
              FROM ({windows_sql(60, 40)}), (SELECT unnest(generate_series(0, 7)) AS j))) WHERE rn = 1""",
)
def sample_target_frames(spark, sf_dir):
    out = windows.time_windows(recordings(spark, sf_dir), 60, 40)
    return windows.sample_targets(out, F.lit(0.5), 8)


_FIXED = f"""SELECT video_id, d, greatest(1, CAST(ceil(d * 1.0) AS BIGINT)) AS desired, greatest(1, CAST(ceil(d * 1.0) AS BIGINT)) AS sampled,
    'fixed_rate' AS mode, false AS capped FROM ({_VIDEOS})"""
_CAPPED = f"""SELECT video_id, d, desired, least(greatest(desired, 128), 7200) AS sampled, 'capped' AS mode, desired > 7200 AS capped
    FROM (SELECT video_id, d, greatest(2, CAST(round_even(d * 2.5::DOUBLE / 2, 0) AS BIGINT) * 2) AS desired FROM ({_VIDEOS}))"""


def _plan_sql(base: str) -> str:
    return f"""SELECT video_id, desired AS desired_sampled_frames, sampled AS sampled_frames, mode AS sampling_mode, capped AS sampling_capped,
    round(sampled / d, 9) AS effective_fps, sampled >= 1280 AS meets_min_frames,
    CASE WHEN sampled < 1280 THEN 'requires_1280_sampled_frames' END AS skip_reason FROM ({base})"""


def _clip_sql(base: str, step: str) -> str:
    return f"""SELECT CAST(video_id AS VARCHAR) || '_clip_' || lpad(CAST(a // 64 AS VARCHAR), 5, '0') AS clip_id, video_id, a // 64 AS clip_index,
    CAST(printf('%.3f', a * step) AS DOUBLE) AS start_seconds, CAST(printf('%.3f', least(d, b * step)) AS DOUBLE) AS end_seconds,
    a AS sample_start_index, b AS sample_end_index, b - a AS sampled_frame_count, b - a < 64 AS is_partial
    FROM (SELECT *, least(a + 64, sampled) AS b, {step} AS step FROM
      (SELECT *, unnest(generate_series(0, sampled - 1, 64)) AS a FROM ({base})))"""


def plans(spark, sf_dir, mode: str):
    fps = 1.0 if mode == "fixed_rate" else 2.5
    return windows.plan_clips(recordings(spark, sf_dir), mode, fps)


def _plan(mode):
    def run(spark, sf_dir):
        return plans(spark, sf_dir, mode).select(
            "video_id",
            "desired_sampled_frames",
            "sampled_frames",
            "sampling_mode",
            "sampling_capped",
            F.round("effective_fps", 9).alias("effective_fps"),
            "meets_min_frames",
            "skip_reason",
        )

    return run


_CLIP_COLUMNS = [
    "clip_id", "video_id", "clip_index", "start_seconds", "end_seconds", "sample_start_index", "sample_end_index",
    "sampled_frame_count", "is_partial",
]


def _clips(mode):
    def run(spark, sf_dir):
        return windows.clips_of_plans(plans(spark, sf_dir, mode)).select(*_CLIP_COLUMNS)

    return run


query("clip_plans_fixed_rate", _plan_sql(_FIXED))(_plan("fixed_rate"))
query("clip_plans_capped", _plan_sql(_CAPPED))(_plan("capped"))
FIXED_CLIPS_SQL = _clip_sql(_FIXED, "1.0::DOUBLE")
query("clips_fixed_rate", FIXED_CLIPS_SQL)(_clips("fixed_rate"))
query("clips_capped", _clip_sql(_CAPPED, "d / sampled"))(_clips("capped"))


@query(
    "clips_without_partial_tail",
    f"SELECT clip_id, video_id, clip_index, end_seconds FROM ({FIXED_CLIPS_SQL}) WHERE NOT is_partial",
)
def clips_without_partial_tail(spark, sf_dir):
    out = windows.clips_of_plans(plans(spark, sf_dir, "fixed_rate"), include_partial=False)
    return out.select("clip_id", "video_id", "clip_index", "end_seconds")


@query(
    "clip_plan_summary",
    f"""SELECT v.*, c.* FROM (SELECT count(*) AS videos, count(*) FILTER (sampled >= 1280) AS meets_min_frames,
        count(*) FILTER (sampled < 1280) AS below_min_frames, count(*) FILTER (capped) AS sampling_capped, 'capped' AS sampling_modes,
        'annotation_duration_only' AS validation_level, round(min(sampled / d), 5) AS fps_min, round(avg(sampled / d), 5) AS fps_mean,
        round(max(sampled / d), 5) AS fps_max FROM ({_CAPPED})) v,
        (SELECT count(*) AS clips, count(*) FILTER (is_partial) AS partial_clips, round(min(end_seconds - start_seconds), 5) AS clip_min,
        round(avg(end_seconds - start_seconds), 5) AS clip_mean, round(max(end_seconds - start_seconds), 5) AS clip_max
        FROM ({_clip_sql(_CAPPED, 'd / sampled')})) c""",
)
def clip_plan_summary(spark, sf_dir):
    p = plans(spark, sf_dir, "capped")
    out = windows.plan_summary(p, windows.clips_of_plans(p))
    five = {"fps_min", "fps_mean", "fps_max", "clip_min", "clip_mean", "clip_max"}
    return out.select(*[F.round(c, 5).alias(c) if c in five else F.col(c) for c in out.columns])


@query(
    "native_sample_frames",
    """SELECT video_id, (i // 16) AS clip_index, i % 16 AS local_index, i AS sample_index,
       least(total - 1, CAST(floor((i + 0.5::DOUBLE) / 0.125::DOUBLE * 2.0::DOUBLE) AS BIGINT)) AS native_frame
       FROM (SELECT doc_id AS video_id, n_chars * 2 - 3 AS total,
             unnest(generate_series(0, greatest(1, CAST(ceil(n_chars * 0.125::DOUBLE) AS BIGINT)) - 1)) AS i FROM documents WHERE n_chars > 0)""",
)
def native_sample_frames(spark, sf_dir):
    videos = recordings(spark, sf_dir)
    clips = windows.clips_of_plans(windows.plan_clips(videos, sample_fps=0.125, frames_per_clip=16))
    native = videos.select(
        "video_id", F.lit(2.0).alias("native_fps"), (F.col("duration_seconds") * 2 - 3).cast("long").alias("total_native_frames")
    )
    return windows.native_frames(clips, native, 0.125)


@query(
    "duration_split",
    "SELECT doc_id AS video_id, n_chars - 500 > 0 AS usable FROM documents",
)
def duration_split(spark, sf_dir):
    videos = recordings(spark, sf_dir).withColumn("duration_seconds", F.col("duration_seconds") - 500)
    good, bad = windows.with_duration(videos)
    return good.select("video_id", F.lit(True).alias("usable")).unionByName(bad.select("video_id", F.lit(False).alias("usable")))


def _with_frames(clips):
    # Joined from pieces: a format is parsed again for every frame. Numbers of more digits keep them.
    digits = lambda i: F.lpad(i.cast("string"), F.greatest(F.lit(3), F.length(i.cast("string"))), F.lit("0"))
    listed = F.sequence(F.lit(0).cast("long"), F.col("sampled_frame_count") - 1)
    # The clip id is a format itself, so it is made once for all frames of a clip.
    names = once(F.concat(F.col("clip_id"), F.lit("/frame_")), lambda head: F.transform(listed, lambda i: F.concat(head, digits(i), F.lit(".jpg"))))
    return clips.withColumn("frame_paths", names)


@query(
    "even_clip_selection",
    f"""WITH full_clips AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY clip_index) - 1 AS pos,
            count(*) OVER (PARTITION BY video_id) AS n FROM ({FIXED_CLIPS_SQL}) WHERE sampled_frame_count = 64)
        SELECT video_id, j AS selection_index, clip_index, NULL AS reason FROM full_clips, (SELECT unnest(generate_series(0, 9)) AS j)
        WHERE n >= 10 AND pos = CAST(round_even(j * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT)
        UNION ALL SELECT DISTINCT video_id, NULL, NULL, 'too_few_clips' FROM full_clips WHERE n < 10""",
)
def even_clip_selection(spark, sf_dir):
    clips = _with_frames(windows.clips_of_plans(plans(spark, sf_dir, "fixed_rate")))
    chosen, short = windows.select_even_clips(windows.full_clips(clips), 10)
    chosen = chosen.select("video_id", "selection_index", "clip_index", F.lit(None).cast("string").alias("reason"))
    return chosen.unionByName(short.select("video_id", "reason"), allowMissingColumns=True)


@query(
    "indexed_clip_selection",
    f"""SELECT w.video_id, w.selection_index, w.clip_index,
        CASE WHEN c.clip_id IS NULL THEN 'not_in_manifest' WHEN c.sampled_frame_count <> 64 THEN 'not_a_complete_clip' ELSE 'selected' END AS status
        FROM (SELECT DISTINCT video_id, j AS selection_index, [4, 0, 2][j + 1] AS clip_index
              FROM ({FIXED_CLIPS_SQL}), (SELECT unnest(generate_series(0, 2)) AS j)) w
        LEFT JOIN ({FIXED_CLIPS_SQL}) c ON c.video_id = w.video_id AND c.clip_index = w.clip_index""",
)
def indexed_clip_selection(spark, sf_dir):
    clips = _with_frames(windows.clips_of_plans(plans(spark, sf_dir, "fixed_rate")))
    good, bad = windows.select_clips_by_index(clips, [4, 0, 2])
    cols = ["video_id", "selection_index", "clip_index"]
    return good.select(*cols, F.lit("selected").alias("status")).unionByName(bad.select(*cols, F.col("reason").alias("status")))


@query(
    "request_frames",
    f"""SELECT clip_id, 64 AS request_frames, CASE WHEN sampled_frame_count < 64 THEN 64 - sampled_frame_count ELSE 0 END AS padding_frames,
        clip_id || '/frame_' || lpad(CAST(sampled_frame_count - 1 AS VARCHAR), 3, '0') || '.jpg' AS last_frame,
        CASE WHEN sampled_frame_count = 1 THEN clip_id || '/frame_000.jpg'
             ELSE array_to_string(list_transform(generate_series(0, least(4, sampled_frame_count) - 1), lambda i: clip_id || '/frame_' ||
               lpad(CAST(CAST(round_even(i * (sampled_frame_count - 1) / CAST(least(4, sampled_frame_count) - 1 AS DOUBLE), 0) AS BIGINT) AS VARCHAR), 3, '0') || '.jpg'), ',')
        END AS sampled FROM ({FIXED_CLIPS_SQL})""",
)
def request_frames(spark, sf_dir):
    clips = _with_frames(windows.clips_of_plans(plans(spark, sf_dir, "fixed_rate")))
    padded = clips.withColumn("_padded", windows.pad_frames(F.col("frame_paths"), F.col("is_partial")))
    return padded.select(
        "clip_id",
        F.size("_padded").alias("request_frames"),
        (F.size("_padded") - F.size("frame_paths")).alias("padding_frames"),
        F.element_at("_padded", -1).alias("last_frame"),
        F.array_join(windows.uniform_sample(F.col("frame_paths"), 4), ",").alias("sampled"),
    )


@query("clip_plan_violations", f"SELECT video_id, clip_id, ['duration'] AS violations FROM ({_clip_sql(_CAPPED, 'd / sampled')}) WHERE end_seconds <= start_seconds")
def clip_plan_violations(spark, sf_dir):
    return checks.clip_plan_violations(windows.clips_of_plans(plans(spark, sf_dir, "capped")))


@query(
    "video_plan_violations",
    """SELECT doc_id AS video_id, ['duration_or_rate'] AS violations FROM documents WHERE n_chars % 50 = 0""",
)
def video_plan_violations(spark, sf_dir):
    # Every fiftieth length is turned negative after planning, to have something to find.
    p = plans(spark, sf_dir, "fixed_rate")
    broken = F.when(F.col("duration_seconds") % 50 == 0, -1.0).otherwise(F.col("duration_seconds"))
    return checks.video_plan_violations(p.withColumn("duration_seconds", broken))


def _event_frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 100").alias("video_id"),
        F.expr("event_id % 100").alias("position"),
        F.expr("concat('f', event_id, '.jpg')").alias("path"),
        "value",
        "event_id",
    )


@query(
    "frames_regrouped",
    """SELECT video_id, chunk_index, array_to_string(list(path ORDER BY event_id), ',') AS frames FROM (
       SELECT event_id, event_id // 100 AS video_id, (event_id % 100) // 8 AS chunk_index, 'f' || event_id || '.jpg' AS path FROM events)
       WHERE chunk_index < 10 GROUP BY 1, 2""",
)
def frames_regrouped(spark, sf_dir):
    f = _event_frames(spark, sf_dir)
    counts = f.select("video_id").distinct().withColumn("chunk_count", F.lit(10))
    out = frames.regroup_into_chunks(f, counts, 8)
    return out.select("video_id", "chunk_index", F.array_join("frame_paths", ",").alias("frames"))


_DECODES = """SELECT event_id // 100 AS video_id, event_id, event_id % 9 AS p, (event_id * 7) % 11 AS f FROM events"""


def _decodes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    paths = lambda n: F.expr(f"CASE WHEN {n} = 0 THEN CAST(array() AS array<string>) ELSE array_repeat('x', CAST({n} AS INT)) END")
    rows = lambda n: e.select(F.expr("event_id div 100").alias("video_id"), F.col("event_id").alias("chunk_id"), paths(n).alias("frame_paths"))
    return rows("event_id % 9"), rows("(event_id * 7) % 11")


@query(
    "decoder_choice",
    f"""SELECT video_id, CASE WHEN taken THEN 'fallback' ELSE 'primary' END AS decoder, round(CASE WHEN taken THEN fr ELSE pr END, 9) AS incomplete_ratio
        FROM (SELECT *, pr >= 0.5 AND fr < pr AS taken FROM (SELECT video_id, avg(CASE WHEN p < 8 THEN 1.0 ELSE 0 END) AS pr,
              avg(CASE WHEN f < 8 THEN 1.0 ELSE 0 END) AS fr FROM ({_DECODES}) GROUP BY 1))""",
)
def decoder_choice(spark, sf_dir):
    primary, fallback = _decodes(spark, sf_dir)
    out = frames.decoder_choice(primary, fallback, 8, 0.5)
    return out.withColumn("incomplete_ratio", F.round("incomplete_ratio", 9))


@query(
    "decode_summary",
    f"""SELECT video_id, CASE WHEN taken THEN 'fallback' ELSE 'primary' END AS decoder,
        CAST(CASE WHEN taken THEN f ELSE p END AS BIGINT) AS decoded_sampled_frames,
        round((800 - CASE WHEN taken THEN f ELSE p END) / 800.0::DOUBLE, 9) AS incomplete_ratio, CAST(5 AS DOUBLE) AS duration_delta_seconds
        FROM (SELECT *, (800 - p) / 800.0 >= 0.01 AND f > p AS taken FROM
              (SELECT video_id, sum(p) AS p, sum(f) AS f FROM ({_DECODES}) GROUP BY 1))""",
)
def decode_summary(spark, sf_dir):
    primary, fallback = _decodes(spark, sf_dir)
    expected = primary.select("video_id").distinct().select(
        "video_id", F.lit(800).alias("expected_frames"), F.lit(105.0).alias("duration_seconds"), F.lit(100.0).alias("annotation_duration_seconds")
    )
    out = frames.decode_summary(expected, primary, fallback, 0.01)
    return out.withColumn("incomplete_ratio", F.round("incomplete_ratio", 9))


_LISTED = """SELECT event_id // 100 AS video_id, event_id // 10 AS chunk_id, 'f' || event_id || '.jpg' AS path, event_id,
             event_id % 4 = 0 OR (event_id // 10) % 7 = 0 AS missing FROM events"""


def _listed(spark, sf_dir):
    """Chunks of ten listed frames, and an inventory in which some frames are missing."""
    e = table(spark, sf_dir, "events")
    chunks = e.groupBy(F.expr("event_id div 100").alias("video_id"), F.expr("event_id div 10").alias("chunk_id")).agg(
        F.expr("transform(array_sort(collect_list(event_id)), x -> concat('f', x, '.jpg'))").alias("frame_paths")
    )
    there = e.filter("NOT (event_id % 4 = 0 OR (event_id div 10) % 7 = 0)").select(F.expr("concat('f', event_id, '.jpg')").alias("path"))
    return chunks, there


@query(
    "chunks_with_existing_frames",
    f"""SELECT chunk_id, video_id, array_to_string(list(path ORDER BY event_id) FILTER (NOT missing), ',') AS frames,
        CASE WHEN count(*) FILTER (NOT missing) = 0 THEN 'no_existing_decodable_frames' END AS reason FROM ({_LISTED}) GROUP BY 1, 2""",
)
def chunks_with_existing_frames(spark, sf_dir):
    chunks, there = _listed(spark, sf_dir)
    kept, audit = frames.keep_existing_frames(chunks, there)
    left = kept.select("chunk_id", "video_id", F.array_join("frame_paths", ",").alias("frames"), F.lit(None).cast("string").alias("reason"))
    return left.unionByName(audit.select("chunk_id", "video_id", F.lit(None).cast("string").alias("frames"), "reason"))


@query("missing_frames", f"SELECT video_id, chunk_id, path FROM ({_LISTED}) WHERE missing")
def missing_frames(spark, sf_dir):
    chunks, there = _listed(spark, sf_dir)
    return frames.missing_frames(chunks, there).select("video_id", "chunk_id", "path")


@query(
    "frame_cache_complete",
    f"SELECT video_id, bool_and(ok) AS complete FROM (SELECT video_id, chunk_id, count(*) = 10 AND bool_and(NOT missing) AS ok FROM ({_LISTED.replace('event_id % 4 = 0 OR ', '')}) GROUP BY 1, 2) GROUP BY 1",
)
def frame_cache_complete(spark, sf_dir):
    chunks, _ = _listed(spark, sf_dir)
    there = table(spark, sf_dir, "events").filter("NOT ((event_id div 10) % 7 = 0)").select(F.expr("concat('f', event_id, '.jpg')").alias("path"))
    clips = chunks.withColumnRenamed("chunk_id", "clip_id").withColumn("sampled_frame_count", F.lit(10))
    return frames.cache_complete(clips, there)
