"""Time windows and clip plans over whole recordings, from their durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.numeric import exact_round, half_even, ratio
from spanlens.functions.text import safe_key
from spanlens.plans.ordered import with_position


def with_duration(videos: DataFrame, duration: str = "duration_seconds") -> tuple[DataFrame, DataFrame]:
    """Recordings with a positive duration, and the rest."""
    ok = F.coalesce(F.col(duration) > 0, F.lit(False))
    return videos.filter(ok), videos.filter(~ok)


def time_windows(
    videos: DataFrame, window_seconds: float = 30.0, stride_seconds: float = 30.0, duration: str = "duration_seconds"
) -> DataFrame:
    """One row per window over [0, duration): tumbling, sliding or gapped by the stride; the short tail stays."""
    if window_seconds <= 0 or stride_seconds <= 0:
        raise ValueError("window and stride must be positive")
    total = F.col(duration).cast("double")
    last = F.ceil(total / F.lit(float(stride_seconds))) - 1
    spread = videos.filter(total > 0).withColumn("window_index", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("window_index") * F.lit(float(stride_seconds))
    return (
        spread.withColumn("start_seconds", start)
        .filter(F.col("start_seconds") < total)
        .withColumn("end_seconds", F.least(F.col("start_seconds") + F.lit(float(window_seconds)), total))
    )


def window_chunks(windows: DataFrame, frames_per_chunk: int = 8) -> DataFrame:
    """Chunk rows with padded ids and bounds at three places."""
    return windows.select(
        F.format_string("%s_%05d", F.col("video_id").cast("string"), F.col("window_index")).alias("chunk_id"),
        "video_id",
        exact_round("start_seconds", 3).alias("start_seconds"),
        exact_round("end_seconds", 3).alias("end_seconds"),
        F.lit(max(1, frames_per_chunk)).alias("expected_frames"),
        F.col("window_index").alias("ord"),
    )


def sample_targets(windows: DataFrame, fps: Column, frames_per_chunk: int = 8) -> DataFrame:
    """Native frame of each centred sample; where samples share a frame, the latest one owns it."""
    n = max(1, frames_per_chunk)
    samples = windows.select(
        "video_id",
        F.col("window_index").alias("chunk_index"),
        "start_seconds",
        "end_seconds",
        fps.cast("double").alias("_fps"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_index"),
    )
    stamp = F.col("start_seconds") + (F.col("end_seconds") - F.col("start_seconds")) * (F.col("sample_index") + 0.5) / n
    # The owner is one number, chunk before sample: a struct of both would be sorted instead of hashed.
    owner = F.col("chunk_index") * F.lit(n) + F.col("sample_index")
    return (
        samples.withColumn("frame_number", half_even(stamp * F.col("_fps")))
        .groupBy("video_id", "frame_number")
        .agg(F.max(owner).alias("_owner"))
        .select(
            "video_id",
            "frame_number",
            F.expr(f"(_owner - pmod(_owner, {n})) div {n}").alias("chunk_index"),
            F.expr(f"CAST(pmod(_owner, {n}) AS INT)").alias("sample_index"),
        )
    )


def plan_clips(
    videos: DataFrame,
    mode: str = "fixed_rate",
    sample_fps: float = 1.0,
    frames_per_clip: int = 64,
    min_sampled_frames: int = 128,
    max_sampled_frames: int = 7200,
    frame_factor: int = 2,
    n_retrieval: int = 20,
    duration: str = "duration_seconds",
) -> DataFrame:
    """Sampling plan per recording.

    ``fixed_rate`` keeps the rate and has no cap; ``capped`` rounds the count to a multiple of
    ``frame_factor`` and clamps it to the given range.
    """
    if mode not in ("fixed_rate", "capped"):
        raise ValueError("mode must be fixed_rate or capped")
    if min(sample_fps, frames_per_clip, min_sampled_frames, max_sampled_frames, frame_factor, n_retrieval) <= 0:
        raise ValueError("rates and counts must be positive")
    if min_sampled_frames > max_sampled_frames or min_sampled_frames % frame_factor or max_sampled_frames % frame_factor:
        raise ValueError("sample bounds must be ordered multiples of frame_factor")
    total = F.col(duration).cast("double")
    wanted = total * F.lit(float(sample_fps))
    if mode == "fixed_rate":
        desired = F.greatest(F.lit(1).cast("long"), F.ceil(wanted))
        sampled = F.col("desired_sampled_frames")
        capped = F.lit(False)
    else:
        desired = F.greatest(F.lit(frame_factor).cast("long"), half_even(wanted / frame_factor) * frame_factor)
        sampled = F.least(F.greatest(F.col("desired_sampled_frames"), F.lit(min_sampled_frames)), F.lit(max_sampled_frames))
        capped = F.col("desired_sampled_frames") > max_sampled_frames
    minimum = frames_per_clip * n_retrieval
    return (
        videos.filter(total > 0)
        .withColumn("desired_sampled_frames", desired)
        .withColumn("sampled_frames", sampled.cast("long"))
        .withColumn("sampling_mode", F.lit(mode))
        .withColumn("target_fps", F.lit(float(sample_fps)))
        .withColumn("frames_per_clip", F.lit(frames_per_clip))
        .withColumn("effective_fps", F.col("sampled_frames") / total)
        .withColumn("sampling_capped", capped)
        .withColumn("meets_min_frames", F.col("sampled_frames") >= minimum)
        .withColumn("skip_reason", F.when(F.col("sampled_frames") < minimum, F.lit(f"requires_{minimum}_sampled_frames")))
    )


def clips_of_plans(
    plans: DataFrame, include_partial: bool = True, id_format: str = "%s_clip_%05d", duration: str = "duration_seconds"
) -> DataFrame:
    """Clips of a plan: consecutive sample groups with their time bounds at three places."""
    n = F.col("frames_per_clip")
    per_sample = F.when(F.col("sampling_mode") == "fixed_rate", 1.0 / F.col("target_fps")).otherwise(
        F.col(duration) / F.col("sampled_frames")
    )
    rows = plans.withColumn(
        "sample_start_index",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("sampled_frames") - 1, n.cast("long"))),
    ).withColumn("_step", per_sample)
    rows = rows.withColumn("sample_end_index", F.least(F.col("sample_start_index") + n, F.col("sampled_frames")))
    rows = rows.withColumn("sampled_frame_count", F.col("sample_end_index") - F.col("sample_start_index"))
    rows = rows.withColumn("is_partial", F.col("sampled_frame_count") < n)
    if not include_partial:
        rows = rows.filter(~F.col("is_partial"))
    rows = rows.withColumn("clip_index", F.floor(F.col("sample_start_index") / n).cast("long"))
    rows = rows.withColumn("_start", F.col("sample_start_index") * F.col("_step")).withColumn(
        "_end", F.least(F.col(duration).cast("double"), F.col("sample_end_index") * F.col("_step"))
    )
    return rows.select(
        F.format_string(id_format, F.col("video_id").cast("string"), F.col("clip_index")).alias("clip_id"),
        "video_id",
        "clip_index",
        exact_round("_start", 3).alias("start_seconds"),
        exact_round("_end", 3).alias("end_seconds"),
        "sample_start_index",
        "sample_end_index",
        "sampled_frame_count",
        exact_round("effective_fps", 6).alias("effective_fps"),
        "is_partial",
    )


def plan_summary(plans: DataFrame, clips: DataFrame) -> DataFrame:
    """One row of counts and distributions over plans and clips."""
    sources = F.sort_array(F.collect_set("planning_source")) if "planning_source" in plans.columns else None
    level = (
        F.lit("annotation_duration_only")
        if sources is None
        else F.when(F.size(sources) == 0, "empty").when(F.size(sources) == 1, sources[0]).otherwise("mixed")
    )
    spread = lambda c: [F.min(c), F.avg(c), F.max(c)]
    low, mean, high = spread(F.col("effective_fps"))
    by_video = plans.agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_if("meets_min_frames").alias("meets_min_frames"),
        F.count_if(~F.col("meets_min_frames")).alias("below_min_frames"),
        F.count_if("sampling_capped").alias("sampling_capped"),
        F.array_join(F.sort_array(F.collect_set("sampling_mode")), ",").alias("sampling_modes"),
        level.alias("validation_level"),
        low.alias("fps_min"),
        mean.alias("fps_mean"),
        high.alias("fps_max"),
    ).withColumn("_one", F.lit(1))
    low, mean, high = spread(F.col("end_seconds") - F.col("start_seconds"))
    by_clip = clips.agg(
        F.count(F.lit(1)).alias("clips"),
        F.count_if("is_partial").alias("partial_clips"),
        low.alias("clip_min"),
        mean.alias("clip_mean"),
        high.alias("clip_max"),
    ).withColumn("_one", F.lit(1))
    # Both sides are a single row, so this equi join pairs exactly one row with one.
    both = by_video.join(by_clip, "_one").drop("_one")
    rounded = ["fps_min", "fps_mean", "fps_max", "clip_min", "clip_mean", "clip_max"]
    return both.select(*[exact_round(c, 6).alias(c) if c in rounded else F.col(c) for c in both.columns])


def native_frames(clips: DataFrame, native: DataFrame, target_fps: float) -> DataFrame:
    """Native frame of every sample at a fixed rate; several samples may use the same frame.

    ``native`` has (video_id, native_fps, total_native_frames).
    """
    rows = clips.join(native, "video_id").select(
        "video_id",
        "clip_index",
        "sample_start_index",
        "native_fps",
        "total_native_frames",
        F.explode(F.sequence(F.col("sample_start_index"), F.col("sample_end_index") - 1)).alias("sample_index"),
    )
    stamp = (F.col("sample_index") + 0.5) / F.lit(float(target_fps))
    frame = F.least(F.col("total_native_frames") - 1, F.floor(stamp * F.col("native_fps")).cast("long"))
    return rows.select(
        "video_id",
        "clip_index",
        (F.col("sample_index") - F.col("sample_start_index")).cast("int").alias("local_index"),
        "sample_index",
        frame.alias("native_frame"),
    )


def frame_path(root: Column, clip_index: Column, local_index: Column, video_id: Column) -> Column:
    """Target path of one extracted frame."""
    return F.concat(
        root, F.lit("/"), safe_key(video_id), F.format_string("/clip_%05d/frame_%03d.jpg", clip_index, local_index)
    )


def full_clips(clips: DataFrame, frames_per_request: int = 64) -> DataFrame:
    """Clips whose planned and listed frame counts both equal the request size."""
    return clips.filter(
        (F.col("sampled_frame_count") == frames_per_request) & (F.size("frame_paths") == frames_per_request)
    )


def even_positions(total: Column, count: int) -> Column:
    """Array of ``count`` evenly spread 0-based positions in ``total`` items; the middle one for 1."""
    if count == 1:
        return F.array(F.floor(total / 2).cast("long"))
    # The product is formed before the division, so exact halves stay exact.
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: half_even(i * (total - 1) / F.lit(float(count - 1)))
    )


def select_even_clips(eligible: DataFrame, count: int, order: str = "clip_index") -> tuple[DataFrame, DataFrame]:
    """``count`` clips per recording in even steps, and the recordings that have fewer, with their number.

    Positions come from a dense numbering inside each recording, which also knows how many clips it has.
    """
    if count <= 0:
        raise ValueError("count must be positive")
    numbered = with_position(eligible, "video_id", order, order, "_pos", total="_n").filter(F.col("_n") >= count)
    wanted = F.transform(
        even_positions(F.col("_n"), count), lambda p, i: F.struct(i.alias("selection_index"), p.alias("pos"))
    )
    here = F.filter(wanted, lambda w: w["pos"] == F.col("_pos"))
    chosen = numbered.withColumn("_w", F.explode(here)).select("*", F.col("_w.selection_index").alias("selection_index"))
    sizes = eligible.groupBy("video_id").agg(F.count(F.lit(1)).alias("clips"))
    short = sizes.filter(F.col("clips") < count).withColumn("reason", F.lit("too_few_clips"))
    columns = ["video_id", *[c for c in eligible.columns if c != "video_id"], "selection_index"]
    return chosen.select(*columns), short


def select_clips_by_index(clips: DataFrame, indices: list[int], frames_per_request: int = 64) -> tuple[DataFrame, DataFrame]:
    """Clips of an index list in list order, and the requests that cannot be met with the reason."""
    if not indices or frames_per_request <= 0:
        raise ValueError("indices must not be empty and frames_per_request must be positive")
    if len(set(indices)) != len(indices):
        raise ValueError("clip indices must be unique")
    wanted = (
        clips.select("video_id")
        .distinct()
        .select("video_id", F.posexplode(F.array(*[F.lit(i).cast("long") for i in indices])).alias("selection_index", "clip_index"))
    )
    # Only asked clips meet the requests: the frame lists of all others are not even made.
    asked = clips.filter(F.col("clip_index").isin(indices))
    found = wanted.join(asked, ["video_id", "clip_index"], "left")
    complete = (F.col("sampled_frame_count") == frames_per_request) & (F.size("frame_paths") == frames_per_request)
    judged = found.withColumn(
        "reason",
        F.when(F.col("sampled_frame_count").isNull(), "not_in_manifest").when(~complete, "not_a_complete_clip"),
    )
    bad = judged.filter(F.col("reason").isNotNull()).select("video_id", "selection_index", "clip_index", "reason")
    return judged.filter(F.col("reason").isNull()).drop("reason"), bad


def pad_frames(paths: Column, is_partial: Column, frames_per_request: int = 64) -> Column:
    """Request frame list: full clips as they are, a partial tail padded with its last frame, else null."""
    n = F.size(paths)
    padded = F.concat(paths, F.array_repeat(F.try_element_at(paths, F.lit(-1)), F.greatest(F.lit(0), frames_per_request - n)))
    return F.when(n == frames_per_request, paths).when(is_partial & (n > 0) & (n < frames_per_request), padded)


def uniform_sample(items: Column, count: int) -> Column:
    """Up to ``count`` items in even steps, ends included; the centre one for a single item."""

    def pick(k: Column) -> Column:
        spread = F.transform(
            F.sequence(F.lit(0), k - 1),
            lambda i: F.try_element_at(items, (half_even(i * (F.size(items) - 1) / (k - 1).cast("double")) + 1).cast("int")),
        )
        centre = F.array(F.try_element_at(items, (F.floor(F.size(items) / 2) + 1).cast("int")))
        return F.when(k <= 1, centre).otherwise(spread)

    return F.when(F.size(items) > 0, pick(F.least(F.lit(count), F.size(items))))


def incomplete_share(chunks: DataFrame, expected: int) -> DataFrame:
    """Share of chunks per recording with fewer frames than expected."""
    bad = F.count_if(F.size("frame_paths") < max(1, expected))
    return chunks.groupBy("video_id").agg(ratio(bad, F.count(F.lit(1))).alias("incomplete_ratio"))
