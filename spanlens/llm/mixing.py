"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.common import WORD_RE, staged

SLICE_ROWS = 4_000


def word_count(text: Column) -> Column:
    """Words of a text, null counting none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def water_level(sources: DataFrame, total: float, max_epochs: float) -> float | None:
    """The level L at which the shares min(max_epochs * size, weight * L) add up to ``total``.

    Starts with all sources open. Those whose share would pass their cap are clamped and the excess is dealt
    to the others by weight, until none passes. A clamped source stays clamped as the level only rises; each
    round is one aggregate of three numbers. None: every source is clamped.
    """
    cap, weight = F.col("source_size") * max_epochs, F.col("weight")
    level, clamped = 0.0, -1
    while True:
        shut = (cap < weight * F.lit(level)) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.coalesce(F.sum(F.when(shut, cap)), F.lit(0.0)).alias("filled"),
            F.coalesce(F.sum(F.when(~shut, weight)), F.lit(0)).alias("open"),
            F.coalesce(F.sum(shut.cast("int")), F.lit(0)).alias("clamped"),
        ).first()
        if not row["open"]:
            return None
        if row["clamped"] == clamped:
            return level
        clamped, level = row["clamped"], (total - row["filled"]) / float(row["open"])


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, weight, target of each source: weights repeat over the sources in order of code points, null last.

    Ranking and targets work on one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    sources = staged(sources.withColumn("weight", F.get(cycle, rank % len(weights)).cast("bigint")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * share, max_epochs)
    cap = F.col("source_size") * max_epochs
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", target.cast("double"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """key, source, size, source_size, target, repeats, taken of each document; ``taken`` words go into the mix.

    Sizes are words. All documents of a source are taken ``repeats`` whole times, and in a seeded order once
    more until the rest of the target is used up; the document on the border gives its first words only, so
    a source's taken words equal its target rounded to a word. The order is the digest of seed and key, so
    reruns agree whatever the layout.

    The order is never sorted as a whole: digests cut each source into slices of about 4,000 rows, slice
    sums find the one slice on the border, and only that slice is sorted. A hot source has more slices, not
    larger ones. Source totals and slice sums come from partial aggregates.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Null keys share one place in
    the order. Repeated rows all count; those with one key follow each other by size. A source of size 0
    gets target 0. No rows: no rows. Other columns are not read.
    """
    sized = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    sized = staged(sized.withColumn("place", digest), "sizes")
    targets = source_targets(sized, weights, share, max_epochs)
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_epochs)))).otherwise(F.lit(0))
    targets = targets.withColumn("repeats", repeats.cast("bigint"))
    targets = targets.withColumn("extra", F.round("target").cast("bigint") - F.col("repeats") * F.col("source_size"))
    n_slices = max(1, sized.count() // SLICE_ROWS)
    unit = F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint")
    sized = sized.withColumn("slice", F.floor(unit * n_slices / float(2**32)))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    # The slice in which the extra words run out; one row per source.
    limits = targets.select(F.col("source").alias("s"), "source_size", "target", "repeats", "extra")
    border = slices.join(limits.select("s", "extra"), F.col("source").eqNullSafe(F.col("s")))
    border = border.where(F.col("before") < F.col("extra")).groupBy("s").agg(F.max_by(F.struct("slice", "before"), "slice").alias("border"))
    limits = limits.join(border.select(F.col("s").alias("b"), "border"), F.col("s").eqNullSafe(F.col("b")), "left").drop("b")
    limits = staged(limits, "limits")
    placed = sized.join(limits, F.col("source").eqNullSafe(F.col("s")))
    on_border = F.coalesce(F.col("slice") == F.col("border.slice"), F.lit(False))
    inside = Window.partitionBy("source", "slice").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("border.before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = placed.where(on_border).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - ahead)))
    whole = placed.where(~on_border).withColumn("more", F.when(F.coalesce(F.col("slice") < F.col("border.slice"), F.lit(False)), F.col("size")).otherwise(F.lit(0)))
    both = whole.unionByName(cut)
    taken = (F.col("repeats") * F.col("size") + F.col("more")).cast("bigint")
    return both.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "repeats", taken.alias("taken"))
