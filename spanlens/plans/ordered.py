"""Ordered passes over a key that may hold a large share of all rows.

A window over the whole key sorts it in one task. These functions cut the order into ranges, work
inside (key, range), and carry only one summary row per range from range to range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_WIDTH = 4096


def _ranges(df: DataFrame, key: str, order: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long"))


def with_previous(
    df: DataFrame, key: str, order: str, tie: str, payload: Sequence[str], out: str = "previous", width: int = RANGE_WIDTH
) -> DataFrame:
    """Add the payload of the preceding row of the key as a struct (null on the first row)."""
    inside = Window.partitionBy(key, "_range").orderBy(order, tie)
    body = _ranges(df, key, order, width)
    item = F.struct(*payload)
    local = body.withColumn("_local", F.lag(item).over(inside))
    edges = (
        body.groupBy(key, "_range")
        .agg(F.max_by(item, F.struct(order, tie)).alias("_last"))
        .select(key, "_range", F.lag("_last").over(Window.partitionBy(key).orderBy("_range")).alias("_carry"))
    )
    joined = local.join(edges, [key, "_range"], "left")
    return joined.withColumn(out, F.coalesce("_local", "_carry")).drop("_range", "_local", "_carry")


def with_position(
    df: DataFrame, key: str, order: str, tie: str, out: str = "position", width: int = RANGE_WIDTH, total: str | None = None
) -> DataFrame:
    """Add the dense position (from 0) of each row in its key, and with ``total`` the number of rows of the key."""
    inside = Window.partitionBy(key, "_range").orderBy(order, tie)
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    body = _ranges(df, key, order, width)
    offsets = (
        body.groupBy(key, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            key, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
            *([F.sum("_n").over(Window.partitionBy(key)).alias(total)] if total else []),
        )
    )
    numbered = body.withColumn("_rn", F.row_number().over(inside)).join(offsets, [key, "_range"])
    return numbered.withColumn(out, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_range", "_rn", "_before")


def capped_runs(
    df: DataFrame,
    key: str,
    order: str,
    tie: str,
    payload: Sequence[str],
    link: Callable[[Column, Column], Column],
    cap: int,
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Group consecutive rows of a key into runs of at most ``cap`` rows.

    ``link(previous, current)`` says whether two neighbours belong together; both arguments are payload
    structs. A run that reaches ``cap`` rows is closed and the next row opens a new one. Adds
    ``run_index`` (from 0 per key), ``run_position`` (from 0 per run), ``previous`` and ``joined``
    (the row continues the run of its predecessor).

    The head of a range (rows before its first break) continues whatever run came in; its run breaks
    depend only on the length carried in. So each range is summed up in one row, lengths and run counts
    are carried over those rows, and one join brings them back.
    """
    inside = Window.partitionBy(key, "_range").orderBy(order, tie)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    item = F.struct(*payload)
    step = F.lit(cap)

    def multiples(first: Column, last: Column) -> Column:
        """Run openings among chain positions first..last."""
        return F.floor(last / step) - F.floor((first - 1) / step)

    local = (
        _ranges(df, key, order, width)
        .withColumn("_item", item)
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn("_prev", F.lag("_item").over(inside))
        .withColumn("_break", (F.col("_rn") > 1) & ~F.coalesce(link(F.col("_prev"), F.col("_item")), F.lit(False)))
        .withColumn("_open", F.max(F.when(F.col("_break"), F.col("_rn"))).over(running))
        .withColumn("_start", F.col("_open").isNotNull() & ((F.col("_rn") - F.col("_open")) % step == 0))
        .withColumn("_starts", F.sum(F.col("_start").cast("int")).over(running))
    )
    place = F.struct(order, tie)
    summary = local.groupBy(key, "_range").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_item", place).alias("_first"),
        F.max_by("_item", place).alias("_last"),
        F.count_if(F.col("_open").isNull()).alias("_head"),
        F.max("_open").alias("_last_open"),
        F.max("_starts").alias("_tail_starts"),
    )
    over_ranges = Window.partitionBy(key).orderBy("_range")
    upto = over_ranges.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = over_ranges.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summary.withColumn("_prev_last", F.lag("_last").over(over_ranges))
        .withColumn("_linked", F.coalesce(link(F.col("_prev_last"), F.col("_first")), F.lit(False)))
        .withColumn("_prev_tail", F.lag(F.col("_n") - F.col("_last_open") + 1).over(over_ranges))
        .withColumn("_prev_n", F.lag("_n").over(over_ranges))
        .withColumn("_reset", (~F.col("_linked") | F.col("_prev_tail").isNotNull()).cast("int"))
        .withColumn("_segment", F.sum("_reset").over(upto))
        .withColumn("_add", F.when(~F.col("_linked"), 0).otherwise(F.coalesce("_prev_tail", "_prev_n")))
        .withColumn(
            "_carry",
            F.sum("_add").over(
                Window.partitionBy(key, "_segment").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .withColumn("_head_starts", multiples(F.col("_carry"), F.col("_carry") + F.col("_head") - 1))
        .withColumn("_before", F.coalesce(F.sum(F.col("_head_starts") + F.col("_tail_starts")).over(ahead), F.lit(0)))
        .select(key, "_range", "_carry", "_head_starts", "_before", "_prev_last", "_linked")
    )
    in_head = F.col("_open").isNull()
    chain = F.when(in_head, F.col("_carry") + F.col("_rn") - 1).otherwise(F.col("_rn") - F.col("_open"))
    opened = F.when(in_head, multiples(F.col("_carry"), F.col("_carry") + F.col("_rn") - 1)).otherwise(
        F.col("_head_starts") + F.col("_starts")
    )
    out = local.join(carried, [key, "_range"])
    out = (
        out.withColumn("run_index", (F.col("_before") + opened - 1).cast("long"))
        .withColumn("run_position", (chain % step).cast("int"))
        .withColumn("previous", F.when(F.col("_rn") > 1, F.col("_prev")).otherwise(F.col("_prev_last")))
        .withColumn("joined", F.col("run_position") > 0)
    )
    return out.drop(
        "_range", "_item", "_rn", "_prev", "_break", "_open", "_start", "_starts", "_carry", "_head_starts", "_before",
        "_prev_last", "_linked",
    )
