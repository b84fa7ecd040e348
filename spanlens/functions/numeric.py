"""Number helpers that stay inside code generation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1, the splitting constant of the error-free product for doubles.
_SPLIT = 134217729.0


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """Division where an empty denominator gives a fixed value."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(empty))


def exact_round(value: Column | str, digits: int) -> Column:
    """Round the *binary* value to ``digits`` places, exact ties to even.

    ``round`` and ``bround`` in Spark look at the shortest decimal text, so 2.675 or 0.03125 come out
    differently from a rounding of the stored value. The product with 10**digits is split into its
    rounded part and its exact error, which decides the direction.
    """
    scale = float(10**digits)
    if isinstance(value, str):
        x = f"CAST(`{value}` AS DOUBLE)"
        return F.expr(_ROUND_TEXT.format(x=x, scale=f"{scale:.1f}D", **_scale_parts(scale)))
    x = value.cast("double")
    parts = {k: F.lit(float(v[:-1])) for k, v in _scale_parts(scale).items()}
    head = F.lit(_SPLIT) * x
    high = head - (head - x)
    low = x - high
    product = x * F.lit(scale)
    error = ((high * parts["sh"] - product) + high * parts["sl"] + low * parts["sh"]) + low * parts["sl"]
    base = F.floor(product).cast("double")
    side = (product - base - F.lit(0.5)) + error
    up = (side > 0) | ((side == 0) & ((base % 2) != 0))
    return F.when(x.isNotNull(), (base + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale))


def exact_rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """``exact_round`` of an array, by the same arithmetic."""
    x, scale = np.asarray(values, dtype=np.float64), float(10**digits)
    scale_high, scale_low = (float(v[:-1]) for v in _scale_parts(scale).values())
    head = _SPLIT * x
    high = head - (head - x)
    low, product = x - high, x * scale
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    base = np.floor(product)
    side = (product - base - 0.5) + error
    return (base + np.where((side > 0) | ((side == 0) & (base % 2 != 0)), 1.0, 0.0)) / scale


def _scale_parts(scale: float) -> dict[str, str]:
    head = _SPLIT * scale
    high = head - (head - scale)
    return {"sh": f"{high!r}D", "sl": f"{scale - high!r}D"}


# The same arithmetic as SQL text, for plain column names: one parsed expression instead of many calls.
_HIGH = "(({k} * {{x}}) - (({k} * {{x}}) - {{x}}))".format(k=f"{_SPLIT:.1f}D")
_PROD = "({x} * {scale})"
_LOW = "({x} - " + _HIGH + ")"
_ERR = f"((({_HIGH} * {{sh}} - {_PROD}) + {_HIGH} * {{sl}} + {_LOW} * {{sh}}) + {_LOW} * {{sl}})"
_BASE = f"CAST(floor({_PROD}) AS DOUBLE)"
_SIDE = f"(({_PROD} - {_BASE} - 0.5D) + {_ERR})"
_ROUND_TEXT = (
    f"CASE WHEN {{x}} IS NOT NULL THEN ({_BASE} + CASE WHEN {_SIDE} > 0D OR ({_SIDE} = 0D AND ({_BASE} % 2D) != 0D) "
    "THEN 1D ELSE 0D END) / {scale} END"
)


def half_even(value: Column) -> Column:
    """Nearest whole number, ties to even, as a long (exact for doubles)."""
    return F.bround(value.cast("double"), 0).cast("long")


def jaccard(left: Column, right: Column) -> Column:
    """Set Jaccard of two arrays; 0 for two empty sets."""
    return ratio(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right)))
