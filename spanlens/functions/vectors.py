"""Dense vector columns as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def norm(vector: Column) -> Column:
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(total)


def unit(vector: Column) -> Column:
    """Vector of length one; the norm is floored so a zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(NORM_FLOOR))
    # The one-element array evaluates the norm once per row instead of once per component.
    return F.element_at(
        F.transform(F.array(length), lambda n: F.transform(vector, lambda x: x.cast("double") / n)), 1
    )


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
