"""Guarded ratios and histogram buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def bucket(x: Column, low: Column, high: Column, n: int = 30) -> Column:
    """1 to n; the largest value is in the last one, and a constant column in the first."""
    return F.least(F.lit(n), F.coalesce(F.width_bucket(x, low, high, F.lit(n)), F.lit(1))).cast("int")
