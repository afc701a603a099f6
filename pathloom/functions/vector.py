"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def use_case_score(similarities: Column, threshold: float = 0.3) -> Column:
    """0.7 of the largest and 0.3 of the mean of the similarities from ``threshold`` on; 0 without any."""
    hit = F.filter(similarities, lambda s: s >= threshold)
    mean = F.aggregate(hit, F.lit(0.0), lambda a, s: a + s) / F.size(hit)
    return F.when(F.size(hit) > 0, 0.7 * F.array_max(hit) + 0.3 * mean).otherwise(0.0)
