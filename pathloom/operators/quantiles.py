"""Exact quantiles of whole columns without gathering their values: selection by refining histograms.

All wanted ranks of all columns are narrowed at once. Each round counts, for every rank still open, the values within its interval in
``BINS`` bins, with map-side combining; the driver gets at most ``BINS`` rows a rank, goes on with the bin that holds it, and ends
where a bin holds one value or few enough rows (``FEW``), which are then read. A bin's ends are values that occur in it, and the
bin number grows with the value, so ranks are exact and each round makes progress.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, FEW = 1024, 2000


def _bin(x: Column, low: Column, high: Column) -> Column:
    """0 to BINS - 1, never falling as x grows; where the width is not finite, halves are taken."""
    part = lambda s: (x * s - low * s) / (high * s - low * s)
    return F.least(F.lit(BINS - 1), F.floor(F.when(high - low < float("inf"), part(1.0)).otherwise(part(0.5)) * BINS)).cast("int")


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float] = [0.5]) -> dict[tuple[str, float], float | None]:  # noqa: B006
    """(column, probability) -> the quantile, interpolated between neighbours as SQL's percentile; None without values.

    Nulls don't count; NaN is above all numbers. ``df`` is read once a round (some three), so it should be cheap to read.
    """
    x = lambda c: F.col(c).cast("double")
    finite = lambda c: ~F.isnan(x(c)) & (F.abs(x(c)) != float("inf"))
    aggs = [a for i, c in enumerate(columns) for a in (
        F.count(c).alias(f"n{i}"), F.count_if(x(c) == float("-inf")).alias(f"under{i}"), F.count_if(finite(c)).alias(f"finite{i}"), F.count_if(F.isnan(x(c))).alias(f"nan{i}"),
        F.min(F.when(finite(c), x(c))).alias(f"low{i}"), F.max(F.when(finite(c), x(c))).alias(f"high{i}"),
    )]
    ends = df.agg(*aggs).first()
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[int, float, float]] = {}  # (column, rank) -> rank within [low, high]
    wanted = {}
    for i, c in enumerate(columns):
        n, under, count = ends[f"n{i}"], ends[f"under{i}"], ends[f"finite{i}"]
        for p in probabilities:
            if not n:
                continue
            at = p * (n - 1)
            wanted[c, p] = (i, at, math.floor(at), math.ceil(at))
            for k in {math.floor(at), math.ceil(at)}:
                if k < under:
                    found[i, k] = -math.inf
                elif k < under + count:
                    open_[i, k] = (k - under, ends[f"low{i}"], ends[f"high{i}"])
                else:
                    found[i, k] = math.nan if k >= n - ends[f"nan{i}"] else math.inf
    while open_:
        for key in [key for key, (_, low, high) in open_.items() if low == high]:
            found[key] = open_.pop(key)[1]
        if not open_:
            break
        spans = sorted({(i, low, high) for (i, _), (_, low, high) in open_.items()})
        values = F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.lit(low).alias("low"), F.lit(high).alias("high"), x(columns[i]).alias("x")) for s, (i, low, high) in enumerate(spans)])).alias("v")
        inside = df.select(values).select("v.*").where("x >= low AND x <= high")
        bins = inside.groupBy("span", _bin(F.col("x"), F.col("low"), F.col("high")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        few = []
        for key, (k, low, high) in list(open_.items()):
            for b in sorted((b for b in bins if b.span == spans.index((key[0], low, high))), key=lambda b: b.bin):
                if k < b.n:
                    open_[key] = (k, b.low, b.high)
                    if b.low < b.high and b.n <= FEW:
                        few.append((key, k, b.low, b.high))
                    break
                k -= b.n
        if few:
            parts = sorted({(key[0], low, high) for key, _, low, high in few})
            values = F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.lit(low).alias("low"), F.lit(high).alias("high"), x(columns[i]).alias("x")) for s, (i, low, high) in enumerate(parts)])).alias("v")
            rows = df.select(values).select("v.*").where("x >= low AND x <= high").select("span", "x").collect()  # FEW a rank at most
            for key, k, low, high in few:
                found[key] = sorted(r.x for r in rows if r.span == parts.index((key[0], low, high)))[k]
                del open_[key]
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in columns for p in probabilities}
    for (c, p), (i, at, a, b) in wanted.items():
        out[c, p] = found[i, a] if a == b else (b - at) * found[i, a] + (at - a) * found[i, b]
    return out
