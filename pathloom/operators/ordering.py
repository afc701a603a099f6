"""Positions and running sums over a whole table, without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut, free_names


def positions(df: DataFrame, order: list[Column | str], name: str = "position", total: str | None = None, running: str = "running") -> DataFrame:
    """``df`` with each row's position (from 1) in ``order``, a total order; with ``total``, that column's running sum too.

    Rows are dealt to ranges of the order (sampled, so a frequent value spreads over ranges as far as the order
    tells its rows apart); each range is numbered within itself and moved on by what the ranges before it hold.
    """
    part, first, before = free_names([*df.columns, name, running], "_part", "_first", "_before")
    dealt = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    some = F.sum(total) if total else F.lit(0)
    sums = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(first), some.alias(before))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row a range
    sums = sums.select(part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in (first, before)])
    inside = W.partitionBy(part).orderBy(*order)
    out = dealt.join(F.broadcast(sums), part).withColumn(name, F.col(first) + F.row_number().over(inside))
    if total:
        out = out.withColumn(running, F.col(before) + F.sum(total).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return out.drop(part, first, before)


def following(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` (never null) of the next row of its ``by`` in ``order``, a total order; null for the last row.

    Rows are dealt to ranges of ``by`` and ``order``, so a frequent key spreads over ranges; each range looks within itself, and
    its last row of a key finds the key's first row in a later range, of which there is a row a key and range.
    """
    part, here, there = free_names([*df.columns, name], "_part", "_here", "_there")
    dealt = cut(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    first = dealt.groupBy(*by, part).agg(F.min_by(value, F.struct(*order)).alias(here))
    # ranges follow the order of keys, so a key lies in neighbouring ranges
    later = first.withColumn(there, F.lead(here).over(W.partitionBy(*by).orderBy(part))).select(*by, part, there)
    inside = W.partitionBy(part, *by).orderBy(*order)
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, part)]
    out = dealt.withColumn(name, F.lead(value).over(inside)).alias("l").join(later.alias("r"), keys, "left")
    return out.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce(f"l.{name}", there).alias(name))
