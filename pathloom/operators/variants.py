"""Walks through nested VARIANT values, a job a level; however deep they are, and however many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import counted, free_names


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def entries(df: DataFrame, column: str, keep: list[Column], key: str, value: str) -> DataFrame:
    """A row for each entry of the objects in ``column``: ``keep``, the entry's key and its value by the names given."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer()).toDF("__pos", "__key", "__value")).select(*keep, F.col("__key").alias(key), F.col("__value").alias(value))


def flattened(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, key (dotted path), value (text) of all scalars in a VARIANT column; nulls and arrays are dropped.

    ``keys`` must not be named key or value.
    """
    path, at, value = free_names(keys, "_path", "_at", "_value")
    level = df.select(*keys, F.lit(None).cast("string").alias(path), F.col(column).alias(value)).where(is_object(F.col(value)))
    out, n = None, 1
    while n:
        step = entries(level, value, [F.col(k) for k in [*keys, path]], at, "_v" if "_v" not in keys else value + "_")
        found = step.columns[-1]
        step = step.select(*keys, F.concat_ws(".", path, at).alias(path), F.col(found).alias(value))
        step, n = counted(step, is_object(F.col(value)))
        kind = F.schema_of_variant(value)
        scalars = step.where(F.col(value).isNotNull() & ~F.is_variant_null(value) & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"))
        scalars = scalars.select(*keys, F.col(path).alias("key"), F.col(value).cast("string").alias("value"))
        out = scalars if out is None else out.union(scalars)
        level = step.where(is_object(F.col(value)))
    return out
