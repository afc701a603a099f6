"""Typed bag matching of nodes, and joins between the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinals(nodes: DataFrame, key: str) -> DataFrame:
    """``nodes`` with ``rn``: each node's number within its type."""
    return nodes.withColumn("type", F.coalesce("type", F.lit("unknown"))).withColumn("rn", F.row_number().over(W.partitionBy(key, "type").orderBy("pos")))


def match_nodes(truth: DataFrame, made: DataFrame, key: str = "template_id") -> DataFrame:
    """Pairs: the i-th true node of a type with the i-th made one. Columns of both sides get g_ and m_."""
    side = lambda df, p: ordinals(df, key).select(key, "type", "rn", *[F.col(c).alias(p + c) for c in df.columns if c not in (key, "type")])
    return side(truth, "g_").join(side(made, "m_"), [key, "type", "rn"])


def unmatched(nodes: DataFrame, matches: DataFrame, side: str, key: str = "template_id") -> DataFrame:
    """Nodes whose id is in no pair (by id, so blank or repeated ids count as matched together)."""
    return nodes.join(matches.select(key, F.col(f"{side}_id").alias("id")), [key, "id"], "left_anti")


def typed_edges(edges: DataFrame, nodes: DataFrame, key: str = "template_id") -> DataFrame:
    """Distinct (key, from_type, to_type); the last node of a name gives its type, unknown names are dropped."""
    types = nodes.groupBy(key, "name").agg(F.max_by("type", "pos").alias("type"))
    for end in ("from", "to"):
        edges = edges.join(types.select(key, F.col("name").alias(f"{end}_name"), F.col("type").alias(f"{end}_type")), [key, f"{end}_name"])
    return edges.select(key, "from_type", "to_type").distinct()
