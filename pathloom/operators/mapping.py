"""Names and node types: forward and reverse mapping, frequencies, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counted(pairs: DataFrame) -> DataFrame:
    """name, type, freq."""
    return pairs.groupBy("name", "type").agg(F.count(F.lit(1)).alias("freq"))


def best_type(mapping: DataFrame) -> DataFrame:
    """name, type, freq: a name's most frequent type, ties by type."""
    return mapping.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("freq"), "type"))).where("_r = 1").drop("_r")


def names_of_types(mapping: DataFrame) -> DataFrame:
    """type, names (sorted)."""
    return mapping.groupBy("type").agg(F.array_sort(F.collect_set("name")).alias("names"))


def most_common_name(mapping: DataFrame) -> DataFrame:
    """type, name, freq: the most frequent name, ties by name."""
    return mapping.groupBy("type").agg(F.min_by("name", F.struct(-F.col("freq"), F.col("name"))).alias("name"), F.max("freq").alias("freq"))


def chain_mapped(chains: DataFrame, lookup: DataFrame, key: str = "chain_id") -> DataFrame:
    """key, path: every element replaced by ``lookup`` (old, new); unknown ones stay."""
    p = chains.select(key, F.posexplode("path").alias("pos", "old")).join(lookup, "old", "left")
    return p.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "old").alias("x")))), lambda s: s["x"]).alias("path"))


def typed_triples(triples: DataFrame, types: DataFrame) -> DataFrame:
    """(head, relation, tail) by type; triples with an unmapped or blank end are dropped."""
    t = types.where("type <> ''").select("name", "type")
    out = triples.join(t.select(F.col("name").alias("head"), F.col("type").alias("h")), "head").join(t.select(F.col("name").alias("tail"), F.col("type").alias("t")), "tail")
    return out.select(F.col("h").alias("head"), "relation", F.col("t").alias("tail"), *[c for c in triples.columns if c not in ("head", "relation", "tail")])


def unknown_names(triples: DataFrame, types: DataFrame) -> DataFrame:
    return triples.select(F.col("head").alias("name")).union(triples.select("tail")).distinct().join(types.where("type <> ''"), "name", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, type, freq: the higher frequency wins, the old mapping wins ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("freq"), "_new", "type"))).where("_r = 1").drop("_r", "_new")


def statistics(mapping: DataFrame, k: int = 20) -> DataFrame:
    """kind, rank, value, freq: the k most frequent names and types, ties by value."""
    out = None
    for kind in ("name", "type"):
        part = mapping.groupBy(F.col(kind).alias("value")).agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq"), "value").limit(k)
        part = part.select(F.lit(kind).alias("kind"), F.row_number().over(W.orderBy(F.desc("freq"), "value")).alias("rank"), "value", "freq")
        out = part if out is None else out.union(part)
    return out


def knowledge_graph_statistics(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """One row: n_triples, n_relations, relations (sorted), ontology_size."""
    t = triples.agg(F.count(F.lit(1)).alias("n_triples"), F.countDistinct("relation").alias("n_relations"), F.array_sort(F.collect_set("relation")).alias("relations"))
    return t.crossJoin(ontology.agg(F.count(F.lit(1)).alias("ontology_size")))
