"""Parameters: comparison of two sides, matching of required ones, filling and validation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pathloom.functions.stats import ratio
from pathloom.functions.vector import cosine

from .patterns import containing

KEY_SIMILARITY, VALUE_SIMILARITY = 0.7, 0.8


def similar(df: DataFrame, a: str, b: str, name: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``name``, the similarity of the texts in ``a`` and ``b``: 1 if equal, else the cosine of their
    embeddings, of which each distinct text and pair gets one. ``embed``: text to text and embedding."""
    pairs = df.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    texts = embed(pairs.select(F.col("x").alias("text")).union(pairs.select("y")).distinct())
    side = lambda c: texts.select(F.col("text").alias(c), F.col("embedding").alias("e" + c))
    scored = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", cosine(F.col("ex"), F.col("ey")).alias("_s"))
    out = df.join(scored, (F.col(a) == F.col("x")) & (F.col(b) == F.col("y")), "left")
    return out.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce("_s", F.lit(0.0)))).drop("x", "y", "_s")


def compare(pairs: DataFrame, truth: DataFrame, made: DataFrame, keys: list[str], embed: Callable[[DataFrame], DataFrame] | None = None, key_least: float = KEY_SIMILARITY, value_least: float = VALUE_SIMILARITY) -> DataFrame:
    """keys, n_truth, n_made, matched, missing, extra (sorted), match_ratio for each matched pair of nodes.

    ``pairs`` has the keys of all pairs; ``truth`` and ``made`` have keys, key, value. A true parameter takes
    the made one of similar key with the most similar value (first by key in a tie), if similar enough; a made
    one may serve several. Texts are compared by ``embed``'s vectors, without it by equality. Without true parameters
    the ratio is 1 if none were made, else 0.
    """
    both = truth.withColumnsRenamed({"key": "tk", "value": "tv"}).join(made.withColumnsRenamed({"key": "mk", "value": "mv"}), keys)
    if embed is None:
        both = both.where((F.col("tk") == F.col("mk")) & (F.col("tv") == F.col("mv"))).withColumn("s", F.lit(1.0))
    else:
        both = similar(similar(both, "tk", "mk", "ks", embed).where(F.col("ks") >= key_least), "tv", "mv", "s", embed).where("s > 0")
    best = both.groupBy(*keys, "tk").agg(F.min_by("mk", F.struct(-F.col("s"), F.col("mk"))).alias("mk"), F.max("s").alias("s")).where(F.col("s") >= value_least)
    matched = best.groupBy(*keys).agg(F.array_sort(F.collect_set("tk")).alias("matched"), F.collect_set("mk").alias("used"))
    names = lambda df, n: df.groupBy(*keys).agg(F.array_sort(F.collect_set("key")).alias(n))
    none = F.array().cast("array<string>")
    out = pairs.select(*keys).join(names(truth, "t"), keys, "left").join(names(made, "m"), keys, "left").join(matched, keys, "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("t", "m", "matched", "used")})
    match_ratio = F.when(F.size("t") == 0, (F.size("m") == 0).cast("double")).otherwise(ratio(F.size("matched"), F.size("t")))
    return out.select(*keys, F.size("t").alias("n_truth"), F.size("m").alias("n_made"), "matched", F.array_except("t", "matched").alias("missing"), F.array_except("m", "used").alias("extra"), match_ratio.alias("match_ratio"))


def parameter_accuracy(compared: DataFrame, key: str) -> DataFrame:
    """key, parameter_accuracy: the mean match ratio of its pairs."""
    return compared.groupBy(key).agg(F.avg("match_ratio").alias("parameter_accuracy"))


def required_matches(required: DataFrame, given: DataFrame) -> DataFrame:
    """node, param, value: for each required (node, param), the first given (pos, key, value) whose key
    contains it or is contained in it, case aside; nulls don't match."""
    need = required.select("node", "param", F.lower("param").alias("a"))
    have = given.where("value is not null").select("pos", "value", F.lower("key").alias("b"))
    hit = containing(need, "a", have, "b").select("node", "param", "pos", "value").union(containing(have, "b", need, "a").select("node", "param", "pos", "value"))
    return hit.groupBy("node", "param").agg(F.min_by("value", "pos").alias("value"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's matching-blocks ratio; there is no built-in for it."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def fuzzy_matches(wanted: DataFrame, given: DataFrame, least: float = 0.6) -> DataFrame:
    """param, key, score: the given key (pos, key) most like each wanted param; 0.3 more if one contains the
    other; above ``least``, first in a tie. Ratios are computed once per distinct pair."""
    pairs = wanted.select("param").distinct().crossJoin(given.groupBy("key").agg(F.min("pos").alias("pos")))
    a, b = F.lower("param"), F.lower("key")
    s = pairs.withColumn("score", sequence_ratio(a, b) + F.when(b.contains(a) | a.contains(b), 0.3).otherwise(0.0)).where(F.col("score") > least)
    return s.groupBy("param").agg(F.min_by("key", F.struct(-F.col("score"), F.col("pos"))).alias("key"), F.max("score").alias("score"))


def fill(chain: DataFrame, required: DataFrame, given: DataFrame, strict: bool = False) -> DataFrame:
    """node, param, value for the nodes of a chain (node): exact, else by containment, else fuzzy, else a placeholder.

    Strict mode fills required (node, param) only, otherwise every given (pos, key, value) is copied.
    """
    nodes = chain.select("node").distinct()
    if not strict:
        return nodes.crossJoin(given.select(F.col("key").alias("param"), "value"))
    wanted = required.join(nodes, "node", "left_semi")
    exact = given.select(F.col("key").alias("param"), F.col("value").alias("exact"), F.lit(True).alias("here"))
    fuzzy = fuzzy_matches(wanted, given).join(given.select("key", F.col("value").alias("fuzzy")), "key").select("param", "fuzzy", F.lit(True).alias("near"))
    held = required_matches(wanted, given).select("node", "param", F.col("value").alias("held"))
    out = wanted.join(exact, "param", "left").join(held, ["node", "param"], "left").join(fuzzy, "param", "left")
    return out.select("node", "param", F.when(F.col("here"), F.col("exact")).when(F.col("held").isNotNull(), F.col("held")).when(F.col("near"), F.col("fuzzy")).otherwise(F.concat(F.lit("<NEEDS_VALUE: "), F.col("param"), F.lit(">"))).alias("value"))


def validate(nodes: DataFrame, required: DataFrame, given: DataFrame) -> DataFrame:
    """node, valid, missing: required params without a value that isn't null; given is (node, param, value)."""
    have = given.where("value is not null").select("node", "param").distinct()
    gone = required.join(have, ["node", "param"], "left_anti").groupBy("node").agg(F.array_sort(F.collect_set("param")).alias("missing"))
    return nodes.select("node").distinct().join(gone, "node", "left").select("node", F.col("missing").isNull().alias("valid"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def ontology_scan(keywords: DataFrame, ontology: DataFrame, most: int = 5) -> DataFrame:
    """keyword, node, rank: the first node types by name that contain each keyword (in name or attributes)."""
    o = ontology.select("node", F.lower(F.concat_ws(" ", "node", "attrs")).alias("text"))
    hit = containing(keywords.select("keyword", F.lower("keyword").alias("low")), "low", o, "text")
    return hit.withColumn("rank", F.row_number().over(W.partitionBy("keyword").orderBy("node"))).where(F.col("rank") <= most).select("keyword", "node", "rank")
