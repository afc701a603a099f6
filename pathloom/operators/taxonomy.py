"""Category trees: nested documents to one row per node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.text import without_number

from .lineage import counted
from .variants import entries, is_object

SKIPPED = ["Description", "description", "Nodes", "mapped_nodes", "name", "example_use_cases"]


def _is_leaf(v: Column) -> Column:
    has = lambda path, kind="variant": F.try_variant_get(v, path, kind)
    named = has("$.name", "string").isNotNull() & has("$.mapped_nodes").isNotNull()
    return ~is_object(v) | has("$.Nodes").isNotNull() | named | (F.coalesce(F.size(has("$.mapped_nodes", "array<string>")), F.lit(0)) > 0)


def flatten(docs: DataFrame, column: str = "tree") -> DataFrame:
    """path (array), depth, name, description, mapped_nodes, example_use_cases, is_leaf: a row per tree node.

    ``docs`` holds VARIANTs with the root key Taxonomy (or one that begins with Taxonomy_). A node is a leaf
    if it has the key Nodes, or name and mapped_nodes, or a mapped_nodes that isn't empty, or is no object.
    A document without root is an error. A tree may be spread over many documents, a branch each.
    """
    require_root(docs, column)
    roots = entries(docs.select(F.col(column).alias("tree")), "tree", [], "root", "value").where((F.col("root") == "Taxonomy") | F.col("root").startswith("Taxonomy_"))
    level, out, n, depth = roots.select(F.array().cast("array<string>").alias("path"), "value"), None, 1, 0
    while n:
        depth += 1
        step = entries(level.where(is_object(F.col("value"))), "value", [F.col("path")], "key", "inner").where(F.lit(depth == 1) | ~F.col("key").isin(SKIPPED))
        step = step.select(F.array_append("path", F.col("key")).alias("path"), F.col("inner").alias("value")).withColumn("is_leaf", _is_leaf(F.col("value")))
        step, n = counted(step, ~F.col("is_leaf"))
        part = step.withColumn("depth", F.lit(depth))
        out = part if out is None else out.union(part)
        level = step.where(~F.col("is_leaf")).select("path", "value")
    get = lambda path, kind: F.try_variant_get(F.col("value"), path, kind)
    none = F.array().cast("array<string>")
    return out.select(
        "path", "depth", "is_leaf", F.coalesce(F.when(F.col("is_leaf"), get("$.name", "string")), F.element_at("path", -1)).alias("name"),
        F.coalesce(get("$.Description", "string"), get("$.description", "string"), F.lit("")).alias("description"),
        F.coalesce(F.when(F.col("is_leaf"), F.coalesce(get("$.Nodes", "array<string>"), get("$.mapped_nodes", "array<string>"))), none).alias("mapped_nodes"),
        F.coalesce(get("$.example_use_cases", "array<string>"), none).alias("example_use_cases"),
    )


def require_root(docs: DataFrame, column: str = "tree") -> None:
    """Raises unless every document has a Taxonomy root."""
    keys = F.json_object_keys(F.to_json(column))
    if not docs.where(~F.coalesce(F.exists(keys, lambda k: (k == "Taxonomy") | k.startswith("Taxonomy_")), F.lit(False))).isEmpty():
        raise ValueError("a taxonomy document has no Taxonomy root")


def search_leaves(nodes: DataFrame) -> DataFrame:
    """Leaves with mapped nodes: path_str, combined_text and the rest."""
    p = F.array_join("path", " -> ")
    return nodes.where(F.col("is_leaf") & (F.size("mapped_nodes") > 0)).withColumns({"path_str": p, "combined_text": F.concat(p, F.lit(": "), F.col("description"))})


def statistics(nodes: DataFrame) -> DataFrame:
    """One row: n_nodes, n_leaves, n_mapped, n_types, max_depth (the virtual root isn't counted)."""
    types = nodes.select(F.explode("mapped_nodes").alias("t")).agg(F.countDistinct("t").alias("n_types"))
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), F.coalesce(F.sum(F.size("mapped_nodes")), F.lit(0)).alias("n_mapped"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")).crossJoin(types)


def types_to_categories(nodes: DataFrame) -> DataFrame:
    """type, categories: the paths that map it, sorted."""
    m = nodes.select(F.explode("mapped_nodes").alias("type"), F.array_join("path", " -> ").alias("path"))
    return m.groupBy("type").agg(F.array_sort(F.collect_list("path")).alias("categories"))


def top_categories(nodes: DataFrame) -> DataFrame:
    """category, description of the first level, numbers stripped; a row named Default if there is none."""
    top = nodes.where("depth = 1").select(without_number(F.element_at("path", 1)).alias("category"), F.when(F.col("description") != "", F.col("description")).otherwise(without_number(F.element_at("path", 1))).alias("description"))
    return nodes.sparkSession.createDataFrame([("Default", "Default")], "category string, description string") if top.isEmpty() else top


def unique_nodes(hits: DataFrame) -> DataFrame:
    """node: the distinct mapped nodes of search hits."""
    return hits.select(F.explode("mapped_nodes").alias("node")).distinct()


def ancestors(nodes: DataFrame) -> DataFrame:
    """path, step, ancestor: the way from the root to each node, itself last."""
    return nodes.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("step")).withColumn("ancestor", F.slice("path", F.lit(1), F.col("step")))
