"""Tables behind plots, and workflow documents."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.stats import bucket
from pathloom.functions.text import display_name

from .lineage import cut, free_names
from .ordering import positions
from .quantiles import quantiles


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (1 to bins), n, of a column between its least and largest value; empty bins are left out."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(bucket(F.col(column), F.col("lo"), F.col("hi"), bins).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def cumulative(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, column, position and running sum by rising value, then key."""
    return positions(df.select(key, column), [F.col(column), F.col(key)], total=column).select(key, column, "position", "running")


def overview(df: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean, exact median of every column."""
    df = cut(df.select(*columns))
    medians = quantiles(df, columns)
    one = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"a{i}").alias("mean"), F.lit(medians[c, 0.5]).cast("double").alias("median")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def density(df: DataFrame, column: str, points: int = 100, bins: int = 1024) -> DataFrame:
    """point, x, density: a Gaussian kernel estimate with Scott's bandwidth, at evenly spaced points.

    Values are first counted in ``bins`` narrow buckets, so what meets the points is bounded, whatever the table.
    """
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"), F.stddev_samp(column).alias("sd"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).where("hi > lo and n > 1").groupBy("lo", "hi", "n", "sd", at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))  # bins x points
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    z = (x - (F.col("lo") + (F.col("bin") + 0.5) * width)) / h
    return grid.groupBy("point").agg(F.first(x).alias("x"), F.sum(F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * h * 2.5066282746310002)).alias("density"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of every pair of columns, in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def heatmap(df: DataFrame, key: str, columns: list[str], k: int = 50) -> DataFrame:
    """The first k rows by key."""
    return df.select(key, *columns).orderBy(key).limit(k)


def workflow_json(chains: DataFrame, name: str = "workflow_name", path: str = "path", parameters: str | None = None, x: int = 250, y: int = 300, step: int = 300) -> DataFrame:
    """``chains`` with ``document``: nodes left to right, edges between neighbours, as JSON.

    Ids are hashes of name, place and type. Nodes of one display name share an entry of ``connections``, as
    edges are keyed by name. ``parameters`` names a map<type, map<param, value>>. Empty paths give null.
    """
    p = F.col(path)
    params = (lambda t: F.coalesce(F.try_element_at(F.col(parameters), t), F.create_map().cast("map<string,string>"))) if parameters else (lambda t: F.create_map().cast("map<string,string>"))
    nodes = F.transform(
        p,
        lambda t, i: F.struct(
            F.sha2(F.concat_ws("|", F.col(name), i.cast("string"), t), 256).alias("id"), display_name(t).alias("name"), t.alias("type"), F.lit(1).alias("typeVersion"),
            F.array(i * step + x, F.lit(y)).alias("position"), params(t).alias("parameters"),
        ),
    )
    # each step is kept as a column by an explode, which nothing is moved through: what a lambda holds is computed for every element
    kept = lambda df, c, value: df.select("*", F.explode(F.array(value)).alias(c))
    names, sorted_, starts, edges = free_names(chains.columns, "_names", "_sorted", "_starts", "_edges")
    last = F.greatest(F.size(names) - 1, F.lit(0))
    ahead = F.zip_with(F.slice(names, 1, last), F.slice(names, 2, last), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    found = kept(chains, names, F.transform(p, display_name))
    found = kept(found, sorted_, F.array_sort(F.transform(ahead, lambda e, i: F.struct(e["s"].alias("s"), i.alias("i"), e["t"].alias("t")))))
    first = lambda e, i: (i == 0) | (e["s"] != F.get(sorted_, i - 1)["s"])
    found = kept(found, starts, F.filter(F.transform(sorted_, lambda e, i: F.when(first(e, i), i)), lambda i: i.isNotNull()))
    until = lambda j: F.coalesce(F.get(starts, j + 1), F.size(sorted_))
    groups = F.array_sort(F.transform(starts, lambda a, j: F.struct(F.get(sorted_, a)["i"].alias("i"), F.slice(sorted_, a + 1, until(j) - a).alias("es"))))
    targets = lambda es: F.transform(es, lambda e: F.struct(e["t"].alias("node"), F.lit("main").alias("type"), F.lit(0).alias("index")))
    found = kept(found, edges, F.map_from_entries(F.transform(groups, lambda g: F.struct(g["es"][0]["s"].alias("key"), F.struct(F.array(targets(g["es"])).alias("main")).alias("value")))))
    empty = F.create_map().cast("map<string,string>")
    doc = F.to_json(F.struct(F.col(name).alias("name"), nodes.alias("nodes"), F.col(edges).alias("connections"), F.lit(False).alias("active"), empty.alias("settings"), empty.alias("pinData")))
    return found.withColumn("document", F.when(F.size(p) > 0, doc)).drop(names, sorted_, starts, edges)


def summary_text(summary: DataFrame, costs: DataFrame) -> DataFrame:
    """One row, ``text``: what ``metrics.summary`` and ``metrics.cost_report`` (one row each) found, to be read by people."""
    line = "=" * 60
    three = lambda name, m, parts: F.concat(F.lit(f"\n{name}:\n"), *[F.format_string(f"  {p.capitalize()}: %.3f\n", F.col(f"{m}_{p}")) for p in parts])
    scores = F.concat(three("Node Type Accuracy (F1)", "node_f1", ("mean", "median", "std")), three("Connection Accuracy (F1)", "edge_f1", ("mean", "median")), three("Parameter Accuracy", "parameter_accuracy", ("mean", "median")))
    none = F.when(F.col("c.n") > 0, F.lit("")).otherwise(F.lit(" (no successful generations)"))
    return summary.alias("s").crossJoin(costs.alias("c")).select(F.concat(
        F.format_string(f"{line}\nEvaluation Summary\n{line}\n\nTotal Templates: %d\nSuccessful: %d\nFailed: %d\n", F.col("s.n"), F.col("s.n") - F.col("s.n_failed"), F.col("s.n_failed")),
        F.when(F.col("s.error").isNotNull(), F.concat(F.lit("\nWarning: "), F.col("s.error"), F.lit("\n"))).otherwise(scores),
        F.format_string("\nCost Report:\n  Total Tokens: %,d\n  Total Cost: $%.2f USD\n  Avg Cost per Template: $%.4f USD", F.col("c.total_tokens"), F.col("c.total_cost"), F.col("c.average_cost")), none, F.lit(f"\n{line}"),
    ).alias("text"))
