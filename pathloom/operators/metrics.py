"""Precision, recall, F1, costs and summary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.stats import f1, ratio

from .lineage import cut
from .quantiles import quantiles

# Dollars per million prompt and completion tokens.
PROMPT_PRICE, COMPLETION_PRICE = 2.5, 10.0


def node_metrics(truth: DataFrame, made: DataFrame, key: str = "template_id") -> DataFrame:
    """key, tp, fp, fn, node_precision, node_recall, node_f1 for every key of either side.

    The i-th true node of a type pairs with the i-th made one. A node counts as unmatched if no node of its side
    with its id is in a pair (so blank or repeated ids count together). All windows share one shuffle by key.
    """
    side = lambda df, made: df.select(key, F.coalesce("type", F.lit("unknown")).alias("type"), "pos", "id", F.lit(made).alias("made"))
    both = side(truth, False).union(side(made, True)).repartition(key)
    rn = F.row_number().over(W.partitionBy(key, "type", "made").orderBy("pos"))
    of_type = W.partitionBy(key, "type")
    counted = both.withColumn("rn", rn).withColumn("pairs", F.least(F.count_if("made").over(of_type), F.count_if(~F.col("made")).over(of_type)))
    counted = counted.withColumn("paired", F.col("rn") <= F.col("pairs"))
    seen = F.col("id").isNotNull() & F.max("paired").over(W.partitionBy(key, "made", "id"))
    out = counted.withColumn("seen", seen).groupBy(key).agg(
        F.count_if(F.col("paired") & F.col("made")).alias("tp"), F.count_if(F.col("made") & ~F.col("seen")).alias("fp"), F.count_if(~F.col("made") & ~F.col("seen")).alias("fn")
    )
    out = out.withColumns({"node_precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "node_recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("node_f1", f1(F.col("node_precision"), F.col("node_recall")))


def edge_metrics(truth: DataFrame, made: DataFrame, key: str = "template_id") -> DataFrame:
    """Set precision, recall and F1 of typed edges (key, from_type, to_type), both sides distinct."""
    sides = truth.withColumn("g", F.lit(1)).join(made.withColumn("m", F.lit(1)), [key, "from_type", "to_type"], "full")
    out = sides.groupBy(key).agg(F.count("g").alias("truth_edges"), F.count("m").alias("made_edges"), F.count_if(F.col("g").isNotNull() & F.col("m").isNotNull()).alias("shared_edges"))
    out = out.withColumns({"edge_precision": ratio(F.col("shared_edges"), F.col("made_edges")), "edge_recall": ratio(F.col("shared_edges"), F.col("truth_edges"))})
    return out.withColumn("edge_f1", f1(F.col("edge_precision"), F.col("edge_recall")))


def costs(usage: DataFrame, prompt: str = "prompt_tokens", completion: str = "completion_tokens", prompt_price: float = PROMPT_PRICE, completion_price: float = COMPLETION_PRICE) -> DataFrame:
    """``usage`` with input_cost, output_cost and total_cost in dollars."""
    a, b = F.coalesce(prompt, F.lit(0)) / 1e6 * prompt_price, F.coalesce(completion, F.lit(0)) / 1e6 * completion_price
    return usage.withColumns({"input_cost": a, "output_cost": b, "total_cost": a + b})


def cost_report(costed: DataFrame, prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    out = costed.agg(
        F.coalesce(F.sum(prompt), F.lit(0)).alias("total_input_tokens"), F.coalesce(F.sum(completion), F.lit(0)).alias("total_output_tokens"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumns({"total_tokens": F.col("total_input_tokens") + F.col("total_output_tokens"), "average_cost": ratio(F.col("total_cost"), F.col("n"))})


def summary(results: DataFrame, metrics: list[str], failed: str | None = None) -> DataFrame:
    """One row: n, n_failed and mean, median, std (population), min, max of every metric; zeros without rows.

    ``failed`` names a column that holds an error; such rows count as failed and have no metrics. Medians are exact, and no
    task gathers values for them (see ``quantiles``).
    """
    bad = F.col(failed).isNotNull() if failed else F.lit(False)
    results = cut(results.select(bad.alias("bad"), *[F.when(~bad, F.col(m)).cast("double").alias(m) for m in metrics]))
    bad, medians = F.col("bad"), quantiles(results, metrics)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_failed")]
    for m in metrics:
        x = F.col(m)
        for name, f in (("mean", F.avg(x)), ("median", F.lit(medians[m, 0.5]).cast("double")), ("std", F.stddev_pop(x)), ("min", F.min(x)), ("max", F.max(x))):
            aggs.append(F.coalesce(f, F.lit(0.0)).alias(f"{m}_{name}"))
    return results.agg(*aggs).withColumn("error", F.when(F.col("n") == F.col("n_failed"), "no evaluated rows"))
