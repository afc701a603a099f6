"""An incremental summary of evaluations: mergeable states, one set a batch, so that a batch that is replayed counts once.

A batch leaves a row a metric (count, mean, squared deviations, extremes; failures and token sums beside) in its own folder, named by
the batch number, which a replay overwrites. The summary merges these rows; no evaluated row is read again. Medians need the values
themselves and are left to the batch summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.metrics import COMPLETION_PRICE, PROMPT_PRICE

from .resume import process_new

STATE = "metric string, n long, failed long, mean double, squares double, least double, most double, prompt_tokens long, completion_tokens long"


def states(results: DataFrame, metrics: list[str], failed: str | None = None, tokens: tuple[str, str] | None = None) -> DataFrame:
    """A row a metric (``STATE``) of evaluated rows; ``failed`` names a column with errors, ``tokens`` prompt and completion tokens."""
    bad = F.col(failed).isNotNull() if failed else F.lit(False)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    spent = [count(c) for c in tokens] if tokens else [F.lit(0).cast("long")] * 2
    aggs = [F.count_if(bad).alias("failed"), spent[0].alias("prompt_tokens"), spent[1].alias("completion_tokens")]
    for m in metrics:
        x = F.when(~bad, F.col(m).cast("double"))
        aggs.append(F.struct(F.lit(m).alias("metric"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares"), F.min(x).alias("least"), F.max(x).alias("most")).alias(f"m_{m}"))
    one = results.agg(*aggs)
    rows = one.select("failed", "prompt_tokens", "completion_tokens", F.explode(F.array(*[F.col(f"m_{m}") for m in metrics])).alias("s"))
    return rows.select("s.metric", "s.n", "failed", "s.mean", "s.squares", "s.least", "s.most", "prompt_tokens", "completion_tokens")


def merged(found: DataFrame) -> DataFrame:
    """A row a metric of any number of states: n, n_failed, mean, std (population), min, max, tokens and their cost."""
    total = found.groupBy("metric").agg(
        F.sum("n").alias("n"), F.sum("failed").alias("n_failed"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"), F.min("least").alias("min"), F.max("most").alias("max"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )
    # deviations about the common mean, so that no large squares are subtracted
    off = found.join(total.select("metric", F.col("mean").alias("all_mean")), "metric")
    off = off.groupBy("metric").agg(F.sum(F.coalesce("squares", F.lit(0.0)) + F.coalesce(F.col("n") * (F.col("mean") - F.col("all_mean")) ** 2, F.lit(0.0))).alias("squares"))
    out = total.join(off, "metric").withColumn("std", F.sqrt(F.try_divide("squares", F.col("n").cast("double"))))
    cost = F.col("prompt_tokens") / 1e6 * PROMPT_PRICE + F.col("completion_tokens") / 1e6 * COMPLETION_PRICE
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("metric", "n", "n_failed", zero("mean"), zero("std"), zero("min"), zero("max"), "prompt_tokens", "completion_tokens", cost.alias("total_cost"))


def keep(batch: DataFrame, number: int, folder: str) -> None:
    """Writes a batch's states below ``folder``; the same number again replaces them."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """The merged states of all batches below ``folder``."""
    return merged(spark.read.schema(STATE).option("recursiveFileLookup", True).parquet(folder))


def summarise_new(spark: SparkSession, path: str, checkpoint: str, folder: str, evaluate: Callable[[DataFrame], DataFrame], metrics: list[str], failed: str | None = None, tokens: tuple[str, str] | None = None) -> DataFrame:
    """Takes in record files that no earlier run has seen, and gives the summary of all so far."""
    process_new(spark, path, checkpoint, lambda batch, number: keep(states(evaluate(batch), metrics, failed, tokens), number, folder))
    return summary(spark, folder)
