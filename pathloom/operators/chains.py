"""Chains of node types scored by a transition matrix (src, dst, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import positions

STRATEGIES = ("sum", "product", "average", "geometric_mean", "min")


def clipped(c="score"):
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))), F.lit(0.0))


def from_factors(p: DataFrame, q: DataFrame) -> DataFrame:
    """src, dst, score of two factor tables (idx, f array<double>)."""
    a = p.select(F.col("idx").alias("src"), F.posexplode("f").alias("k", "x"))
    b = q.select(F.col("idx").alias("dst"), F.posexplode("f").alias("k", "y"))
    return a.join(b, "k").groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def transition_scores(chains: DataFrame, matrix: DataFrame, key: str = "chain_id", path: str = "path") -> DataFrame:
    """``chains`` with ``scores``, the clipped score of every step in order; unknown steps score 0."""
    steps = chains.select(key, F.posexplode(path).alias("pos", "src")).withColumn("dst", F.lead("src").over(W.partitionBy(key).orderBy("pos"))).where("dst is not null")
    s = steps.join(matrix.select("src", "dst", "score"), ["src", "dst"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", clipped().alias("s")))).alias("x"))
    return chains.join(s.select(key, F.transform("x", lambda v: v["s"]).alias("scores")), key, "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))


def reduced(scores, strategy: str):
    """A chain's score from its steps' scores; 0 for fewer than two nodes."""
    n = F.size(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    product = F.aggregate(scores, F.lit(1.0), lambda a, x: a * x)
    out = {"sum": lambda: total, "product": lambda: product, "average": lambda: F.try_divide(total, n), "geometric_mean": lambda: F.power(product, F.try_divide(F.lit(1.0), n)), "min": lambda: F.array_min(scores)}
    if strategy not in out:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.when(n > 0, out[strategy]()).otherwise(0.0)


def score_chains(chains: DataFrame, matrix: DataFrame, strategy: str = "average", key: str = "chain_id") -> DataFrame:
    return transition_scores(chains, matrix, key).withColumn("chain_score", reduced(F.col("scores"), strategy))


def rank_candidates(chains: DataFrame, matrix: DataFrame, strategy: str = "average", min_score: float = 0.0, key: str = "chain_id") -> DataFrame:
    """Chains by falling score, then by ``key``; empty paths and scores below ``min_score`` are dropped."""
    s = score_chains(chains.where(F.size("path") > 0), matrix, strategy, key).where(F.col("chain_score") >= min_score)
    return s.orderBy(F.desc("chain_score"), key)


def top_transitions(matrix: DataFrame, k: int = 5, src: str | None = None) -> DataFrame:
    """src, rank, dst, score: the k best successors by raw score, then clipped."""
    m = matrix if src is None else matrix.where(F.col("src") == src)
    r = m.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= k)
    return r.select("src", "rank", "dst", clipped().alias("score"))


def als_model(counts: DataFrame, rank: int = 20, reg: float = 0.2, iterations: int = 5, seed: int = 0):
    """A factorised transition model of (src, dst, n): the fitted model and the index of node types."""
    from pyspark.ml.recommendation import ALS

    nodes = counts.select(F.col("src").alias("node")).union(counts.select("dst")).distinct()
    index = positions(nodes, ["node"], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))
    rated = counts.join(index.select(F.col("node").alias("src"), F.col("idx").alias("u")), "src").join(index.select(F.col("node").alias("dst"), F.col("idx").alias("v")), "dst")
    model = ALS(rank=rank, regParam=reg, maxIter=iterations, seed=seed, userCol="u", itemCol="v", ratingCol="n", coldStartStrategy="nan").fit(rated.select("u", "v", F.col("n").cast("float").alias("n")))
    return model, index


def als_scores(counts: DataFrame, **settings) -> DataFrame:
    """src, dst, score of every pair that the model knows."""
    model, index = als_model(counts, **settings)
    a = model.userFactors.select(F.col("id").alias("idx"), F.col("features").cast("array<double>").alias("f"))
    b = model.itemFactors.select(F.col("id").alias("idx"), F.col("features").cast("array<double>").alias("f"))
    s = from_factors(a, b)
    return s.join(index.select(F.col("idx").alias("src"), F.col("node").alias("s")), "src").join(index.select(F.col("idx").alias("dst"), F.col("node").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "score")
