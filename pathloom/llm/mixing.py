"""Operator 3, mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Targets: sources, in code-point order with null last, weigh 3, 1, 2 in turn and share 150 % of all words; a
target stops at twice its source's size and the excess is shared again by weight (solved in closed form, as
a water level). Quotas: the words to take are cut into blocks of ``block_words`` words, and the blocks go to
the sources by highest quotients target / (2 j + 1); each source's blocks go to its shards likewise, by the
shards' sizes. Selection: a shard's documents stand in seeded order on a circle of blocks; its quota is the
run of blocks from a seeded start, going around up to twice. So a document is taken from 0 to 2 times its
size, and at most the documents at a run's two ends are taken in part.

Only DataFrame and SQL functions are used. A source is dealt to shards of about ``shard_docs`` documents (at
most ``most_shards``), so a hot source doesn't meet in one task. What is windowed per source are its shards.

Defined results: null or blank text has size 0 and takes nothing; a null source is a source of its own;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, free_names, table, with_columns_of

BLOCK_WORDS, SHARD_DOCS, MOST_SHARDS, SEED, WEIGHTS, SHARE, LIMIT = 8, 128, 4096, 20251, (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size, ...), one row per source, with weight and target."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(LIMIT))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(SHARE)
    rise = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "total": total,
        "full": F.coalesce(F.sum("cap").over(rise), F.lit(0.0)),
        "open": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(rise), F.lit(0.0)),
    })
    # the water level: the first source, by rising cap / weight, that stays below its cap sets it
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(W.partitionBy())
    s = s.withColumn("at", level)
    return s.withColumn("target", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))).drop("cap", "total", "full", "open", "level", "at")


def sainte_lague(votes: DataFrame, within: list[str], party: list[str], vote: str, seats: Column) -> DataFrame:
    """``votes`` with ``quota``: ``seats`` dealt within each group by highest quotients vote / (2 j + 1).

    Starts from rounding at the ideal divisor, which misses the house size by a few seats only, and settles
    that difference among the nearest quotients.
    """
    group = W.partitionBy(*within)
    v = votes.withColumns({"_seats": seats.cast("long"), "_sum": F.sum(vote).over(group)})
    v = v.withColumn("_n", F.when(F.col("_sum") > 0, F.floor(F.col(vote) * F.col("_seats") / F.col("_sum") + 0.5)).otherwise(F.lit(0)).cast("long"))
    v = v.withColumn("_off", F.col("_seats") - F.sum("_n").over(group)).withColumn("_off", F.when(F.col("_sum") > 0, F.col("_off")).otherwise(F.lit(0)))
    # one row for each seat that may be added (_off > 0) or given back (_off < 0)
    near = v.where("_off <> 0").select(*within, *party, vote, "_n", "_off", F.explode(F.sequence(F.lit(1), F.abs("_off"))).alias("_j"))
    near = near.withColumn("_seat", F.when(F.col("_off") > 0, F.col("_n") + F.col("_j") - 1).otherwise(F.col("_n") - F.col("_j"))).where("_seat >= 0")
    q = F.col(vote) / (2 * F.col("_seat") + 1)
    best = W.partitionBy(*within).orderBy(F.when(F.col("_off") > 0, -q).otherwise(q), *[F.col(p).asc_nulls_last() for p in party])
    moved = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.abs("_off")).groupBy(*within, *party).agg(F.sum(F.signum("_off")).cast("long").alias("_d"))
    out = with_columns_of(v, moved, [*within, *party])
    return out.select(*votes.columns, (F.col("_n") + F.coalesce(F.col("_d"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, most_shards: int = MOST_SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, quota_blocks (its shard's), taken, and what else ``docs`` carries in ``row_key``."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", F.lit(seed)).alias("_h")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    t = targets(sources)
    t = t.withColumn("_share", F.col("target")).withColumn("_one", F.lit(1))
    house = F.floor(F.sum("target").over(W.partitionBy()) / F.lit(float(block_words)) + 0.5)
    t = sainte_lague(t.withColumn("_house", house), ["_one"], ["source"], "_share", F.col("_house"))
    t = cut(t.select("source", "source_size", "target", F.col("quota").alias("source_quota"), F.least(F.lit(most_shards), F.ceil(F.col("_docs") / shard_docs)).cast("long").alias("shards")))
    # a row per source: sent to all tasks only while there are few of them
    few = t.count() <= 10_000
    near = F.broadcast(t) if few else t
    d = with_columns_of(sized, near, ["source"]).withColumn("shard", F.pmod(F.xxhash64("doc_id", "_h", F.lit(seed)), F.col("shards")))
    line = W.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "_h", F.lit(seed + 1)), "doc_id", "_h").rowsBetween(W.unboundedPreceding, 0)
    shards = d.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards.withColumn("_votes", F.col("shard_size").cast("double")), ["source"], ["shard"], "_votes", F.col("source_quota"))
    shards = shards.select("source", "shard", "shard_size", "quota")
    d = d.withColumn("_to", F.sum("size").over(line)).withColumn("_from", F.col("_to") - F.col("size"))
    d = with_columns_of(d, shards, ["source", "shard"])
    b = F.lit(block_words)
    d = d.withColumn("_blocks", F.ceil(F.col("shard_size") / b)).withColumn("_quota", F.least(F.col("quota"), 2 * F.col("_blocks")))
    d = d.withColumn("_whole", F.when(F.col("_blocks") > 0, F.floor(F.col("_quota") / F.col("_blocks"))).otherwise(F.lit(0)))
    d = d.withColumn("_part", F.col("_quota") - F.col("_whole") * F.col("_blocks"))
    d = d.withColumn("_start", F.when(F.col("_blocks") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.col("_blocks"))).otherwise(F.lit(0)))
    # the run [start, start + part) on the circle, as one or two intervals of words
    one, two = F.col("_start") * b, (F.col("_start") + F.col("_part")) * b
    ring = F.col("_blocks") * b
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_to"), hi) - F.greatest(F.col("_from"), lo))
    d = d.withColumn("taken", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("_whole") * F.col("size") + over(one, F.least(two, ring)) + over(F.lit(0), two - ring)).cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", F.col("_quota").alias("quota_blocks"), "taken", "_h")


def resampled(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each document's row repeated taken / size times, rounded; same columns."""
    mark, times, nth = free_names(docs.columns, "_h", "_copies", "_i")
    m = mix(docs, seed)
    copies = m.where("size > 0").groupBy("doc_id", F.col("_h").alias(mark)).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(times)).where(F.col(times) > 0)
    keyed = with_columns_of(docs.withColumn(mark, F.xxhash64("text", F.lit(seed))), copies, ["doc_id", mark], "inner")
    return keyed.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth)).drop(nth)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
