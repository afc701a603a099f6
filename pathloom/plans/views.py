"""Analogues of workflow data over the relational test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """head, tail, relation, ts, event_id: consecutive event types of each user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("head"), F.lead("event_type").over(w).alias("tail"))
    return e.where("tail is not null").withColumn("relation", F.col("event_id").cast("string"))


TRIPLES = "triples AS (SELECT * FROM (SELECT event_id, ts, event_type AS head, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tail, CAST(event_id AS VARCHAR) AS relation FROM events) WHERE tail IS NOT NULL)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, n, score: transition counts and shares."""
    t = triples(spark, sf_dir).groupBy(F.col("head").alias("src"), F.col("tail").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("score", F.col("n") / F.sum("n").over(W.partitionBy("src")))


MATRIX = TRIPLES + ", matrix AS (SELECT head AS src, tail AS dst, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY head) AS score FROM triples GROUP BY head, tail)"


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain_id, path: all event types of each user in order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w))
    return e.groupBy(F.col("user_id").alias("chain_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_type"))), lambda s: s["event_type"]).alias("path"))


STEPS = "numbered AS (SELECT user_id AS chain_id, event_type AS src, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), steps AS (SELECT chain_id, rn, src, lead(src) OVER (PARTITION BY chain_id ORDER BY rn) AS dst FROM numbered), scored AS (SELECT s.chain_id, s.rn, coalesce(least(1.0, greatest(0.0, m.score)), 0.0) AS score FROM steps s LEFT JOIN matrix m USING (src, dst) WHERE s.dst IS NOT NULL)"


def side(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """template_id, pos, id, name, type, props: a user's events on even (0) or odd (1) days of the month."""
    e = table(spark, sf_dir, "events").where(F.dayofmonth("ts") % 2 == parity)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("template_id"), F.row_number().over(w).alias("pos"), F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("name"), F.col("event_type").alias("type"), "props")


SIDES = "g AS (SELECT user_id, event_id, event_type, props, ts FROM events WHERE day(ts) % 2 = 0), m AS (SELECT user_id, event_id, event_type, props, ts FROM events WHERE day(ts) % 2 = 1)"


def side_edges(nodes: DataFrame) -> DataFrame:
    from pathloom.operators.normalize import step_edges

    return step_edges(nodes, ["template_id"], "pos", "name")


def taxonomy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree: a VARIANT for each part type, with its brands (leaves) that map part names."""
    p = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("Nodes"))
    t = p.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct("Nodes")))).alias("b"))
    return t.select(F.parse_json(F.to_json(F.struct(F.create_map("p_type", "b").alias("Taxonomy")))).alias("tree"))


LEAVES = "leaves AS (SELECT p_type, p_brand, list_sort(list(DISTINCT p_name)) AS nodes FROM part GROUP BY ALL)"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, prompt_tokens, completion_tokens: lengths of what others and the assistant said."""
    c = table(spark, sf_dir, "conversations")
    n, made = F.length("text"), F.col("role") == "assistant"
    return c.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(~made, n)), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(F.when(made, n)), F.lit(0)).alias("completion_tokens"))


USAGE = "u AS (SELECT conv_id, CAST(coalesce(sum(CASE WHEN role <> 'assistant' THEN length(text) END), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS completion_tokens FROM conversations GROUP BY conv_id)"


def mapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"))


COUNTED = "counted AS (SELECT p_name AS name, p_type AS type, count(*) AS freq FROM part GROUP BY ALL)"
