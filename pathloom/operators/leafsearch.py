"""Leaf search for many requests, without scoring every request against every leaf.

A leaf passes only with a keyword, with a category, or with a cosine above ``LEAST / SEMANTIC``; so three sources give all
candidates. Keywords and categories are found in the leaves' texts in one pass (``patterns``), which gives postings that the
requests join. For the cosine, leaves are dealt to the nearest of at most ``LEADERS`` of them, and angles obey the triangle
inequality: |A - a| <= angle(request, leaf) <= A + a, where a leader lies at angle A from the request and a from the leaf; the nearest ``MARKS`` leaders of a leaf count. Leaves
whose bound stays below the threshold are never met. Of the candidates, those stay whose upper bound reaches the request's k-th
largest lower bound; only these are scored on their vectors. What is left out can't be among the k best, so the result is that of
scoring everything.

What is broadcast are the leaders (``LEADERS`` vectors) and, behind a check of their size, the patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.vector import cosine, dot

from . import angles, patterns, search
from .angles import LEADERS, SLACK, matrix, unit
from .lineage import cut

MARKS, DIGITS = 8, 9


def _similarity(a: Column, b: Column) -> Column:
    """``cosine`` with a single root, which is exact where the product of the squared norms is: equal directions of whole numbers
    are equally similar, however long. Products near the ends of the double range take two roots."""
    squares = dot(a, a) * dot(b, b)
    return F.when((squares > 1e-280) & (squares < 1e280), dot(a, b) / F.sqrt(squares)).otherwise(cosine(a, b))


def _near(leaves: DataFrame, leaders: np.ndarray) -> DataFrame:
    """leaf, leader, near (its nearest leader and the angle to it), marks and fars (its nearest leaders and the angles to them)."""
    shared = leaves.sparkSession.sparkContext.broadcast(leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = np.arccos(np.clip(unit(matrix(batch.column("d"))) @ shared.value.T, -1, 1))
                by = np.argsort(angle, 1, kind="stable")[:, :MARKS]
                far = np.take_along_axis(angle, by, 1)
                yield pa.RecordBatch.from_arrays([batch.column("leaf"), pa.array(by[:, 0].astype(np.int32)), pa.array(far[:, 0]), pa.array(list(by.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(far), pa.list_(pa.float64()))], names=["leaf", "leader", "near", "marks", "fars"])

    return leaves.select("leaf", "d").mapInArrow(run, "leaf long, leader int, near double, marks array<int>, fars array<double>")


def _angles(requests: DataFrame, leaders: np.ndarray) -> DataFrame:
    """req, angles: each request's angle to each leader."""
    shared = requests.sparkSession.sparkContext.broadcast(leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = np.arccos(np.clip(unit(matrix(batch.column("q"))) @ shared.value.T, -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("req"), pa.array(list(a), pa.list_(pa.float64()))], names=["req", "angles"])

    return requests.select("req", "q").mapInArrow(run, "req long, angles array<double>")


def _postings(requests: DataFrame, words: str, leaves: DataFrame, text: str, name: str) -> DataFrame:
    """req, leaf and, as ``name``, how many of the request's words stand in the leaf's text."""
    w = requests.select("req", F.explode(words).alias("w")).select("req", F.lower("w").alias("w")).where("w IS NOT NULL").groupBy("req", "w").agg(F.count(F.lit(1)).alias("times"))
    hits = patterns.containing(w.select(F.col("w").alias("word")).distinct(), "word", leaves.select("leaf", text), text)
    return w.join(hits.select("word", "leaf"), F.col("w") == F.col("word")).groupBy("req", "leaf").agg(F.sum("times").alias(name))


def candidates(requests: DataFrame, leaves: DataFrame, k: int, leaders: int = LEADERS) -> DataFrame:
    """req, leaf, category_score, keyword_score: the pairs that can be among the k best of their request.

    ``requests``: req, q, keywords, function_categories; ``leaves``: leaf, d, low (text, lower case), path (lower case). Vectors
    without direction (zero, null) never pass and must not be among them.
    """
    centres = angles.leaders(leaves, "d", leaders)
    if not len(centres):
        return requests.select("req", F.lit(None).cast("long").alias("leaf"), F.lit(0.0).alias("category_score"), F.lit(0.0).alias("keyword_score")).limit(0)
    near, seen_from = cut(_near(leaves, centres)), cut(_angles(requests, centres))
    least = float(np.arccos(search.LEAST / search.SEMANTIC))
    reach = near.groupBy("leader").agg(F.max("near").alias("radius"))  # a row a leader
    far = F.posexplode("angles").alias("leader", "angle")
    met = seen_from.select("req", far).join(F.broadcast(reach), "leader").where(F.col("angle") - F.col("radius") <= least + SLACK)
    alike = met.select("req", "leader", "angle").join(near.select("leaf", "leader", "near"), "leader").where(F.abs(F.col("angle") - F.col("near")) <= least + SLACK).select("req", "leaf")
    none = lambda c: F.lit(0).cast("long").alias(c)
    found = alike.select("req", "leaf", none("c"), none("w"))
    found = found.unionByName(_postings(requests, "function_categories", leaves, "path", "c").select("req", "leaf", "c", none("w")))
    found = found.unionByName(_postings(requests, "keywords", leaves, "low", "w").select("req", "leaf", none("c"), "w"))
    found = found.groupBy("req", "leaf").agg(F.max("c").alias("c"), F.max("w").alias("w"))
    sizes = requests.select("req", F.size("function_categories").alias("nc"), F.size("keywords").alias("nk"))
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(of)), F.lit(0.0))
    found = found.join(sizes, "req").select("req", "leaf", share("c", "nc").alias("category_score"), share("w", "nk").alias("keyword_score"))
    # bounds of the reward from the leaf's leader
    bound = found.join(near, "leaf").join(seen_from, "req")
    seen = F.transform("marks", lambda m: F.get("angles", m))
    bound = bound.withColumns({"apart": F.array_max(F.zip_with(seen, "fars", lambda a, b: F.abs(a - b))), "within": F.array_min(F.zip_with(seen, "fars", lambda a, b: a + b))})
    rest = search.reward(F.lit(0.0), F.col("category_score"), F.col("keyword_score"))
    most = F.cos(F.greatest(F.lit(0.0), F.col("apart") - SLACK))
    low = F.cos(F.least(F.lit(float(np.pi)), F.col("within") + SLACK))
    needs = F.when(F.col("keyword_score") > 0, search.LEAST_WITH_KEYWORD).otherwise(search.LEAST)
    bound = bound.withColumns({"most": search.SEMANTIC * most + rest, "low": search.SEMANTIC * low + rest}).where(F.col("most") > needs - SLACK)
    bound = cut(bound.select("req", "leaf", "category_score", "keyword_score", "most", F.when(F.col("low") > needs, F.col("low")).alias("low")))
    ranked = bound.where("low IS NOT NULL").withColumn("r", F.row_number().over(W.partitionBy("req").orderBy(F.desc("low")))).where(F.col("r") <= k)
    floor = ranked.where(F.col("r") == k).select(F.col("req").alias("req2"), F.col("low").alias("floor"))
    left = bound.join(floor, F.col("req") == F.col("req2"), "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK))
    return left.select("req", "leaf", "category_score", "keyword_score")


def best_leaves(requests: DataFrame, leaves: DataFrame, k: int = 5, leaders: int = LEADERS) -> DataFrame:
    """request_id, rank, path_str, description, mapped_nodes, reward: the k best passing leaves of each request, ties
    (rewards equal to ``DIGITS`` places) by path.

    ``requests``: request_id, q, keywords, function_categories; ``leaves``: path_str, combined_text, description, mapped_nodes, d.
    """
    some = lambda c: F.exists(c, lambda x: x != 0)
    r = cut(requests.where(some("q")).select("request_id", "q", "keywords", "function_categories").withColumn("req", F.monotonically_increasing_id()))
    low = F.lower(F.concat_ws(" ", "combined_text", F.array_join("mapped_nodes", " ")))
    d = cut(leaves.where(some("d")).select("path_str", "description", "mapped_nodes", "d", low.alias("low"), F.lower("path_str").alias("path")).withColumn("leaf", F.monotonically_increasing_id()))
    pairs = candidates(r, d, k, leaders)
    both = pairs.join(r.select("req", "request_id", "q"), "req").join(d.drop("low", "path"), "leaf").withColumn("semantic_score", _similarity(F.col("q"), F.col("d")))
    both = search.passing(both.withColumn("reward", search.reward(F.col("semantic_score"), F.col("category_score"), F.col("keyword_score"))))
    best = W.partitionBy("req").orderBy(F.desc(F.floor(F.col("reward") * 10.0**DIGITS + 0.5)), "path_str")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("request_id", "rank", "path_str", "description", "mapped_nodes", "reward")
