"""Bounded leaf search against scoring every leaf, and how much it leaves out."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.vector import cosine
from pathloom.operators import leafsearch, search
from pathloom.plans import pipelines, providers


def everything(requests, leaves, k):
    """Each request against every leaf."""
    q = requests.withColumn("q", providers.hashed_embedding(F.col("goal_description")))
    d = leaves.withColumn("d", providers.hashed_embedding(F.col("combined_text")))
    both = q.crossJoin(d)
    low = F.lower(F.concat_ws(" ", "combined_text", F.array_join("mapped_nodes", " ")))
    hits = F.filter("keywords", lambda w: low.contains(F.lower(w)))
    both = both.withColumns({"semantic_score": cosine(F.col("q"), F.col("d")), "category_score": search.category_reward(F.col("path_str"), F.col("function_categories")), "keyword_score": F.coalesce(F.try_divide(F.size(hits).cast("double"), F.size("keywords")), F.lit(0.0))})
    both = search.passing(both.withColumn("reward", search.reward(F.col("semantic_score"), F.col("category_score"), F.col("keyword_score"))))
    best = W.partitionBy("request_id").orderBy(F.desc("reward"), "path_str")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    topics = [[word() for _ in range(12)] for _ in range(25)]
    text = lambda t: " ".join(rng.choices(topics[t], k=7) + [word()])
    leaves = [(f"T{t} -> {i:04d}", text(t), f"about {t}", [f"n.{topics[t][0]}"]) for i in range(700) for t in [rng.randrange(25)]]
    leaves += [("T1 -> zero", "", "", []), (leaves[0][0] + "x", leaves[0][1], "twin", leaves[0][3])]
    asked = [(i, text(t), rng.sample(topics[t], rng.randint(0, 2)) + ([rng.choice(topics[3]).upper()] if i % 5 == 0 else []), [f"t{t} "] if i % 3 == 0 else []) for i in range(60) for t in [rng.randrange(25)]]
    asked += [(1000, "", ["x"], []), (1001, "qqqq", [], []), (1002, leaves[0][1], [], [])]
    r = spark.createDataFrame(asked, "request_id int, goal_description string, keywords array<string>, function_categories array<string>")
    d = spark.createDataFrame(leaves, "path_str string, combined_text string, description string, mapped_nodes array<string>")
    return r, d


@pytest.mark.parametrize("k", [1, 5])
def test_same_as_scoring_everything(tables, k):
    r, d = tables
    rows = lambda df: sorted((x.request_id, x.rank, x.path_str, round(x.reward, 9)) for x in df.collect())
    want = rows(everything(r, d, k))
    assert rows(pipelines.score_leaves(r, d, k=k)) == want and len(want) > 50


def test_few_pairs_are_scored(tables):
    r, d = tables
    q = r.withColumn("q", providers.hashed_embedding(F.col("goal_description"))).withColumn("req", F.col("request_id").cast("long")).where(F.exists("q", lambda x: x != 0))
    low = F.lower(F.concat_ws(" ", "combined_text", F.array_join("mapped_nodes", " ")))
    v = d.withColumn("d", providers.hashed_embedding(F.col("combined_text"))).where(F.exists("d", lambda x: x != 0)).withColumns({"low": low, "path": F.lower("path_str"), "leaf": F.xxhash64("path_str")})
    pairs = leafsearch.candidates(q, v, 5).count()
    assert 0 < pairs < 0.45 * q.count() * v.count(), pairs / (q.count() * v.count())


def test_nothing(tables):
    r, d = tables
    assert pipelines.score_leaves(r.limit(0), d).isEmpty() and pipelines.score_leaves(r, d.limit(0)).isEmpty()


@pytest.mark.parametrize("least", [0.9, 0.35, -0.2])
def test_pairs_above(spark, least):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.25 * rng.normal(size=(900, 16)), rng.normal(size=(20, 16))])
    x[50:60] = x[49]
    group = [None if i % 4 == 3 else i % 4 for i in range(len(x))]
    rows = [(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, group, strict=True))] + [(5000, [0.0] * 16, 0), (5001, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j) for i, j in np.argwhere(np.triu(c >= least, 1)).tolist() if group[i] == group[j]}
    got = search.pairs_above(df, least, "label", block=40).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    _, cells, leaders = search.dealt_by_angle(df, "label", 40)
    met, every = (search.cell_pairs(cells, leaders, t).agg(F.sum("pairs")).first()[0] for t in (least, -1.0))
    assert met <= every and (least < 0.9 or met < 0.4 * every)


def test_ties_by_path_and_halves(spark):
    """Equal rewards that doubles tell apart are ties, and a reward half way between two places is met exactly."""
    letters = lambda *n: "".join("abcdefgh"[i] * k for i, k in enumerate(n))
    rng = random.Random(8)
    tied = [[k * x for x in (1, 2, 3, 5, 7)] for k in rng.sample(range(1, 60), 25)]
    leaves = [(f"L -> {i:02d}", letters(*v), "", []) for i, v in enumerate(tied)]
    d = spark.createDataFrame(leaves, "path_str string, combined_text string, description string, mapped_nodes array<string>")
    r = spark.createDataFrame([(1, letters(3, 1, 4, 1, 5), [], []), (2, letters(2, 7, 1, 8), [], [])], "request_id int, goal_description string, keywords array<string>, function_categories array<string>")
    got = pipelines.score_leaves(r, d, providers.letter_counts).collect()
    assert [(x.request_id, x.path_str) for x in sorted(got, key=lambda x: x["rank"])] == [(1, f"L -> {j:02d}") for j in range(5)]  # the other has no leaf above the least reward
    # cosines of 9/16 and the like: 0.5 * n / 32 has its half at the sixth place
    for u, v, want in (((1,) * 4, (3, 1), None), ((2, 2, 2, 2), (8, 0, 0, 0), 0.25), ((5, 5, 5, 1), (19, 0, 0, 0), None)):
        s = spark.createDataFrame([([float(x) for x in u], [float(x) for x in (*v, 0, 0)[:4]])], "a array<double>, b array<double>").select(leafsearch._similarity(F.col("a"), F.col("b")).alias("s")).first().s
        exact = sum(x * y for x, y in zip(u, v)) / (sum(x * x for x in u) * sum(x * x for x in v)) ** 0.5
        assert s == exact and (want is None or s == 2 * want)
