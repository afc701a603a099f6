"""Many patterns in many texts against plain containment."""

import random

import pytest

from pathloom.operators import patterns, search
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    word = lambda k: "".join(rng.choice("abAB é.") for _ in range(k))
    needles = sorted({word(rng.randint(0, 5)) for _ in range(300)} | {"", "zzz", "aa"})
    hays = [word(rng.randint(0, 40)) for _ in range(120)] + ["", "x" * 5 + "zzz" * 30_000, None, "aa"]
    n = spark.createDataFrame([(i, w) for i, w in enumerate(needles)] + [(998, "aa"), (999, None)], "n int, needle string")
    h = spark.createDataFrame([(i, t) for i, t in enumerate(hays)], "h int, text string").repartition(3)
    want = sorted((i, k) for i, w in [*enumerate(needles), (998, "aa")] for k, t in enumerate(hays) if t is not None and w in t)
    return n, h, want


@pytest.mark.parametrize("most", [0, patterns.MOST_BYTES])
def test_containing(tables, most):
    n, h, want = tables
    got = patterns.containing(n, "needle", h, "text", most)
    assert got.columns == ["n", "needle", "h", "text"]
    assert sorted((r.n, r.h) for r in got.collect()) == want


def test_parts_give_the_same(tables):
    n, h, want = tables
    words = patterns.known(n, "needle")
    got = patterns.with_found(h, "text", words, "h", part=7)
    assert got.columns == ["h", "text", "h_"]
    first = {w: i for i, w in enumerate(words)}
    assert sorted((first[w], r.h) for r in got.collect() for w in r.h_) == [x for x in want if x[0] < 998]


def test_ten_thousand_patterns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(2)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = sorted({t[i : i + rng.randint(4, 30)] for t in texts.values() if t for i in rng.choices(range(len(t)), k=70)})[:10_000]
    assert len(words) == 10_000
    got = {r.doc_id: r.f for r in patterns.with_found(docs, "text", words, "f").collect()}
    some = words[::97]
    assert all(set(got[d]) & set(some) == {w for w in some if w in t} for d, t in texts.items())


def test_keyword_scan_takes_a_table(spark):
    leaves = spark.createDataFrame([(1, "Gmail inbox"), (2, "slack"), (3, None)], "id int, description string")
    words = spark.createDataFrame([("MAIL",), ("inbox",), ("none",)], "w string")
    (hit,) = search.keyword_scan(leaves, words, F.col("description")).collect()
    assert (hit.id, hit.keyword_matches, hit.reward) == (1, ["inbox", "mail"], 0.5)


def test_nothing(spark):
    none = spark.createDataFrame([], "n int, needle string")
    texts = spark.createDataFrame([(1, "a")], "h int, text string")
    assert patterns.containing(none, "needle", texts, "text").isEmpty() and patterns.containing(none, "needle", texts, "text", -1).isEmpty()
