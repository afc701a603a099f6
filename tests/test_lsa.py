"""Learned embeddings against a dense SVD."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import lsa


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    topics = [[f"w{t}x{i}" for i in range(15)] for t in range(5)]
    return [" ".join(rng.choices(topics[i % 5], k=12) + rng.choices(sum(topics, []), k=3)) for i in range(120)] + [None, "", "w0x1"]


def dense(texts):
    counts = [Counter(re.findall(r"\w+", t)) for t in texts if t is not None]
    terms = sorted(set().union(*counts))
    df = Counter(w for c in counts for w in c)
    idf = np.array([np.log((1 + len(counts)) / (1 + df[w])) + 1 for w in terms])
    a = np.array([[(1 + np.log(c[w])) * i if c[w] else 0 for w, i in zip(terms, idf, strict=True)] for c in counts])
    return terms, a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def test_same_subspace_as_a_dense_svd(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    model = lsa.fit(df, "text", rank=5, power=8)
    terms, a = dense(texts)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(model.values, s[:5], rtol=1e-4)
    f = {r.term: r.f for r in model.terms.collect()}
    v = np.array([f[w] for w in terms])
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-6)
    assert np.linalg.svd(vt[:5] @ v)[1].min() > 0.999  # the cosines between the two subspaces
    # both ways to embed give the projections
    by_join = {r.id: np.array(r.embedding) for r in lsa.embedded(df, "text", model).collect()}
    by_column = {r.id: np.array(r.e) for r in df.select("id", lsa.embedder(model)(F.col("text")).alias("e")).collect()}
    want = iter(a @ v)
    for i, t in enumerate(texts):
        row = next(want) if t is not None else np.zeros(5)
        assert np.allclose(by_join[i], row, atol=1e-9) and np.allclose(by_column[i], row, atol=1e-9)


def test_small_models(spark):
    one = spark.createDataFrame([("a b",), ("a b",)], "text string")
    model = lsa.fit(one, "text", rank=4)
    assert len(model.values) == 1 and np.isclose(model.values[0], 2**0.5)
    none = lsa.fit(one.limit(0), "text")
    assert len(none.values) == 0 and lsa.embedded(one, "text", none).count() == 2
    with pytest.raises(ValueError, match="by a join"):
        lsa.embedder(model, 10)
