"""Searches and joins over many blocks: same results as comparing everything, and rows are sent to few groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import search


@pytest.mark.parametrize("odd", [False, True])
def test_nearest_over_blocks(spark, odd):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[40:60] = x[39]
    x[60:70] = 2 * x[39]
    if odd:
        x[100] = 0
        x[101] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    d = x.astype(float)
    with np.errstate(invalid="ignore"):
        u = d / np.sqrt((d * d).sum(1))[:, None]
    c = np.round(np.nan_to_num(u @ u.T, nan=-2.0), 9)
    for block in (37, 8192):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in search.nearest(df, 5, block).collect()}
        assert len(got) == 5 * len(x)
        for i in range(len(x)):
            want = sorted((-c[i, j], j) for j in range(len(x)) if j != i)[:5]
            have = [got[i, k] for k in range(1, 6)]
            assert [v for v, _ in have] == [j for _, j in want], i
            assert all(s is None if w == 2 else abs(s + w) < 1e-8 for (_, s), (w, _) in zip(have, want, strict=True))


def test_cells_travel_in_bundles(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(rng.normal(size=(1500, 8)))], "vec_id long, embedding array<double>, label int")
    _, cells, centres = search.dealt_by_angle(df, "label", 20)
    b = search.bundles(cells, 200)
    assert cells.count() > 80 and b.select("w", "bundle").distinct().count() <= 8
    sizes = cells.join(b.withColumnsRenamed({"w": "w2"}), (F.col("w") == F.col("w2")) & (F.struct("leader", "sub") == F.col("at"))).groupBy("w", "bundle").agg(F.sum("n").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] == 1500
    got = search.pairs_above(df, 0.5, "label", block=20, bundle=200).collect()
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in np.argwhere(np.triu(u @ u.T >= 0.5, 1)).tolist() if i % 2 == j % 2}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
