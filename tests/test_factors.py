"""The factorised transition model against a plain version and SQL."""

import duckdb
import numpy as np

from pathloom.operators import factors


def made(spark, rng, nodes=25):
    a, b = rng.gamma(2, 1, (nodes, 3)), rng.gamma(2, 1, (nodes, 3))
    n = a @ b.T
    rows = [(f"s{i}", f"t{j}", float(n[i, j])) for i in range(nodes) for j in range(nodes) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "src string, dst string, n double").repartition(5)


def test_errors_by_sql_and_by_hand(spark):
    counts = made(spark, np.random.default_rng(1))
    model = factors.fit(counts, rank=3, reg=0.01, rounds=5, held_out=0.2)
    pairs, source, target = (df.toPandas() for df in (factors.split(counts, 0.2), model.source, model.target))
    source["f"], target["f"] = source["f"].map(list), target["f"].map(list)
    got = {h[1]: h for h in model.history if h[0] == model.best}
    sql = """SELECT held, count(*), avg(abs(n - s)), sqrt(avg((n - s) * (n - s))), max(abs(n - s)) FROM
    (SELECT held, n, list_dot_product(a.f, b.f) AS s FROM pairs JOIN source a ON src = a.node JOIN target b ON dst = b.node) GROUP BY held"""
    for held, n, *want in duckdb.sql(sql).fetchall():
        h = got["held out" if held else "training"]
        assert h[2] == n and np.allclose(h[3:], want)
    # the same rounds in plain numpy
    train = pairs[~pairs.held]
    first = {r.node: np.array(r.f) for r in factors._start(spark.createDataFrame([(d,) for d in sorted(set(train.dst))], "node string"), 3, 0).collect()}
    t = first
    for _ in range(model.best):
        side = {}
        for one, other, known in (("src", "dst", t), ("dst", "src", None)):
            known = side if known is None else known
            new = {}
            for node, rows in train.groupby(one):
                f = np.stack([known[o] for o in rows[other]])
                new[node] = np.linalg.solve(f.T @ f + 0.01 * len(f) * np.eye(3), f.T @ rows.n.to_numpy())
            side, t = (new, t) if one == "src" else (side, new)
    assert all(np.allclose(t[r.node], r.f) for r in target.itertuples())
    rmse = [h[4] for h in model.history if h[1] == "held out"]
    assert model.best == 1 + int(np.argmin(rmse)) and min(rmse) < 0.5 * pairs.n.std()


def test_early_stop_and_nothing(spark):
    rng = np.random.default_rng(2)
    noise = spark.createDataFrame([(int(i), int(j), int(n)) for i, j, n in rng.integers(0, 12, (90, 3))] + [(None, 1, 1), (1, None, 1), (1, 1, None)], "src long, dst long, n long")
    model = factors.fit(noise, rank=8, reg=0.001, rounds=30, patience=2, held_out=0.3)
    rounds = max(h[0] for h in model.history)
    assert rounds < 30 and rounds == model.best + 2
    none = factors.fit(noise.limit(0), rank=2)
    assert none.history == [] and none.source.isEmpty() and none.best == 0


def test_many_blocks_give_the_same_factors(spark, monkeypatch):
    """Blocks of 20 pairs: a round sends each node's factors at most once a block, and no row a pair."""
    counts = made(spark, np.random.default_rng(3)).union(spark.createDataFrame([("s0", "once", 2.0), ("one", "t0", 1.0), ("far", "off", 3.0)], "src string, dst string, n double"))
    one = factors.fit(counts, rank=3, rounds=3)
    monkeypatch.setattr(factors, "BLOCK", 20)
    monkeypatch.setattr(factors, "SLICE", 50)
    many = factors.fit(counts, rank=3, rounds=3)
    assert [h[:3] for h in one.history] == [h[:3] for h in many.history] and np.allclose([h[3:] for h in one.history], [h[3:] for h in many.history])
    for a, b in ((one.source, many.source), (one.target, many.target)):
        a, b = ({r.node: r.f for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    rated = factors.split(counts)
    cells = factors._packed(rated, "src", "dst", 7)
    came = cells.select(cells.block.alias("to"), cells.others.alias("nodes"), factors.F.flatten(factors.F.transform("others", lambda x: factors._drawn(x, 3, 0))).alias("f"))
    out = factors._solved(cells, came, 3, 0.2).where("to IS NOT NULL")
    sent = out.select("to", factors.F.explode("nodes").alias("node"))
    assert sent.count() == sent.distinct().count() < rated.count() and out.count() <= 7 * 7
