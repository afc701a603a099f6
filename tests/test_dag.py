"""Depths, strong components and longest paths against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import dag, graph

EDGES = "head string, tail string"


def frame(spark, edges):
    return spark.createDataFrame(list(edges), EDGES)


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def plain_longest(edges, names):
    succ = {n: sorted({b for a, b in edges if a == n and b != a and b in names}) for n in names}
    behind = {b for bs in succ.values() for b in bs}
    best = []

    def walk(path):
        nonlocal best
        if not best or (-len(path), path) < (-len(best), best):
            best = list(path)
        for b in succ[path[-1]]:
            if b not in path:
                walk([*path, b])

    for s in sorted(set(names) - behind) or sorted(names):
        walk([s])
    return best


def plain_components(edges, names):
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}


def path(spark, edges, names):
    got = dag.longest_path(frame(spark, edges), nodes(spark, names)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got)))
    return [r.node for r in got]


@pytest.mark.parametrize("seed", [0, 2, 3, 5])
def test_longest_path_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    density = [0.12, 0.12, 0.2, 0.2, 0.3, 0.15][seed]
    edges = {(a, b) for a in names for b in names if rng.random() < density and (seed % 2 == 0 or a < b or rng.random() < 0.3)}
    inside = names if seed < 4 else names[:7]
    assert path(spark, edges, inside) == plain_longest(edges, inside)
    both = {n: plain_components(edges, names)[n] for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in dag.strong_components(frame(spark, edges)).collect()} == both


def test_longest_path_through_cycles(spark):
    """A source, a ring with a chord, a bridge, a ring, and chains inside and behind them."""
    edges = [("s", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "d"), ("c", "x"), ("d", "x"), ("x", "y"), ("y", "p"), ("p", "q"), ("q", "r"), ("r", "p"), ("q", "z"), ("a", "a"), ("s", "z"), ("s", "p")]
    names = sorted({n for e in edges for n in e})
    assert path(spark, edges, names) == plain_longest(edges, names)
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("t", "u")]
    assert path(spark, ring, list("abctu")) == plain_longest(ring, "abctu") == list("abctu")


def test_small_graphs(spark):
    assert path(spark, [], ["b", "a"]) == ["a"]
    assert path(spark, [], []) == []
    assert path(spark, [("a", "a"), ("a", None), (None, "b")], ["a", "b"]) == ["a"]
    assert graph.longest_path(frame(spark, []), nodes(spark, [])).isEmpty()
    assert dag.strong_components(frame(spark, [])).isEmpty() and dag.levels(frame(spark, [])).isEmpty()


def test_long_chain_and_ring(spark):
    n = 5000
    chain = [(f"{i:05d}", f"{i + 1:05d}") for i in range(n - 1)]
    names = [f"{i:05d}" for i in range(n)]
    assert path(spark, chain, names) == names
    at = {r.node: r.level for r in dag.levels(frame(spark, [*chain, ("x", "00010"), ("00020", "y")])).collect()}
    assert all(at[x] == i for i, x in enumerate(names)) and at["x"] == 0 and at["y"] == 21
    ring = [*[(a, b) for a, b in chain[:600]], (chain[599][1], chain[0][0])]
    assert {r.component for r in dag.strong_components(frame(spark, ring)).collect()} == {"00000"}
    assert path(spark, ring, names[:601]) == names[:601]


def test_a_path_of_10000_nodes_takes_few_jobs(spark):
    n = 10_000
    e = spark.range(n - 1).select(F.format_string("%05d", "id").alias("head"), F.format_string("%05d", F.col("id") + 1).alias("tail"))
    started = lambda: int(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs())
    before = started()
    assert dag.levels(e).agg(F.max("level"), F.count("*")).first()[:] == (n - 1, n)
    assert started() - before < 150  # about four shuffles (jobs, as adaptive execution counts) a doubling
    seen = graph.reachable(e, spark.createDataFrame([("00003", 1)], "node string, k int"))
    assert seen.agg(F.min("node"), F.max("node"), F.count("*")).first()[:] == ("00003", "09999", n - 3)
    back = graph.reachable(e, spark.createDataFrame([("09000",)], "node string"), backward=True)
    assert back.agg(F.count("*")).first()[0] == 9001


def test_large_dag(spark):
    rng = random.Random(1)
    n = 20_000
    edges = {(a, a + 1 + int(rng.expovariate(1 / 6000))) for a in rng.choices(range(n), k=100_000)}
    edges = {(a, b) for a, b in edges if b < n}
    depth, hop = [0] * n, [None] * n
    succ = {}
    for a, b in edges:
        succ.setdefault(a, []).append(b)
    for a in range(n - 1, -1, -1):
        for b in sorted(succ.get(a, [])):
            if depth[b] + 1 > depth[a]:
                depth[a], hop[a] = depth[b] + 1, b
    sources = set(range(n)) - {b for _, b in edges}
    at = min(sources, key=lambda v: (-depth[v], v))
    want = []
    while at is not None:
        want.append(f"{at:05d}")
        at = hop[at]
    e = spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for a, b in edges], EDGES)
    got = dag.longest_path(e, nodes(spark, [f"{i:05d}" for i in range(n)])).orderBy("position").collect()
    assert [r.node for r in got] == want and len(want) > 20


def test_levels_and_reach_of_random_graphs(spark):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(40)]
    edges = {(a, b) for a in names for b in names if rng.random() < 0.03 and (a < b or rng.random() < 0.06)} | {("n39", "n39")}
    at, left = {}, {x for e in edges for x in e}
    while now := {x for x in left if not any(b == x and a in left for a, b in edges)}:
        level = max(at.values(), default=-1) + 1
        at |= dict.fromkeys(now, level)
        left -= now
    assert {r.node: r.level for r in dag.levels(frame(spark, edges)).collect()} == at
    seen = {("n00", 1), ("n05", 2)}
    while more := {(b, k) for x, k in seen for a, b in edges if a == x} - seen:
        seen |= more
    seeds = spark.createDataFrame([("n00", 1), ("n05", 2)], "node string, k int")
    for most in (0, 1, 99):
        assert {tuple(r) for r in graph.reachable(frame(spark, edges), seeds, most_levels=most).collect()} == seen


def test_components_too_large_are_an_error(spark, monkeypatch):
    full = [(a, b) for a in "abcdefgh" for b in "abcdefgh" if a != b]
    monkeypatch.setattr(dag, "MOST_NODES", 5)
    with pytest.raises(ValueError, match="strong component of 8 nodes"):
        dag.longest_path(frame(spark, full), nodes(spark, "abcdefgh")).collect()


def test_find_path_is_bounded(spark):
    full = [(f"m{i:02d}", f"m{j:02d}") for i in range(14) for j in range(14) if i != j]
    names = sorted({n for e in full for n in e}) + ["noOp", "webhook"]
    got = graph.find_path(frame(spark, [*full, ("webhook", "m00")]), nodes(spark, names), nodes(spark, ["m03"])).collect()
    assert len(got) == 1 and len(got[0].path) <= 15


def test_peeling_in_many_blocks(spark, monkeypatch):
    """Blocks of 30 links: the same depths and first edges, with cycles left out; one block takes one round."""
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in range(120)]
    edges = {(a, b) for a in names for b in names if a < b and rng.random() < 0.03} | {("n050", "n049"), ("n049", "n050")}
    e = frame(spark, edges).cache()
    links = dag.weighted(e).selectExpr("head", "tail", "1L AS weight", "tail AS hop", "step")
    whole = {r.node: (r.depth, r.hop, r.step) for r in dag.peeled(links, nodes(spark, names)).collect()}
    rounds, real = [], dag._round
    monkeypatch.setattr(dag, "_round", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(dag, "BLOCK", 30)
    assert {r.node: (r.depth, r.hop, r.step) for r in dag.peeled(links, nodes(spark, names)).collect()} == whole
    succ = {n: sorted(b for a, b in edges if a == n) for n in names}
    want, left = {}, set(names)
    while now := {n for n in left if all(b in want for b in succ[n])}:
        for n in now:
            best = min(((-want[b][0] - 1, b) for b in succ[n]), default=(0, None))
            want[n] = (-best[0], best[1], [best[1]] if succ[n] else None)
        left -= now
    assert whole == want and len(want) < 120 and 1 < len(rounds) <= 2 + max(d for d, _, _ in want.values())
    monkeypatch.setattr(dag, "BLOCK", 1 << 21)
    rounds.clear()
    assert dag.peeled(links, nodes(spark, names), False).count() == len(want) and len(rounds) == 1
