"""Queries over chains take each user's whole chain."""

import json
import math
from collections import Counter

import pytest

from pathloom.plans import views
from pathloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def paths(spark, sf_dir):
    out = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect(), key=lambda r: (r.ts, r.event_id)):
        out.setdefault(r.user_id, []).append(r.event_type)
    assert max(map(len, out.values())) > 6
    return out


@pytest.fixture(scope="module")
def scores(paths):
    steps = Counter(s for p in paths.values() for s in zip(p, p[1:]))
    heads = Counter(a for p in paths.values() for a in p[:-1])
    return {c: [steps[a, b] / heads[a] for a, b in zip(p, p[1:])] for c, p in paths.items()}


def test_chains_are_whole(spark, sf_dir, paths):
    assert {r.chain_id: r.path for r in views.chains(spark, sf_dir).collect()} == paths


REDUCE = {"sum": sum, "product": math.prod, "average": lambda s: sum(s) / len(s), "geometric_mean": lambda s: math.prod(s) ** (1 / len(s)), "min": min}


@pytest.mark.parametrize("strategy", sorted(REDUCE))
def test_chain_scores(strategy, spark, sf_dir, scores):
    got = {r.chain_id: r.chain_score for r in QUERIES[f"chain_score_{strategy}"](spark, sf_dir).collect()}
    want = {c: REDUCE[strategy](s) if s else 0.0 for c, s in scores.items()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 2e-6 for c in want)


def test_mapped_and_written_chains(spark, sf_dir, paths):
    got = {r.chain_id: r.path.split(">") for r in QUERIES["chain_to_types"](spark, sf_dir).collect()}
    assert got == {c: ["input" if t in ("click", "view") else t for t in p] for c, p in paths.items()}
    documents = {r.chain_id: json.loads(r.document) for r in QUERIES["workflow_json"](spark, sf_dir).collect()}
    assert {c: len(d["nodes"]) for c, d in documents.items()} == {c: len(p) for c, p in paths.items()}


def test_all_candidates_are_ranked(spark, sf_dir, tmp_path):
    """Also those beyond rank 20."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.unionByName(e.withColumn("user_id", e.user_id + 1_000_000)).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["rank_candidates"](spark, str(tmp_path)).collect()
    steps, heads = Counter(), Counter()
    chains = {r.chain_id: r.path for r in views.chains(spark, str(tmp_path)).collect()}
    for p in chains.values():
        steps.update(zip(p, p[1:]))
        heads.update(p[:-1])
    mean = {c: sum(steps[s] / heads[s[0]] for s in zip(p, p[1:])) / max(1, len(p) - 1) for c, p in chains.items()}
    want = {c: s for c, s in mean.items() if s >= 0.2}
    assert len(want) > 20 and {r.chain_id: r.chain_score for r in got} == pytest.approx(want, abs=2e-6)
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.chain_score, r.chain_id))] == list(range(1, len(want) + 1))
