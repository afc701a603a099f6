"""Quantiles by selection against sorted values."""

import math
import random

import duckdb
import pytest

from pathloom.operators import quantiles as q


def plain(values, p):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    at = p * (len(values) - 1)
    a, b = math.floor(at), math.ceil(at)
    return values[a] if a == b else (b - at) * values[a] + (at - a) * values[b]


def same(a, b):
    return (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-12 * abs(b)


@pytest.mark.parametrize("few", [0, 50])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(q, "FEW", few)
    monkeypatch.setattr(q, "BINS", 8)
    rng = random.Random(2)
    columns = {
        "a": [rng.gauss(0, 1e9) for _ in range(500)], "b": [float(rng.randint(0, 3)) for _ in range(500)], "c": [7.0] * 500,
        "d": [rng.choice([None, 1e308, -1e308, 5e-324, 0.0, rng.random()]) for _ in range(500)],
        "e": [rng.choice([math.inf, -math.inf, math.nan, rng.random()]) for _ in range(500)], "f": [None] * 500, "g": [1.5, 2.5] + [None] * 498,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    ps = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = q.quantiles(df, list(columns), ps)
    for c, values in columns.items():
        known = [v for v in values if v is not None]
        for p in ps:
            want = plain(known, p) if known else None
            assert same(got[c, p], want), (c, p, got[c, p], want)
    assert q.quantiles(df.limit(0), ["a"]) == {("a", 0.5): None}


def test_like_duckdb_with_bounded_reads(spark):
    path = "/root/testdata/sf0.1/lineitem.parquet"
    names = ["l_extendedprice", "l_quantity"]
    got = q.quantiles(spark.read.parquet(path), names, [0.5, 0.999])
    for c in names:
        for p in (0.5, 0.999):
            ((want,),) = duckdb.sql(f"SELECT quantile_cont({c}, {p}) FROM '{path}'").fetchall()
            assert abs(got[c, p] - want) <= 1e-9 * abs(want)
