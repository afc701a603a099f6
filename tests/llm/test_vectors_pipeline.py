"""Vector operators and the pipeline against brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import hamming, language, mixing, neardups, neighbours, packing, pseudonyms, registry, scoring, substrings, toxicity

SCHEMA = "vec_id long, embedding array<float>, label int, id string, a long, n long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[100:140] = x[99] + 0.05 * rng.normal(size=(40, 16))
    x[200:230] = x[199]
    out = [(i, [float(np.float32(v)) for v in r], 0, "x", 1, 2) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3]
    return out + [(1000 + i, v, 0, "x", 1, 2) for i, v in enumerate(odd)]


def brute(rows):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i < 1000]
    return np.array([i for i, _ in good]), np.stack([v for _, v in good])


def test_near_vectors(spark, rows):
    ids, x = brute(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ok = u @ u.T >= 0.95
    np.fill_diagonal(ok, False)
    root = ids.copy()
    for _ in range(len(ids)):
        root = np.minimum(root, np.where(ok, root[None], 10**9).min(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hamming.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[i][0] for i in ids)
    assert found >= 0.98 * ok.sum() and all(got[i][0] <= n for i, n in zip(ids, ok.sum(1), strict=True))
    assert np.mean([got[i][1] == r for i, r in zip(ids, root, strict=True)]) > 0.98
    assert all(got[i] == (0, i, True) for i in range(1000, 1006))
    assert hamming.near_vectors(spark.createDataFrame([], SCHEMA)).isEmpty()


@pytest.mark.parametrize("offset", [0.0, 2.0])
def test_near_vectors_wherever_they_lie(spark, offset):
    """Pairs just above the threshold, in vectors around the origin and far from it."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 32)) + offset * 32**0.5 * np.eye(32)[0]
    side = rng.normal(size=base.shape)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    side -= (side * unit).sum(1, keepdims=True) * unit
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.955 * unit + np.sqrt(1 - 0.955**2) * side
    x = np.concatenate([base, near]) if not offset else np.concatenate([base, near * np.linalg.norm(base, axis=1, keepdims=True)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = np.argwhere(np.triu(u @ u.T >= 0.95, 1))
    got = hamming.near_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.95 * 2 * len(true) >= 0.95 * 1000
    assert np.mean([r.component_id == r.vec_id for r in got if r.vec_id < 300]) > 0 and len(got) == 1200


def test_bits_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32)) + 3 * rng.normal(size=32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (1000, 10**6, 10**9):
        c = hamming.Coder(x, n, 0.95)
        bits = np.unpackbits(c.codes(x), axis=2, bitorder="little")[:, :, : c.bits].reshape(len(x), -1)
        assert abs(bits.mean(0) - 0.5).max() < 0.35 and abs(bits.mean() - 0.5) < 0.05
        assert c.bits <= max(hamming.LEAST_BITS, round(np.log2(n))) and c.tables <= hamming.MOST_TABLES


def test_nearest(spark, rows):
    ids, x = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    out = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        assert len(by[q]) == 20 and all(abs(sc - s[i]) < 1e-9 for i, sc in by[q])
        hit += len({i for i, _ in by[q]} & set(order))
    assert hit >= 0.9 * 400 and set(by) == set(range(0, 400, 20))
    few = df.where("vec_id < 5")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 4
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none, none).isEmpty()


def test_anisotropic_codes_favour_inner_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 16))
    q = neighbours.Quantiser(x)
    r = x - q.decode(q.codes(x))
    along = ((r * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2
    plain = neighbours.Quantiser(x, threshold=0.0)
    s = x - plain.decode(plain.codes(x))
    assert q.eta >= 1 and along.mean() <= (((s * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean() * 1.05
    packed = q.pack(q.codes(x))
    assert np.allclose(q.scan(x[:5], packed), q.decode(q.codes(x)) @ x[:5].T, atol=1e-3)


def test_nearest_on_many_leaves(spark, monkeypatch):
    """Clustered vectors away from the origin, leaves and blocks of queries by the dozen, against brute force."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    monkeypatch.setattr(neighbours, "ASKS", 40)
    rng = np.random.default_rng(5)
    x = 2 * rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24)) + 1
    x[50:60] = x[40]  # ties, a query among them
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.union(df.where("vec_id in (0, 7)"))  # repeated rows
    by = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        got = sorted(by[q])
        assert [r for r, _, _ in got] == list(range(1, 21)) and [(-sc, i) for _, i, sc in got] == sorted((-sc, i) for _, i, sc in got)
        hit += len({i for _, i, _ in got} & set(want))
    assert hit >= 0.98 * 20 * 150


def test_registry(spark, sf_dir):
    assert len(registry.queries()) == 13 and {k.split("_")[0] for k in registry.queries()} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


COLUMNS = {
    "op1": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8": {"doc_id": "bigint", "text": "string"},
    "op9": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11": dict.fromkeys(("client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents"), "bigint") | dict.fromkeys(("closed_by", "path_sha256"), "string"),
    "op12": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op13": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    """Names, types, one row per document or vector, and what the contracts say of single columns."""
    out = registry.queries()[name](spark, sf_dir)
    types = dict(out.dtypes)
    assert COLUMNS[name.split("_")[0]].items() <= types.items()
    if name.split("_")[0] in ("op11", "op12", "op13"):  # test_oracle compares their rows
        return
    rows = out.toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").toPandas().vec_id
    held = lambda n, k: rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % n == k)
    if name.startswith("op1_"):
        assert set(rows.query_id) == {v for v in vecs if v % 20 == 0} and (rows.query_id != rows.vec_id).all()
        assert (rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id")["rank"].apply(list).map(lambda r: r == list(range(1, 21)))).all()
    elif name.startswith("op9"):
        assert sorted(rows.vec_id) == sorted(vecs) and (rows.kept == (rows.vec_id == rows.component_id)).all()
    elif name.startswith("op7"):
        assert set(rows.doc_id) == set(docs.doc_id) and rows.length.max() <= 2048
    else:
        assert sorted(rows.doc_id) == sorted(docs.doc_id)
    if name.startswith("op4"):
        assert (rows.held_out == held(7, 2)).all() and (rows.n_known <= rows.n_tokens).all() and rows.loc[rows.held_out, "score"].sum() > rows.loc[rows.held_out, "base_score"].sum()
    if name.startswith("op6"):
        assert (rows.held_out == held(5, 0)).all() and set(rows.lang_pred) <= {*docs.lang.dropna(), "und"}
    if name.startswith("op10"):
        assert (rows.held_out == held(5, 0)).all() and (rows.predicted == (rows.score >= 0.5)).all() and rows.score.between(0, 1).all()


#: Names that operators use themselves, or might.
CLASHES = ["_h", "_gone", "_lang", "_score", "_copies", "_i", "__doc_id", "_part", "n", "h", "id", "key", "value", "block", "chunk", "held", "new", "r", "salt", "k"]


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Some documents with clashing columns, repeated rows, ids with two texts, null ids, null and empty texts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    more = spark.createDataFrame([(None, "une phrase sans identité, écrite en français pour voir", "fr", None, 5), (None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, " 12 !", None, "s", 4)], d.schema)
    d = d.union(d.where("doc_id < 5")).union(d.where("doc_id = 7").withColumn("text", F.lit("another text of the same document, which says other things"))).union(more)
    return d.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES]).repartition(3)


def test_stages_on_odd_documents(spark, sf_dir, odd):
    """Every stage keeps the other columns as they are, whatever their names, and takes what a table may hold."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert rows, name
        if name == "pack":
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == docs.columns, name
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in CLASHES), name
        before = docs.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
        if name == "language":
            assert None in {r.doc_id for r in rows} and 10**6 not in {r.doc_id for r in rows} and len(rows) < len(before)
        if name == "dedup":
            assert len({(r.doc_id, r.text) for r in rows}) == len(rows) and None in {r.doc_id for r in rows}
        if name == "pii":
            assert len(rows) == len(before) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
        docs = spark.createDataFrame(rows, out.schema)


def test_stages_on_an_empty_table(spark, sf_dir, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd.limit(0), sf_dir)
        assert out.isEmpty() and (name == "pack" or out.columns == odd.columns)
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).isEmpty()


def test_operators_on_odd_documents(spark, odd):
    """A row for each row (a piece at least for packing), also for repeated ones and those without an id."""
    n = odd.count()
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    net = toxicity.train(odd, marks)
    assert substrings.dedup_substrings(odd).count() == n
    assert mixing.mix(odd).count() == n
    assert scoring.score_texts(odd).count() == n
    assert neardups.near_duplicates(odd).count() == n
    assert language.identify(odd, language.train(odd)).count() == n
    assert packing.best_fit_packing(odd).where("piece = 0").count() == n
    assert pseudonyms.pseudonymise(odd, "k").count() == n
    assert toxicity.score_toxicity(odd, net).count() == n


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 !", None, None, 4)], docs.schema)
    docs, kept = docs.union(odd), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        kept[name] = (docs, out)
        assert name == "pack" or out.columns == docs.columns
        docs = out
    a, b = kept["language"]
    assert b.where(F.col("doc_id") >= 10**6).isEmpty() and b.count() >= 0.98 * (a.count() - 2)
    a, b = kept["dedup"]
    assert b.count() == b.select("doc_id").distinct().count() < a.count()
    a, b = kept["pii"]
    assert a.count() == b.count() and b.where("text rlike '@'").count() == a.where("text rlike '@'").count()
    a, b = kept["mix"]
    assert b.groupBy("doc_id").count().where("count > 2").isEmpty()
    a, b = kept["pack"]
    assert b.where("piece = 0").count() == a.count()
    n = pipeline.run(spark, sf_dir).count()
    assert n > 0
