"""Sessions, archives and vector codes against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import codes, sessions, warc

MIN = 60_000_000
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, us long, slot long, island_us string"


def clicks(spark, rows):
    """rows: (click_id, us, us of arrival, client, kind, value)."""
    made = spark.createDataFrame(rows, "click_id long, t long, a long, client_id long, kind string, value double")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    extra = {"props": F.lit("{}"), "us": F.lit(1), "slot": F.lit(2), "island_us": F.lit("x")}
    return made.withColumns({"ts": at("t"), "arrived_at": at("a")} | extra).drop("t", "a")


def plain_sessions(rows):
    once, out = {}, []
    for c, us, a, client, kind, value in sorted(rows, key=lambda r: ((r[2] is not None), r[2] or 0, r[1] or 0)):
        if None not in (c, us, client) and c not in once:
            cents = int(np.floor(100 * value + 0.5)) if value is not None and np.isfinite(value) else 0
            once[c] = (client, us, c, a is not None and a - us > 15 * MIN, kind in ("purchase", "signup") and value is not None and not value < 60, cents)
    for client in {r[0] for r in once.values()}:
        mine = sorted(r for r in once.values() if r[0] == client)
        made, last, reason = [], None, None
        for r in (r for r in mine if not r[3]):
            if last is not None:
                reason = "end" if last[4] else "gap" if r[1] - last[1] >= 15 * MIN else "length" if r[1] - made[-1][0][1] > 60 * MIN else None
            if last is None or reason:
                if made:
                    made[-1].append(reason)
                made.append([r])
            else:
                made[-1].append(r)
            last = r
        if made:
            made[-1].append("end" if last[4] else "none")
        starts = [s[0][1] for s in made] + [float("inf")]
        for i, s in enumerate(made):
            cs, closed = s[:-1], s[-1]
            late = sum(r[3] and starts[i] <= r[1] < starts[i + 1] for r in mine)
            path = hashlib.sha256(",".join(str(r[2]) for r in cs).encode()).hexdigest()
            out.append((client, cs[0][2], cs[0][1], cs[-1][1], len(cs), late, sum(r[5] for r in cs), closed, path))
    return sorted(out)


def found(df):
    cols = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("slot", "stretch"), [(60, 360), (16, 76), (7, 120), (100_000, 200)])
def test_sessions(spark, slot, stretch):
    rng, rows, n = random.Random(5), [], 0
    for client, many, step in ((1, 900, 4.0), (2, 300, 9.0), (3, 150, 20.0), (4, 1, 1.0), (-7, 400, 0.5), (5, 300, 14.9)):
        us = rng.randrange(-50 * MIN, 500 * MIN)
        for _ in range(many):
            us += rng.choice([0, 1, int(MIN * 15) if client == 3 else 1, int(rng.random() * step * MIN)]) if client != 5 else int(14.9 * MIN)
            late = rng.random() < 0.15
            kind = rng.choice(["view", "click", None, "purchase", "signup"] if client in (2, 3) else ["view"] * 60 + ["purchase"])
            row = (n * 37 % 5003, us, us + (rng.choice([16, 15.0001, 900]) if late else rng.choice([0, 15])) * MIN // 1 if rng.random() > 0.02 else None, client, kind, rng.choice([None, 60.0, 59.99, 1.005, -3.2, 1e9, float("nan")]))
            row = (*row[:2], None if row[2] is None else int(row[2]), *row[3:])
            rows += [row] * rng.choice([1, 1, 1, 2])
            n += 1
    rows += [(9001, None, 0, 1, "view", 1.0), (9002, 5, 5, None, "view", 1.0), (None, 5, 5, 1, "view", 1.0)]
    rows += [(9100 + i, 10**14 + i, 10**15, 1, "view", 1.0) for i in range(3)]  # late, long after all islands
    got = sessions.summary(sessions.sessionised(clicks(spark, rows).repartition(3), slot=slot * MIN, stretch=stretch * MIN))
    want = plain_sessions(rows)
    assert found(got) == want and len({r[7] for r in want}) == 4


def test_sessions_of_nothing(spark):
    empty = clicks(spark, [])
    assert sessions.summary(sessions.sessionised(empty)).isEmpty()
    only_late = clicks(spark, [(1, 0, 10**12, 1, None, None)])
    assert sessions.summary(sessions.sessionised(only_late)).isEmpty()


def test_copies_that_differ(spark):
    rows = [(1, 0, 100, 1, "view", 5.0), (1, 10, 50, 1, "view", 7.0), (2, 20, 50, 1, "view", None)]
    (r,) = sessions.summary(sessions.sessionised(clicks(spark, rows))).collect()
    assert (r.session_id, r.start_us, r.n_clicks, r.value_cents) == (1, 10, 2, 700)


def test_times_without_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = clicks(spark, [(1, 12345, 12345, 1, "view", 1.0)])
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sessions.prepared(df).first().us == 12345
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# --- archives ---------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, n long, digest string, first_id long"


def page_rows():
    long = "äb\r\n\r\nWARC/1.1\r\n" * 9000
    same = "x" * 100
    rows = [(3, "http://a/ b\r\nX: y", same), (1, None, same), (7, "u", same), (1, "u2", same), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", None), (8, "u", ""), (9, "u", long), (2, "u", long), (None, "u", long), (None, "v", "y" * 200), (None, "w", "y" * 200), (10, "u", "é" * 50), (11, "u", "é" * 50)]
    return [(*r, 1, "d", 2) for r in rows]


def plain_pages(rows):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html, *_ in rows:
        data, f = (html or "").encode(), first.get(html)
        revisit = f is not None and i != f
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "most"), [(7, 1000), (1000, 1), (1 << 20, 1 << 28)])
def test_archives(spark, chunk, most):
    rows = page_rows()
    manifest = warc.write(spark.createDataFrame(rows, PAGES).repartition(3), chunk=chunk, most_file=most)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.pages_of(warc.read(manifest, chunk=chunk, data=False)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_pages(rows)
    back = warc.read(manifest, chunk=chunk).where("record_type = 'response'").collect()
    assert max(len(r.data) for r in back) <= chunk
    texts = {}
    for r in sorted(back, key=lambda r: (r.path, r.record_no, r.chunk_no)):
        at = texts.setdefault((r.path, r.record_no), [])
        assert r.chunk_no == len(at) and r.is_last == (r.payload_digest is not None)
        at.append(bytes(r.data))
    assert {b"".join(t) for t in texts.values()} == {(r[2] or "").encode() for r in rows}
    targets = {r.target for r in warc.read(manifest).collect()}
    assert "http://a/%20b%0D%0AX:%20y" in targets


def test_no_pages(spark):
    assert warc.pages_of(warc.read(warc.write(spark.createDataFrame([], PAGES)))).isEmpty()


def test_many_copies_of_one_page(spark):
    pages = spark.range(4000).select((F.col("id") + 5).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, "z" * 300).otherwise(F.concat(F.lit("q" * 100), (F.col("id") % 1500).cast("string"))).alias("html"))
    got = warc.pages_of(warc.read(warc.write(pages), data=False)).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in got), key=str) == plain_pages(rows)


def test_damaged_and_plain_archives(spark, tmp_path):
    manifest = warc.write(spark.createDataFrame(page_rows(), PAGES).coalesce(1))
    path, n, _ = manifest.orderBy(F.desc("records")).first()
    at, inner = warc.opened(path)
    whole = at.open_input_stream(inner, compression=None).read()
    import gzip

    plain = gzip.decompress(whole)
    files = {"plain": plain, "cut": plain[: len(plain) // 2], "torn": whole[: len(whole) * 2 // 3], "noise": plain[:200] + b"\r\n\r\nnoise\r\n\r\n", "none": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {n: list(warc.read_file(str(tmp_path / n), 1000)) for n in files}
    assert len([r for r in rows["plain"] if r[10]]) == n + 1  # and the file's own record
    assert rows["none"] == [] and all(rows[n][-1][3] == "damaged" for n in ("cut", "torn", "noise"))
    same = [r[1:] for r in rows["plain"]]
    for n in ("cut", "torn"):
        assert [r[1:] for r in rows[n][:-1]] == same[: len(rows[n]) - 1]


# --- vector codes -----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n long, code string, error long, label_error long"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, v, y) for i, v, y, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = -(-len(good[0][1]) // parts)
    x = np.zeros((len(good), parts * width), np.int64)
    for k, (_, v, _) in enumerate(good):
        x[k, : len(v)] = [int(np.floor(256 * float(np.float32(c)))) for c in v]
    x = x.reshape(len(good), parts, width)
    books = [[list(map(int, v)) for v in x[:entries, p]] for p in range(parts)]
    assign = lambda p: [min((sum((int(a) - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(books[p])) for v in x[:, p]]
    for _ in range(rounds):
        for p in range(parts):
            to = [i for _, i in assign(p)]
            books[p] = [[sum(c) // len(c) for c in zip(*(map(int, x[k, p]) for k in range(len(x)) if to[k] == i), strict=True)] if i in to else e for i, e in enumerate(books[p])]
    found = [assign(p) for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{found[p][k][1]:02x}" for p in range(parts)), sum(found[p][k][0] for p in range(parts)), y, sha) for k, (i, _, y) in enumerate(good)), key=str)


@pytest.mark.parametrize("dim", [32, 37, 16])
def test_vector_codes(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(300, dim)) * 0.02  # few whole numbers, so many ties
    x[200:260] = x[5]
    rows = [(int(i) if i % 11 else 7, [float(np.float32(c)) for c in v], int(i % 3) if i % 3 else None, 1, "c", 2, 3) for i, v in enumerate(x)]
    odd = [None, [], [float("nan")] * dim, [None] * dim, [1.0] * 3, [float("inf")] * dim]
    rows += [(1000 + i, v, 0, 1, "c", 2, 3) for i, v in enumerate(odd)] + [(None, [0.0] * dim, 5, 1, "c", 2, 3)]
    coded, books = codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = sorted(((r.vec_id, r.code, r.error, r.label, codes.digest(books)) for r in coded.collect()), key=str)
    assert got == plain_codes(rows)
    one = coded.where("vec_id = 1").first()
    assert np.abs(codes.decoded(books, one.code)[:dim] - x[1]).max() < 0.2


def test_tree_finds_the_lower_of_equals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 64):
        book = rng.integers(-3, 4, (n, 4))
        x = rng.integers(-4, 5, (2000, 4))
        d = np.square(x[:, None] - book).sum(2)
        i, best = codes.nearest(codes.grown(book), book, x)
        assert (i == d.argmin(1)).all() and (best == d.min(1)).all()


def test_few_or_no_vectors(spark):
    assert codes.compressed(spark.createDataFrame([], VECTORS))[0].isEmpty()
    coded, books = codes.compressed(spark.createDataFrame([(1, [0.0] * 16, 0, 1, "", 2, 3), (2, [-0.001] * 16, 0, 1, "", 2, 3)], VECTORS))
    assert books.shape == (16, 2, 1) and sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    with pytest.raises(Exception, match="don't fit"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 16, 0, 1, "", 2, 3)], VECTORS))


def test_group_values_of_hot_keys(spark):
    from pathloom.llm.common import beside_groups

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("k"), "id")
    sums = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    got = {(r.k, r.id, r.s) for r in beside_groups(rows, sums, "k", most=2).collect()}
    total = {r.k: r.s for r in sums.collect()}
    assert len(got) == 3000 and all(total[k] == s for k, _, s in got)


# --- ids that many rows share -----------------------------------------------------------------------------------


def test_one_id_for_all_vectors(spark):
    """More vectors than the samples hold, all under one id."""
    from pathloom.llm import hamming, neighbours

    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    df = spark.createDataFrame([(5, v.tolist(), 1) for v in x], "vec_id long, embedding array<float>, n long")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum() - len(x)
    got = hamming.near_vectors(df, most=500).collect()
    assert len(got) == len(x) and all((r.component_id, r.kept) == (5, True) for r in got)
    assert 0.95 * want <= sum(r.n_links for r in got) <= want
    both = df.union(spark.createDataFrame([(20, x[0].tolist(), 1)], df.schema))
    (top,) = neighbours.nearest(both, both.where("vec_id = 20"), k=1).collect()
    assert (top.vec_id, top.rank) == (5, 1) and abs(top.score - (x.astype(np.float64) @ x[0].astype(np.float64)).max()) < 1e-9
    same = spark.createDataFrame([(20, [1.0, 2.0]), (20, [1.0, 2.0]), (21, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in neighbours.nearest(same, same.where("vec_id = 20")).collect()] == [21]


def test_pseudonyms_have_no_short_cycle(spark):
    from pathloom.llm import pseudonyms

    values = ["415-555-2671", "4111 1111 1111 1111", "10.20.30.40", "2024-02-29", "someone.else@example.org"]
    df = spark.createDataFrame([(i, f"x {v} y") for i, v in enumerate(values)], "doc_id long, text string")
    first = {r.doc_id: r.text for r in df.collect()}
    for passes in range(1, 11):
        df = spark.createDataFrame(pseudonyms.pseudonymise(df, "k").collect(), "doc_id long, text string")
        now = {r.doc_id: r.text for r in df.collect()}
        assert not any(now[i] == first[i] for i in first), passes
    octets = spark.range(256).select(F.array(F.struct(F.lit(7).alias("v"), F.lit(256).alias("m")), F.struct(F.col("id").cast("int").alias("v"), F.lit(256).alias("m"))).alias("s"))
    images = {tuple(x.v for x in r.p) for r in octets.select(pseudonyms.feistel(F.col("s"), "k", "ip").alias("p")).collect()}
    assert len(images) == 256
