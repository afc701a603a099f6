"""Operator 9, embedding near-dedup: iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample of unit vectors, less their mean, by iterative quantisation (alternating
sign codes and orthogonal Procrustes), several from different starts; the sign bits of a vector under all
rotations are its code, so bits are balanced wherever the vectors lie. The code is cut into tables. Vectors that
agree in a table's bits meet in that table's bucket; pairs whose whole codes differ too much are left out, the
others are reranked on the original vectors: linked where the cosine, in double precision, is at least the
threshold. A pair leaves only the first table in which it meets, so no pair is made twice.

A table has about log2(rows) bits, so that buckets stay small as the input grows, and fewer where ``MOST_TABLES``
tables could not find ``RECALL`` of the pairs. That is measured, not assumed: vectors of the sample are paired
with vectors at exactly the threshold from them, and the share of such pairs that agree in a table's bits gives the
number of tables, the spread of their codes' differences what is left out.

Skew: equal vectors are one class (map-side combined, weighted by their number). A bucket of more than
``BLOCK`` classes is dealt to blocks, and pairs of blocks are the units of work, so no task holds an
unbounded group.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have not the
most frequent length, link with nothing (n_links 0, a component of their own, kept); rows with one vec_id
are vectors of their own with that id; a null vec_id links with nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, counted, cut, table

SAMPLE, ROUNDS, BLOCK, COSINE = 20_000, 30, 128, 0.95
RECALL, MOST_TABLES, LEAST_BITS, MOST_BITS, PROBES = 0.99, 32, 8, 24, 4000


def usable(embedding: str = "embedding") -> F.Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    e = F.col(embedding)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(e.isNotNull() & ~odd & F.exists(e, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_name: str = "vec_id") -> tuple[DataFrame, int]:
    """The usable vectors (id, embedding as array<double>) of the most frequent length, and that length."""
    good = df.select(F.col(id_name).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("id").isNotNull() & usable())
    most = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = most.n if most else 0
    return good.where(F.size("embedding") == dim), dim


def sample(rows: DataFrame, n: int, most: int, seed: int) -> np.ndarray:
    """About ``most`` of ``n`` vectors (all, if fewer), chosen by a hash of the vectors; never more than twice ``most``."""
    share = min(1.0, most / max(1, n))
    chance = F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    got = rows.where(chance < share).select(F.col("embedding").cast("array<float>").alias("embedding")).orderBy("embedding").limit(2 * most).toArrow()
    return matrix(got.column("embedding").combine_chunks())


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Iterative quantisation: a rotation of unit vectors ``x`` whose signs lose least."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds if len(x) else 0):
        code = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(code.T @ x)
        r = (u @ vt).T
    return r


class Coder:
    """Codes of vectors: ``tables`` of ``bits`` bits each, a table's bits padded to whole bytes."""

    def __init__(self, x: np.ndarray, n: int, cosine: float, recall: float = RECALL):
        """``x``: unit vectors of a sample; ``n``: rows of the whole input."""
        dim = x.shape[1]
        self.mean = x.mean(0)
        learnt: list[np.ndarray] = []

        def turned(bits: int) -> np.ndarray:
            while len(learnt) * dim < bits:
                learnt.append(learn_rotation(x - self.mean, len(learnt)))
            return np.concatenate(learnt, 1)[:, :bits]

        # pairs at the threshold itself
        rng = np.random.default_rng(9)
        a = x[rng.integers(0, len(x), PROBES)]
        side = rng.normal(size=a.shape)
        side -= (side * a).sum(1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine**2) * side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-30)
        def found(bits: int, tables: int) -> np.ndarray:
            """Of all pairs, which tables find them."""
            r = turned(bits * tables)
            same = ((a - self.mean) @ r >= 0) == ((b - self.mean) @ r >= 0)
            return same.reshape(len(a), tables, bits).all(2)

        for self.bits in range(int(np.clip(round(np.log2(max(2, n))), LEAST_BITS, MOST_BITS)), LEAST_BITS - 1, -1):
            hit = np.clip(found(self.bits, 4).mean(), 1e-6, 0.999)
            self.tables = int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))
            # pairs differ in how well they agree, so the tables that are enough on average may not be
            while self.tables <= MOST_TABLES and found(self.bits, self.tables).any(1).mean() < recall:
                self.tables += 1
            if self.tables <= MOST_TABLES:
                break
        self.tables = min(self.tables, MOST_TABLES)
        self.rotation = turned(self.tables * self.bits)
        off = (((a - self.mean) @ self.rotation >= 0) != ((b - self.mean) @ self.rotation >= 0)).sum(1)
        self.far = int(np.ceil(off.mean() + 6 * off.std()))  # differing bits beyond which a pair is left out
        self.bytes = -(-self.bits // 8)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bytes of unit vectors: rows x tables x bytes."""
        bits = np.zeros((len(x), self.tables, self.bytes * 8), np.uint8)
        bits[:, :, : self.bits] = ((x - self.mean) @ self.rotation >= 0).reshape(len(x), self.tables, self.bits)
        return np.packbits(bits, axis=2, bitorder="little")


def hamming_pairs(classes: DataFrame, coder: Coder) -> DataFrame:
    """Candidate pairs (a, b), a < b, of classes (id, embedding), each once."""
    shared = classes.sparkSession.sparkContext.broadcast(coder)
    tables, width, far = coder.tables, coder.bytes, coder.far

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Coder = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            codes = own.codes(x)
            n, ids = len(codes), batch.column("id").to_numpy()
            keys = (codes.astype(np.int32) << (8 * np.arange(width, dtype=np.int32))).sum(2, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel()), pa.array(np.repeat(ids, tables)),
                pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(np.repeat(np.arange(n), tables))),
            ], names=["t", "key", "id", "code"])

    rows = cut(classes.select("id", "embedding").mapInArrow(encode, "t int, key int, id long, code binary"))
    # buckets by size; a lone row pairs with nothing
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = rows.join(sizes, ["t", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("t", "key", "id", "code", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # many small buckets share a unit of work; a pair of blocks of a large one is its own
    unit = F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(unit.alias("unit"), "t", "key", "id", "code", "own", F.greatest("own", "other").alias("j"), F.least("own", "other").alias("i"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            tab = pa.Table.from_batches(held)
            units = tab.column("unit").to_numpy()
            stop = len(units) if last else int(np.searchsorted(units, units[-1]))
            held = tab.slice(stop).to_batches()
            cuts = np.flatnonzero(np.diff(units[:stop])) + 1
            bounds = [0, *cuts.tolist(), stop]
            ids, t = tab.column("id").to_numpy(), tab.column("t").to_numpy()
            own, i, j = (tab.column(c).to_numpy() for c in ("own", "i", "j"))
            codes = np.frombuffer(b"".join(tab.column("code").to_pylist()), np.uint8).reshape(len(units), -1)
            words = codes.reshape(len(units), tables, width)
            out_a, out_b = [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                diff = np.bitwise_count(codes[a:b, None] ^ codes[None, a:b]).sum(2, dtype=np.int32)
                ok = (diff <= far) & (ids[a:b, None] < ids[None, a:b])
                if i[a] != j[a]:
                    ok &= own[a:b, None] != own[None, a:b]
                x, y = np.nonzero(ok)
                # this table must be the first in which the two meet
                same = (words[a:b][x] == words[a:b][y]).all(2)
                first = same.any(1) & (same.argmax(1) == t[a])
                out_a.append(ids[a:b][x[first]])
                out_b.append(ids[a:b][y[first]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > 20_000:
                yield from done(False)
                n = sum(x.num_rows for x in held)
        if n:
            yield from done(True)

    return dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(pairs, "a long, b long")


def similar_pairs(classes: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """``pairs`` whose vectors' cosine, on the originals in double precision, is at least ``cosine``."""
    v = classes.select("id", "embedding")
    both = pairs.join(v.withColumnsRenamed({"id": "a", "embedding": "x"}), "a").join(v.withColumnsRenamed({"id": "b", "embedding": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = matrix(batch.column("x")), matrix(batch.column("y"))
                c = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                ok = pa.array(c >= cosine)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_vectors(df: DataFrame, cosine: float = COSINE, most: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``df``."""
    good, dim = vectors(df)
    # ids may be shared by different vectors, so classes of equal vectors have keys of their own
    classes = good.groupBy("embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes, n = counted(classes.withColumn("id", F.monotonically_increasing_id()))
    if n:
        x = sample(classes, n, most, 9)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = cut(similar_pairs(classes, hamming_pairs(classes, Coder(x, n, cosine)), cosine))
    else:
        links = classes.sparkSession.createDataFrame([], "a long, b long")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = classes.select(F.col("id").alias("b"), F.col("copies").alias("weight"))
    degree = both.join(other, "b").groupBy("a").agg(F.sum("weight").alias("links"))
    member = components(links).select(F.col("id").alias("c"), "component")
    named = member.join(classes, F.col("c") == F.col("id")).groupBy("component").agg(F.min("least").alias("smallest"))
    found = classes.join(degree, classes.id == degree.a, "left").join(member.join(named, "component"), classes.id == F.col("c"), "left")
    found = found.select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    out = df.select("vec_id", F.when(F.col("vec_id").isNotNull() & usable() & (F.size("embedding") == dim), F.col("embedding").cast("array<double>")).alias("e"))
    out = out.join(found, out.e == found.embedding, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
