"""Operator 1, approximate nearest neighbours: maximum inner product by score-aware anisotropic quantisation.

The model is fitted on a bounded sample: leaves (k-means centres), and codebooks of 16 centres for every two
dimensions. A vector x with quantisation residual r costs |r|^2 + (eta - 1) (r . x / |x|)^2: the part of the
error parallel to x, which moves large inner products, is penalised by eta. Codebooks are fitted by
alternating coordinate descent over codes and least squares under that cost, and every row is encoded by the
same descent, two 4-bit codes to a byte.

Search: the stated queries meet the index leaf by leaf. For each query its (3 k)-th best inner product within
the sample is a lower bound of its true (3 k)-th best; a leaf is skipped if none of its vectors can be expected to
reach that: beyond q . c + |q| radius none can, and beyond q . c + ``SPREAD`` standard deviations of the leaf's
residuals along q (their mean square in the leaf, shaped as the sample's residuals are) hardly any does. In a leaf,
a 16-entry table per code position is built for each query, the codes are scanned by table sums, and what comes
within ``MARGIN`` standard errors of the lower bound is scored exactly on the original vectors; what reaches the bound
goes to the merge.

Skew: equal vectors are one entry that carries their k + 1 smallest ids (no more can show in a result),
combined in the map tasks; a leaf of more than ``BLOCK`` entries is dealt to several units, and queries are dealt
to blocks of about ``ASKS``, so both sides of a unit of work are bounded.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have not the most
frequent length take no part; neither do null ids; a repeated id is one entry per distinct vector; with fewer
candidates than k all are returned; ties go to the smaller id; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import counted, cut, table
from .hamming import matrix, vectors

K, SLACK, MARGIN, SPREAD, LEAF_ROWS, MOST_LEAVES, BLOCK, ASKS, SAMPLE, FIT, THRESHOLD, PART, EVERY = 20, 3, 3.0, 4.5, 1024, 1024, 4096, 20_000, 20_000, 5_000, 0.2, 2, 20


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    """Four-bit product codes under the anisotropic cost."""

    def __init__(self, x: np.ndarray, seed: int = 1, rounds: int = 3, threshold: float = THRESHOLD):
        self.dim = x.shape[1]
        self.parts = -(-self.dim // PART)
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        p = self._split(x)
        books = [kmeans(p[:, m], 16, seed + m) for m in range(self.parts)]
        self.books = np.zeros((self.parts, 16, PART))
        for m, b in enumerate(books):
            self.books[m, : len(b)] = b
            self.books[m, len(b) :] = b[:1]
        for _ in range(rounds):
            self._refit(x, self.codes(x))

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * PART))
        wide[:, : self.dim] = x
        return wide.reshape(len(x), self.parts, PART)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent from the nearest centres."""
        p = self._split(x)
        unit = self._split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
        out = np.stack([((p[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)], 1)
        along = ((p - self.books[np.arange(self.parts), out]) * unit).sum((1, 2))
        for _ in range(sweeps):
            for m in range(self.parts):
                left = p[:, m, None] - self.books[m]
                part = np.einsum("nkd,nd->nk", left, unit[:, m])
                rest = along - part[np.arange(len(x)), out[:, m]]
                best = ((left**2).sum(2) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(1)
                out[:, m] = best
                along = rest + part[np.arange(len(x)), best]
        return out

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codebooks of least cost for given codes: one linear system over all centres."""
        d, n = self.parts * PART, self.parts * 16 * PART
        wide = self._split(x).reshape(len(x), d)
        unit = wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-30)
        at = ((np.arange(self.parts) * 16 + codes)[:, :, None] * PART + np.arange(PART)).reshape(len(x), d)
        a, b = np.zeros(n * n), np.zeros(n)
        for i in range(0, len(x), 1000):
            u, k = unit[i : i + 1000], at[i : i + 1000]
            weight = (self.eta - 1) * u[:, :, None] * u[:, None]
            weight[:, np.arange(d), np.arange(d)] += 1
            a += np.bincount((k[:, :, None] * n + k[:, None]).ravel(), weight.ravel(), n * n)
            b += np.bincount(k.ravel(), np.einsum("nij,nj->ni", weight, wide[i : i + 1000]).ravel(), n)
        a = a.reshape(n, n)
        free = a.diagonal() > 0
        solved = self.books.ravel().copy()
        solved[free] = np.linalg.solve(a[np.ix_(free, free)] + 1e-6 * np.eye(int(free.sum())), b[free])
        self.books = solved.reshape(self.parts, 16, PART)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.parts), codes].reshape(len(codes), -1)[:, : self.dim]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        c = codes.astype(np.uint8)
        if c.shape[1] % 2:
            c = np.column_stack([c, np.zeros(len(c), np.uint8)])
        return c[:, ::2] | c[:, 1::2] << 4

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Table sums of every query (columns) over every packed code (rows)."""
        tables = np.einsum("qmd,mkd->mkq", self._split(queries), self.books).astype(np.float32)
        out = np.zeros((len(packed), len(queries)), np.float32)
        for m in range(self.parts):
            out += tables[m][(packed[:, m // 2] >> (4 * (m % 2))) & 15]
        return out


class Index:
    """What all tasks share: leaves, quantiser and the sample for lower bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, total: int):
        leaves = max(1, min(MOST_LEAVES, -(-total // LEAF_ROWS)))
        self.centres = kmeans(x, leaves, 3)
        self.quantiser = Quantiser(x[np.random.default_rng(5).permutation(len(x))[:FIT]])
        self.ids, self.x = ids, x.astype(np.float32)
        # how a leaf's residuals spread along a direction, against their mean square
        left = x - self.centres[self.leaf(x)]
        shape = left.T @ left
        self.shape = shape / max(float(np.trace(shape)), 1e-300)
        # the scan's standard error for a query of unit length
        part = x[:FIT]
        self.error = float(np.sqrt(((part - self.quantiser.decode(self.quantiser.codes(part))) ** 2).sum(1).mean() / x.shape[1]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)

    def lower_bounds(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best inner product within the sample, its own id left out and each other id counted once."""
        out = np.full(len(queries), -np.inf)
        order = np.argsort(self.ids, kind="stable")
        names, first = np.unique(self.ids[order], return_index=True)
        if len(names) > k:
            x = self.x.astype(np.float64)[order]
            for i in range(0, len(queries), 256):
                s = queries[i : i + 256] @ x.T
                s = np.maximum.reduceat(s, first, 1) if len(first) < len(x) else s
                s[ids[i : i + 256, None] == names[None]] = -np.inf
                out[i : i + 256] = np.partition(s, len(names) - k, 1)[:, len(names) - k]
        return out - 1e-9 * np.maximum(1, np.abs(out, where=np.isfinite(out), out=np.ones_like(out)))


def _entries(good: DataFrame, most: int) -> DataFrame:
    """A row per distinct vector: embedding, ids (its ``most`` smallest)."""

    def fewest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, row in zip(batch.column("id").to_pylist(), matrix(batch.column("embedding")) + 0.0, strict=True):
                ids = seen.setdefault(row.tobytes(), [])
                ids.append(i)
                if len(ids) >= 4 * most:
                    seen[row.tobytes()] = sorted(set(ids))[:most]
            if len(seen) > 20_000:
                yield out(seen)
                seen = {}
        if seen:
            yield out(seen)

    def out(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.frombuffer(k) for k in seen], pa.list_(pa.float64())), pa.array([sorted(set(v))[:most] for v in seen.values()], pa.list_(pa.int64()))], names=["embedding", "ids"])

    rows = good.select("id", "embedding").mapInArrow(fewest, "embedding array<double>, ids array<long>")
    return rows.groupBy("embedding").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def nearest(df: DataFrame, queries: DataFrame, k: int = K, margin: float = MARGIN) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each of ``queries`` among all rows of ``df``."""
    spark = df.sparkSession
    result = "query_id long, vec_id long, score double"
    good, dim = vectors(df)
    good, total = counted(good)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked, n = counted(vectors(queries)[0].where(F.size("embedding") == dim).select("id", "embedding").distinct())
    blocks = max(1, -(-n // ASKS))
    share = min(1.0, SAMPLE / total)
    chance = F.pmod(F.xxhash64("id", "embedding", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    got = good.where(chance < share).orderBy("id", "embedding").limit(2 * SAMPLE).toArrow()
    got = got if got.num_rows else good.orderBy("id", "embedding").limit(SAMPLE).toArrow()  # copies of few vectors
    index = Index(got.column("id").to_numpy(), matrix(got.column("embedding").combine_chunks()), total)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            leaf = own.leaf(x)
            far = np.linalg.norm(x - own.centres[leaf], axis=1)
            code = own.quantiser.pack(own.quantiser.codes(x))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("ids"), batch.column("embedding")], names=["leaf", "far", "code", "ids", "embedding"])

    entries = cut(_entries(good, k + 1).select("embedding", "ids").mapInArrow(encode, "leaf int, far double, code binary, ids array<long>, embedding array<double>"))
    far = F.col("far")
    stats = {r.leaf: (r.radius, r.square, -(-r.n // BLOCK)) for r in entries.groupBy("leaf").agg(F.max(far).alias("radius"), F.avg(far * far).alias("square"), F.count(F.lit(1)).alias("n")).collect()}  # a row per leaf
    units = F.create_map(*[F.lit(x) for leaf, (_, _, n) in stats.items() for x in (leaf, n)])
    unit = F.pmod(F.xxhash64("code", "ids"), F.element_at(units, F.col("leaf"))).cast("int")
    dealt = entries.select("leaf", unit.alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "code", "ids", "embedding")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, q, dealt_to = part.column("id").to_numpy(), matrix(part.column("embedding")), part.column("block").to_numpy()
                least = own.lower_bounds(ids, q, SLACK * k)
                most = q @ own.centres.T
                size = np.linalg.norm(q, axis=1) * (1 + 1e-9)
                along = SPREAD * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", q, own.shape, q), 0))
                rows = []
                for leaf, (radius, square, n) in stats.items():
                    reach = np.minimum(size * radius, along * np.sqrt(square))
                    for b in range(blocks):
                        go = np.flatnonzero((most[:, leaf] + reach >= least) & (dealt_to == b))
                        if len(go):
                            blob = [ids[go].tobytes(), q[go].tobytes(), least[go].tobytes()]
                            rows += [(leaf, u, b, *blob) for u in range(n)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["leaf", "unit", "block", "qids", "q", "least"])

    def search(block: pa.Table, asks: pa.Table) -> pa.Table:
        own: Index = shared.value
        out_q, out_v, out_s = [], [], []
        if block.num_rows and asks.num_rows:
            x = matrix(block.column("embedding").combine_chunks())
            ids = block.column("ids").to_pylist()
            packed = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            qids, q, least = (np.frombuffer(b"".join(asks.column(c).to_pylist()), t) for c, t in (("qids", np.int64), ("q", np.float64), ("least", np.float64)))
            q = q.reshape(len(qids), -1)
            slack = margin * own.error * np.linalg.norm(q, axis=1)
            for at in range(0, len(qids), 128):
                ask = slice(at, at + 128)
                approx = own.quantiser.scan(q[ask], packed)
                which, row = np.nonzero(approx.T >= (least - slack)[ask, None])
                exact = np.einsum("ij,ij->i", x[row], q[ask][which])
                ok = exact >= least[ask][which]
                which, row, exact = which[ok], row[ok], exact[ok]
                order = np.lexsort((-exact, which))
                which, row, exact = which[order], row[order], exact[order]
                cuts = np.searchsorted(which, np.arange(approx.shape[1] + 1))
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    me = int(qids[at + i])
                    found: list[tuple[float, int]] = []
                    for s, r in zip(exact[lo:hi].tolist(), row[lo:hi].tolist(), strict=True):
                        if len(found) >= k and s < -found[-1][0]:
                            break
                        found += [(-s, v) for v in ids[r] if v != me]
                    found.sort()
                    for s, v in found[:k]:
                        out_q.append(me)
                        out_v.append(v)
                        out_s.append(-s)
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    asks = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).mapInArrow(visits, "leaf int, unit int, block int, qids binary, q binary, least binary")
    found = dealt.groupBy("leaf", "unit", "block").cogroup(asks.groupBy("leaf", "unit", "block")).applyInArrow(search, result)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
