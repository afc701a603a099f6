"""Embeddings learned from texts: TF-IDF weights and a randomised truncated SVD, with tables throughout.

A text is its words' 1 + log(count) times log((1 + texts) / (1 + texts with the word)) + 1, scaled to length one; the texts' rows form a
sparse matrix A of (row, term, weight). Its range is found by random projection (Halko, Martinsson and Tropp, 2011): a term's random
directions come from a hash of the term, so nothing is broadcast; ``power`` rounds with A and its transpose sharpen it. The tall
matrices of the iteration are orthonormalised by the Gram matrix of their rows, added up by partial sums (Cholesky QR, done twice
against rounding): the driver gets only width x width numbers. A term's factors are its column of the projected matrix, turned by
the small SVD; a text's embedding is the weighted sum of its terms' factors, so new texts are folded in alike, by a join or, for
models up to ``MOST_BYTES``, by a Column function without one.

Defined results: null and empty texts have no words, and a zero vector as embedding; words that the model doesn't know don't count.
A model of no words is empty. The rank is at most that of the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .intent import words
from .lineage import cut

RANK, OVERSAMPLE, POWER, MOST_BYTES = 32, 8, 2, 64_000_000


@dataclass
class Model:
    """terms (term, idf, f: its factors) and the singular values, greatest first."""

    terms: DataFrame
    values: np.ndarray


def _weights(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The sparse matrix (row, term, x), rows of length one, and term, idf."""
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    rows = cut(rows.where("text IS NOT NULL"))
    counts = rows.select("row", F.explode(words(F.col("text"))).alias("term")).groupBy("row", "term").agg(F.count(F.lit(1)).alias("n"))
    counts, n = cut(counts), rows.count()
    idf = cut(counts.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf")))
    x = counts.join(idf, "term").select("row", "term", ((1 + F.log("n")) * F.col("idf")).alias("x"))
    size = x.groupBy("row").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return cut(x.join(size, "row").select("row", "term", (F.col("x") / F.col("size")).alias("x"))), idf


def _random(term: str, width: int, seed: int) -> np.ndarray:
    import zlib

    return np.random.default_rng([seed, zlib.crc32(term.encode()), len(term)]).normal(size=width)


def _sums(matrix: DataFrame, by: str, other: str, vectors: DataFrame) -> DataFrame:
    """by, v: for each ``by`` of the sparse matrix the weighted sum of the vectors (other, v) that it meets."""
    kind = matrix.schema[by].dataType.simpleString()
    met = matrix.join(vectors, other).select(by, "x", "v")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) * batch.column("x").to_numpy()[:, None]
            total = np.zeros((len(codes.dictionary), v.shape[1]))
            np.add.at(total, codes.indices.to_numpy(), v)
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(list(total), pa.list_(pa.float64()))], names=[by, "v"])

    parts = met.mapInArrow(partial, f"{by} {kind}, v array<double>").select(by, F.posexplode("v").alias("i", "y"))
    return parts.groupBy(by, "i").agg(F.sum("y").alias("y")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("v"))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            total += v.T @ v if len(v) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], names=["i", "y"])

    got = vectors.select("v").mapInArrow(run, "i int, y double").groupBy("i").agg(F.sum("y").alias("y")).orderBy("i").toArrow()
    return got.column("y").to_numpy().reshape(width, width) if got.num_rows else np.zeros((width, width))


def _turned(vectors: DataFrame, by: str, turn: np.ndarray) -> DataFrame:
    """Each vector times a small matrix."""
    kind = vectors.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ turn
                yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(list(v), pa.list_(pa.float64()))], names=[by, "v"])

    return vectors.select(by, "v").mapInArrow(run, f"{by} {kind}, v array<double>")


def _orthonormal(vectors: DataFrame, by: str, width: int) -> tuple[DataFrame, int]:
    """The vectors turned so that their columns are orthonormal, and how many columns that leaves."""
    for _ in range(2):
        vectors = cut(vectors)
        values, basis = np.linalg.eigh(_gram(vectors, width))
        keep = values > max(values.max(), 0) * 1e-13
        if not keep.any():
            return vectors.limit(0), 0
        vectors = _turned(vectors, by, basis[:, keep] / np.sqrt(values[keep]))
        width = int(keep.sum())
    return cut(vectors), width


def fit(texts: DataFrame, text: str, rank: int = RANK, power: int = POWER, oversample: int = OVERSAMPLE, seed: int = 0) -> Model:
    a, idf = _weights(texts, text)
    width = rank + oversample

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [_random(t, width, seed) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.list_(pa.float64()))], names=["term", "v"])

    v = idf.select("term").mapInArrow(draw, "term string, v array<double>")
    q, left = _orthonormal(_sums(a, "row", "term", v), "row", width)
    for _ in range(power if left else 0):
        z, left = _orthonormal(_sums(a, "term", "row", q), "term", left)
        q, left = _orthonormal(_sums(a, "row", "term", z), "row", left)
    if not left:
        return Model(idf.withColumn("f", F.array().cast("array<double>")).limit(0), np.zeros(0))
    b = cut(_sums(a, "term", "row", q))  # the projected matrix, a column a term
    values, basis = np.linalg.eigh(_gram(b, left))
    by = np.argsort(-values)[:rank]
    by = by[values[by] > values.max() * 1e-13]
    sigma = np.sqrt(values[by])
    factors = _turned(b, "term", basis[:, by] / sigma).withColumnRenamed("v", "f")
    return Model(cut(idf.join(factors, "term")), sigma)


def embedded(texts: DataFrame, text: str, model: Model, name: str = "embedding") -> DataFrame:
    """``texts`` with ``name``, by a join on words, however large the model."""
    rows = cut(texts.withColumn("_row", F.monotonically_increasing_id()))
    n = rows.select("_row", F.explode(words(F.col(text))).alias("term")).groupBy("_row", "term").agg(F.count(F.lit(1)).alias("n"))
    x = n.join(model.terms.select("term", "idf"), "term").select(F.col("_row").alias("row"), "term", ((1 + F.log("n")) * F.col("idf")).alias("x"))
    size = x.groupBy("row").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    v = _sums(x.join(size, "row").select("row", "term", (F.col("x") / F.col("size")).alias("x")), "row", "term", model.terms.select("term", F.col("f").alias("v")))
    zero = F.array(*[F.lit(0.0)] * len(model.values)).cast("array<double>")
    return rows.join(v, F.col("_row") == F.col("row"), "left").select(*texts.columns, F.coalesce("v", zero).alias(name))


def embedder(model: Model, most_bytes: int = MOST_BYTES) -> Callable[[Column], Column]:
    """A Column function, as ``embed`` of ``evaluate`` and ``recommend`` takes it; larger models are an error (use ``embedded``)."""
    size = model.terms.agg(F.sum(F.octet_length("term") + 8 * F.size("f") + 64)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a model of {size} bytes: embed by a join (embedded)")
    got = model.terms.select("term", "idf", "f").collect()  # most_bytes at most
    shared = model.terms.sparkSession.sparkContext.broadcast({r.term: (r.idf, np.array(r.f)) for r in got})
    width = len(model.values)

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(found: pd.Series) -> pd.Series:
        known, out = shared.value, []
        for ws in found:
            counts: dict[str, int] = {}
            for w in ws if ws is not None else ():
                if w in known:
                    counts[w] = counts.get(w, 0) + 1
            x = {w: (1 + np.log(n)) * known[w][0] for w, n in counts.items()}
            size = np.sqrt(sum(v * v for v in x.values())) or 1.0
            out.append(sum((v / size * known[w][1] for w, v in x.items()), np.zeros(width)).tolist())
        return pd.Series(out)

    return lambda text: embed(words(text))
