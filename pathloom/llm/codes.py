"""Vector codes by 16 codebooks, learned in whole numbers: the same codes whatever the partitioning.

A component x counts as floor(256 x). A vector is cut into ``PARTS`` consecutive parts; each part's position has a codebook
of at most ``ENTRIES`` entries, which starts as that part of the smallest ids. In each round every part goes to its nearest
entry (squared Euclidean distance, ties to the lower index), and each entry becomes its parts' mean, rounded down; unused
entries stay. The codebooks are all that is broadcast (parts x entries, whatever the input), each as a kd-tree: a part first
descends to the leaf it lies in, and then meets every other leaf whose box is not farther than the best distance so far; boxes as
far are visited as well, so that an equal distance at a lower index is found. Tasks add up their parts as integers, at most
one row a codebook entry, which an aggregation adds up over all tasks; the driver gets one row an entry.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those whose length differs
from that of the smallest kept id's vector (they can't be cut alike). A length that the number of parts doesn't divide is filled
up with zeros; zero and empty vectors count. Ids may repeat: each row is a vector of its own. Of rows with one id the smaller
vector comes first, null ids come last. Null labels are one label. With fewer vectors than entries, codebooks are smaller. An
empty table gives an empty result. Sums are exact: a component beyond 2^20 in size, whose squares long columns can't hold, is
an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside_groups, store, table

PARTS, ENTRIES, ROUNDS, SCALE, LEAF, MOST = 16, 64, 2, 256, 4, 1 << 28
CODED = "vec_id long, label int, code string, error long"


@dataclass
class Node:
    """A box (low, high) around entries; a leaf holds their indexes in order, another node splits them at a component."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    axis: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def grown(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook: split at the median of the widest component."""
    entries = np.arange(len(book)) if entries is None else entries
    x = book[entries]
    node = Node(x.min(0), x.max(0), entries)
    if len(entries) > LEAF and (node.high > node.low).any():
        axis = int(np.argmax(node.high - node.low))
        at = int(np.sort(x[:, axis])[(len(x) - 1) // 2])
        at = at if at < node.high[axis] else at - 1
        low = x[:, axis] <= at
        node.axis, node.at, node.left, node.right = axis, at, grown(book, entries[low]), grown(book, entries[~low])
    return node


def nearest(root: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest entry (ties: the lower one) and its squared distance."""
    best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book))
    home = np.zeros(len(x), np.int64)

    def offer(leaf: Node, rows: np.ndarray) -> None:
        d = np.square(x[rows, None] - book[leaf.entries]).sum(2)
        first = d.argmin(1)  # entries are in order, so the lower one of equals
        d, i = d[np.arange(len(rows)), first], leaf.entries[first]
        better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], i[better]

    def descend(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.left is None:
            home[rows] = id(node)
            offer(node, rows)
            return
        low = x[rows, node.axis] <= node.at
        descend(node.left, rows[low])
        descend(node.right, rows[~low])

    def visit(node: Node, rows: np.ndarray) -> None:
        off = np.maximum(node.low - x[rows], 0) + np.maximum(x[rows] - node.high, 0)
        rows = rows[np.square(off).sum(1) <= best[rows]]
        if not len(rows):
            return
        if node.left is None:
            offer(node, rows[home[rows] != id(node)])
            return
        visit(node.left, rows)
        visit(node.right, rows)

    every = np.arange(len(x))
    descend(root, every)
    if len(x):
        visit(root, every)
    return index, best


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as whole numbers: (rows, parts, width)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.floor(SCALE * x)
    if x.size and np.abs(x).max() > MOST:
        raise ValueError(f"components beyond {MOST // SCALE} don't fit")
    out = np.zeros((len(x), PARTS * width), np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), PARTS, width)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, embedding of rows without null or non-finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return e.where(F.col("embedding").isNotNull() & ~odd)


def train(good: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, width) whole numbers, of vectors of one length as ``usable`` returns them."""
    spark = good.sparkSession
    first = good.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow().column("embedding").combine_chunks()
    width = -(-len(first[0]) // PARTS)
    books = np.ascontiguousarray(_whole(first, width).transpose(1, 0, 2))
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((books, [grown(b) for b in books]))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books, trees = shared.value
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                x = _whole(batch.column(0), width)
                for p, (book, tree) in enumerate(zip(books, trees, strict=True)):
                    i = nearest(tree, book, x[:, p])[0]
                    count[p] += np.bincount(i, minlength=len(book))
                    np.add.at(total[p], i, x[:, p])
            part, entry = np.nonzero(count)
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), *[pa.array(total[part, entry, i]) for i in range(width)]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *names])

        schema = ", ".join(["part int", "entry int", "n long", *[f"{s} long" for s in names]])
        got = good.select("embedding").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).toArrow()  # a row an entry
        part, entry, n = (got.column(c).to_numpy() for c in ("part", "entry", "n"))
        books = books.copy()
        for i, s in enumerate(names):
            books[part, entry, i] = got.column(s).to_numpy() // n  # rounds down
        shared.destroy()
    return books


def encode(good: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances of all parts)."""
    width = books.shape[2]
    shared = good.sparkSession.sparkContext.broadcast((books, [grown(b) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        for batch in batches:
            x = _whole(batch.column("embedding"), width)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, (book, tree) in enumerate(zip(books, trees, strict=True)):
                code[:, p], d = nearest(tree, book, x[:, p])
                error += d
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return good.mapInArrow(run, CODED)


def decoded(books: np.ndarray, code: str) -> np.ndarray:
    """The vector that a code stands for, in the scale of the originals (a cell's lower corner)."""
    return np.concatenate([book[i] for book, i in zip(books, bytes.fromhex(code), strict=True)]) / SCALE


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, and the codebooks."""
    good = usable(embeddings)
    first = good.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).first()
    if first is None:
        return embeddings.sparkSession.createDataFrame([], CODED), np.zeros((PARTS, 0, 0), np.int64)
    good = good.where(F.size("embedding") == first.n)
    books = train(good)
    return encode(good, books), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    coded = store(coded)
    sums = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error"))
    return beside_groups(coded, sums, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
