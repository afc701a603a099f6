"""Operator 7, best-fit packing: sum-of-squares packing of tokenised documents into sequences.

Each document is tokenised and closed with an end id; documents above the capacity are cut into full
pieces, of which the first may be shorter. A full piece is a sequence of its own. The pieces below the capacity
are dealt evenly to chunks of about ``CHUNK`` pieces, and within a chunk they are packed by the sum-of-squares
rule: a piece goes where the sum, over residual gaps, of the squared number of open bins with that gap
becomes smallest. That is done for two orders, falling length and seeded random, and the better one counts. Chunks
are packed by different tasks, so nothing meets on the driver, and a table of any size is packed by the same rule;
what a chunk leaves open are some bins among tens of thousands.

Defined results: null text counts as empty (the end id alone); a text counts whole, however long; repeated rows are
packed once each; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted, slices, table

CAPACITY, END_ID, CHUNK = 2048, 0, 262_144
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SPECIAL, _UNSAFE, _SPLIT = "<|endoftext|>", re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Ids of a chunk of text as little-endian 32-bit bytes, by chunk."""

    most, longest, group = 900_000, 64, 20_000

    def __init__(self, tokenizer, lead: str):
        self.tokenizer, self.lead = tokenizer, lead

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = np.array(self.tokenizer.encode(self.lead + chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= self.longest:
            self[chunk] = ids
        return ids

    def learn(self, chunks: set[str]) -> None:
        """Chunks that are still missing, many in a call."""
        new = [c for c in chunks if len(c) <= self.longest and c not in self]
        if len(self) + len(new) >= self.most:
            self.clear()
        for i in range(0, len(new), self.group):
            part = new[i : i + self.group]
            found = self.tokenizer.encode_batch_fast([self.lead + c for c in part], add_special_tokens=False)
            self.update(zip(part, (struct.pack(f"<{len(f)}I", *f.ids) for f in found), strict=True))


class Encoder:
    """Ids of whole texts, from the ids of chunks.

    Byte-level pre-tokenisation never joins a space that is followed by a visible character to what stands
    before it, so a text may be encoded chunk by chunk, and each distinct chunk once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.later = _Memo(self.tokenizer, ""), _Memo(self.tokenizer, " ")

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        parts = [None if _SPECIAL in t else _SPLIT.split(t) if _UNSAFE.search(t) else t.split(" ") for t in texts]
        self.later.learn({c for p in parts if p for c in p[1:]})
        return [self._whole(t, p) for t, p in zip(texts, parts, strict=True)]

    def _whole(self, text: str, parts: list[str] | None) -> bytes:
        if parts is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # a leading space belongs to the first visible chunk
        head = self.first[parts[0]] if parts[0] else b""
        return head + b"".join(map(self.later.__getitem__, parts[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens."""
    first = min(total, (total - 1) % capacity + 1)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids."""
    path = path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                rows = []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.many(texts), strict=True):
                    ids += end
                    rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def sum_of_squares(items: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``items`` (lengths below ``capacity``), in the order given: each one's bin and place in it by the rule."""
    gaps = np.zeros(capacity + 1, np.int64)  # open bins by gap; full bins aren't counted
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
    far, used = np.int64(1) << 60, 0
    for i, n in enumerate(map(int, items)):
        here = gaps[n:capacity]
        change = 2 * (gaps[: capacity - n] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = far
        k = int(change.argmin())
        if change[k] < far and change[k] <= 2 * gaps[capacity - n] + 1:
            gap = n + k
            gaps[gap] -= 1
            at = by_gap[gap].pop()
        else:
            gap, at, used = capacity, used, used + 1
        bins[i], places[i] = at, capacity - gap
        if gap > n:
            gaps[gap - n] += 1
            by_gap[gap - n].append(at)
    return bins, places


def best_order(lengths: np.ndarray, capacity: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Bins and places of ``lengths`` (sorted, below ``capacity``) by the better of two orders."""
    best: tuple[np.ndarray, np.ndarray] | None = None
    for order in (np.arange(len(lengths))[::-1], np.random.default_rng(seed).permutation(len(lengths))):
        bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        bins[order], places[order] = sum_of_squares(lengths[order], capacity)
        if best is None or bins.max(initial=-1) < best[0].max(initial=-1):
            best = bins, places
    return best


def packed(pieces: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    open_ = F.col("length") < capacity
    # rows are numbered, so that even one document repeated without end is dealt evenly
    pieces, n = counted(pieces.select(*columns, F.monotonically_increasing_id().alias("n")), open_)
    chunks = max(1, -(-n // chunk))

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        order = np.lexsort([group.column(c).fill_null(-1).to_numpy() for c in ("start", "ids_crc32", "doc_id", "length")])
        bins, places = best_order(lengths[order], capacity)
        out = group.select(columns).take(pa.array(order))
        base = group.column("chunk")[0].as_py() << 32
        return out.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(places))

    dealt = pieces.where(open_).withColumn("chunk", F.pmod(F.xxhash64("n"), F.lit(chunks)))
    below = dealt.groupBy("chunk").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
    whole = pieces.where(~open_).select(*columns, (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return below.union(whole)


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return packed(tokenised(docs, path, capacity), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
