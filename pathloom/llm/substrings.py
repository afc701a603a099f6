"""Operator 2, substring dedup: exact repeated 20-word windows by super-k-mer partitioning.

A window is 20 consecutive words. Its minimiser is the smallest hash among its 2-word grams, those that are
frequent in a sample coming after all others; consecutive windows that share it form a super-k-mer. Each super-k-mer travels as one packed string (word codes, with
the dictionary of the words they stand for) to the bucket of its minimiser, so that all copies of a window
meet in one bucket. There windows are sorted, equal neighbours are compared word by word, and every window
but the first (smallest doc_id, then earliest start) is marked. Words under a marked window are removed.

Skew: within a stretch of input (some megabytes) each distinct super-k-mer travels once, with its first
place; its later places are known to be repeats and are marked on the spot. So a passage that all documents
share sends one string per stretch, however often it occurs. The number of buckets follows the input's size, and
frequent grams, which would gather windows without end in one bucket, are no minimisers where a window has any
other gram. Which grams are frequent is told by a sample of about ``SAMPLE_BYTES`` (as ranges are in a sort): it
moves windows between buckets and never changes a result.

Defined results: null and blank texts have no words; texts shorter than a window stay whole; very long texts are
taken whole; rows that agree in doc_id and text are one document (each gets the same result), rows that agree in
doc_id alone are ordered by a hash of their texts; a null doc_id comes first; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, give_back, mixed, runs, shuffle_width, slices, table, word_codes

WINDOW, GRAM, CHUNK_BYTES, BUCKET_BYTES = 20, 2, 12_000_000, 6_000_000
SAMPLE_BYTES, OFTEN, MARKS = 8_000_000, 8, 1 << 22
_LEAST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MARKS = "doc_id long, text_hash long, start long, n long"


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _pack(words: list[bytes], *arrays: np.ndarray) -> bytes:
    parts = [b" ".join(words), *(a.tobytes() for a in arrays)]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def _unpack(blob: bytes, n: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{n}q", data)
    at, out = 8 * n, []
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def grams_of(codes: np.ndarray, hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of words that stand end to end."""
    h, n = hashes[codes], len(codes) - gram + 1
    low = h[:n].copy()
    for j in range(1, gram):
        low = low * np.uint64(0x100000001B3) + h[j : n + j]
    return mixed(low)


def frequent_grams(docs: DataFrame, total: int, gram: int) -> np.ndarray:
    """Which hashes (modulo MARKS) belong to grams that occur at least OFTEN times in a sample of the texts."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    chance = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.where((F.octet_length("text") <= SAMPLE_BYTES // 100) & (chance < share)).select("text").toArrow()
    codes, words, _ = word_codes(as_bytes(rows.column("text").combine_chunks()))
    out = np.zeros(MARKS, bool)
    if len(codes) >= gram:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        grams, times = np.unique(grams_of(codes, hashes, gram), return_counts=True)
        out[(grams[times >= OFTEN] % np.uint64(MARKS)).astype(np.int64)] = True
    return np.packbits(out)


def super_kmers(codes: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, window: int, gram: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' word codes laid end to end: each super-k-mer's first word, number of windows and minimiser."""
    n = len(codes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = grams_of(codes, hashes, gram)
    often = frequent[low.astype(np.uint32) & np.uint32(MARKS - 1)]
    low >>= np.uint64(1)
    low[often] |= np.uint64(1 << 63)
    del often
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    ends = np.cumsum(lengths)
    valid = np.zeros(n - window + 1, bool)
    long = lengths >= window
    valid[runs(ends[long] - lengths[long], lengths[long] - window + 1)] = True
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]))
    starts = np.flatnonzero(first)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~first[1:], False)) + 1
    return starts, stop - starts, low[starts]


def _mapped(batch: pa.RecordBatch, buckets: int, window: int, gram: int, frequent: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, payload): packed super-k-mers (kind 0) and marks made here (kind 1) of one stretch of input."""
    docs, hashes_of = batch.column("doc_id").fill_null(_LEAST).to_numpy(), batch.column("text_hash").to_numpy()
    order = np.lexsort((hashes_of, docs))
    # rows that repeat a document would find their own windows again
    again = (docs[order][1:] == docs[order][:-1]) & (hashes_of[order][1:] == hashes_of[order][:-1])
    order = order[np.insert(~again, 0, True)]
    texts = as_bytes(batch.column("text"))
    codes, words, lengths = word_codes([texts[i] for i in order])
    del texts
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    starts, windows, minimiser = super_kmers(codes, hashes, lengths, window, gram, frequent)
    ends = np.cumsum(lengths)
    row = np.searchsorted(ends, starts, "right")
    places = np.stack([docs[order][row], hashes_of[order][row], starts - (ends - lengths)[row]], 1)
    seen: dict[bytes, int] = {}
    data, fresh, repeats = codes.tobytes(), [], []
    for i, (s, n) in enumerate(zip(starts.tolist(), windows.tolist(), strict=True)):
        at = seen.setdefault(data[4 * s : 4 * (s + n + window - 1)], i)
        (fresh if at == i else repeats).append(i)
    del seen
    repeats = np.array([i for i in repeats], np.int64)
    if len(repeats):
        yield buckets + int(docs[0] & 0xFF), 1, _pack([], np.column_stack([places[repeats], windows[repeats]]).astype(np.int64))
    fresh = np.array(fresh, np.int64)
    bucket = (minimiser[fresh] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    for part in np.split(by, cuts) if len(by) else []:
        at = fresh[part]
        used, inverse, times = np.unique(codes[runs(starts[at], windows[at] + window - 1)], return_inverse=True, return_counts=True)
        spelt = used.tolist()
        # compresses well: the most frequent words have one-byte codes, the others stand in order; bytes by plane
        often = np.argsort(-times, kind="stable")[:255]
        rest = np.ones(len(used), bool)
        rest[often] = False
        listed = np.concatenate([often, np.flatnonzero(rest)])
        rank = np.empty(len(used), np.uint32)
        rank[listed] = np.arange(len(used))
        own_rows, row_of = np.unique(row[at], return_inverse=True)
        owners = np.column_stack([docs[order][own_rows], hashes_of[order][own_rows]])
        planes = rank[inverse].view(np.uint8).reshape(-1, 4).T.copy()
        yield int(bucket[part[0]]), 0, _pack([words[spelt[i]] for i in listed.tolist()], planes, windows[at].astype(np.int32), owners, row_of.astype(np.int32), places[at, 2].astype(np.int32))


def _prints(codes: np.ndarray, n_codes: int, size: np.ndarray, windows: np.ndarray, window: int, step: int = 1 << 18) -> np.ndarray:
    """A fingerprint of every window of super-k-mers that stand end to end (``size`` words, ``windows`` windows each),
    some of them at a time."""
    value = mixed(np.arange(1, n_codes + 1, dtype=np.uint64) * np.uint64(_BASE))
    longest = step + int(size.max(initial=0))
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(longest, b, np.uint64)])) for b in (_BASE, _INVERSE))
    ends, out, first = np.cumsum(size), [np.zeros(0, np.uint64)], 0
    while first < len(size):
        base = int(ends[first] - size[first])
        last = max(first + 1, int(np.searchsorted(ends, base + step, "right")))
        part = value[codes[base : int(ends[last - 1])]]
        run = np.zeros(len(part) + 1, np.uint64)
        np.add.accumulate(part * up[: len(part)], out=run[1:])
        at = runs((ends - size)[first:last] - base, windows[first:last])
        out.append((run[at + window] - run[at]) * down[at])
        first = last
    return np.concatenate(out)


def _marked(blobs: list[bytes], window: int) -> np.ndarray:
    """Rows (doc_id, text_hash, start, n): runs of windows that also start earlier."""
    code = _Codes()
    all_codes, all_windows, all_places = [], [], []
    for b in blobs:
        words, planes, windows, owners, row_of, start = _unpack(b, 6)
        own = np.fromiter(map(code.__getitem__, words.split(b" ")), np.uint32)
        all_codes.append(own[np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()])
        all_windows.append(np.frombuffer(windows, np.int32))
        all_places.append(np.column_stack([np.frombuffer(owners, np.int64).reshape(-1, 2)[np.frombuffer(row_of, np.int32)], np.frombuffer(start, np.int32).astype(np.int64)]))
    codes, windows, places = np.concatenate(all_codes), np.concatenate(all_windows).astype(np.int64), np.concatenate(all_places)
    size = windows + window - 1
    begin = np.cumsum(size) - size
    at = runs(begin, windows)
    print_ = _prints(codes, len(code), size, windows, window)
    order = np.argsort(print_, kind="stable")
    same = print_[order][1:] == print_[order][:-1]
    inside = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    if not len(inside):
        return np.zeros((0, 4), np.int64)
    pick = order[inside]
    kmer = np.repeat(np.arange(len(windows)), windows)[pick]
    place = places[kmer].copy()
    place[:, 2] += (at - np.repeat(begin, windows))[pick]
    key, at = print_[pick], at[pick]
    by = np.lexsort((place[:, 2], place[:, 1], place[:, 0], key))
    key, at, place = key[by], at[by], place[by]
    head = np.insert(key[1:] != key[:-1], 0, True)
    group = np.flatnonzero(head)[np.cumsum(head) - 1]
    alike = np.ones(len(at), bool)
    for j in range(window):
        alike &= codes[at + j] == codes[at[group] + j]
    later = alike & (place != place[group]).any(1)
    if not alike.all():  # a fingerprint met by two contents: tell them apart word by word
        firsts: dict[bytes, int] = {}
        odd = np.isin(group, group[~alike])
        for i in np.flatnonzero(odd):
            f = firsts.setdefault(codes[at[i] : at[i] + window].tobytes(), i)
            later[i] = f != i and (place[i] != place[f]).any()
    return merged(place[later])


def merged(places: np.ndarray) -> np.ndarray:
    """Single windows (doc_id, text_hash, start) as runs (doc_id, text_hash, start, n)."""
    if not len(places):
        return np.zeros((0, 4), np.int64)
    p = places[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))]
    new = np.insert((p[1:, :2] != p[:-1, :2]).any(1) | (p[1:, 2] > p[:-1, 2] + 1), 0, True)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return np.column_stack([p[first], p[last, 2] - p[first, 2] + 1])


def _rows(marks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(marks[:, i]) for i in range(4)], names=["doc_id", "text_hash", "start", "n"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of windows that also start earlier: doc_id (null as the least long), text_hash, start, n. Runs may overlap."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_width(spark), -(-total // BUCKET_BYTES))
    marks = spark.sparkContext.broadcast(frequent_grams(docs, total, gram).tobytes())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(np.frombuffer(marks.value, np.uint8)).view(bool)

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = list(_mapped(pa.Table.from_batches(held).combine_chunks().to_batches()[0], buckets, window, gram, frequent))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "payload"])

        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                n = batch.column("text").nbytes
                if held and size + n > CHUNK_BYTES:
                    yield packed(held)
                    held, size = [], 0
                held.append(batch)
                size += n
        if held and sum(b.num_rows for b in held):
            yield packed(held)
        held.clear()
        give_back()

    def reduced(group: pa.Table) -> pa.Table:
        kinds, payloads = group.column("kind").to_pylist(), group.column("payload").to_pylist()
        marks = [np.frombuffer(_unpack(p, 2)[1], np.int64).reshape(-1, 4) for k, p in zip(kinds, payloads, strict=True) if k == 1]
        blobs = [p for k, p in zip(kinds, payloads, strict=True) if k == 0]
        if blobs:
            marks.append(_marked(blobs, window))
        give_back()
        return pa.Table.from_batches([_rows(np.concatenate(marks))])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return keyed.mapInArrow(mapped, "bucket long, kind int, payload binary").groupBy("bucket").applyInArrow(reduced, _MARKS)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that is left: words joined by one space)."""
    marks = repeated_windows(docs, window).groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    marks = marks.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LEAST)).alias("k"), F.xxhash64("text").alias("g"))
    joined = keyed.join(marks, (F.col("k") == F.col("d")) & (F.col("g") == F.col("h")), "left").select("doc_id", "text", "starts", "ns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n_words, n_removed, kept = [], [], []
                for text, starts, ns in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist(), batch.column("ns").to_pylist(), strict=True):
                    words = text.split()
                    n_words.append(len(words))
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, np.add(starts, ns) + window - 1, -1)
                        stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                        words = [words[i] for i in stay]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
