"""Operator 6, language identification: prediction by partial matching over bytes.

Each language has a byte context tree of orders 0 to 4 with escape probabilities (method C, no exclusions):
in a context seen T times with D distinct next bytes, a byte seen n times has probability n / (T + D), and
the escape to the next shorter context D / (T + D). The statistics are frozen after training. A text's
exact code length in every language is the sum over its bytes; the shortest wins, and the score is its
posterior share, 2^-length over the sum.

Training takes a bounded sample of labelled documents: about ``sample_docs`` documents per language (texts up to
``sample_bytes``), and about ``total_bytes`` over all languages in equal parts, chosen by a hash of their ids
among those with crc32(doc_id) mod 5 <> 0. The trees are compiled, for all languages
at once, to sorted tables from k-grams to vectors of code lengths, and scoring walks whole texts with array
lookups only.

Defined results: ``und`` with score 0 for null text and text without a letter; ties go to the language that
sorts first; a null doc_id counts as the empty text in crc32; without any training row every text is
``und``; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc32_of_id, slices, table

ORDER, SAMPLE_DOCS, SAMPLE_BYTES, TOTAL_BYTES, FOLDS, UNKNOWN = 4, 300, 40_000, 24_000_000, 5, "und"
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """From 64-bit keys to rows, by open addressing; all lookups are array operations."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros((1 << bits, rows.shape[1]), np.float32)
        todo, at = np.arange(len(keys)), ((keys * _MIX) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[at] == np.iinfo(np.uint64).max
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.rows[at[put]] = keys[todo[put]], rows[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is missing."""
        at = ((keys * _MIX) >> self.shift).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        todo = np.flatnonzero((got != keys) & (got != np.iinfo(np.uint64).max))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (got != np.iinfo(np.uint64).max)]
        return out


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k-grams ending at each place from ORDER on, as integers (the last byte lowest)."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint64)
    for j in range(k):
        at = ORDER - k + 1 + j
        out = (out << np.uint64(8)) | data[at : at + n]
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts after ORDER zero bytes each, and where each one's bytes start."""
    gap = bytes(ORDER)
    data = np.frombuffer((gap + gap.join(texts)).translate(_FOLD), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return data, np.cumsum(lengths + ORDER) - lengths


class Model:
    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        n = len(self.languages)
        per = []  # by language, by order: grams and counts
        for lang in self.languages:
            data, starts = _joined(samples[lang])
            keep = np.ones(len(data) - ORDER, bool)
            for s in starts[1:]:
                keep[s - 2 * ORDER : s - ORDER] = False  # the zero bytes between texts
            per.append([np.unique(_grams(data, k + 1)[keep], return_counts=True) for k in range(ORDER + 1)])
        self.tables, self.escapes = [], []
        self.floor = np.full((1, n), 8.0, np.float32)
        for k in range(ORDER + 1):
            grams = np.unique(np.concatenate([p[k][0] for p in per]))
            contexts = np.unique(grams >> np.uint64(8))
            escape = np.zeros((len(contexts), n), np.float32)
            cost = np.zeros((len(grams), n), np.float32)
            lower = self._cost(grams & np.uint64((1 << 8 * k) - 1), k - 1)
            for i, p in enumerate(per):
                g, c = p[k]
                ctx, first, inv = np.unique(g >> np.uint64(8), return_index=True, return_inverse=True)
                total = np.bincount(inv, c, len(ctx)) if len(g) else np.zeros(0)
                distinct = np.bincount(inv, minlength=len(ctx)) if len(g) else np.zeros(0)
                escape[np.searchsorted(contexts, ctx), i] = -np.log2(distinct / (total + distinct))
                cost[:, i] = escape[np.searchsorted(contexts, grams >> np.uint64(8)), i] + lower[:, i]
                if len(g):
                    cost[np.searchsorted(grams, g), i] = -np.log2(c / (total[inv] + distinct[inv]))
            self.tables.append(_Table(grams, cost))
            self.escapes.append(_Table(contexts, escape))

    def _cost(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code lengths in bits of each gram's last byte, after its first k bytes, in every language."""
        if k < 0:
            return np.repeat(self.floor, len(grams), 0)
        at = self.tables[k].find(grams)
        out = self.tables[k].rows[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            g = grams[miss]
            ctx = self.escapes[k].find(g >> np.uint64(8))
            out[miss] = np.where(ctx[:, None] < 0, 0, self.escapes[k].rows[ctx]) + self._cost(g & np.uint64((1 << 8 * k) - 1), k - 1)
        return out

    def code_lengths(self, texts: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        data, starts = _joined(texts)
        ends = np.append(starts[1:] - ORDER, len(data))
        for at in range(ORDER, len(data), block):
            to = min(len(data), at + block)
            cost = self._cost(_grams(data[at - ORDER : to], ORDER + 1), ORDER)
            # sums over the texts' parts in this block; zero bytes between texts fall out
            a, b = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, to))
            run = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, 0, dtype=np.float64)])
            lo, hi = np.maximum(starts[a:b], at) - at, np.minimum(ends[a:b], to) - at
            out[a:b] += run[np.maximum(hi, lo)] - run[lo]
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Model | None:
    """A model from about ``sample_docs`` training documents per language, texts above ``sample_bytes`` left out of it."""
    size = F.octet_length("text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc32_of_id(), F.lit(FOLDS)) != 0) & (size <= sample_bytes)).select("doc_id", "lang", "text")
    counts = {r.lang: (r.n, r.b) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()}  # a row per language
    if not counts:
        return None
    share = F.create_map(*[x for k, (n, b) in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n, total_bytes / len(counts) / max(1, b))))])
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1 << 20)) / float(1 << 20)
    samples: dict[str, list[bytes]] = {}
    for r in rows.where(chance < F.element_at(share, F.col("lang"))).select("lang", "text", "doc_id").orderBy("doc_id", "text").limit(2 * sample_docs * len(counts)).collect():  # about total_bytes
        samples.setdefault(r.lang, []).append(r.text.encode())
    return Model(samples) if samples else None


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row; with ``keep``, all columns of ``docs`` and these two by the names given,
    which must be free."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                text = batch.column("text")
                letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                pred, score = [UNKNOWN] * len(text), np.zeros(len(text))
                at = np.flatnonzero(letters)
                if m is not None and len(at):
                    bits = m.code_lengths(text.take(pa.array(at)).cast(pa.binary()).to_pylist())
                    best = bits.argmin(1)
                    score[at] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    for i, b in zip(at, best, strict=True):
                        pred[i] = m.languages[b]
                own = [batch.column(c) for c in names] if keep else [batch.column("doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score)], names=[*names, *keep] if keep else ["doc_id", "lang_pred", "score"])

    if keep:
        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(keep[0], StringType()), StructField(keep[1], DoubleType())]))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (F.pmod(crc32_of_id(), F.lit(FOLDS)) == 0).alias("held_out"), "lang_pred", "score")
