"""Operator 4, LM scoring: a weighted backoff automaton.

Unigrams, bigrams and trigrams are counted in full over all training documents, each of them from one occurrence
on. Unigrams are add-one over the vocabulary and one unknown; on top stand

    p(w | h) = max(c(h w) - D, 0) / c(h) + backoff(h) p(w | shorter h),   backoff(h) = D distinct(h) / c(h)

with distinct(h) the number of different words seen after h. That is an automaton with a state for each history
seen, an arc for each n-gram seen and a failure arc to the shorter history (``Automaton``). It is never whole in one
place: a block of texts builds the states and arcs that its own texts can take, with the counts of all training texts,
and walks them once from left to right, all texts at once, carrying a state a text and adding up log-probabilities.

The n-grams grow with the input and are never gathered. Texts are read once, into blocks of about ``BLOCK_BYTES`` of
neighbouring documents, kept as packed token codes. Each block asks for its own distinct n-grams (one packed string
for each bucket of keys), a bucket sums the counts over all blocks and answers in the order asked. A second round
does the same for distinct(h): each n-gram is owned by one block, which counts it for its history; only histories
that several blocks hold travel. The number of buckets follows the input's size.

Words are told apart by 64-bit hashes, n-grams by log2(n-grams) + ``SPARE_BITS`` bits of such hashes: of 16 million,
about one is taken for another. Defined results: null and empty texts are the end token alone; a text counts whole,
however long; repeated rows count and are scored each; a null doc_id counts as the empty text in crc32; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, counted, crc32_of_id, hashed_words, mixed, shuffle_width, slices, store, table

BLOCK_BYTES, DISCOUNT, FOLDS, HELD, SPARE_BITS, LEAST_BITS, PIECE = 8_000_000, 0.75, 7, 2, 24, 48, 512
END = np.int64(xxhash.xxh64_intdigest(b" ") - (1 << 64) if xxhash.xxh64_intdigest(b" ") >> 63 else xxhash.xxh64_intdigest(b" "))
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_QUESTION = "block long, bucket int, payload binary"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text with an end token each, and the texts' numbers of tokens."""
    words, _, _, _, per = hashed_words([t.translate(_FOLD) for t in texts])
    lengths = per + 1
    out = np.full(int(lengths.sum()), END, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(lengths) - 1] = False
    out[is_word] = words.view(np.int64)
    return out, lengths


def order_of(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of unsigned keys: keys and places are sorted as one number, which is several times faster;
    the few that differ only in bits that found no room are sorted again."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    low = keys.min()
    room = np.uint64((n - 1).bit_length())
    gone = np.uint64(max(0, int(keys.max() - low).bit_length() + int(room) - 64))
    both = np.sort((((keys - low) >> gone) << room) | np.arange(n, dtype=np.uint64))
    out = (both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    if gone:
        head, found = both >> room, keys[out]
        for h in np.unique(head[1:][(head[1:] == head[:-1]) & (found[1:] != found[:-1])]):
            a, b = np.searchsorted(head, h, "left"), np.searchsorted(head, h, "right")
            out[a:b] = out[a:b][np.argsort(found[a:b], kind="stable")]
    return out


# --- packed strings -----------------------------------------------------------------------------------------


def _joint(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def _split(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", blob)[0]
    sizes = struct.unpack_from(f"<{n}q", blob, 8)
    at, out = 8 * (n + 1), []
    for size in sizes:
        out.append(blob[at : at + size])
        at += size
    return out


def _pressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _loosened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte, each plane pressed on its own."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    wide = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return _joint([_pressed(np.ascontiguousarray(wide[:, i]).tobytes()) for i in range(width)])


def _from_planes(blob: bytes) -> np.ndarray:
    planes = [np.frombuffer(_loosened(p), np.uint8) for p in _split(blob)]
    wide = np.zeros((len(planes[0]), 8), np.uint8)
    for i, p in enumerate(planes):
        wide[:, i] = p
    return wide.reshape(-1).view("<u8")


def _ascending(keys: np.ndarray) -> bytes:
    """Sorted keys as differences. Their low bytes are as good as random and stay as they are."""
    first = keys[:1]
    steps = np.diff(keys, prepend=first)
    raw = (int(keys[-1] - keys[0]) // len(keys)).bit_length() // 8 if len(keys) else 0
    wide = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return _joint([bytes([raw]), first.tobytes(), np.ascontiguousarray(wide[:, :raw].T).tobytes(), _planes(steps >> np.uint64(8 * raw))])


def _from_ascending(blob: bytes) -> np.ndarray:
    raw, first, low, high = _split(blob)
    steps = _from_planes(high) << np.uint64(8 * raw[0])
    wide = steps.view(np.uint8).reshape(-1, 8)
    wide[:, : raw[0]] = np.frombuffer(low, np.uint8).reshape(raw[0], len(steps)).T
    steps[:1] = np.frombuffer(first, np.uint64)
    return np.add.accumulate(steps)


def _counts(x: np.ndarray) -> bytes:
    """Counts, most of which are 1: which ones are, and the others."""
    other = x != 1
    return _joint([struct.pack("<q", len(x)), _pressed(np.packbits(other).tobytes()), _planes(x[other].astype(np.uint64))])


def _from_counts(blob: bytes) -> np.ndarray:
    n, bits, others = _split(blob)
    out = np.ones(struct.unpack("<q", n)[0], np.int64)
    other = np.unpackbits(np.frombuffer(_loosened(bits), np.uint8), count=len(out)).view(bool)
    out[other] = _from_planes(others).view(np.int64)
    return out


def _bits(x: np.ndarray) -> bytes:
    return _pressed(np.packbits(x).tobytes())


def _from_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_loosened(blob), np.uint8), count=n).view(bool)


# --- blocks ---------------------------------------------------------------------------------------------------


def _packed_block(ids: pa.Array, held: np.ndarray, texts: list[bytes]) -> tuple[bytes, int]:
    words, lengths = tokens(texts)
    by = order_of(words.view(np.uint64))
    new = np.insert(words[by][1:] != words[by][:-1], 0, True) if len(by) else np.zeros(0, bool)
    codes = np.empty(len(by), np.int64)
    codes[by] = np.cumsum(new) - 1
    # frequent words have small codes
    often = np.argsort(-np.bincount(codes, minlength=int(new.sum())), kind="stable")
    rank = np.empty(len(often), np.uint64)
    rank[often] = np.arange(len(often), dtype=np.uint64)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    parts = [struct.pack("<q", len(ids)), _pressed(ids.fill_null(0).to_numpy().tobytes()), _bits(missing), _bits(held), _planes(lengths.astype(np.uint64)), words[by][new][often].tobytes(), _planes(rank[codes])]
    return _joint(parts), len(words)


def _blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (block, tokens): packed token codes of neighbouring documents; how many buckets of keys there should be,
    and how many bits a key."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: t.column(c).combine_chunks()
            blob, n = _packed_block(column("doc_id"), column("held").to_numpy(zero_copy_only=False), as_bytes(column("text")))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([first + made - 1], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["block", "tokens", "payload"])

        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                n = batch.column("text").nbytes
                if held and size + n > BLOCK_BYTES:
                    yield packed(held)
                    held, size = [], 0
                held.append(batch)
                size += n
        if sum(b.num_rows for b in held):
            yield packed(held)

    is_held = F.pmod(crc32_of_id(), F.lit(FOLDS)) == HELD
    blocks, n = counted(docs.select("doc_id", "text", is_held.alias("held")).mapInArrow(run, "block long, tokens long, payload binary"))
    total = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return blocks.select("block", "payload"), max(shuffle_width(spark), n), min(64, max(LEAST_BITS, (3 * total).bit_length() + SPARE_BITS))


def _joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their histories and last words."""
    return mixed(mixed(history * np.uint64(0x9E3779B97F4A7C15)) + word * np.uint64(0xC2B2AE3D27D4EB4F))


class _Grams:
    """Distinct n-grams of a block's texts (``keys`` of so many bits, sorted) and, for each position, the places there
    of its word (``one``), the word before (``before``, the end token at a text's start) and its bigram (``two``); for
    the positions ``inner``, which have a word before in their text, also of the trigram (``three``)."""

    def __init__(self, payload: bytes, bits: int):
        n, ids, missing, held, lengths, words, codes = _split(payload)
        n = struct.unpack("<q", n)[0]
        self.ids = pa.array(np.frombuffer(_loosened(ids), np.int64), mask=_from_bits(missing, n))
        self.held = _from_bits(held, n)
        self.lengths = _from_planes(lengths).astype(np.int64)
        codes = _from_planes(codes).astype(np.int64)
        words = np.frombuffer(words, np.uint64)[codes]
        self.begin = np.cumsum(self.lengths) - self.lengths
        starts = np.zeros(len(words), bool)
        starts[self.begin] = True
        self.inner = np.flatnonzero(~starts)
        self.trained = np.repeat(~self.held, self.lengths)
        end = END.view(np.uint64)
        two = _joined(np.where(starts, end, np.roll(words, 1)), words)
        three = _joined(two[self.inner - 1], words[self.inner])
        cut = np.uint64(64 - bits)
        every = np.concatenate([words, two, three]) >> cut
        by = order_of(every)
        new = np.insert(every[by][1:] != every[by][:-1], 0, True)
        self.keys = every[by][new]
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        self.one, self.two, self.three = np.split(place, [len(words), 2 * len(words)])
        self.before = np.where(starts, np.searchsorted(self.keys, end >> cut), np.roll(self.one, 1))

    def counts(self) -> np.ndarray:
        """How often each n-gram occurs in the block's training texts."""
        at = np.concatenate([self.one[self.trained], self.two[self.trained], self.three[self.trained[self.inner]]])
        return np.bincount(at, minlength=len(self.keys))

    def histories(self) -> np.ndarray:
        """Which keys are histories of a position."""
        out = np.zeros(len(self.keys), bool)
        out[self.before] = out[self.two[self.inner - 1]] = True
        return out

    def followed(self, own: np.ndarray) -> np.ndarray:
        """For each key, the number of n-grams among ``own`` of which it is the history."""
        out = np.zeros(len(self.keys), np.int64)
        for grams, history in ((self.two, self.before), (self.three, self.two[self.inner - 1])):
            of = np.full(len(self.keys), -1, np.int64)
            of[grams] = history
            out += np.bincount(of[own & (of >= 0)], minlength=len(out))
        return out


def _questions(block: int, buckets: int, bits: int, keys: np.ndarray, counts: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """Sorted keys with their counts, dealt to ``buckets`` ranges of keys."""
    bucket = (((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)] if len(keys) else [0]
    out = [_joint([_ascending(keys[a:b]), _counts(counts[a:b]), _bits(word[a:b])]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), block, np.int64)), pa.array(bucket[cuts[:-1]]), pa.array(out, pa.binary())], names=["block", "bucket", "payload"])


def _answers(questions: DataFrame, kind: int) -> DataFrame:
    """For each question its keys' counts over all blocks, and whether the block owns a key (1) and shares it (2).

    Each n-gram seen is owned by one block. ``tokens`` and ``words`` add up to the training words and the vocabulary.
    """

    def run(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_numpy()
        order = np.argsort(blocks)
        payloads = group.column("payload")
        parts = []
        for i in order.tolist():
            keys, counts, word = _split(payloads[i].as_py())
            keys = _from_ascending(keys)
            parts.append((keys, _from_counts(counts).astype(np.int32), _from_bits(word, len(keys))))
        keys, counts, word = (np.concatenate([p[k] for p in parts]) for k in range(3))
        cuts = np.cumsum([len(p[0]) for p in parts])
        del payloads, parts
        by = order_of(keys)
        head = np.flatnonzero(np.insert(keys[by][1:] != keys[by][:-1], 0, True))
        times = np.diff(np.append(head, len(by)))
        sums = np.add.reduceat(counts[by].astype(np.int64), head)
        total, shared, owned = np.empty(len(by), np.int64), np.empty(len(by), bool), np.zeros(len(by), bool)
        total[by], shared[by] = np.repeat(sums, times), np.repeat(times > 1, times)
        seen = by[counts[by] > 0]
        owned[seen[np.insert(keys[seen][1:] != keys[seen][:-1], 0, True)[: len(seen)]]] = True
        out = [_joint([_counts(t), _bits(o), _bits(s)]) for t, o, s in zip(*(np.split(x, cuts[:-1]) for x in (total, owned, shared)), strict=True)]
        n, v = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
        n[0], v[0] = counts[word].sum(dtype=np.int64), owned[word].sum(dtype=np.int64)
        return pa.table({"block": pa.array(blocks[order]), "bucket": group.column("bucket"), "kind": pa.array(np.full(len(out), kind, np.int32)), "payload": pa.array(out, pa.binary()), "tokens": pa.array(n), "words": pa.array(v)})

    return questions.groupBy("bucket").applyInArrow(run, "block long, bucket int, kind int, payload binary, tokens long, words long")


def _heard(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the order of the keys asked for: counts, which are the block's own, and which it shares."""
    kinds, buckets, payloads = answers.column("kind").to_numpy(), answers.column("bucket").to_numpy(), answers.column("payload")
    at = np.flatnonzero(kinds == kind)
    parts = []
    for i in at[np.argsort(buckets[at])].tolist():
        counts, owned, shared = _split(payloads[i].as_py())
        counts = _from_counts(counts)
        parts.append((counts, _from_bits(owned, len(counts)), _from_bits(shared, len(counts))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


class Automaton:
    """The part of the automaton that a block's texts can walk: a state for each history seen in training, an arc for each
    n-gram seen, and from each state a failure arc to the shorter history. State 0 has no history and an arc for every
    word; the state of an n-gram is its place among the block's keys and 1.

    ``count`` and ``distinct`` are those of the block's keys over all training texts, ``n`` and ``v`` the training tokens
    and their vocabulary.
    """

    def __init__(self, g: _Grams, count: np.ndarray, distinct: np.ndarray, n: int, v: int):
        size = len(g.keys)
        history, word, shorter = (np.full(size, -1, np.int32) for _ in range(3))
        history[g.two], word[g.two], shorter[g.two] = g.before, g.one, g.one
        history[g.three], word[g.three], shorter[g.three] = g.two[g.inner - 1], g.one[g.inner], g.two[g.inner]
        two, three = (np.flatnonzero(np.bincount(x, minlength=size).astype(bool) & (count > 0)) for x in (g.two, g.three))
        share = np.where(count > 0, DISCOUNT * distinct / np.maximum(count, 1), 1)
        p = (count + 1.0) / (n + v + 1)  # of a word without a history
        self.words = np.log10(p)
        for at in (two, three):  # of the last word after the others
            of = history[at]
            p[at] = (count[at] - DISCOUNT) / count[of] + share[of] * p[shorter[at]]
        self.backoff = np.log10(np.insert(np.where(share > 0, share, 1), 0, 1))
        self.failure = np.zeros(size + 1, np.int32)
        self.failure[two + 1] = word[two] + 1
        self.entered = np.where(count > 0, np.arange(1, size + 1, dtype=np.int32), np.int32(0))  # by a word alone
        at = np.concatenate([two, three])
        arcs = (history[at].astype(np.int64) + 1) * size + word[at]
        target = np.concatenate([two, shorter[three]]) + 1
        by = order_of(arcs.view(np.uint64))
        self.size, self.arcs, self.weight, self.target = size, arcs[by], np.log10(p[at[by]]), target[by].astype(np.int32)
        end = g.before[0]  # a text starts after an end
        self.start = int(self.entered[end])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading a word in a state, failures included, and the states it leads to."""
        weight, state, to = np.zeros(len(word)), state.copy(), self.entered[word]
        left = np.arange(len(word))
        while len(left):
            none = state[left] == 0
            weight[left[none]] += self.words[word[left[none]]]
            left = left[~none]
            if not len(left):
                break
            key = state[left].astype(np.int64) * self.size + word[left]
            arc = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            weight[left[hit]] += self.weight[arc[hit]]
            to[left[hit]] = self.target[arc[hit]]
            left = left[~hit]
            weight[left] += self.backoff[state[left]]
            state[left] = self.failure[state[left]]
        return weight, to

    def walk(self, words: np.ndarray, lengths: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """The log10 probabilities of texts, all read from left to right at once, a token a step.

        A text of more than ``piece`` tokens is read in pieces. A state hangs on two tokens only, so a later piece starts two
        tokens early, without a history, and is in the whole text's state where it begins to add up.
        """
        pieces = -(-lengths // piece)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.cumsum(lengths)
        low = (ends - lengths)[text] + number * piece
        high = np.minimum(low + piece, ends[text])
        at = np.where(number > 0, low - 2, low)
        order = np.argsort(at - high, kind="stable")  # the longest first, so those still read come first
        text, low, at, steps = text[order], low[order], at[order], (high - at)[order]
        state = np.where(number[order] > 0, 0, self.start).astype(np.int32)
        total = np.zeros(len(text))
        for k in range(int(steps[0]) if len(steps) else 0):
            alive = int(np.searchsorted(-steps, -k, "left"))
            place = at[:alive] + k
            weight, state[:alive] = self.step(state[:alive], words[place])
            total[:alive] += np.where(place >= low[:alive], weight, 0)
        return np.bincount(text, total, len(lengths))


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    blocks, buckets, bits = _blocks(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                g = _Grams(payload.as_py(), bits)
                word = np.zeros(len(g.keys), bool)
                word[g.one] = True
                yield _questions(block, buckets, bits, g.keys, g.counts(), word)

    def ask_histories(block: pa.Table, answers: pa.Table) -> pa.Table:
        g = _Grams(block.column("payload")[0].as_py(), bits)
        _, owned, shared = _heard(answers, 1)
        at = np.flatnonzero(g.histories() & shared)
        return pa.Table.from_batches([_questions(block.column("block")[0].as_py(), buckets, bits, g.keys[at], g.followed(owned)[at], np.zeros(len(at), bool))])

    counts = store(_answers(blocks.mapInArrow(ask, _QUESTION), 1))
    train_tokens, vocabulary = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(ask_histories, _QUESTION)
    answers = counts.union(_answers(asked, 2)).select("block", "bucket", "kind", "payload")

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        g = _Grams(block.column("payload")[0].as_py(), bits)
        count, owned, shared = _heard(answers, 1)
        distinct = g.followed(owned)
        distinct[g.histories() & shared] = _heard(answers, 2)[0]
        score = Automaton(g, count, distinct, train_tokens, vocabulary).walk(g.one, g.lengths)
        base = np.log10((count[g.one] + 1.0) / (train_tokens + vocabulary + 1))
        sums = [*(np.add.reduceat(x, g.begin) for x in ((count[g.one] > 0).astype(np.int64), base)), score]
        return pa.table([g.ids, pa.array(g.held), pa.array(g.lengths), pa.array(sums[0]), pa.array(np.full(len(g.lengths), train_tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
