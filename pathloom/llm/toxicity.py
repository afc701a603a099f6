"""Operator 10, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word is the sum of two inputs: an embedding of the word itself (for words that enough training texts
hold) and the mean of embeddings of its hashed character trigrams (all words, so spellings near a known word
still count). A window of ``WINDOW`` words runs through a GRU in both directions; attention weighs its
states, and their weighted mean gives the window's logit. All windows of a whole text, half overlapping, are
scored; the text's score is its largest logit, calibrated to a probability.

Training takes a bounded sample: at most about ``SAMPLE`` labelled documents of each class (chosen by a hash
among those with crc32(doc_id) mod 5 <> 0, texts up to ``SAMPLE_BYTES``). As labels are of documents, not
windows, training alternates: the network picks the most toxic windows of each document, then learns from
those with the document's label (Adam, cross entropy). The last step fits the calibration on the same rows.

Defined results: null, blank and empty texts have no window and get the score of a bare bias; without
training rows of both classes every score is 0; documents labelled more than once count with their largest
label; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, crc32_of_id, hashed_words, runs, slices, table

WINDOW, STEP, EMBED, HIDDEN, TRIGRAMS, SAMPLE, SAMPLE_BYTES, FOLDS = 32, 16, 8, 8, 4096, 700, 30_000, 5
LEAST_TEXTS, EPOCHS, BATCH, RATE, DECAY = 5, 14, 256, 0.01, 1e-4
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the sum of ``rows`` at its place."""
    out, by = np.zeros((n, rows.shape[1]), np.float32), np.argsort(at, kind="stable")
    own = at[by]
    first = np.flatnonzero(np.insert(own[1:] != own[:-1], 0, True)) if len(own) else np.zeros(0, np.int64)
    if len(first):
        out[own[first]] = np.add.reduceat(rows[by], first)
    return out


class Texts:
    """Texts as distinct words (hashes and trigrams) and windows over them."""

    def __init__(self, texts: list[bytes]):
        hashes, starts, ends, data, self.per = hashed_words([t.translate(_FOLD) for t in texts])
        by = np.argsort(hashes)
        new = np.insert(hashes[by][1:] != hashes[by][:-1], 0, True) if len(by) else np.zeros(0, bool)
        self.inverse = np.empty(len(by), np.int64)
        self.inverse[by] = np.cumsum(new) - 1
        first = by[new]
        self.hashes = hashes[first]
        # trigrams of each distinct word between two marks
        a, size = starts[first], ends[first] - starts[first]
        wide = np.zeros(int((size + 2).sum()), np.int64)
        begin = np.cumsum(size + 2) - (size + 2)
        if len(first):
            wide[runs(begin + 1, size)] = data[runs(a, size)]
            at = runs(begin, size)
            self.trigrams = ((wide[at] * 961 + wide[at + 1] * 31 + wide[at + 2]) * 2654435761 >> 7) % TRIGRAMS
        else:
            self.trigrams = np.zeros(0, np.int64)
        self.trigrams_of = size
        # windows: starts 0, STEP, ... and the last one at the text's end
        n = self.per
        count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)))
        self.owner = np.repeat(np.arange(len(n)), count)
        k = runs(np.zeros(len(n), np.int64), count)
        offset = np.minimum(k * STEP, np.maximum(0, n[self.owner] - WINDOW))
        self.start = (np.cumsum(n) - n)[self.owner] + offset
        self.length = np.minimum(WINDOW, n[self.owner])

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words (windows x WINDOW) and which of them are there."""
        t = np.arange(WINDOW)
        there = t < self.length[which, None]
        return self.inverse[np.minimum(self.start[which, None] + t, len(self.inverse) - 1)], there


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        init = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": (rng.normal(size=(len(vocabulary) + 1, EMBED)) * 0.1).astype(np.float32), "tri": (rng.normal(size=(TRIGRAMS, EMBED)) * 0.3).astype(np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(2 * EMBED, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": init(HIDDEN, 3 * HIDDEN)}
        self.p |= {"v": init(2 * HIDDEN), "o": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, x: Texts, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words (all, or ``used``), their places in the vocabulary (0: not in it), their
        trigrams one after another and how many each has."""
        hashes, size, trigrams = x.hashes, x.trigrams_of, x.trigrams
        if used is not None:
            begin = (np.cumsum(size) - size)[used]
            hashes, size = hashes[used], size[used]
            trigrams = trigrams[runs(begin, size)]
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        place = np.where(self.vocabulary[at] == hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(hashes), np.int64)
        begin = np.cumsum(size) - size
        tri = np.add.reduceat(self.p["tri"][trigrams], begin) / size[:, None] if len(begin) else np.zeros((0, EMBED))
        return np.concatenate([self.p["word"][place], tri], 1).astype(np.float32), place, trigrams, size

    def _run(self, gates: np.ndarray, places: np.ndarray, there: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (WINDOW x windows x HIDDEN) of one direction; gates: by distinct word."""
        u, n = self.p[f"u{d}"], len(places)
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((WINDOW, n, HIDDEN), np.float32)
        full = there.all(0)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, hu = gates[places[:, t]], h @ u
            zr = x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            after = new + z * (h - new)
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
            h = after if full[t] else np.where(there[:, t, None], after, h)
            out[t] = h
        return out

    def logits(self, gates: dict[str, np.ndarray], places: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        for d in "fb":
            if keep is not None:
                keep[d] = []
        states = np.concatenate([self._run(gates[d], places, there, d, None if keep is None else keep[d]) for d in "fb"], 2)
        e = np.where(there.T, states @ self.p["v"], -np.inf)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["bias"][0]

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {d: inputs @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, x: Texts, which: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        places, there = x.windows(which)
        used, places = np.unique(places, return_inverse=True)
        places = places.reshape(there.shape)
        inputs, place, trigrams, size = self.inputs(x, used)
        keep: dict = {}
        p = self.p
        logit = self.logits(self.gates(inputs), places, there, keep)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_sigmoid(logit) - target) / len(which)).astype(np.float32)
        states, weight, pooled = keep["states"], keep["weight"], keep["pooled"]
        g["bias"][0], g["o"] = dl.sum(), pooled.T @ dl
        dpool = dl[:, None] * p["o"]
        dweight = np.einsum("nh,tnh->tn", dpool, states)
        de = weight * (dweight - (weight * dweight).sum(0))
        g["v"] = np.einsum("tn,tnh->h", de, states)
        dstates = weight[:, :, None] * dpool + de[:, :, None] * p["v"]
        dx = np.zeros_like(inputs)
        for k, d in enumerate("fb"):
            u, dh = p[f"u{d}"], np.zeros((len(which), HIDDEN), np.float32)
            moved = np.empty((WINDOW, len(which), 3 * HIDDEN), np.float32)
            for t, h, z, r, new, hn in reversed(keep[d]):
                m = there[:, t, None]
                dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                down = np.where(m, dh, 0)
                da = down * (1 - z) * (1 - new**2)
                dz, dr = down * (h - new) * z * (1 - z), da * hn * r * (1 - r)
                du = np.concatenate([dz, dr, da * r], 1)
                g[f"u{d}"] += h.T @ du
                moved[t] = np.concatenate([dz, dr, da], 1)
                dh = np.where(m, dh * z, dh) + du @ u.T
            dgate = _summed(places.T.ravel(), moved.reshape(-1, 3 * HIDDEN), len(used))
            g[f"w{d}"], g[f"c{d}"] = inputs.T @ dgate, dgate.sum(0)
            dx += dgate @ p[f"w{d}"].T
        g["word"] = _summed(place, dx[:, :EMBED], len(p["word"]))
        g["word"][0] = 0
        g["tri"] = _summed(trigrams, np.repeat(dx[:, EMBED:] / size[:, None], size, 0), TRIGRAMS)
        return g

    def scores(self, x: Texts, block: int = 4096) -> np.ndarray:
        """Logits of all windows."""
        gates = self.gates(self.inputs(x)[0])
        out = np.empty(len(x.owner), np.float32)
        for at in range(0, len(out), block):
            which = np.arange(at, min(len(out), at + block))
            out[which] = self.logits(gates, *x.windows(which))
        return out

    def by_text(self, x: Texts, logits: np.ndarray) -> np.ndarray:
        """The largest logit of every text; the bias for a text without words."""
        out = np.full(len(x.per), self.p["bias"][0], np.float64)
        has = np.flatnonzero(x.per)
        if len(has):
            out[has] = np.maximum.reduceat(logits, np.searchsorted(x.owner, has))
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        x = Texts(texts)
        return _sigmoid(self.scale * self.by_text(x, self.scores(x)) + self.shift)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 10, epochs: int = EPOCHS) -> Network:
    x, rng = Texts(texts), np.random.default_rng(seed)
    text_of = np.repeat(np.arange(len(x.per)), x.per)
    pairs = np.unique(x.inverse * len(x.per) + text_of)
    often = np.bincount(pairs // len(x.per), minlength=len(x.hashes)) >= LEAST_TEXTS
    net = Network(np.sort(x.hashes[often]), seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    y = labels[x.owner].astype(np.float32)
    first = np.searchsorted(x.owner, np.arange(len(x.per)))
    for epoch in range(epochs):
        # the windows that stand for their documents: those that look most toxic, at first at random
        rank_by = net.scores(x) if epoch > 1 else rng.random(len(y))
        order = np.lexsort((-rank_by, x.owner))
        nth = np.empty(len(y), np.int64)
        nth[order] = np.arange(len(y)) - first[x.owner[order]]
        random = rng.random(len(y))
        pick = np.flatnonzero(np.where(y == 1, nth < (3 if epoch < 2 else 2), (nth < 2) | (random < 0.1)))
        rng.shuffle(pick)
        for at in range(0, len(pick), BATCH):
            which = pick[at : at + BATCH]
            g, step = net.gradients(x, which, y[which]), step + 1
            for k, v in net.p.items():
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.01 * (g[k] ** 2 - m2[k])
                v -= RATE * (0.3 if epoch > epochs * 2 // 3 else 1) * (m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8) + DECAY * v)
    s = net.by_text(x, net.scores(x))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a weak prior
        q = _sigmoid(a * s + b)
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - labels) * s).sum() + 1e-2 * (a - 1), (q - labels).sum() + 1e-2 * b])
        hess = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-2]])
        da, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(0.05, a - da), b - db
    net.scale, net.shift = a, b
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(F.max("toxic").alias("toxic")).where(F.pmod(crc32_of_id("d"), F.lit(FOLDS)) != 0)
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(1.0, sample / n)))])
    chosen = marks.where(F.pmod(F.xxhash64("d", F.lit(10)), F.lit(1 << 20)) / float(1 << 20) < F.element_at(share, F.col("toxic")))
    # at most about two samples of ids: a bounded side
    rows = docs.where(F.octet_length("text") <= sample_bytes).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("d")).select("doc_id", "text", "toxic").distinct().orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(4 * sample).collect()
    y = np.array([int(r.toxic > 0) for r in rows], np.int64)
    return fit([r.text.encode() for r in rows], y) if 0 < y.sum() < len(y) else None


def score_toxicity(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Network | None = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                score = np.zeros(batch.num_rows) if own is None else own.probabilities(as_bytes(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(crc32_of_id(), F.lit(FOLDS)) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
