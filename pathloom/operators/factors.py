"""A factorised transition model with held-out errors: alternating least squares, round by round.

Observed (src, dst, n) are split by a hash of the pair: the same pairs are held out however the table is partitioned. A round
solves one side's factors from the other's, and then the other way. The nodes of each side are dealt to blocks of about ``BLOCK`` pairs;
a block's pairs are packed once, as a row, and stay where they are. In a round only factors travel: a block solves its nodes and
sends each one's factors to the blocks of the other side that hold a pair of it, once a block and never more often than the pair table has
rows. The blocks that solve the second side hold both factors of their pairs, so they add up the errors too: mean absolute, root mean
square and largest error over training and held-out pairs. The round of least held-out root mean square error counts, and fitting stops
when ``patience`` rounds brought nothing better. All factors stay in tables. A node's pairs stand in one block: at most as many as the
other side has nodes, 12 bytes each.

Defined results: rows with null src, dst or n don't count; equal pairs are added up. A node without training pairs has no factors,
and its pairs no score. Without training pairs there are no factors and no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vector import dot

from .lineage import counted, cut

BLOCK, SLICE = 1 << 22, 1 << 22  # pairs of a block; numbers that a task adds up at once
ERRORS = "round int, part string, n long, mae double, rmse double, max_error double"


@dataclass
class Factors:
    """source and target (node, f), history (``ERRORS``) of all rounds, and the best round."""

    source: DataFrame
    target: DataFrame
    history: list[tuple[int, str, int, float, float, float]]
    best: int


def split(counts: DataFrame, held_out: float = 0.1, seed: int = 0) -> DataFrame:
    """src, dst, n, held: each pair once, and whether it is held out."""
    once = counts.where("src IS NOT NULL AND dst IS NOT NULL AND n IS NOT NULL").groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n"))
    return once.withColumn("held", F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(10_000)) < round(10_000 * held_out))


def _drawn(node: Column, rank: int, seed: int) -> Column:
    """Positive factors that depend on a node's name only."""
    draw = lambda i: (F.pmod(F.xxhash64(node, i, F.lit(seed)), F.lit(1 << 20)) + 1) / float(1 << 20)
    return F.transform(F.sequence(F.lit(1), F.lit(rank)), draw)


def _start(nodes: DataFrame, rank: int, seed: int) -> DataFrame:
    return nodes.withColumn("f", _drawn(F.col("node"), rank, seed))


def _packed(rated: DataFrame, one: str, other: str, blocks: int) -> DataFrame:
    """A row a block of nodes of side ``one``: its nodes and those they are paired with, the pairs by node (``ends``: where a
    node's pairs end), and, by block of the other side, which nodes have a pair there (``to``, ``which``)."""
    kinds = [rated.schema[c].dataType.simpleString() for c in (one, other)]
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def coded(names: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        codes = names.combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(codes.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        return codes.dictionary.take(order), place[codes.indices.to_numpy()]

    def pack(group: pa.Table) -> pa.Table:
        (nodes, i), (others, j) = coded(group.column("node")), coded(group.column("other"))
        order = np.lexsort((j, i))
        ends = np.cumsum(np.bincount(i, minlength=len(nodes)))
        routes = np.unique(group.column("to").to_numpy().astype(np.int64) * len(nodes) + i)
        numbers = (ends, j[order], group.column("n").to_numpy()[order], group.column("held").to_numpy()[order], (routes // len(nodes)).astype(np.int32), (routes % len(nodes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (nodes, others)]
        return pa.table([group.column("block").slice(0, 1), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in numbers)], names=["block", "nodes", "others", "ends", "j", "n", "held", "to", "which"])

    rows = rated.select(block(one).alias("block"), F.col(one).alias("node"), F.col(other).alias("other"), block(other).alias("to"), "n", "held")
    out = rows.groupBy("block").applyInArrow(pack, f"block int, nodes array<{kinds[0]}>, others array<{kinds[1]}>, ends binary, j binary, n binary, held binary, to binary, which binary")
    return cut(out.repartition(blocks, "block"))  # kept by block, so that a round needn't send pairs


def _solved(cells: DataFrame, factors: DataFrame, rank: int, reg: float) -> DataFrame:
    """What the blocks of ``cells`` make of the factors that came to them (to, nodes, f: ``rank`` numbers a node).

    Rows to the blocks of the other side, and for each block a row without ``to`` of all its nodes that have factors, with the
    errors of its pairs (``off``: number, sums of absolute and squared errors, largest; of training, then of held-out pairs).
    """
    at = np.triu_indices(rank)
    kind = cells.schema["nodes"].dataType.simpleString()
    step = max(1, SLICE // (len(at[0]) + rank + 1))

    def solve(cell: pa.Table, came: pa.Table) -> pa.Table:
        nodes, others = (cell.column(c).combine_chunks().flatten() for c in ("nodes", "others"))
        raw = lambda c, kind: np.frombuffer(cell.column(c)[0].as_buffer(), kind)
        j, n, held, to, which = raw("j", np.int32), raw("n", np.float64), raw("held", bool), raw("to", np.int32), raw("which", np.int32)
        i = np.repeat(np.arange(len(nodes)), np.diff(raw("ends", np.int64), prepend=0))
        g, known = np.zeros((len(others), rank)), np.zeros(len(others), bool)
        place = pc.index_in(came.column("nodes").combine_chunks().flatten(), value_set=others).to_numpy(zero_copy_only=False)
        g[place], known[place] = came.column("f").combine_chunks().flatten().to_numpy().reshape(-1, rank), True
        total = np.zeros((len(nodes), len(at[0]) + rank + 1))
        train = np.flatnonzero(known[j] & ~held)
        for k in (train[s : s + step] for s in range(0, len(train), step)):
            f, own = g[j[k]], i[k]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[first]] += np.add.reduceat(np.concatenate([f[:, at[0]] * f[:, at[1]], f * n[k, None], np.ones((len(k), 1))], 1), first)
        fitted = total[:, -1] > 0
        a = np.zeros((int(fitted.sum()), rank, rank))
        a[:, at[0], at[1]] = a[:, at[1], at[0]] = total[fitted, : len(at[0])]
        a += reg * total[fitted, -1, None, None] * np.eye(rank)
        mine = np.zeros((len(nodes), rank))
        mine[fitted] = np.linalg.solve(a, total[fitted, len(at[0]) : -1, None])[..., 0]
        off = np.zeros((2, 4))
        both = np.flatnonzero(known[j] & fitted[i])
        for k in (both[s : s + step] for s in range(0, len(both), step)):
            e = np.abs(n[k] - (mine[i[k]] * g[j[k]]).sum(1))
            for part in (0, 1):
                x = e[held[k] == part]
                off[part] = [*(off[part, :3] + (len(x), x.sum(), (x * x).sum())), max(off[part, 3], x.max(initial=0))]
        to, which = to[fitted[which]], which[fitted[which]]  # by block
        first = np.flatnonzero(np.diff(to, prepend=-1))
        parts = [(None, np.flatnonzero(fitted), off.ravel()), *((int(to[s]), w, None) for s, w in zip(first, np.split(which, first[1:]), strict=True))] if len(first) else []
        return pa.table({
            "to": pa.array([t for t, _, _ in parts], pa.int32()),
            "nodes": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(w) for _, w, _ in parts)]), pa.int32()), nodes.take(pa.array(np.concatenate([np.zeros(0, np.int64), *(w for _, w, _ in parts)])))),
            "f": pa.array([mine[w].ravel() for _, w, _ in parts], pa.list_(pa.float64())),
            "off": pa.array([o for _, _, o in parts], pa.list_(pa.float64())),
        })

    return cut(cells.groupBy("block").cogroup(factors.groupBy("to")).applyInArrow(solve, f"to int, nodes {kind}, f array<double>, off array<double>"))


def _factors(solved: DataFrame, rank: int) -> DataFrame:
    """node, f of all blocks."""
    kind = solved.schema["nodes"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, f = batch.column("nodes").flatten(), batch.column("f").flatten()
            yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(np.arange(0, len(f) + 1, rank, dtype=np.int32), f)], names=["node", "f"])

    return solved.where("to IS NULL").select("nodes", "f").mapInArrow(rows, f"node {kind}, f array<double>")


def scored(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``pairs`` (src, dst, ...) with ``score``, null where a node has no factors."""
    a, b = source.select(F.col("node").alias("src"), F.col("f").alias("fa")), target.select(F.col("node").alias("dst"), F.col("f").alias("fb"))
    return pairs.join(a, "src", "left").join(b, "dst", "left").withColumn("score", dot(F.col("fa"), F.col("fb"))).drop("fa", "fb")


def errors(pairs: DataFrame, by: Column) -> DataFrame:
    """part, n, mae, rmse, max_error of pairs that have a score."""
    off = F.abs(F.col("n") - F.col("score"))
    return pairs.where("score IS NOT NULL").groupBy(by.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.max(off).alias("max_error"))


def fit(counts: DataFrame, rank: int = 20, reg: float = 0.2, rounds: int = 20, patience: int = 2, held_out: float = 0.1, seed: int = 0) -> Factors:
    """Factors of the best round and the errors of all rounds."""
    rated, pairs = counted(split(counts, held_out, seed))
    blocks = max(1, -(-pairs // BLOCK))
    by_src, by_dst = _packed(rated, "src", "dst", blocks), _packed(rated, "dst", "src", blocks)
    train = rated.where("NOT held")
    kept = tuple(_start(train.select(F.col(c).alias("node")).distinct(), rank, seed) for c in ("src", "dst"))
    history, best = [], (float("inf"), 0)
    came = by_src.select(F.col("block").alias("to"), F.col("others").alias("nodes"), F.flatten(F.transform("others", lambda x: _drawn(x, rank, seed))).alias("f"))
    sums = [(F.max if k % 4 == 3 else F.sum)(F.col("off")[k]) for k in range(8)]
    for i in range(1, rounds + 1):
        source = _solved(by_src, came, rank, reg)
        target = _solved(by_dst, came := source.where("to IS NOT NULL"), rank, reg)
        off = target.where("off IS NOT NULL").agg(*sums).first()  # one row
        came = target.where("to IS NOT NULL")
        found = [(part, int(n), a / n, (b / n) ** 0.5, most) for part, (n, a, b, most) in (("held out", off[4:]), ("training", off[:4])) if n]
        if not found:
            break
        history += [(i, *f) for f in found]
        now = found[0][3]
        if now < best[0]:
            best, kept = (now, i), (_factors(source, rank), _factors(target, rank))
        elif i - best[1] >= patience:
            break
    return Factors(*kept, history, best[1])
