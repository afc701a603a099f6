"""Depths, levels, strong components and longest paths of large directed graphs.

Graphs are edge tables (head, tail); loops, repeats and null ends don't count. Chains of nodes with one edge in and one out are
contracted first, by pointer doubling: as many jobs as the logarithm of the longest chain. What is left is peeled from its sinks in blocks
of about ``BLOCK`` links: a block peels as far as its own nodes allow and tells other blocks how deep the heads of its links lie, so
there is at most a round a level. Links are packed once and stay where they are; a round moves what was found in it and two numbers a
node. Nodes that no peeling reaches lie on cycles or between them; strong components are found there by
colours: the greatest name that reaches a node goes forward, and from the nodes of that name backward. No step holds more than
one row a node or edge, and nothing but counts comes to the driver.

A longest simple path passes a strong component once, in one stretch. So the components are replaced by edges, from each node
at which a path may enter to each node behind it, as long as the longest simple path inside, which branch and bound finds in one
task a component; what remains is acyclic. That search is exponential in the worst case, as the problem is hard: components of more than
``MOST_NODES`` nodes, or that take more than ``MOST_STEPS`` steps, are an error rather than a wrong answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import counted, cut, release

MOST_NODES, MOST_STEPS, MERGE, BLOCK = 1000, 2_000_000, 12, 1 << 21
_END = "\x00end "


def plain(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes: head, tail."""
    return edges.select("head", "tail").where("head <> tail").distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """head, tail, step (the nodes that the edge leads to): edges of length one."""
    return edges.withColumn("step", F.array("tail"))


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("tail").alias("head"), F.col("head").alias("tail"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("head").alias("node")).union(edges.select(F.col("tail").alias("node"))).distinct()


def contracted(edges: DataFrame, fixed: DataFrame | None = None, firsts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Links between nodes that are not inside a chain (those of ``fixed`` never are), and the inner nodes.

    ``edges``: head, tail, step, at most one for a head and tail, lengths being those of the steps. Links: head, tail,
    weight, hop and step (first edge of the longest chain, ties by step). Inner nodes: node, to (the chain's end), away (how far),
    ring (the smallest name of a ring that consists of inner nodes only, else null) and, with ``firsts``, hop and step.
    """
    sides = edges.select(F.col("head").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("tail", F.lit(0), F.lit(1)))
    inner = sides.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select("node")
    inner = cut(inner if fixed is None else inner.join(fixed.select("node"), "node", "left_anti"))
    out = edges.join(inner, F.col("head") == F.col("node"), "left")
    is_inner = inner.select(F.col("node").alias("n2"))
    first = out.where("node IS NOT NULL").select("node", F.col("tail").alias("to"), F.size("step").cast("long").alias("away"), F.col("node").alias("low"))
    chain, n = counted(first.join(is_inner, F.col("to") == F.col("n2"), "left").withColumn("open", F.col("n2").isNotNull()).drop("n2"), F.col("open"))
    total, moved = (chain.count() if n else 0), 1
    while n and moved < total:
        ahead = chain.select(F.col("node").alias("n2"), F.col("to").alias("to2"), F.col("away").alias("away2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
        both = chain.join(ahead, F.col("open") & (F.col("to") == F.col("n2")), "left")
        step = both.select("node", F.coalesce("to2", "to").alias("to"), (F.col("away") + F.coalesce("away2", F.lit(0))).alias("away"), F.least("low", "low2").alias("low"), F.coalesce("open2", F.lit(False)).alias("open"))
        old, (chain, n) = chain, counted(step, F.col("open"))
        release(old)
        moved *= 2
    chain = chain.select("node", "to", "away", F.when(F.col("open"), F.col("low")).alias("ring"))
    onward = chain.select(F.col("node").alias("n2"), "to", "away")
    links = out.where("node IS NULL").select("head", "tail", "step").join(onward, F.col("tail") == F.col("n2"), "left")
    length = F.size("step") + F.coalesce("away", F.lit(0))
    links = links.select("head", F.coalesce("to", "tail").alias("end"), F.struct((-length).alias("less"), "step", F.col("tail").alias("hop")).alias("best"))
    links = links.groupBy("head", "end").agg(F.min("best").alias("best"))
    return cut(links.select("head", F.col("end").alias("tail"), (-F.col("best.less")).alias("weight"), "best.hop", "best.step")), chain.join(out.where("node IS NOT NULL").select("node", F.col("tail").alias("hop"), "step"), "node") if firsts else chain


def _cells(links: DataFrame, nodes: DataFrame, blocks: int, salt: int) -> tuple[DataFrame, int]:
    """A row a block of nodes, and whether two names have one key (a 64-bit hash).

    keys, sorted; waiting: how many links a node has; the links to each node (up to ``ends``): key, block and, within the block, place
    of their heads (-1 elsewhere), and weight.
    """
    key = lambda c: F.xxhash64(c, F.lit(salt))
    dealt = lambda c: F.pmod(c, F.lit(blocks)).cast("int")
    none = F.lit(None).cast("long")
    rows = nodes.select(key("node").alias("key"), none.alias("head"), none.alias("weight"))
    rows = rows.union(links.select(key("tail"), key("head"), F.col("weight").cast("long")))
    rows = rows.union(links.groupBy(key("head").alias("key")).agg(F.count(F.lit(1)).alias("weight")).select("key", none, "weight"))
    # a node has neither head nor weight, a number of links no head

    def pack(group: pa.Table) -> pa.Table:
        key, head, weight = (group.column(c).fill_null(0).to_numpy() for c in ("key", "head", "weight"))
        is_link, is_count = group.column("head").is_valid().to_numpy(), group.column("weight").is_valid().to_numpy()
        keys = np.sort(key[~is_count])
        once = np.unique(keys)

        def place(k: np.ndarray) -> np.ndarray:
            at = np.searchsorted(once, k)
            return np.where((at < len(once)) & (once[np.minimum(at, len(once) - 1)] == k), at, -1) if len(once) else np.full(len(k), -1)

        number = is_count & ~is_link
        at, n = place(key[number]), weight[number]
        waiting = np.zeros(len(once), np.int32)
        waiting[at[at >= 0]] = n[at >= 0]
        at, head, weight = place(key[is_link]), head[is_link], weight[is_link]
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        head, weight = head[order], weight[order]
        inside = place(head)
        ends = np.cumsum(np.bincount(at[order], minlength=len(once)))
        here = group.column("block")[0].as_py()
        keep = (inside >= 0) | (np.mod(head, blocks) != here)  # heads that are no nodes don't count
        if not keep.all():
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        parts = (once, waiting, ends.astype(np.int64), head[keep], inside[keep].astype(np.int32), weight[keep])
        return pa.table([pa.array([here], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([len(once) < len(keys)])], names=["block", "keys", "waiting", "ends", "head", "inside", "weight", "clash"])

    out = rows.withColumn("block", dealt(F.col("key"))).groupBy("block").applyInArrow(pack, "block int, keys binary, waiting binary, ends binary, head binary, inside binary, weight binary, clash boolean")
    return counted(out.repartition(blocks, "block"), F.col("clash"))  # kept by block


def _round(cells: DataFrame, moving: DataFrame, blocks: int) -> tuple[DataFrame, int]:
    """``moving`` after a round, and whether there is more to do: block, keys, waiting, depth, each block's state (waiting, -1
    when done, and depth of its nodes) and what it is told (keys of nodes and a depth of each, a link each)."""

    def run(cell: pa.Table, came: pa.Table) -> pa.Table:
        raw = lambda row, c, kind: np.frombuffer(row.column(c)[0].as_buffer(), kind)
        out: list[tuple] = []
        if cell.num_rows:
            keys, ends, head, inside, weight = (raw(cell, c, kind) for c, kind in (("keys", np.int64), ("ends", np.int64), ("head", np.int64), ("inside", np.int32), ("weight", np.int64)))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            told = came.column("keys").is_valid()
            state, told = came.filter(pc.invert(told)), came.filter(told)
            waiting = raw(state, "waiting", np.int32).copy()
            depth = raw(state, "depth", np.int64).copy() if state.column("depth").null_count == 0 else np.zeros(len(keys), np.int64)
            for k in range(told.num_rows):
                row = told.slice(k, 1)
                to, d = raw(row, "keys", np.int64), raw(row, "depth", np.int64)
                at = np.minimum(np.searchsorted(keys, to), max(0, len(keys) - 1))
                known = keys[at] == to if len(keys) else np.zeros(len(to), bool)
                np.maximum.at(depth, at[known], d[known])
                np.subtract.at(waiting, at[known], 1)
            front, sent = np.flatnonzero(waiting == 0), []
            while len(front):
                waiting[front] = -1
                n = ends[front] - starts[front]
                link = np.repeat(starts[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
                d, at = np.repeat(depth[front], n) + weight[link], inside[link]
                own = at >= 0
                sent.append((head[link[~own]], d[~own]))
                at = at[own]
                np.maximum.at(depth, at, d[own])
                np.subtract.at(waiting, at, 1)
                front = np.unique(at[waiting[at] == 0])
            here = cell.column("block")[0].as_py()
            out = [(here, None, waiting.tobytes(), depth.tobytes())]
            if sent:
                to, d = (np.concatenate(x) for x in zip(*sent, strict=True))
                target = np.mod(to, blocks)
                order = np.argsort(target, kind="stable")
                at = np.flatnonzero(np.diff(target[order], prepend=-1))
                out += [(int(target[o[0]]), to[o].tobytes(), None, d[o].tobytes()) for o in np.split(order, at[1:]) if len(o)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "keys", "waiting", "depth"])

    both = cells.select("block", "keys", "ends", "head", "inside", "weight").groupBy("block").cogroup(moving.groupBy("block"))
    return counted(both.applyInArrow(run, "block int, keys binary, waiting binary, depth binary"), F.col("keys").isNotNull())


def peeled(links: DataFrame, nodes: DataFrame, firsts: bool = True) -> DataFrame:
    """node, depth for nodes (among ``nodes``, each once) from which no cycle can be reached: the longest way on; with ``firsts``, its first edge (hop, step)."""
    blocks, salt, clash = max(1, -(-links.count() // BLOCK), -(-nodes.count() // BLOCK)), 0, 1
    while clash:
        cells, clash = _cells(links, nodes, blocks, salt := salt + 1)
    none = F.lit(None).cast("binary")
    moving, n = _round(cells, cells.select("block", none.alias("keys"), "waiting", none.alias("depth")), blocks)
    while n:
        old, (moving, n) = moving, _round(cells, moving, blocks)
        release(old)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, waiting, depth in zip(*(batch.column(c) for c in ("keys", "waiting", "depth")), strict=True):
                done = np.frombuffer(waiting.as_buffer(), np.int32) < 0
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)[done]) for x in (keys, depth)], names=["key", "depth"])

    found = cells.select("block", "keys").join(moving.where("keys IS NULL").select("block", "waiting", "depth"), "block").select("keys", "waiting", "depth").mapInArrow(rows, "key long, depth long")
    done = cut(nodes.select("node", F.xxhash64("node", F.lit(salt)).alias("key")).join(found, "key").select("node", "depth"))
    release(moving, cells)
    if not firsts:
        return done
    behind = links.join(done.select(F.col("node").alias("tail"), F.col("depth").alias("far")), "tail").join(done.select(F.col("node").alias("head"), "depth"), "head")
    best = behind.where("weight + far = depth").groupBy("head").agg(F.min(F.struct("step", "hop")).alias("best"))
    return cut(done.join(best, F.col("node") == F.col("head"), "left").select("node", "depth", "best.hop", "best.step"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def depths(edges: DataFrame, nodes: DataFrame, firsts: bool = True) -> DataFrame:
    """node, depth (with ``firsts``, hop and step): the longest way on from each node that reaches no cycle. ``edges``: head, tail, step."""
    links, inner = contracted(edges, firsts=firsts)
    outer = nodes.select("node").join(inner, "node", "left_anti")
    found = peeled(links, outer, firsts)
    behind = inner.where("ring IS NULL").join(found.select(F.col("node").alias("n2"), "depth"), F.col("to") == F.col("n2"))
    return found.unionByName(behind.select("node", (F.col("away") + F.col("depth")).alias("depth"), *(["hop", "step"] if firsts else [])))


def levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest path from a source; nodes on or behind cycles (loops are cycles) are left out."""
    e = edges.select("head", "tail").where("head IS NOT NULL AND tail IS NOT NULL").distinct()
    loop = e.where("head = tail").select("head", F.concat(F.lit(_END), "head").alias("tail"))  # a loop becomes a cycle of two
    e = cut(plain(e).union(loop).union(turned(loop)))
    out = depths(weighted(turned(e)), ends(e), firsts=False)
    return out.where(~F.col("node").startswith(_END)).select("node", F.col("depth").cast("int").alias("level"))


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What paths from ``seeds`` (node, and columns that travel along) reach, seeds included; a chain is one step."""
    keys = seeds.columns
    e, fixed = cut(plain(edges)), seeds.select("node").distinct()
    links = contracted(weighted(e), fixed, False)[0].select(F.col("head").alias("h"), "tail")
    inner = contracted(weighted(turned(e)), fixed, False)[1].select(F.col("node").alias("inside"), "to")
    front, n = counted(seeds.distinct())
    seen, kept = front, []
    while n:
        ahead = front.join(links, F.col("node") == F.col("h")).select(*[F.col("tail" if c == "node" else c).alias(c) for c in keys])
        front, n = counted(ahead.distinct().join(seen, keys, "left_anti").select(*keys))
        seen = seen.union(front)
        kept.append(front)
        if len(kept) % MERGE == 0:
            seen = cut(seen.repartition("node"))
    along = inner.join(seen, F.col("to") == F.col("node")).select(*[F.col("inside" if c == "node" else c).alias(c) for c in keys])
    out = cut(seen.union(along).distinct())
    release(*kept)
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for every node of an edge."""
    e = cut(plain(edges))
    links, inner = contracted(weighted(e), firsts=False)
    back = contracted(weighted(turned(e)), firsts=False)[1]
    names = cut(ends(e))
    outer = cut(names.join(inner, "node", "left_anti"))
    forward = peeled(links, outer, False)
    swapped = links.select(F.col("tail").alias("head"), F.col("head").alias("tail"), "weight", "hop", "step")
    backward = peeled(swapped, outer, False)
    left = cut(outer.join(forward, "node", "left_anti").join(backward, "node", "left_anti"))
    pairs = links.select("head", "tail")
    found, n = [], left.count()
    while n:
        e2 = cut(pairs.join(left.select(F.col("node").alias("head")), "head", "left_semi").join(left.select(F.col("node").alias("tail")), "tail", "left_semi").select("head", "tail"))
        colour, moved = cut(left.select("node", F.col("node").alias("colour"))), 1
        while moved:
            came = e2.join(colour, F.col("head") == F.col("node")).groupBy("tail").agg(F.max("colour").alias("c2"))
            step = colour.join(came, F.col("node") == F.col("tail"), "left").select("node", F.greatest("colour", "c2").alias("colour"), F.coalesce(F.col("c2") > F.col("colour"), F.lit(False)).alias("moved"))
            old, (colour, moved) = colour, counted(step, F.col("moved"))
            release(old)
        colour = colour.select("node", "colour")
        same = e2.join(colour.select(F.col("node").alias("head"), F.col("colour").alias("c1")), "head").join(colour.select(F.col("node").alias("tail"), F.col("colour").alias("c2")), "tail").where("c1 = c2").select("head", "tail")
        same = cut(same)
        front, m = counted(colour.where("node = colour"))
        group = front
        while m:
            ahead = front.join(same, F.col("node") == F.col("tail")).select(F.col("head").alias("node"), "colour").distinct()
            front, m = counted(ahead.join(group.select("node"), "node", "left_anti"))
            group = group.unionByName(front)
        group = cut(group)
        found.append(group)
        left, n = counted(left.join(group, "node", "left_anti"))
    own = names.join(inner, "node", "left_anti").select("node")
    if found:
        own = own.join(_union(found), "node", "left").select("node", F.coalesce("colour", "node").alias("c"))
    else:
        own = own.withColumn("c", F.col("node"))
    own = cut(own)
    # an inner node belongs to the component in which its chain begins and ends, if that is one
    between = inner.select("node", "to", "ring").join(back.select("node", F.col("to").alias("since")), "node")
    a, b = own.select(F.col("node").alias("to"), F.col("c").alias("ca")), own.select(F.col("node").alias("since"), F.col("c").alias("cb"))
    between = between.join(a, "to", "left").join(b, "since", "left").select("node", F.coalesce("ring", F.when(F.col("ca") == F.col("cb"), F.col("ca")), "node").alias("c"))
    every = cut(own.unionByName(between))
    least = every.groupBy("c").agg(F.min("node").alias("component"))
    return every.join(least, "c").select("node", "component")


def _best_inside(entries: list[str], exits: set[str], succ: dict[str, list[str]], most: int = MOST_STEPS) -> dict[tuple[str, str | None], list[str]]:
    """For each entry, the longest simple path to each exit and (under None) to anywhere; of equally long ones the first by name."""
    pred: dict[str, list[str]] = {}
    for a, bs in succ.items():
        for b in bs:
            pred.setdefault(b, []).append(a)
    steps, out = 0, {}

    def room(node: str, used: set[str], goal: str | None) -> int:
        """How many nodes a path may still take from ``node`` on, those being left out from which the goal is out of reach."""
        seen, stack = {node}, [node]
        while stack:
            for b in succ.get(stack.pop(), []):
                if b not in seen and b not in used:
                    seen.add(b)
                    stack.append(b)
        if goal is None or goal == node:
            return len(seen) - 1 if goal is None else 0
        if goal not in seen:
            return -1
        back, stack = {goal}, [goal]
        while stack:
            for a in pred.get(stack.pop(), []):
                if a in seen and a not in back:
                    back.add(a)
                    stack.append(a)
        return len(back) - 1

    for a in sorted(entries):
        for goal in [None, *sorted(exits)]:
            best: list[str] = []
            most_nodes = 1 + room(a, {a}, goal)
            path, used = [a], {a}
            ahead = [iter(succ.get(a, []))] if most_nodes else []
            if most_nodes and goal in (None, a):
                best = [a]
            while ahead and len(best) < most_nodes:
                b = next(ahead[-1], None) if path[-1] != goal else None
                if b is None:
                    ahead.pop()
                    used.discard(path.pop())
                    continue
                if b in used:
                    continue
                steps += 1
                if steps > most:
                    raise ValueError(f"no longest path within {most} steps in the strong component of {min(succ)}")
                used.add(b)
                choice = len(succ[path[-1]]) > 1  # on a chain there is nothing to decide
                if choice and ((more := room(b, used, goal)) < 0 or len(path) + 1 + more <= len(best)):
                    used.discard(b)
                    continue
                path.append(b)
                ahead.append(iter(succ.get(b, [])))
                if (goal is None or b == goal) and len(path) > len(best):
                    best = list(path)
            if best:
                out[a, goal] = best
    return out


def _through(edges: DataFrame, comps: DataFrame, sourceless: bool) -> DataFrame:
    """head, tail, step: ``edges`` with each strong component replaced by its longest ways from entries to what is behind it."""
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    big = cut(comps.join(sizes, "component"))
    widest = big.agg(F.max("size")).first()[0]
    if widest is not None and widest > MOST_NODES:
        raise ValueError(f"a strong component of {widest} nodes: longest simple paths are searched up to {MOST_NODES}")
    side = lambda c, k: big.select(F.col("node").alias(c), F.col("component").alias(k))
    e = cut(edges.join(side("head", "ch"), "head", "left").join(side("tail", "ct"), "tail", "left").select("head", "tail", "ch", "ct"))
    outside = ~F.col("ch").eqNullSafe(F.col("ct")) | F.col("ch").isNull()
    inner = e.where(~outside).select(F.col("ch").alias("component"), "head", "tail", F.lit("edge").alias("kind"))
    enter = e.where(outside & F.col("ct").isNotNull()).select(F.col("ct").alias("component"), F.col("tail").alias("head"), F.lit(None).cast("string").alias("tail"), F.lit("entry").alias("kind")).distinct()
    leave = e.where(outside & F.col("ch").isNotNull()).select(F.col("ch").alias("component"), "head", F.lit(None).cast("string").alias("tail"), F.lit("exit").alias("kind")).distinct()
    rows = inner.unionByName(enter).unionByName(leave)
    if sourceless:  # a path begins in a component that nothing leads to, at any of its nodes
        first = big.join(enter.select("component").distinct(), "component", "left_anti")
        rows = rows.unionByName(first.select("component", F.col("node").alias("head"), F.lit(None).cast("string").alias("tail"), F.lit("entry").alias("kind")))

    def run(group: pa.Table) -> pa.Table:
        succ: dict[str, list[str]] = {}
        entries, exits = [], set()
        for head, tail, kind in zip(*(group.column(c).to_pylist() for c in ("head", "tail", "kind")), strict=True):
            if kind == "edge":
                succ.setdefault(head, []).append(tail)
            elif kind == "entry":
                entries.append(head)
            else:
                exits.add(head)
        found = _best_inside(entries, exits, {a: sorted(b) for a, b in succ.items()})
        return pa.table({"entry": pa.array([a for a, _ in found], pa.string()), "leave": pa.array([b for _, b in found], pa.string()), "inside": pa.array([p[1:] for p in found.values()], pa.list_(pa.string()))})

    ways = cut(rows.groupBy("component").applyInArrow(run, "entry string, leave string, inside array<string>"))
    keep = e.where(outside & F.col("ch").isNull()).select("head", "tail", F.array("tail").alias("step"))
    out = e.where(outside & F.col("ch").isNotNull()).select(F.col("head").alias("leave"), "tail")
    on = ways.join(out, "leave").select(F.col("entry").alias("head"), "tail", F.concat("inside", F.array("tail")).alias("step"))
    on = on.groupBy("head", "tail").agg(F.min(F.struct((-F.size("step")).alias("less"), "step")).alias("b")).select("head", "tail", "b.step")
    last = ways.where("leave IS NULL AND size(inside) > 0").select(F.col("entry").alias("head"), F.concat(F.lit(_END), "entry").alias("tail"), F.col("inside").alias("step"))
    return keep.unionByName(on).unionByName(last)


def longest_path(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """position (from 0), node: the longest simple path within ``nodes`` (node) from a source, else from any node; ties by name.

    An empty ``nodes`` gives an empty result; edges to other nodes don't count.
    """
    nodes = cut(nodes.select("node").where("node IS NOT NULL").distinct())
    e = plain(edges)
    e = cut(e.join(nodes.select(F.col("node").alias("head")), "head", "left_semi").join(nodes.select(F.col("node").alias("tail")), "tail", "left_semi").select("head", "tail"))
    sources = nodes.join(e.select(F.col("tail").alias("node")).distinct(), "node", "left_anti")
    sourceless = sources.isEmpty()
    found = cut(depths(weighted(e), nodes))
    if found.count() < nodes.count():  # there are cycles
        through = cut(_through(e, strong_components(e), sourceless))
        found = cut(depths(through, nodes.union(through.where(F.col("tail").startswith(_END)).select("tail")).distinct()))
    begin = found.join(sources, "node", "left_semi") if not sourceless else found.where(~F.col("node").startswith(_END))
    start = begin.orderBy(F.desc("depth"), "node").limit(1).select("node", "depth").first()
    if start is None:
        return nodes.select(F.lit(0).cast("long").alias("position"), "node").limit(0)
    known = cut(found.where(F.col("node") == start.node).select("node", F.lit(0).cast("long").alias("position")))
    jump, moved = found.where("hop IS NOT NULL").select(F.col("node").alias("n2"), F.col("hop").alias("to"), F.size("step").cast("long").alias("far")), 1
    jump = cut(jump)
    while moved <= start.depth:
        old = known
        known = cut(known.union(known.join(jump, F.col("node") == F.col("n2")).select("to", F.col("position") + F.col("far"))).repartition("node"))  # else each union doubles the partitions
        release(old)
        moved *= 2
        if moved <= start.depth:
            twice = jump.select(F.col("n2").alias("n3"), F.col("to").alias("to2"), F.col("far").alias("far2"))
            old, jump = jump, cut(jump.join(twice, F.col("to") == F.col("n3")).select("n2", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far")))
            release(old)
    steps = known.join(found.where("step IS NOT NULL").select(F.col("node").alias("n2"), "step"), F.col("node") == F.col("n2"))
    steps = steps.select("position", F.posexplode("step").alias("i", "node")).select((F.col("position") + F.col("i") + 1).alias("position"), "node")
    return cut(known.where("position = 0").select("position", "node").unionByName(steps))
