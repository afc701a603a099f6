"""Directed graphs as edge tables (head, tail, relation): degrees, components, reachability, paths, order.

Loops run on the driver over cut lineage (checkpoint); what they carry stays distributed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.stats import ratio

from . import dag, lineage
from .lineage import counted, cut

# Substrings that mark triggers, usual ends, preferred sources and sinks, and critical nodes.
TRIGGERS = ["trigger", "webhook", "cron"]
ENDS = ["noOp", "stopAndError", "emailSend", "respondToWebhook"]
PATH_ENDS = [*ENDS, "googleCalendar"]
PRIORITY_SOURCES = ["manualTrigger", "webhook", "scheduleTrigger"]
PRIORITY_SINKS = ["noOp", "stopAndError"]
CRITICAL = ["function", "code", "if", "switch", "merge", "openai", "agent", "llm", "chat", "embedding", "extract", "transform", "filter", "aggregate"]


def digraph(triples: DataFrame, order: str) -> DataFrame:
    """One row per (head, tail): the last relation by ``order`` wins; weight 1."""
    return triples.groupBy("head", "tail").agg(F.max_by("relation", order).alias("relation")).withColumn("weight", F.lit(1.0))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("head").alias("node")).union(edges.select(F.col("tail").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree."""
    ends = edges.select(F.col("head").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("tail"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("head")), "head", "left_semi").join(nodes.select(F.col("node").alias("tail")), "tail", "left_semi").select(edges.columns)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node)."""
    found = lineage.components(edges, "head", "tail")
    return nodes_of(edges).join(found, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("component"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_components, connected, density, average_degree; zeros for an empty graph."""
    e = edges.select("head", "tail").distinct()
    nodes = nodes_of(e).agg(F.count(F.lit(1)).alias("n_nodes"))
    n_edges = e.agg(F.count(F.lit(1)).alias("n_edges"))
    parts = components(e).agg(F.countDistinct("component").alias("n_components"))
    out = nodes.crossJoin(n_edges).crossJoin(parts)  # one row each
    n, m = F.col("n_nodes"), F.col("n_edges")
    return out.withColumns({"connected": F.col("n_components") == 1, "density": ratio(m, n * (n - 1)), "average_degree": ratio(2 * m, n)})


def reachable(edges: DataFrame, seeds: DataFrame, backward: bool = False, most_levels: int = 8) -> DataFrame:
    """The rows that paths from ``seeds`` (node, and columns that travel along) reach, seeds included.

    A job a level; beyond ``most_levels``, chains are contracted (see ``dag``), so long ones don't cost a job a node.
    """
    src, dst = ("tail", "head") if backward else ("head", "tail")
    keys = seeds.columns
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    front, n = counted(seeds.distinct())
    seen, level = front, 0
    while n and (level := level + 1) <= most_levels:
        ahead = front.join(e, "node").select(*[F.col("next" if c == "node" else c).alias(c) for c in keys])
        front, n = counted(ahead.distinct().join(seen, keys, "left_anti").select(*keys))
        seen = seen.union(front)
    if n:
        seen = seen.union(dag.reached(e.select(F.col("node").alias("head"), F.col("next").alias("tail")), front)).distinct()
    return seen


def _contains_any(node: Column, parts: list[str], fold: bool = True) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | (F.lower(node).contains(p.lower()) if fold else node.contains(p))
    return out


def is_trigger(node: Column) -> Column:
    return _contains_any(node, TRIGGERS)


def is_critical(node: Column) -> Column:
    return _contains_any(node, CRITICAL)


def end_nodes(edges: DataFrame, nodes: DataFrame, usual: list[str], fallback_all: bool) -> DataFrame:
    """node: those of ``nodes`` in the graph without successors, else with usual names, else all (or none)."""
    inside = nodes.join(nodes_of(edges), "node", "left_semi")
    dead = inside.join(edges.select(F.col("head").alias("node")).distinct(), "node", "left_anti")
    named = nodes.where(_contains_any(F.col("node"), usual, fold=False))
    for found in (dead, named):
        if not found.isEmpty():
            return found
    return nodes if fallback_all else nodes.limit(0)


def entries(edges: DataFrame, nodes: DataFrame, most_triggers: int = 3, most_ends: int = 5) -> DataFrame:
    """trigger, node: for the first triggers by name, what lies between them and the first ends.

    Forward from the trigger and backward from the ends within ``nodes``; the intersection, else forward.
    Without a trigger there is no entry.
    """
    inside = cut(induced(edges, nodes))
    ends = end_nodes(edges, nodes, ENDS, True).orderBy("node").limit(most_ends)
    back = reachable(inside, ends.select("node"), backward=True)
    triggers = nodes.join(nodes_of(edges), "node", "left_semi").where(is_trigger(F.col("node"))).orderBy("node").limit(most_triggers)
    forward = reachable(inside, triggers.select(F.col("node").alias("trigger"), "node"))
    marked = forward.join(back.withColumn("back", F.lit(True)), "node", "left").withColumn("any", F.max(F.coalesce("back", F.lit(False))).over(W.partitionBy("trigger")))
    return marked.where(F.col("back") | ~F.col("any")).select("trigger", "node")


def simple_paths(edges: DataFrame, start: str, end: str, most_edges: int = 6) -> DataFrame:
    """path: all simple paths from ``start`` to ``end`` of at most ``most_edges`` edges.

    One join a step. A path goes on only to nodes from which the end is within the steps that are left.
    """
    e = cut(edges.select("head", "tail").where("head <> tail").distinct())
    # how many edges the end is away
    near = edges.sparkSession.createDataFrame([(end, 0)], "node string, away int")
    for i in range(1, most_edges):
        step = e.join(near.select(F.col("node").alias("tail")), "tail").select(F.col("head").alias("node"), F.lit(i).alias("away"))
        near = near.union(step).groupBy("node").agg(F.min("away").alias("away"))
    near = cut(near)
    walk = edges.sparkSession.createDataFrame([([start], start)], "path array<string>, node string")
    out = None
    for left in range(most_edges - 1, -1, -1):
        ahead = e.join(near.where(F.col("away") <= left).select(F.col("node").alias("tail")), "tail", "left_semi")
        walk = walk.where(F.col("node") != end).join(ahead, F.col("node") == F.col("head")).where(~F.array_contains("path", F.col("tail")))
        walk = walk.select(F.array_append("path", F.col("tail")).alias("path"), F.col("tail").alias("node"))
        found = walk.where(F.col("node") == end).select("path")
        out = found if out is None else out.union(found)
    return out


def best_paths(edges: Iterable[tuple[str, str]], start: str, end: str, required: set[str], k: int, most_edges: int) -> list[tuple[float, list[str]]]:
    """The k best simple paths of a small graph with their scores, as ``rank_paths`` would choose them among all.

    Depth first, by name; a prefix is left when not even the most that it may still cover would be among the best.
    """
    succ: dict[str, list[str]] = {}
    pred: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        if a != b:
            succ.setdefault(a, []).append(b)
            pred.setdefault(b, []).append(a)
    away, queue = {end: 0}, [end]
    for node in queue:
        for p in pred.get(node, []):
            if p not in away:
                away[p] = away[node] + 1
                queue.append(p)
    best: list[tuple[float, int, list[str]]] = []  # (-score, length, path), sorted

    def walk(path: list[str], covered: int) -> None:
        node, steps = path[-1], most_edges - len(path) + 1
        if node == end:
            best.append((-round(covered * 2.0 - len(path) * 0.1, 6), len(path), list(path)))
            best.sort()
            del best[k:]
            return
        if away.get(node, steps + 1) > steps:
            return
        more = min(len(required) - covered, steps - 1)
        length = len(path) + max(away[node], more + 1)
        # what comes later by name loses a tie
        if len(best) == k and (-round((covered + more) * 2.0 - length * 0.1, 6), length) >= best[-1][:2]:
            return
        for n in succ.get(node, []):
            if n not in path:
                path.append(n)
                walk(path, covered + (n in required))
                path.pop()

    if start in succ and start != end:
        walk([start], int(start in required))
    return [(-s, path) for s, _, path in best]


def peeled(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[tuple[int, str]]:
    """(level, node) of a small graph by peeling sources, in order; nodes on or behind cycles are left out."""
    left, e, out = set(nodes), set(edges), []
    while now := left - {b for _, b in e}:
        level = out[-1][0] + 1 if out else 0
        out += [(level, n) for n in sorted(now)]
        left -= now
        e = {(a, b) for a, b in e if a not in now}
    return out


def rank_paths(paths: DataFrame, required: DataFrame, k: int = 5) -> DataFrame:
    """The k best of ``paths`` (path): twice the required nodes covered, less a tenth of the length."""
    need = required.agg(F.array_sort(F.collect_set("node")).alias("need"))  # one row
    p = paths.crossJoin(F.broadcast(need)).withColumns({"coverage": F.array_intersect("path", "need"), "length": F.size("path")})
    p = p.withColumns({"coverage_count": F.size("coverage"), "score": F.round(F.size("coverage") * 2.0 - F.size("path") * 0.1, 6)})
    return p.drop("need").orderBy(F.desc("score"), "length", F.array_join("path", "\x01")).limit(k)


def levels(edges: DataFrame) -> DataFrame:
    """node, level (longest path from a source); nodes on or behind cycles are left out. Jobs as in ``dag``."""
    return dag.levels(edges)


def topological_order(edges: DataFrame) -> DataFrame | None:
    """node, level, or None if there is a cycle."""
    out = levels(edges)
    return out if out.count() == nodes_of(edges).count() else None


def expand(edges: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    """``nodes`` with the first predecessor and the first successor (by name) of each, at most ``most`` by name."""
    e = edges.select("head", "tail").distinct()
    first = lambda a, b: e.join(nodes.select(F.col("node").alias(a)), a, "left_semi").groupBy(a).agg(F.min(b).alias("node")).select("node")
    return nodes.select("node").union(first("tail", "head")).union(first("head", "tail")).distinct().orderBy("node").limit(most)


def longest_path(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """path: the longest simple path within ``nodes`` from a source (else any node) in one row; ties by name.

    ``dag.longest_path`` gives it as a row a node.
    """
    steps = dag.longest_path(edges, nodes).groupBy().agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("p"))
    return steps.where(F.size("p") > 0).select(F.transform("p", lambda x: x["node"]).alias("path"))


CANDIDATES = "trigger string, path array<string>, coverage array<string>, length int, coverage_count int, score double"


def compose(edges: DataFrame, nodes: DataFrame, most_nodes: int = 40, k: int = 5, most_edges: int = 6, most_topo: int = 15) -> DataFrame:
    """Candidate chains: trigger, path, score, coverage, coverage_count, length.

    For each entry's module (its first ``most_nodes`` nodes by name, the trigger among them), the best paths to the
    first end by name; where none connects, the topological order from the trigger on stands in. A module is
    bounded, so each is one small group.
    """
    edges, nodes = cut(edges.select("head", "tail").distinct()), cut(nodes.select("node").distinct())
    module = numbered(entries(edges, nodes), ["trigger"], [F.col("node") != F.col("trigger"), "node"]).where(F.col("rank") <= most_nodes).select("trigger", "node")
    module = cut(module)
    inside = edges.join(module.withColumnRenamed("node", "head"), "head").join(module.withColumnRenamed("node", "tail"), ["trigger", "tail"])
    rows = module.select("trigger", F.col("node").alias("head"), F.lit(None).cast("string").alias("tail")).union(inside.select("trigger", "head", "tail"))

    def run(group: pa.Table) -> pa.Table:
        trigger = group.column("trigger")[0].as_py()
        pairs = list(zip(group.column("head").to_pylist(), group.column("tail").to_pylist(), strict=True))
        inner, links = {a for a, b in pairs if b is None}, {(a, b) for a, b in pairs if b is not None}
        ends = inner - {a for a, _ in links} or {n for n in inner if any(p in n for p in PATH_ENDS)}
        out = []
        if ends:
            required = {n for n in inner if any(c.lower() in n.lower() for c in CRITICAL)} - {trigger} - ends
            for score, path in best_paths(links, trigger, min(ends), required, k, most_edges):
                covered = [n for n in path if n in required]
                out.append((trigger, path, covered, len(path), len(covered), score))
            order = peeled(inner, links)
            if not out and len(order) == len(inner):
                path = [n for _, n in order[[n for _, n in order].index(trigger) :]][:most_topo]
                out.append((trigger, path, [], len(path), 0, 0.0))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in CANDIDATES.split(", ")])

    return rows.groupBy("trigger").applyInArrow(run, CANDIDATES)


def _all_simple_paths(succ: dict[str, list[str]], start: str, end: str, most_edges: int, most_steps: int = 20_000) -> Iterator[list[str]]:
    """Simple paths of a small graph, depth first by name.

    A path goes on only to nodes from which the end is within the steps that are left; in cyclic graphs that can still be
    many, so the search ends after ``most_steps`` prefixes.
    """
    pred: dict[str, list[str]] = {}
    for a, bs in succ.items():
        for b in bs:
            pred.setdefault(b, []).append(a)
    away, queue = {end: 0}, [end]
    for node in queue:
        for p in pred.get(node, []):
            if p not in away:
                away[p] = away[node] + 1
                queue.append(p)
    stack = [[start]]
    while stack and (most_steps := most_steps - 1) >= 0:
        path = stack.pop()
        if path[-1] == end:
            yield path
        else:
            left = most_edges - len(path)
            stack += [[*path, n] for n in reversed(succ.get(path[-1], [])) if n not in path and away.get(n, left + 1) <= left]


def find_path(edges: DataFrame, nodes: DataFrame, core: DataFrame, most_nodes: int = 50, most_paths: int = 50, most_length: int = 15) -> DataFrame:
    """path: one row, the path that orders ``nodes`` (node), of which ``core`` (node) matter.

    From the preferred sources (else those of least in-degree) to the preferred sinks (else those of least
    out-degree), two of each by name, the longest of the first ``most_paths`` simple paths of at most 20 edges; more
    core nodes decide a tie. Without a path, cycles are broken and core nodes come in topological order between
    sources and sinks. Of the path stay core nodes, sources, sinks, and nodes beside a core node; a path above
    ``most_length`` keeps sources, core nodes and sinks only. Above ``most_nodes`` nodes, those not beside a core
    node go first. So what is searched here is bounded, whatever the graph.
    """
    spark = edges.sparkSession
    edges, nodes, core = edges.select("head", "tail").distinct(), nodes.select("node").distinct(), core.select("node").distinct()
    beside = edges.join(core, F.col("head") == F.col("node"), "left_semi").select(F.col("tail").alias("node")).union(edges.join(core, F.col("tail") == F.col("node"), "left_semi").select(F.col("head").alias("node"))).distinct()
    at_end = F.exists(F.array(*[F.lit(x) for x in PRIORITY_SOURCES + PRIORITY_SINKS]), lambda x: F.element_at(F.split("node", r"\."), -1) == x)
    ranked = nodes.join(core.withColumn("core", F.lit(True)), "node", "left").join(beside.withColumn("beside", F.lit(True)), "node", "left")
    chosen = ranked.orderBy(F.coalesce("core", F.lit(False)).desc(), at_end.desc(), F.coalesce("beside", F.lit(False)).desc(), "node").limit(most_nodes)
    kept = [(r.node, bool(r.core), bool(r.beside)) for r in chosen.collect()]  # at most most_nodes rows
    names, is_core, is_beside = {n for n, _, _ in kept}, {n for n, c, _ in kept if c}, {n for n, _, b in kept if b}
    links = sorted((r.head, r.tail) for r in induced(edges, spark.createDataFrame([(n,) for n in names], "node string")).where("head <> tail").collect())  # at most their square
    path = _ordered(sorted(names), links, is_core, is_beside, most_paths, most_length)
    return spark.createDataFrame([(path,)], "path array<string>").where(F.size("path") > 0)


def _ordered(names: list[str], links: list[tuple[str, str]], core: set[str], beside: set[str], most_paths: int, most_length: int) -> list[str]:
    if len(names) < 2:
        return names
    succ = {n: [b for a, b in links if a == n] for n in names}
    degree = lambda i: {n: sum(e[i] == n for e in links) for n in names}
    ins, outs = degree(1), degree(0)
    preferred = lambda kinds: [n for k in kinds for n in names if n.split(".")[-1] == k]
    sources = preferred(PRIORITY_SOURCES) or [n for n in names if ins[n] == min(ins.values())]
    sinks = preferred(PRIORITY_SINKS) or [n for n in names if outs[n] == min(outs.values())]
    best: list[str] = []
    tried = 0
    for a, b in ((a, b) for a in sources[:2] for b in sinks[:2] if a != b):
        for path in _all_simple_paths(succ, a, b, min(20, len(names))):
            tried += 1
            if tried > most_paths:
                break
            if (len(path), len(core & set(path))) > (len(best), len(core & set(best))):
                best = path
    if not best:
        inner = (core | set(sources) | set(sinks)) if core else set(names)
        left = {(a, b) for a, b in links if a in inner and b in inner}
        while len(order := peeled(inner, left)) < len(inner):
            # one edge of what is left of the cycles goes, the first by name
            done = {n for _, n in order}
            left.discard(min(e for e in left if e[0] not in done and e[1] not in done))
        middle = [n for _, n in order]
        best = [n for n in middle if n in sources] + [n for n in middle if n not in sources and n not in sinks] + [n for n in middle if n in sinks and n not in sources]
    ends = {*sources, *sinks}
    best = [n for i, n in enumerate(best) if n in core or n in ends or (0 < i < len(best) - 1 and n in beside)]
    if len(best) > most_length:
        best = list(dict.fromkeys([n for n in best if n in sources] + [n for n in best if n in core] + [n for n in best if n in sinks]))[:most_length]
    return best


def numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
