"""Leaf search: every leaf is scored by a query, thresholds and a deterministic top-k follow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.text import without_number

from . import angles, patterns
from .lineage import counted, cut, free_names

# Weights and thresholds of a leaf's reward, categories that a result should cover and their boost.
SEMANTIC, CATEGORY, KEYWORD = 0.5, 0.2, 0.3
LEAST, LEAST_WITH_KEYWORD, BOOST = 0.35, 0.20, 0.40
COVERED = ["SMS", "Email", "Payment", "Database", "API"]


def category_reward(path: Column, categories: Column) -> Column:
    """The share of categories whose name is in the path, case aside; 0 without categories."""
    low = F.lower(path)
    return F.coalesce(F.try_divide(F.size(F.filter(categories, lambda c: low.contains(F.lower(c)))).cast("double"), F.size(categories)), F.lit(0.0))


def has_category(path: Column, description: Column, mapped: Column, category: Column) -> Column:
    text = F.lower(F.concat_ws(" ", path, description))
    c = F.lower(category)
    return text.contains(c) | F.exists(mapped, lambda m: F.lower(m).contains(c))


def reward(semantic: Column, category: Column, keyword: Column) -> Column:
    return SEMANTIC * semantic + CATEGORY * category + KEYWORD * keyword


def passing(scored: DataFrame, score: str = "reward", keyword: str = "keyword_score") -> DataFrame:
    return scored.where(F.col(score) > F.when(F.col(keyword) > 0, LEAST_WITH_KEYWORD).otherwise(LEAST))


def top_leaves(scored: DataFrame, tie: str, k: int = 5) -> DataFrame:
    """The k best of the passing leaves with their rank; ties by ``tie``."""
    best = passing(scored).orderBy(F.desc("reward"), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("reward"), tie)))  # at most k rows


def keyword_scan(leaves: DataFrame, keywords: list[str] | DataFrame, text: Column, case_scores: Column | None = None) -> DataFrame:
    """Leaves that hold a keyword (0.5) or match a use case (0.6 + 0.2 of the match), with what was found.

    Each text is passed over once, however many keywords there are (a list, or a table's first column).
    """
    low, score = F.lower(text), F.lit(0.0) if case_scores is None else case_scores
    hay, found, case = free_names(leaves.columns, "_text", "keyword_matches", "case_score")
    words = keywords if isinstance(keywords, list) else patterns.known(keywords.select(F.lower(keywords.columns[0]).alias("w")), "w")
    if words is None:
        raise ValueError(f"keywords of more than {patterns.MOST_BYTES} bytes: join them by patterns.containing")
    marked = patterns.with_found(leaves.withColumn(hay, low), hay, sorted({k.lower() for k in words}), found).drop(hay)
    hits = marked.withColumn(case, score).where((F.size(found) > 0) | (F.col(case) > 0))
    return hits.withColumn("reward", F.when(F.col(case) > 0, 0.6 + 0.2 * F.col(case)).otherwise(0.5))


def cover_categories(results: DataFrame, leaves: DataFrame, categories: list[str], k: int = 5) -> DataFrame:
    """``results`` with, for each of COVERED that was asked for and that no result matches, its first leaf.

    Both have path_str, description, mapped_nodes; results have reward, leaves have pos.
    """
    out = results.select("path_str", "description", "mapped_nodes", "reward")
    for c in [c for c in COVERED if c in categories]:
        match = lambda df: df.where(has_category(F.col("path_str"), F.col("description"), F.col("mapped_nodes"), F.lit(c)))  # noqa: B023, E731
        if match(out).isEmpty():
            first = match(leaves).orderBy("pos").limit(1).join(out.select("path_str"), "path_str", "left_anti")
            out = out.unionByName(first.select("path_str", "description", "mapped_nodes", F.lit(BOOST).alias("reward")))
    return out.orderBy(F.desc("reward"), "path_str").limit(k)


def per_category(scored: DataFrame, path: str = "path_str", k: int = 3, most: int = 50) -> DataFrame:
    """The k best leaves of each first-level category among the ``most`` best above 0.15 semantic score."""
    some = scored.where("semantic_score > 0.15").orderBy(F.desc("reward"), path).limit(most)
    some = some.withColumn("category", without_number(F.element_at(F.split(path, " -> "), 1)))
    return some.withColumn("category_rank", F.row_number().over(W.partitionBy("category").orderBy(F.desc("reward"), path))).where(F.col("category_rank") <= k)


def expand_categories(hits: DataFrame, leaves: DataFrame, categories: list[str], top: int = 5, per: int = 3, most: int = 50) -> DataFrame:
    """path_str, mapped_nodes, reward: ``hits`` with more leaves of their first-level categories, the ``top`` best.

    A category of a hit that an asked category names (or is named by), case aside, is filled up to ``per`` leaves: of
    its ``most`` leaves with most mapped nodes, those of highest reward, of 0.5 semantic, 0.2 half for the category and
    0.3 of the use-case score, which counts above 0.15 semantic score only. No more than twice ``top`` are considered,
    hits first. ``leaves`` has path_str, mapped_nodes, semantic_score, case_score.
    """
    first = lambda df: df.withColumn("category", without_number(F.element_at(F.split("path_str", " -> "), 1)))
    hits = first(hits).select("path_str", "mapped_nodes", "reward", "category")
    low = F.lower("category")
    asked = F.exists(F.array(*[F.lit(c.lower()) for c in categories]).cast("array<string>"), lambda c: low.contains(c) | c.contains(low))
    wanted = hits.where(asked).groupBy("category").agg((F.lit(per) - F.count(F.lit(1))).alias("needed")).where("needed > 0")
    others = first(leaves).join(hits.select("path_str"), "path_str", "left_anti").join(wanted, "category")
    many = W.partitionBy("category").orderBy(F.desc(F.size("mapped_nodes")), "path_str")
    keyword = F.when(F.col("semantic_score") > 0.15, F.col("case_score")).otherwise(0.0)
    scored = others.withColumn("r", F.row_number().over(many)).where(F.col("r") <= most).withColumn("reward", reward(F.col("semantic_score"), F.lit(0.5), keyword))
    best = W.partitionBy("category").orderBy(F.desc("reward"), "path_str")
    added = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= F.col("needed"))
    both = hits.select("path_str", "mapped_nodes", "reward", F.lit(0).alias("r"), F.lit("").alias("category")).unionByName(added.select("path_str", "mapped_nodes", "reward", "r", "category"))
    return both.orderBy("category", "r", "path_str").limit(2 * top).orderBy(F.desc("reward"), "path_str").limit(top).select("path_str", "mapped_nodes", "reward")


def high_reward(leaves: DataFrame, least: float = 0.25) -> DataFrame:
    """Leaves above ``least`` reward or with keyword matches; all, where there are none."""
    some = leaves.where((F.col("reward") > least) | F.coalesce(F.size("keyword_matches") > 0, F.lit(False)))
    return leaves if some.isEmpty() else some


def deepest(nodes: DataFrame) -> DataFrame:
    """The nodes at the greatest depth: what a search without leaves falls back to."""
    return nodes.join(nodes.agg(F.max("depth").alias("depth")), "depth", "left_semi")


def upper_confidence(total: Column, visits: Column, parent_visits: Column, c: float = 1.414, e: float = 1e-6) -> Column:
    return total / (visits + e) + c * F.sqrt(F.log(parent_visits + 1) / (visits + e))


def _best_of(ids: np.ndarray, x: np.ndarray, q: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None) -> pa.Table:
    """query_id, vec_id, similarity: the k of the rows ``c`` most like each of the rows ``q``, but for those that are certainly
    below the row's ``floor``, where given. Single precision chooses, with room for its error; double precision decides."""
    norm = np.sqrt((x * x).sum(1))
    plain = bool(np.isfinite(norm).all() and (norm > 1e-150).all())
    room = 1e-6 + 2.4e-7 * x.shape[1] if plain else 1e-9
    u = (x / norm[:, None]).astype(np.float32) if plain else x
    others, parts = u[c].T, []
    for at in range(0, len(q) if len(c) else 0, 256):
        rows = q[at : at + 256]
        s = u[rows] @ others
        if not plain:
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.nan_to_num(s / (norm[rows, None] * norm[c]), nan=-2.0)
        if floor is None:
            s[ids[rows, None] == ids[c]] = -np.inf
            least = np.partition(s, max(0, len(c) - k), 1)[:, max(0, len(c) - k)].astype(float)
        else:
            least = floor[at : at + 256]
        a, b = np.nonzero(s >= (least - 2 * room).astype(s.dtype)[:, None])
        ok = (s[a, b] > -np.inf) & (ids[rows[a]] != ids[c[b]])
        a, b = a[ok], b[ok]
        # once more pair by pair, so that equal vectors are equally similar
        with np.errstate(invalid="ignore", divide="ignore"):
            exact = np.nan_to_num((x[rows[a]] * x[c[b]]).sum(1) / (norm[rows[a]] * norm[c[b]]), nan=-2.0)
        by = np.lexsort((ids[c[b]], -exact, a))
        a, b, exact = a[by], b[by], exact[by]
        best = np.arange(len(a)) - np.searchsorted(a, a) < k
        parts.append((ids[rows[a[best]]], ids[c[b[best]]], exact[best]))
    cols = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2], mask=cols[2] < -1.5)})


def nearest(vectors: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, similarity: the k rows of ``vectors`` (vec_id, embedding) most like each row, ties by id.

    Rows are dealt to blocks. Each block first finds its rows' k nearest within itself; the least of them is a row's floor, below
    which no other block needs to answer. Each pair of blocks compares all its rows and keeps at most k for each query.
    """
    n = max(1, -(-vectors.count() // block))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("own")
    dealt = vectors.select("vec_id", "embedding", own)
    result = "query_id long, vec_id long, similarity double"

    def inside(group: pa.Table) -> pa.Table:
        every = np.arange(group.num_rows)
        return _best_of(group.column("vec_id").to_numpy(), angles.matrix(group.column("embedding").combine_chunks()), every, every, k)

    found = dealt.groupBy("own").applyInArrow(inside, result)
    if n > 1:
        found = cut(found)
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min(F.coalesce("similarity", F.lit(-2.0)))).alias("floor"))
        other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i != F.col("own")))
        asking = dealt.join(floors, "vec_id", "left").select(F.col("own").alias("q"), other.alias("c"), F.coalesce("floor", F.lit(-2.0)).alias("floor"), "vec_id", "embedding")
        asked = dealt.select(other.alias("q"), F.col("own").alias("c"), F.lit(None).cast("double").alias("floor"), "vec_id", "embedding")

        def across(group: pa.Table) -> pa.Table:
            floor = group.column("floor").to_numpy()
            q, c = np.flatnonzero(~np.isnan(floor)), np.flatnonzero(np.isnan(floor))
            return _best_of(group.column("vec_id").to_numpy(), angles.matrix(group.column("embedding").combine_chunks()), q, c, k, floor[q])

        found = found.unionByName(asking.union(asked).groupBy("q", "c").applyInArrow(across, result))
    w = W.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def dealt_by_angle(vectors: DataFrame, within: str, block: int = 2048) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rows (w, vec_id, embedding, leader, near, sub), cells (w, leader, sub, n, radius), and the leaders.

    A row belongs to its nearest leader, at angle ``near``; a leader's rows of one ``within`` value are dealt to cells of
    about ``block``, which lie within ``radius`` of it. There is a leader for each ``block`` rows, at most ``angles.LEADERS``.
    """
    v = vectors.select(F.col(within).alias("w"), "vec_id", "embedding").where(F.exists("embedding", lambda x: x != 0))
    v, total = counted(v)
    centres = angles.leaders(v, "embedding", min(angles.LEADERS, max(1, -(-total // block))))
    rows = cut(angles.with_leader(v, "embedding", centres))
    sizes = rows.groupBy("w", "leader").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("radius")).withColumn("subs", F.ceil(F.col("n") / block).cast("int"))
    on = F.col("w").eqNullSafe(F.col("w2")) & (F.col("leader") == F.col("l2"))
    dealt = rows.join(sizes.select(F.col("w").alias("w2"), F.col("leader").alias("l2"), "subs"), on).withColumn("sub", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("subs")).cast("int"))
    cells = sizes.select("w", "leader", (F.col("n") / F.col("subs")).alias("n"), "radius", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    return dealt.select("w", "vec_id", "embedding", "leader", "sub"), cells, centres


def cell_pairs(cells: DataFrame, centres: np.ndarray, least: float) -> DataFrame:
    """w, i and j (leader and sub, i up to j), pairs: the pairs of cells in which a cosine can reach ``least``.

    Two cells whose leaders are further apart than the angle of ``least`` and both radii hold no such pair.
    """
    most = float(np.arccos(np.clip(least, -1, 1)))
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1)) if len(centres) else np.zeros((0, 0))
    table = cells.sparkSession.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(apart)) for j in range(len(apart))], "l1 int, l2 int, apart double")  # LEADERS squared at most
    side = lambda k: cells.select(F.col("w").alias(f"w{k}"), F.struct("leader", "sub").alias("ij"[k - 1]), F.col("leader").alias(f"l{k}"), F.col("n").alias(f"n{k}"), F.col("radius").alias(f"r{k}"))
    both = side(1).join(side(2), F.col("w1").eqNullSafe(F.col("w2")) & (F.col("i") <= F.col("j"))).join(F.broadcast(table), ["l1", "l2"])
    met = both.where(F.col("apart") - F.col("r1") - F.col("r2") <= most + angles.SLACK)
    return met.select(F.col("w1").alias("w"), "i", "j", F.when(F.col("i") == F.col("j"), F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2")).alias("pairs"))


def bundles(cells: DataFrame, most: int) -> DataFrame:
    """w, at (leader and sub), bundle: neighbouring cells of one w value, together about ``most`` rows. A row a cell."""
    before = F.sum("n").over(W.partitionBy("w").orderBy("leader", "sub").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return cells.select("w", F.struct("leader", "sub").alias("at"), F.floor(before / most).cast("int").alias("bundle"))


def pairs_above(vectors: DataFrame, least: float, within: str, block: int = 2048, bundle: int = 8192) -> DataFrame:
    """a, b, similarity: pairs a < b of ``vectors`` (vec_id, embedding) of one ``within`` value, from a cosine of ``least`` on.

    Rows are dealt to cells by direction (``dealt_by_angle``), and only pairs of cells that can hold such a pair meet
    (``cell_pairs``). So that a row isn't sent to each cell that its own meets, cells travel in bundles of about ``bundle`` rows: each
    pair of bundles with cells that meet is one bounded group, in which those cells are compared. Null and zero vectors have no pairs.
    """
    rows, cells, centres = dealt_by_angle(vectors, within, block)
    cells = cut(cells)
    dealt_to = cut(bundles(cells, bundle))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("w")
    side = lambda c, name: dealt_to.select(F.col("w").alias(f"w_{c}"), F.col("at").alias(f"at_{c}"), F.col("bundle").alias(name))
    same = lambda c: F.col("w").eqNullSafe(F.col(f"w_{c}")) & (F.col(c) == F.col(f"at_{c}"))
    met = cell_pairs(cells, centres, least).join(side("i", "bi"), same("i")).join(side("j", "bj"), same("j"))
    met = cut(met.select(key("w"), "bi", "bj", "i", "j"))
    groups = met.select("w", "bi", "bj").distinct()
    takes = groups.select("w", "bi", "bj", F.col("bi").alias("own")).union(groups.where("bi <> bj").select("w", "bi", "bj", "bj"))
    placed = rows.withColumn("cell", F.struct("leader", "sub")).join(side("cell", "own"), same("cell")).select(key("w"), "own", "cell", "vec_id", "embedding")
    dealt = placed.join(takes, ["w", "own"]).select("w", "bi", "bj", F.col("cell.leader").alias("leader"), F.col("cell.sub").alias("sub"), "vec_id", "embedding")
    pairs = met.select(*[F.col(c).alias(c) for c in ("w", "bi", "bj")], F.col("i.leader").alias("l1"), F.col("i.sub").alias("s1"), F.col("j.leader").alias("l2"), F.col("j.sub").alias("s2"))

    def run(group: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, x = group.column("vec_id").to_numpy(), angles.matrix(group.column("embedding").combine_chunks())
        norm = np.sqrt((x * x).sum(1))
        of = lambda t, a, b: (t.column(a).to_numpy().astype(np.int64) << 32) | t.column(b).to_numpy()
        cell = of(group, "leader", "sub")
        order = np.argsort(cell, kind="stable")
        names, starts = np.unique(cell[order], return_index=True)
        members = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))
        partners: dict[int, list[int]] = {}
        for i, j in zip(of(pairs, "l1", "s1").tolist(), of(pairs, "l2", "s2").tolist(), strict=True):
            partners.setdefault(i, []).append(j)
        none, parts = np.zeros(0, np.int64), []
        for i, js in partners.items():
            q = members.get(i, none)
            c = np.concatenate([members.get(j, none) for j in js])
            own = np.concatenate([np.full(len(members.get(j, none)), i == j) for j in js])
            for at in range(0, len(q), 512):
                rows = q[at : at + 512]
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (x[rows] @ x[c].T) / (norm[rows, None] * norm[c])
                u, v = np.nonzero(s >= least - 1e-9)
                inner = own[v]
                u, v = rows[u], c[v]
                # once more pair by pair, and each pair once
                exact = (x[u] * x[v]).sum(1) / (norm[u] * norm[v])
                ok = (exact >= least) & np.where(inner, ids[u] < ids[v], ids[u] != ids[v])
                parts.append((np.minimum(ids[u], ids[v])[ok], np.maximum(ids[u], ids[v])[ok], exact[ok]))
        cols = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [none, none, np.zeros(0)]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2])})

    return dealt.groupBy("w", "bi", "bj").cogroup(pairs.groupBy("w", "bi", "bj")).applyInArrow(run, "a long, b long, similarity double")
