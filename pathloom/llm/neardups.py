"""Operator 5, MinHash near-dedup: an LSH forest.

Every document's set of distinct word shingles (five words, unless said otherwise; the query takes two) gets 64
minhash bytes. The forest has 16 trees; a tree is the order of all signatures rotated to start at its own four bytes, so
signatures with a long common prefix stand together. Documents that share at least ``DEPTH`` of a tree's bytes form a
region. A row's next ``NEIGHBOURS`` in the order have the longest common prefixes with it: those estimated at ESTIMATE (far below
the threshold) or more are linked first. Rows outside the largest cluster that this makes are then compared with all
of the region, so every region is searched whole, but a group of near copies costs little more than its neighbours. What
leaves a task spans the runs that belong together, never all pairs.

The depth adapts to the region: one of more than ``REGION`` documents is cut again at ``DEPTHS`` bytes, as often as it is
too large; signatures equal throughout are joined without comparing. What the cuts separate is searched exactly afterwards:
in each region that was cut, the rows outside its largest candidate cluster meet all other rows, in pairs of blocks, each
pair a group of its own. So a large region's depth decides what work is saved, not which pairs are found.

The candidate clusters (components of those forests) are then checked exactly on full shingle sets, in blocks of
``BLOCK`` documents. A cluster of one block is checked pair by pair at once. The blocks of a larger one are first
checked each within itself and against ``HUBS`` members of the cluster, which joins most of what belongs together
and sends each text once; only where parts of a cluster are still separate, the documents outside its largest part
are compared with all others, each pair of blocks a task of its own. Again a spanning forest of the true links
suffices, as only components are asked for. Documents with equal sets are one class throughout (map-side combined),
so a large group of copies costs one signature and one text.

Recall: a pair at exactly 0.8 shares no tree's prefix with probability (1 - 0.8^4)^16 = 2e-4; a pair that does is
lost if 64 signature bytes estimate it below 0.6 (2e-4 at 0.8) and no chain of candidates joins the two otherwise.

Defined results: null, blank and empty texts have no shingles and link with nothing (n_shingles 0); a text
shorter than a shingle is one; a text counts whole, however long; rows that share a doc_id are one document, in one
component, with the links of all their texts (each row shows its own text's n_shingles); a null doc_id links with
nothing and is kept (component_id null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, beside_groups, components, counted, cut, free_names, release, shuffle_width, slices, table

WIDTH, TREES, DEPTH, REGION, ESTIMATE, BLOCK, HUBS, NUMERATOR, PART_ROWS = 5, 16, 4, 4096, 0.6, 128, 8, 80, 400_000
DEPTHS, NEIGHBOURS = (8, 16, 32), 4
_NONE = np.iinfo(np.int64).max
HASHES = TREES * DEPTH
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MANY = np.random.default_rng(20255).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: bytes, hashes: dict, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words as sorted 64-bit hashes; the whole sequence, if it is shorter."""
    words = text.translate(_FOLD).split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = h[:n] * _K1
    for j in range(1, min(width, len(h))):
        out = _mixed(out) * _K1 + h[j : j + n] * _K2
    return np.unique(_mixed(out + np.uint64(min(width, len(h))) * _K3))


def signature(s: np.ndarray) -> bytes:
    """64 minhashes, one byte each."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, (s[at : at + 4096, None] * _MANY).min(0))
    return (_mixed(out) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, a 128-bit print of the set (f1, f2) and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                n, f1, f2, sig = [], [], [], []
                for text in as_bytes(batch.column("text")):
                    s = shingles(text, hashes, width)
                    n.append(len(s))
                    f1.append(int(_mixed(s ^ _K1).sum(dtype=np.uint64).astype(np.int64)))
                    f2.append(int(np.bitwise_xor.reduce(_mixed(s * _K2)).astype(np.int64)) if len(s) else 0)
                    sig.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "h", "n_shingles", "f1", "f2", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n_shingles long, f1 long, f2 long, sig binary")


def _forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, out = len(ok), []
    left = np.ones(n, bool)
    while left.any():
        root = int(left.argmax())
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            for y in np.flatnonzero(ok[at] & left).tolist():
                out.append((at, y))
                left[y] = False
                queue.append(y)
    return out


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of a row of ``x`` and one of ``y`` agree in at least ESTIMATE of their bytes."""
    ok = np.zeros((len(x), len(y)), bool)
    columns = np.ascontiguousarray(y.T)
    step = max(1, 1_000_000 // len(y))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        same = np.zeros((len(part), len(y)), np.uint8)
        for k in range(HASHES):
            same += part[:, k, None] == columns[k]
        ok[a : a + step] = same >= ESTIMATE * HASHES
    return ok


def _rooted(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the least that ``pairs`` join it with."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs].ravel(), np.repeat(low, 2))
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _candidates(ids: np.ndarray, sigs: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, int]:
    """Candidate pairs that span what is alike in whole regions, and how many pairs were compared.

    Rows stand in the order of their (rotated) signatures; a region begins where ``head`` is set.
    """
    region = np.cumsum(head)
    compared, near = 0, []
    for apart in range(1, NEIGHBOURS + 1):
        at = np.flatnonzero(region[apart:] == region[:-apart])
        compared += len(at)
        near.append(at[(sigs[at] == sigs[at + apart]).sum(1) >= ESTIMATE * HASHES])
    first = np.ones(len(ids), bool)
    first[near[0] + 1] = False
    run = np.cumsum(first) - 1
    out = [np.column_stack([ids[at], ids[at + apart]]) for apart, at in enumerate(near, 1)]
    bridges = np.concatenate([np.column_stack([run[at], run[at + apart]]) for apart, at in enumerate(near[1:], 2)])
    cluster = _rooted(int(run[-1]) + 1, np.unique(bridges[bridges[:, 0] != bridges[:, 1]], axis=0))[run]
    cuts = np.append(np.flatnonzero(head), len(ids))
    several = (np.add.reduceat((cluster != cluster[cuts[region - 1]]).astype(np.int64), cuts[:-1]) > 0) & (np.diff(cuts) > 2)
    for k in np.flatnonzero(several).tolist():
        a, b = int(cuts[k]), int(cuts[k + 1])
        begin = np.flatnonzero(first[a:b])
        of = cluster[a:b] - cluster[a:b].min()
        outside = np.flatnonzero(of != np.bincount(of).argmax())
        ok = _alike(sigs[a:b][outside], sigs[a:b])
        compared += ok.size
        of = run[a:b][outside] - run[a]
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        between = np.zeros((len(begin), len(begin)), bool)
        between[of[heads]] = np.logical_or.reduceat(np.logical_or.reduceat(ok, begin, axis=1), heads, axis=0)
        pairs = _forest(between | between.T)
        if pairs:
            out.append(ids[a:b][begin[np.array(pairs)]])
    return np.concatenate(out), compared


def _as_keys(column: pa.ChunkedArray) -> np.ndarray:
    """Keys of the orders as rows of bytes: the tree, and the signature from its bytes on."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES + 1)


def _orders(classes: DataFrame) -> DataFrame:
    """Rows (key, id): every class in the orders of all trees."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    start = F.col("tree") * DEPTH
    rotated = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring("sig", start + 1, F.lit(HASHES)), F.substring("sig", F.lit(1), start))
    return classes.select("id", "sig", trees).select(rotated.alias("key"), "id")


def _region(depth: int) -> Column:
    return F.substring("key", 1, depth + 1)


def _searched(rows: DataFrame, depth: int, parts: int) -> DataFrame:
    """Candidate pairs (a, b) of rows that share so many bytes; no region has more than ``REGION`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Searches what is complete; a region that may go on stays."""
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            keys = _as_keys(t.column("key"))
            head = np.insert((keys[1:, : depth + 1] != keys[:-1, : depth + 1]).any(1), 0, True)
            stop = t.num_rows if last else int(np.flatnonzero(head)[-1])
            held = t.slice(stop).to_batches()
            if stop > 1:
                p, _ = _candidates(t.column("id").to_numpy()[:stop], keys[:stop, 1:], head[:stop])
                yield pa.RecordBatch.from_arrays([pa.array(p.min(1)), pa.array(p.max(1))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > 50_000:
                yield from done(False)
        if held:
            yield from done(True)

    dealt = rows.select("key", "id").withColumn("region", _region(depth)).repartition(parts, "region")
    return dealt.sortWithinPartitions("key", "id").select("key", "id").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of every group (region, i, j) of ``rows`` (and own, key, id): all pairs of one block if
    i = j, else those between the two blocks."""

    def run(group: pa.Table) -> pa.Table:
        sigs, ids = _as_keys(group.column("key"))[:, 1:], group.column("id").to_numpy()
        one = group.column("own").to_numpy() == group.column("i")[0].as_py()
        if group.column("i")[0].as_py() == group.column("j")[0].as_py():
            ok = _alike(sigs, sigs)
        else:
            ok = np.zeros((len(ids), len(ids)), bool)
            if one.any() and not one.all():
                ok[np.ix_(one, ~one)] = found = _alike(sigs[one], sigs[~one])
                ok[np.ix_(~one, one)] = found.T
        p = ids[np.array(_forest(ok), np.int64).reshape(-1, 2)]
        return pa.table([pa.array(p.min(1)), pa.array(p.max(1))], names=["a", "b"])

    return rows.groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def candidate_pairs(classes: DataFrame, n: int) -> DataFrame:
    """Candidate pairs (a, b) of the ``n`` classes (id, sig) from all trees of the forest; repeats are left in."""
    parts = max(shuffle_width(classes.sparkSession), -(-n * TREES // PART_ROWS))
    rest, found, hot = _orders(classes), None, None
    add = lambda pairs: pairs if found is None else found.union(pairs)
    for depth in (DEPTH, *DEPTHS):
        large, any_ = counted(rest.groupBy(_region(depth).alias("region")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REGION))
        if not any_:
            found = add(_searched(rest, depth, parts))
            break
        marked = beside_groups(rest.select("key", "id", _region(depth).alias("region")), large.withColumn("large", F.lit(True)), "region")
        found = add(_searched(marked.where("large is null"), depth, parts))
        rest = cut(marked.where("large").select("key", "id"))
        hot = rest if hot is None else hot
    else:
        least = rest.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
        found = found.union(beside_groups(rest, least, "key").where("a < id").select("a", F.col("id").alias("b")))
    if hot is None:
        return found
    # what the cuts of large regions have separated: all rows outside a region's largest cluster meet all others
    found = cut(found)
    named = components(found).withColumnRenamed("id", "c")
    of = cut(hot.join(named, F.col("id") == F.col("c"), "left").select(_region(DEPTH).alias("region"), "key", "id", F.coalesce("component", "id").alias("cluster")))
    sizes = of.groupBy("region", "cluster").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("region").agg(F.max(F.struct("size", "cluster")).alias("most"), F.sum("size").alias("n"))
    most = most.select("region", F.col("most.cluster").alias("main"), F.col("most.size").alias("inside"), (F.col("n") - F.col("most.size")).alias("outside"), "n")
    apart, any_ = counted(beside_groups(of, most, "region").where("outside > 0"))
    if not any_:
        return found
    deal = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    outer, inner = (F.ceil(F.col(c) / REGION).cast("int") for c in ("outside", "inside"))
    is_in = F.col("cluster") == F.col("main")
    apart = apart.withColumn("own", F.when(is_in, outer + deal(inner)).otherwise(deal(outer)))
    apart = apart.select("region", "key", "id", "own", F.explode(F.sequence(F.lit(0), F.when(is_in, outer).otherwise(outer + inner) - 1)).alias("o"))
    return found.union(_across(apart.select("region", "key", "id", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))))


def linked(sets: list[np.ndarray], within: int | None = None, numerator: int = NUMERATOR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= numerator * union.

    With ``within``, only pairs between the first ``within`` sets and the rest.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(item, kind="stable")
    owner_by_item, item_sorted = owner[order], item[order]
    begin = np.searchsorted(item_sorted, np.arange(item_sorted[-1] + 2))
    at = np.cumsum(size) - size
    both = np.zeros((n, n), np.int64)
    for i in range(n):
        mine = item[at[i] : at[i] + size[i]]
        lo, length = begin[mine], begin[mine + 1] - begin[mine]
        ends = np.cumsum(length)
        idx = np.arange(ends[-1]) + np.repeat(lo - ends + length, length)
        both[i] = np.bincount(owner_by_item[idx], minlength=n)
    ok = 100 * both >= numerator * (size[:, None] + size[None] - both)
    np.fill_diagonal(ok, False)
    if within is not None:
        ok[:within, :within] = False
        ok[within:, within:] = False
    return _forest(ok)


_LINKS = "a long, b long, cluster long, label long, doc_id long, h long"


def _links(dealt: DataFrame, width: int, labels: bool) -> DataFrame:
    """A spanning forest (a, b) of the true links of every group (cluster, i, j): all pairs if i = j, else those
    between the rows whose ``own`` block is i and the others. ``dealt``: cluster, i, j, own, id, text, hub, doc_id, h.

    With ``labels``, also a row for each document that is no guest (a = id): the smallest hub that it is joined with in
    its group, as ``label``.
    """

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own = group.column("own").to_numpy()
        ids = group.column("id").to_numpy()
        order = np.lexsort((ids, own))
        order = order[np.insert(ids[order][1:] != ids[order][:-1], 0, True)]
        ids, own = ids[order], own[order]
        texts = as_bytes(group.column("text").combine_chunks())
        hashes = _Hashes()
        sets = [shingles(texts[k], hashes, width) for k in order]
        pairs = linked(sets, None if i == j else int((own == i).sum())) if len(sets) > 1 else []
        p = ids[np.array(pairs)] if pairs else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(p), pa.int64())
        out = pa.table([pa.array(p[:, 0]), pa.array(p[:, 1]), none, none, none, none], names=["a", "b", "cluster", "label", "doc_id", "h"])
        if labels:
            g = group.take(pa.array(order))
            hub = np.where(g.column("hub").to_numpy(zero_copy_only=False), ids, _NONE)
            label = hub.copy()
            for _ in range(len(pairs)):  # at most a block's documents
                before = label.copy()
                for x, y in pairs:
                    label[x] = label[y] = min(label[x], label[y])
                if (label == before).all():
                    break
            home = np.flatnonzero(~g.column("guest").to_numpy(zero_copy_only=False))
            rows = g.take(pa.array(home))
            found = pa.array(label[home], mask=label[home] == _NONE)
            out = pa.concat_tables([out, pa.table([rows.column("id"), pa.nulls(len(home), pa.int64()), rows.column("cluster"), found, rows.column("doc_id"), rows.column("h")], names=out.column_names)])
        return out

    return dealt.select("cluster", "i", "j", "own", "id", "text", "hub", "guest", "doc_id", "h").groupBy("cluster", "i", "j").applyInArrow(run, _LINKS)


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, h and other columns, one row for each pair) with the text. A task sends a document that
    it holds several times only once."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if len(seen) > 2_000_000:
                seen.clear()
            fresh = []
            for key in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            yield batch if all(fresh) else batch.filter(pa.array(fresh))

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(once, "doc_id long, h long, text string").join(wanted, ["doc_id", "h"])


def verified(docs: DataFrame, clusters: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (a, b) that span the true components of each cluster: ``clusters`` has cluster, n (its size), id and the
    place (doc_id, h) of a text."""
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int")
    blocks = _blocks(F.col("n"))
    # about HUBS members of a large cluster are guests in all its blocks
    hub = (F.col("n") > BLOCK) & (F.pmod(F.xxhash64("id", F.lit(2)), F.col("n")) < HUBS)
    own = clusters.withColumns({"home": deal(blocks), "hub": hub})
    own = own.withColumn("own", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("home"))))
    own = own.withColumn("guest", (F.col("n") <= BLOCK) | (F.col("own") != F.col("home")))
    # repeats of a document that came from several tasks meet in their group, once for each task
    first = _texts(docs, own.select("doc_id", "h", "cluster", "id", "own", "hub", "guest"))
    within, unsettled = counted(_links(first.withColumns({"i": F.col("own"), "j": F.col("own")}), width, True), F.col("b").isNull())
    links = within.where("b is not null").select("a", "b")
    if not unsettled:
        return links
    # what the largest part of a cluster leaves out is compared with everything
    rows = within.where("b is null")
    sizes = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("size"))
    named = F.when(F.col("label").isNotNull(), F.struct("size", "label"))
    most = sizes.groupBy("cluster").agg(F.max(named).alias("most"), F.sum("size").alias("total"))
    inside = F.coalesce("most.size", F.lit(0))
    most = most.select("cluster", F.col("most.label").alias("main"), inside.alias("inside"), (F.col("total") - inside).alias("outside")).where("outside > 0")
    rest, unsettled = counted(rows.join(most, "cluster").select("cluster", F.col("a").alias("id"), "doc_id", "h", F.coalesce(F.col("label") == F.col("main"), F.lit(False)).alias("in"), "inside", "outside"))
    if not unsettled:
        return links
    bo, bl = _blocks(F.col("outside")), _blocks(F.col("inside"))
    rest = rest.withColumn("own", F.when(F.col("in"), bo + deal(F.greatest(bl, F.lit(1)))).otherwise(deal(bo)))
    rest = rest.select("cluster", "id", "doc_id", "h", "own", F.explode(F.sequence(F.lit(0), F.when(F.col("in"), bo).otherwise(bo + bl) - 1)).alias("other"))
    pairs = rest.select("cluster", "id", "doc_id", "h", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(False).alias("hub"), F.lit(True).alias("guest"))
    return links.union(_links(_texts(docs, pairs), width, False).select("a", "b"))


def components_of(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n_shingles, f1, f2) of all documents, and for each class of equal sets (f1, f2, n) the
    smallest doc_id that it is joined with (root)."""
    d = cut(described(docs, width))
    full = d.where("n_shingles > 0 and doc_id is not null")
    # a class's id is its own; its smallest document (doc_id, h) has its text
    classes, n = counted(full.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "h")).alias("place"), F.first("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()))
    clusters = components(candidate_pairs(classes, n)).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    clusters = cut(clusters.join(sizes, "cluster").join(classes.select("id", "place.doc_id", "place.h"), "id"))
    links = verified(docs, clusters, width)
    # sets that share a doc_id
    shared, any_ = counted(full.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n_shingles")).alias("lo"), F.max(F.struct("f1", "f2", "n_shingles")).alias("hi")).where("lo <> hi").select("doc_id"))
    if any_:
        of = full.join(shared, "doc_id").select("doc_id", "f1", "f2", F.col("n_shingles").alias("n")).distinct().join(classes.select("f1", "f2", "n", "id"), ["f1", "f2", "n"])
        least = of.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = links.union(of.join(least, "doc_id").select("a", F.col("id").alias("b")))
    joined = components(links)
    least = joined.join(classes.select("id", "place.doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("root"))
    roots = classes.join(joined.join(least, "component").select(F.col("id").alias("c"), "root"), F.col("id") == F.col("c"), "left")
    release(shared)
    return d, roots.select("f1", "f2", "n", F.coalesce("root", "place.doc_id").alias("root"))


def _joined(d: DataFrame, roots: DataFrame) -> DataFrame:
    same = (d.f1 == F.col("r.f1")) & (d.f2 == F.col("r.f2")) & (d.n_shingles == F.col("r.n")) & d.doc_id.isNotNull()
    out = d.join(roots.alias("r"), same, "left")
    component = F.coalesce("r.root", d.doc_id)
    return out.select(d.doc_id, d.n_shingles, component.alias("component_id"), F.coalesce(d.doc_id == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    return _joined(*components_of(docs, width))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each component: its smallest doc_id, and one of its rows for each text."""
    gone, h = free_names(docs.columns, "_gone", "_h")
    d, roots = components_of(docs, width)
    marks = _joined(d, roots).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    is_marked = F.col("doc_id") == F.col(gone)
    left = docs.join(marks, is_marked, "left_anti")
    repeats, any_ = counted(d.where("doc_id is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(gone)).distinct())
    if not any_:
        return left
    once = left.join(repeats, is_marked, "left_semi").withColumn(h, F.xxhash64("text")).dropDuplicates(["doc_id", h]).drop(h)
    return left.join(repeats, is_marked, "left_anti").unionByName(once)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 2)
