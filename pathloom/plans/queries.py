"""Queries over the test tables and the same in SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import jsonx, text, vector
from pathloom.operators import chains, dag, factors, graph, intent, mapping, matching, metrics, normalize, ordering, params, patterns, quantiles, report, search, taxonomy, variants
from pathloom.sources.readers import pending

from . import pipelines, providers, views
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- evaluation -----------------------------------------------------------------------------------------

NODE_SQL = views.SIDES + """, gc AS (SELECT user_id, event_type, count(*) AS c FROM g GROUP BY ALL), mc AS (SELECT user_id, event_type, count(*) AS c FROM m GROUP BY ALL),
b AS (SELECT coalesce(gc.user_id, mc.user_id) AS template_id, coalesce(gc.c, 0) AS g, coalesce(mc.c, 0) AS m FROM gc FULL JOIN mc ON gc.user_id = mc.user_id AND gc.event_type = mc.event_type),
nf AS (SELECT template_id, CAST(sum(least(g, m)) AS BIGINT) AS tp, CAST(sum(greatest(m - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - m, 0)) AS BIGINT) AS fn FROM b GROUP BY 1),
np AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM nf),
node AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM np)"""
EDGE_SQL = """ge AS (SELECT DISTINCT user_id AS template_id, a, b FROM (SELECT user_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM g) WHERE a IS NOT NULL),
me AS (SELECT DISTINCT user_id AS template_id, a, b FROM (SELECT user_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM m) WHERE a IS NOT NULL),
ec AS (SELECT coalesce(ge.template_id, me.template_id) AS template_id, count(ge.a) AS gn, count(me.a) AS mn, count(CASE WHEN ge.a IS NOT NULL AND me.a IS NOT NULL THEN 1 END) AS s FROM ge FULL JOIN me ON ge.template_id = me.template_id AND ge.a = me.a AND ge.b = me.b GROUP BY 1),
ep AS (SELECT *, CASE WHEN mn = 0 THEN 0.0 ELSE s / CAST(mn AS DOUBLE) END AS p, CASE WHEN gn = 0 THEN 0.0 ELSE s / CAST(gn AS DOUBLE) END AS r FROM ec),
edge AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM ep)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return views.side(spark, sf, 0), views.side(spark, sf, 1)


def _node_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.node_metrics(*_sides(spark, sf))


def _edge_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g, m = _sides(spark, sf)
    return metrics.edge_metrics(matching.typed_edges(views.side_edges(g), g), matching.typed_edges(views.side_edges(m), m))


@query(f"WITH {NODE_SQL} SELECT template_id, tp, fp, fn, round(p, 6) AS node_precision, round(r, 6) AS node_recall, round(f, 6) AS node_f1 FROM node")
def typed_match_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_node_metrics(spark, sf), ["node_precision", "node_recall", "node_f1"]).select("template_id", "tp", "fp", "fn", "node_precision", "node_recall", "node_f1")


@query(f"WITH {views.SIDES}, {EDGE_SQL} SELECT template_id, gn AS truth_edges, mn AS made_edges, s AS shared_edges, round(p, 6) AS edge_precision, round(r, 6) AS edge_recall, round(f, 6) AS edge_f1 FROM edge")
def edge_set_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_edge_metrics(spark, sf), ["edge_precision", "edge_recall", "edge_f1"])


@query(f"""WITH {NODE_SQL}, {EDGE_SQL}, j AS (SELECT node.f AS nf, edge.f AS ef FROM node LEFT JOIN edge USING (template_id))
SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_failed, round(avg(nf), 6) AS node_f1_mean, round(median(nf), 6) AS node_f1_median, round(stddev_pop(nf), 6) AS node_f1_std, round(min(nf), 6) AS node_f1_min, round(max(nf), 6) AS node_f1_max,
round(avg(ef), 6) AS edge_f1_mean, round(median(ef), 6) AS edge_f1_median, round(stddev_pop(ef), 6) AS edge_f1_std, round(min(ef), 6) AS edge_f1_min, round(max(ef), 6) AS edge_f1_max FROM j""")
def summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    r = _node_metrics(spark, sf).join(_edge_metrics(spark, sf), "template_id", "left")
    out = metrics.summary(r, ["node_f1", "edge_f1"]).drop("error")
    return _rounded(out, [c for c in out.columns if "_f1_" in c])


@query(f"WITH {views.USAGE} SELECT conv_id, prompt_tokens, completion_tokens, round(prompt_tokens / 1e6 * 2.5, 9) AS input_cost, round(completion_tokens / 1e6 * 10.0, 9) AS output_cost, round(prompt_tokens / 1e6 * 2.5 + completion_tokens / 1e6 * 10.0, 9) AS total_cost FROM u")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.costs(views.usage(spark, sf)), ["input_cost", "output_cost", "total_cost"], 9)


@query(f"WITH {views.USAGE} SELECT CAST(sum(prompt_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, count(*) AS n, round(sum(prompt_tokens / 1e6 * 2.5 + completion_tokens / 1e6 * 10.0), 4) AS total_cost, round(sum(prompt_tokens / 1e6 * 2.5 + completion_tokens / 1e6 * 10.0) / count(*), 4) AS average_cost FROM u")
def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.cost_report(metrics.costs(views.usage(spark, sf))), ["total_cost", "average_cost"], 4)


# --- graph ------------------------------------------------------------------------------------------------

@query(f"WITH {views.TRIPLES} SELECT head, tail, max_by(relation, (ts, event_id)) AS relation, count(*) AS n FROM triples GROUP BY head, tail")
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    t = views.triples(spark, sf)
    d = graph.digraph(t.withColumn("at", F.struct("ts", "event_id")), "at")
    return d.join(t.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("n")), ["head", "tail"]).select("head", "tail", "relation", "n")


def _dag(spark: SparkSession, sf: str) -> DataFrame:
    return views.triples(spark, sf).where("head < tail").select("head", "tail").distinct()


DAG = views.TRIPLES + ", dag AS (SELECT DISTINCT head, tail FROM triples WHERE head < tail)"


@query(f"WITH {DAG} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT head AS node, 0 AS i, 1 AS o FROM dag UNION ALL SELECT tail, 1, 0 FROM dag) GROUP BY node")
def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_dag(spark, sf))


def _bipartite(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("head"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("tail"))


@query("WITH x AS (SELECT count(*) AS c, count(DISTINCT c_nationkey) AS n FROM customer) SELECT c + n AS n_nodes, c AS n_edges, n AS n_components, n = 1 AS connected, round(c / CAST((c + n) * (c + n - 1) AS DOUBLE), 9) AS density, round(2 * c / CAST(c + n AS DOUBLE), 6) AS average_degree FROM x")
def graph_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = graph.statistics(_bipartite(spark, sf))
    return _rounded(_rounded(s, ["density"], 9), ["average_degree"])


@query("WITH x AS (SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n FROM customer), k AS (SELECT n, least(min(c), n) AS component FROM x GROUP BY n) SELECT c AS node, component FROM x JOIN k USING (n) UNION SELECT n, component FROM k")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(_bipartite(spark, sf))


@query(f"WITH RECURSIVE {DAG}, f(node) AS (SELECT min(head) FROM dag UNION SELECT tail FROM dag JOIN f ON head = node), b(node) AS (SELECT max(tail) FROM dag UNION SELECT head FROM dag JOIN b ON tail = node) SELECT node FROM f INTERSECT SELECT node FROM b")
def reachable_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = _dag(spark, sf)
    f = graph.reachable(e, e.agg(F.min("head").alias("node")))
    return f.intersect(graph.reachable(e, e.agg(F.max("tail").alias("node")), backward=True))


@query(f"WITH RECURSIVE {DAG}, l(node, level) AS (SELECT head, 0 FROM dag WHERE head NOT IN (SELECT tail FROM dag) UNION SELECT tail, level + 1 FROM dag JOIN l ON head = node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY node")
def topo_order(spark: SparkSession, sf: str) -> DataFrame:
    return graph.levels(_dag(spark, sf)).withColumn("level", F.col("level").cast("int"))


PATHS = views.TRIPLES + """, e AS (SELECT DISTINCT head, tail FROM triples), w(path, node, n) AS (SELECT ['click'], 'click', 0 UNION ALL SELECT list_append(path, tail), tail, n + 1 FROM w JOIN e ON head = node WHERE n < 6 AND node <> 'view' AND NOT list_contains(path, tail)),
p AS (SELECT path FROM w WHERE node = 'view' AND n > 0)"""


@query(f"WITH RECURSIVE {PATHS} SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS length FROM p")
def simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = graph.simple_paths(views.triples(spark, sf), "click", "view")
    return p.select(F.array_join("path", ">").alias("path"), F.size("path").alias("length"))


@query(f"WITH RECURSIVE {PATHS}, s AS (SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS length, CAST(list_contains(path, 'error') AS INTEGER) + CAST(list_contains(path, 'signup') AS INTEGER) AS coverage_count FROM p) SELECT path, length, coverage_count, CAST(round(coverage_count * 2.0 - length * 0.1, 6) AS DOUBLE) AS score FROM s ORDER BY score DESC, length, path LIMIT 5")
def path_rank(spark: SparkSession, sf: str) -> DataFrame:
    need = spark.createDataFrame([("error",), ("signup",)], "node string")
    r = graph.rank_paths(graph.simple_paths(views.triples(spark, sf), "click", "view"), need)
    return r.select(F.array_join("path", ">").alias("path"), "length", "coverage_count", "score")


@query(f"WITH {DAG}, seed AS (SELECT 'error' AS node) SELECT node FROM seed UNION SELECT min(head) FROM dag WHERE tail = 'error' HAVING min(head) IS NOT NULL UNION SELECT min(tail) FROM dag WHERE head = 'error' HAVING min(tail) IS NOT NULL")
def dependency_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand(_dag(spark, sf), spark.createDataFrame([("error",)], "node string"))


@query(f"WITH RECURSIVE {DAG}, w(path, node, n) AS (SELECT [head], head, 0 FROM dag WHERE head NOT IN (SELECT tail FROM dag) UNION SELECT list_append(path, tail), tail, n + 1 FROM w JOIN dag ON head = node) SELECT array_to_string(path, '>') AS path FROM w ORDER BY n DESC, path LIMIT 1")
def longest_path(spark: SparkSession, sf: str) -> DataFrame:
    e = _dag(spark, sf)
    return graph.longest_path(e, graph.nodes_of(e)).select(F.array_join("path", ">").alias("path"))


ORDER_LINKS = """o AS (SELECT printf('%09d', o_orderkey) AS node, o_orderkey AS k, o_orderdate AS d, o_custkey AS c, c_nationkey AS n, o_orderpriority = '1-URGENT' AS urgent FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT node AS head, lead(node) OVER (PARTITION BY c ORDER BY d, k) AS tail FROM o UNION SELECT node, t FROM (SELECT node, urgent, lead(node) OVER (PARTITION BY n ORDER BY d, k) AS t FROM o) WHERE urgent)"""


def _order_links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """head, tail: from an order to its customer's next one, and from an urgent one to the next in its nation; the nodes."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    o = o.select(F.format_string("%09d", "o_orderkey").alias("node"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_custkey").alias("c"), F.col("c_nationkey").alias("n"), "o_orderpriority")
    own = o.select(F.col("node").alias("head"), F.lead("node").over(W.partitionBy("c").orderBy("d", "k")).alias("tail"))
    # a nation's orders are many: what is next is found within ranges of dates, and across them by a row a range
    urgent = ordering.following(o.select("n", "d", "k", "node", "o_orderpriority"), ["n"], ["d", "k"], "node", "next").where("o_orderpriority = '1-URGENT'").select(F.col("node").alias("head"), F.col("next").alias("tail"))
    return own.union(urgent).where("tail IS NOT NULL"), o.select("node")


@query(f"""WITH RECURSIVE {ORDER_LINKS}, x AS (SELECT head, tail FROM e WHERE tail IS NOT NULL), l(node, level) AS (SELECT node, 0 FROM o WHERE node NOT IN (SELECT head FROM x) UNION SELECT head, level + 1 FROM x JOIN l ON tail = node),
m AS (SELECT node, max(level) AS depth FROM l GROUP BY node), s AS (SELECT min_by(node, (-depth, node)) AS node FROM m WHERE node NOT IN (SELECT tail FROM x)),
p(position, node) AS (SELECT 0, node FROM s UNION ALL SELECT position + 1, (SELECT min(tail) FROM x JOIN m t ON t.node = tail JOIN m h ON h.node = head WHERE head = p.node AND t.depth = h.depth - 1) FROM p WHERE node IN (SELECT head FROM x))
SELECT CAST(position AS BIGINT) AS position, node FROM p WHERE node IS NOT NULL""")
def longest_order_path(spark: SparkSession, sf: str) -> DataFrame:
    return dag.longest_path(*_order_links(spark, sf))


@query(f"""WITH RECURSIVE {ORDER_LINKS}, x AS (SELECT head, tail FROM e WHERE tail IS NOT NULL), l(node, level) AS (SELECT node, 0 FROM o WHERE node IN (SELECT head FROM x UNION SELECT tail FROM x) AND node NOT IN (SELECT tail FROM x) UNION SELECT tail, level + 1 FROM x JOIN l ON head = node)
SELECT level, count(*) AS n FROM (SELECT node, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY node) GROUP BY level""")
def order_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graph.levels(_order_links(spark, sf)[0]).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


# --- chains -----------------------------------------------------------------------------------------------

@query(f"WITH {views.MATRIX}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM matrix) SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(least(1.0, 4 * score), 6) AS score FROM r WHERE rank <= 3")
def top_transitions(spark: SparkSession, sf: str) -> DataFrame:
    m = views.matrix(spark, sf).withColumn("score", 4 * F.col("score"))
    return _rounded(chains.top_transitions(m, 3), ["score"])


_REDUCE = {"sum": "sum(score)", "product": "product(score)", "average": "avg(score)", "geometric_mean": "power(product(score), 1.0 / count(*))", "min": "min(score)"}


def _chain_score(strategy: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = chains.score_chains(views.chains(spark, sf), views.matrix(spark, sf), strategy)
        return _rounded(s, ["chain_score"]).select("chain_id", "chain_score")

    return run


for _s, _sql in _REDUCE.items():
    query(f"WITH {views.MATRIX}, {views.STEPS} SELECT n.chain_id, round(coalesce(max(x.s), 0.0), 6) AS chain_score FROM (SELECT DISTINCT chain_id FROM numbered) n LEFT JOIN (SELECT chain_id, {_sql} AS s FROM scored GROUP BY chain_id) x USING (chain_id) GROUP BY n.chain_id", f"chain_score_{_s}")(_chain_score(_s))


@query(f"WITH {views.MATRIX}, {views.STEPS}, c AS (SELECT chain_id, avg(score) AS s FROM scored GROUP BY chain_id) SELECT CAST(row_number() OVER (ORDER BY round(s, 6) DESC, chain_id) AS INTEGER) AS rank, chain_id, round(s, 6) AS chain_score FROM c WHERE s >= 0.2")
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    r = chains.rank_candidates(views.chains(spark, sf), views.matrix(spark, sf), "average", 0.2)
    r = _rounded(r, ["chain_score"]).select("chain_id", "chain_score")
    return ordering.positions(r, [F.desc("chain_score"), F.col("chain_id")], "rank").select(F.col("rank").cast("int").alias("rank"), "chain_id", "chain_score")


@query()
def als_transition_model(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: an iterative factorisation."""
    return _rounded(chains.als_scores(views.matrix(spark, sf).select("src", "dst", "n"), rank=4), ["score"], 3)


def _supplier_steps(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, n: how often a supplier's line is followed by another's in an order."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"))
    return lines.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query()
def transition_model_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: the errors of a factorised model, round by round, over training and held-out pairs."""
    model = factors.fit(_supplier_steps(spark, sf), rank=4, rounds=6)
    rows = [(*h, h[0] == model.best) for h in model.history]
    return _rounded(spark.createDataFrame(rows, factors.ERRORS + ", best boolean"), ["mae", "rmse", "max_error"], 3)


# --- taxonomy ----------------------------------------------------------------------------------------------

def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.flatten(views.taxonomy_documents(spark, sf))


@query(f"WITH {views.LEAVES} SELECT p_type || ' -> ' || p_brand AS path, 2 AS depth, true AS is_leaf, CAST(len(nodes) AS INTEGER) AS n_mapped FROM leaves UNION ALL SELECT DISTINCT p_type, 1, false, 0 FROM leaves")
def taxonomy_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select(F.array_join("path", " -> ").alias("path"), "depth", "is_leaf", F.size("mapped_nodes").alias("n_mapped"))


@query(f"WITH {views.LEAVES} SELECT count(*) + count(DISTINCT p_type) AS n_nodes, count(*) AS n_leaves, CAST(sum(len(nodes)) AS BIGINT) AS n_mapped, 2 AS max_depth, (SELECT count(DISTINCT p_name) FROM part) AS n_types FROM leaves")
def taxonomy_stats(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.statistics(_tree(spark, sf))


@query("SELECT p_name AS type, string_agg(DISTINCT p_type || ' -> ' || p_brand, '|' ORDER BY p_type || ' -> ' || p_brand) AS categories FROM part GROUP BY p_name")
def type_to_category(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.types_to_categories(_tree(spark, sf)).select("type", F.array_join("categories", "|").alias("categories"))


@query("SELECT r_name AS category, r_name AS description FROM region")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    doc = table(spark, sf, "region").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", F.col("r_regionkey").cast("string"), "r_name").alias("k"), F.struct(F.array(F.lit("x")).alias("Nodes")).alias("v")))).alias("Taxonomy"))
    return taxonomy.top_categories(taxonomy.flatten(doc.select(F.parse_json(F.to_json(F.struct("Taxonomy"))).alias("tree"))))


# --- search ------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _similar_to(spark: SparkSession, sf: str, vec: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    one = e.where(F.col("vec_id") == vec).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).withColumn("semantic_score", vector.cosine(F.col("q"), F.col("embedding")))  # one query row


@query(f"""WITH x AS (SELECT b.vec_id, 'L' || b.label || ' -> V' || b.vec_id AS path_str, {_COS} AS semantic_score, CAST(b.label = 1 OR b.label = 3 AS INTEGER) / 2.0 AS category_score, CASE WHEN b.vec_id % 7 = 0 THEN 0.5 ELSE 0.0 END AS keyword_score FROM embeddings a, embeddings b WHERE a.vec_id = 0),
r AS (SELECT *, 0.5 * semantic_score + 0.2 * category_score + 0.3 * keyword_score AS reward FROM x)
SELECT CAST(row_number() OVER (ORDER BY reward DESC, path_str) AS INTEGER) AS rank, path_str, round(reward, 5) AS reward FROM r WHERE reward > CASE WHEN keyword_score > 0 THEN 0.20 ELSE 0.35 END ORDER BY 1 LIMIT 5""")
def leaf_scoring_topk(spark: SparkSession, sf: str) -> DataFrame:
    x = _similar_to(spark, sf, 0).withColumn("path_str", F.concat(F.lit("L"), F.col("label"), F.lit(" -> V"), F.col("vec_id")))
    x = x.withColumns({"category_score": search.category_reward(F.col("path_str"), F.array(F.lit("L1 "), F.lit("L3 "))), "keyword_score": F.when(F.col("vec_id") % 7 == 0, 0.5).otherwise(0.0)})
    x = x.withColumn("reward", search.reward(F.col("semantic_score"), F.col("category_score"), F.col("keyword_score")))
    return _rounded(search.top_leaves(x, "path_str"), ["reward"], 5).select("rank", "path_str", "reward")


@query(f"""WITH x AS (SELECT b.vec_id, b.label, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0), t AS (SELECT * FROM x WHERE s > 0.15 ORDER BY s DESC, vec_id LIMIT 50),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k FROM t) SELECT 'L' || label AS category, CAST(k AS INTEGER) AS category_rank, vec_id, round(s, 5) AS reward FROM r WHERE k <= 3""")
def category_topk(spark: SparkSession, sf: str) -> DataFrame:
    x = _similar_to(spark, sf, 0).withColumns({"path_str": F.concat(F.col("label"), F.lit(" L"), F.col("label"), F.lit(" -> V"), F.lpad(F.col("vec_id").cast("string"), 9, "0")), "reward": F.col("semantic_score")})
    x = search.per_category(x.withColumn("path_str", F.concat(F.lit("7 L"), F.col("label"), F.lit(" -> "), F.lpad(F.col("vec_id").cast("string"), 9, "0"))))
    return _rounded(x, ["reward"], 5).select("category", "category_rank", "vec_id", "reward")


KEYWORDS = ["token", "license", "idiot", "thing"]


@query("SELECT doc_id, array_to_string(list_filter(['idiot', 'license', 'thing', 'token'], lambda w: contains(lower(text), w)), ',') AS keyword_matches, 0.5 AS reward FROM documents WHERE len(list_filter(['idiot', 'license', 'thing', 'token'], lambda w: contains(lower(text), w))) > 0".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"))
def keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.keyword_scan(table(spark, sf, "documents"), KEYWORDS, F.col("text"))
    return hits.select("doc_id", F.array_join("keyword_matches", ",").alias("keyword_matches"), "reward")


@query("""WITH d AS (SELECT lang AS category, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents WHERE lang IS NOT NULL), own AS (SELECT word, category, count(*) AS n FROM d GROUP BY ALL),
sh AS (SELECT word, sum(n) AS w FROM own GROUP BY word), cl AS (SELECT category, sum(n) AS size FROM own GROUP BY category), t AS (SELECT count(*) AS v, sum(w) AS t FROM sh),
f AS (SELECT k, word, count(*) AS f, w FROM (SELECT conv_id * 1000 + turn AS k, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM conversations) JOIN sh USING (word) GROUP BY k, word, w),
x AS (SELECT k, c.category, sum(-f * ln((w - coalesce(o.n, 0) + 1.0) / (v + t.t - c.size))) AS score, sum(CASE WHEN o.n IS NULL THEN 0 ELSE f END) AS support FROM f CROSS JOIN cl c CROSS JOIN t LEFT JOIN own o ON o.word = f.word AND o.category = c.category GROUP BY k, c.category)
SELECT k AS request_id, category, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 6) DESC, category) AS r FROM x WHERE support > 0) WHERE r = 1""")
def intent_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns by a classifier that documents of each language fit."""
    model = intent.fit(table(spark, sf, "documents"), "lang", "text")
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")
    return _rounded(intent.best(intent.scores(turns, "request_id", "text", model), "request_id", digits=6), ["score"], 4).select("request_id", "category", "score")


_QUANTILES = [("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({p} AS DOUBLE) AS probability, round(quantile_cont({c}, {p}), 6) AS value FROM {t}" for t, c in _QUANTILES for p in (0.01, 0.5, 0.999)))
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = quantiles.quantiles(table(spark, sf, "lineitem"), [c for _, c in _QUANTILES], [0.01, 0.5, 0.999])
    return _rounded(spark.createDataFrame([(c, p, v) for (c, p), v in found.items()], "metric string, probability double, value double"), ["value"])


_LETTERS = "list_transform(range(97, 123), lambda c: CAST(length(lower(text)) - length(replace(lower(text), chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"
_WORD8 = "list_distinct(list_filter(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'), lambda w: length(w) >= 8))"


@query(f"""WITH r AS (SELECT conv_id * 1000 + turn AS request_id, 'b' || (conv_id % 7) || ' ' AS category, {_LETTERS} AS q, {_WORD8} AS ws FROM conversations WHERE role = 'user'),
l AS (SELECT 'B' || (item_id % 7) || ' -> ' || item_id AS path_str, lower(text) AS low, {_LETTERS} AS d FROM benchmark),
x AS (SELECT request_id, path_str, list_cosine_similarity(q, d) AS s, CAST(contains(lower(path_str), category) AS INTEGER) AS c, coalesce(len(list_filter(ws, lambda w: contains(low, w))) / nullif(CAST(len(ws) AS DOUBLE), 0), 0) AS w FROM r, l WHERE list_max(q) > 0 AND list_max(d) > 0),
y AS (SELECT *, 0.5 * s + 0.2 * c + 0.3 * w AS reward FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(reward, 9) DESC, path_str) AS rank FROM y WHERE reward > CASE WHEN w > 0 THEN 0.20 ELSE 0.35 END)
SELECT request_id, CAST(rank AS INTEGER) AS rank, path_str, round(reward, 5) AS reward FROM z WHERE rank <= 5""")
def leaf_search(spark: SparkSession, sf: str) -> DataFrame:
    """What users say as requests to the benchmark's items as leaves."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.length(w) >= 8))
    asked = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("goal_description"), words.alias("keywords"), F.array(F.concat(F.lit("B"), F.col("conv_id") % 7, F.lit(" "))).alias("function_categories"))
    none = F.array().cast("array<string>")
    leaves = table(spark, sf, "benchmark").select(F.concat(F.lit("B"), F.col("item_id") % 7, F.lit(" -> "), F.col("item_id")).alias("path_str"), F.col("text").alias("combined_text"), F.lit("").alias("description"), none.alias("mapped_nodes"))
    # as SQL rounds: the product in binary decides on which side of a half it is, not the shortest decimal (0.653125 is 0.65312)
    out = pipelines.score_leaves(asked, leaves, providers.letter_counts)
    return out.select("request_id", "rank", "path_str", (F.floor(F.col("reward") * 100000.0 + 0.5) / 100000.0).alias("reward"))


@query("""WITH p AS (SELECT DISTINCT lower(w) AS pattern FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM benchmark) WHERE length(w) >= 6)
SELECT pattern, count(doc_id) AS n_documents FROM p LEFT JOIN documents ON contains(lower(text), pattern) GROUP BY pattern""")
def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    """In how many documents each of the benchmark's longer words stands, as a part of any text."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).where(F.length("w") >= 6)
    words = words.select(F.lower("w").alias("pattern")).distinct()
    hits = patterns.containing(words, "pattern", table(spark, sf, "documents").select(F.lower("text").alias("text")), "text").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return words.join(hits, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents"))


@query(f"""WITH x AS (SELECT b.label, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0), h AS (SELECT label, max(s) AS m, avg(s) AS a FROM x WHERE s >= 0.1 GROUP BY label)
SELECT label, round(coalesce(0.7 * m + 0.3 * a, 0.0), 5) AS match_score FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN h USING (label)""")
def usecase_match(spark: SparkSession, sf: str) -> DataFrame:
    # max and mean of a label's similarities are partial aggregates: no group is gathered
    hit = F.when(F.col("semantic_score") >= 0.1, F.col("semantic_score"))
    x = _similar_to(spark, sf, 0).groupBy("label").agg(F.coalesce(0.7 * F.max(hit) + 0.3 * F.avg(hit), F.lit(0.0)).alias("match_score"))
    return _rounded(x, ["match_score"], 5)


@query(f"""WITH x AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM x)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 5) AS similarity FROM r WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    x = search.nearest(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return _rounded(x, ["similarity"], 5).select("query_id", "rank", "vec_id", "similarity")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.35")
def cosine_pairs_threshold(spark: SparkSession, sf: str) -> DataFrame:
    x = search.pairs_above(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), 0.35, "label")
    return _rounded(x, ["similarity"], 5).select("a", "b", "similarity")


# --- text --------------------------------------------------------------------------------------------------

_T = "'[\\p{L}\\p{N}_]+'"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_FALLBACK = "[" + ", ".join(f"'{w}'" for w in text.FALLBACK_STOP_WORDS) + "]"


def _terms(f: Callable) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = table(spark, sf, "documents").select("doc_id", f(F.col("text")).alias("t"))
        return d.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|").cast("binary")).alias("digest"))

    return run


def _terms_sql(inner: str) -> str:
    return f"WITH x AS (SELECT doc_id, list_sort(list_distinct({inner})) AS t FROM documents) SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, '|')) AS digest FROM x"


_ACRONYMS = f"list_filter(regexp_extract_all(text, {_T}), lambda t: regexp_full_match(t, '[A-Z]{{2,}}'))"
query(_terms_sql(f"list_concat({_ACRONYMS}, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+\\.[\\p{{L}}\\p{{N}}_]+'))"), "technical_terms")(_terms(text.technical_terms))
query(_terms_sql(f"list_concat(list_transform({_ACRONYMS}, lambda t: lower(t)), list_filter(regexp_extract_all(lower(text), {_T}), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t)))"), "keyword_extract")(_terms(text.keywords))
query(_terms_sql(f"list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda t: trim(t, '.,!?;:()[]{{}}\"''-')), lambda t: length(t) > 2 AND NOT list_contains({_FALLBACK}, t))"), "fallback_tokens")(_terms(text.fallback_tokens))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), ' ')) AS digest, CAST(length(trim(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), ' ')) AS INTEGER) AS n FROM documents")
def ascii_clean(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.ascii_only(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").alias("n"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN trim(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) = '' THEN 'no_ascii' ELSE 'ok' END AS status, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short FROM documents")
def description_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.description_status(F.col("text")).alias("status"), text.short_error(F.col("text")).alias("short"))


@query("SELECT p_partkey, CASE lower(x) WHEN 'http' THEN 'httpRequest' WHEN 'function' THEN 'code' WHEN 'loop' THEN 'splitInBatches' ELSE lower(x) END AS type FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'Function' WHEN 2 THEN 'loop' ELSE p_brand END AS x FROM part)")
def node_type_normalize(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.concat(F.lit("pack.base."), F.when(k == 0, "http").when(k == 1, "Function").when(k == 2, "loop").otherwise(F.col("p_brand")))
    return table(spark, sf, "part").select("p_partkey", text.canonical_type(raw).alias("type"))


@query("SELECT DISTINCT event_type, 'On ' || upper(left(event_type, 1)) || substr(event_type, 2) || ' Done' AS name FROM events")
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("base.on"), F.initcap("event_type"), F.lit("Done"))
    return table(spark, sf, "events").select("event_type", text.display_name(raw).alias("name")).distinct()


# --- mapping -----------------------------------------------------------------------------------------------

@query(f"WITH {views.COUNTED}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY freq DESC, type) AS k FROM counted) SELECT name, type, freq FROM r WHERE k = 1")
def name_type_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.best_type(mapping.counted(views.mapping_pairs(spark, sf)))


@query(f"WITH {views.COUNTED}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY freq DESC, name) AS k FROM counted) SELECT type, name, freq FROM r WHERE k = 1")
def most_common_name(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.most_common_name(mapping.counted(views.mapping_pairs(spark, sf)))


@query(f"WITH {views.COUNTED}, n AS (SELECT name AS value, CAST(sum(freq) AS BIGINT) AS freq FROM counted GROUP BY 1), t AS (SELECT type AS value, CAST(sum(freq) AS BIGINT) AS freq FROM counted GROUP BY 1) SELECT * FROM (SELECT 'name' AS kind, CAST(row_number() OVER (ORDER BY freq DESC, value) AS INTEGER) AS rank, value, freq FROM n UNION ALL SELECT 'type', CAST(row_number() OVER (ORDER BY freq DESC, value) AS INTEGER), value, freq FROM t) WHERE rank <= 20")
def mapping_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.statistics(mapping.counted(views.mapping_pairs(spark, sf)))


@query(f"WITH {views.COUNTED}, o AS (SELECT name, type, freq, 0 AS new FROM counted WHERE type < 'M' UNION ALL SELECT name, type, freq, 1 FROM counted WHERE type >= 'M'), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY freq DESC, new, type) AS k FROM o) SELECT name, type, freq FROM r WHERE k = 1")
def mapping_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = mapping.counted(views.mapping_pairs(spark, sf))
    return mapping.upsert(c.where("type < 'M'"), c.where("type >= 'M'"))


@query("WITH r AS (SELECT user_id AS chain_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT chain_id, string_agg(CASE event_type WHEN 'click' THEN 'input' WHEN 'view' THEN 'input' ELSE event_type END, '>' ORDER BY rn) AS path FROM r GROUP BY chain_id")
def chain_to_types(spark: SparkSession, sf: str) -> DataFrame:
    lookup = spark.createDataFrame([("click", "input"), ("view", "input")], "old string, new string")
    return mapping.chain_mapped(views.chains(spark, sf), lookup).select("chain_id", F.array_join("path", ">").alias("path"))


@query(f"WITH {views.TRIPLES} SELECT head, tail, count(*) AS n FROM (SELECT CASE head WHEN 'click' THEN 'input' WHEN 'view' THEN 'input' WHEN 'purchase' THEN 'deal' END AS head, CASE tail WHEN 'click' THEN 'input' WHEN 'view' THEN 'input' WHEN 'purchase' THEN 'deal' END AS tail FROM triples) WHERE head IS NOT NULL AND tail IS NOT NULL GROUP BY ALL")
def typed_triples(spark: SparkSession, sf: str) -> DataFrame:
    types = spark.createDataFrame([("click", "input"), ("view", "input"), ("purchase", "deal"), ("error", "")], "name string, type string")
    return mapping.typed_triples(views.triples(spark, sf), types).groupBy("head", "tail").agg(F.count(F.lit(1)).alias("n"))


# --- JSON and parameters -----------------------------------------------------------------------------------

@query("SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'a.b', event_type FROM events")
def json_flatten_params(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    nested = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct(F.col("event_type").alias("b"), F.array(F.lit(1)).alias("dropped")).alias("a")))
    return variants.flattened(e.select("event_id", F.parse_json(nested).alias("v")), ["event_id"], "v")


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    e, m = table(spark, sf, "events"), F.col("event_id") % 4
    raw = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" done"))).otherwise(F.lit("no json {"))
    return e.select("event_id", F.try_variant_get(jsonx.repaired(raw), "$.k", "int").alias("k"))


@query(f"""WITH {views.SIDES}, a AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM g), b AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM m)
SELECT user_id AS template_id, count(*) AS pairs, round(avg(CASE WHEN a.k = b.k THEN 1.0 ELSE 0.0 END), 6) AS parameter_accuracy FROM a JOIN b USING (user_id, event_type, rn) GROUP BY 1""")
def param_compare(spark: SparkSession, sf: str) -> DataFrame:
    g, m = _sides(spark, sf)
    pairs, keys = matching.match_nodes(g, m), ["template_id", "type", "rn"]
    given = lambda s: pairs.select(*keys, F.explode(F.from_json(f"{s}_props", "map<string,string>")).alias("key", "value"))
    c = params.compare(pairs, given("g"), given("m"), keys)
    return _rounded(c.groupBy("template_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg("match_ratio").alias("parameter_accuracy")), ["parameter_accuracy"])


def _letters(texts: DataFrame) -> DataFrame:
    """text, embedding: how often each letter from a to z stands in a text. An embedding that SQL can express."""
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
    return texts.withColumn("embedding", F.array(*[count(chr(i)) for i in range(97, 123)]))


_EMBED = "list_transform(range(97, 123), lambda i: CAST(length({t}) - length(replace({t}, chr(CAST(i AS INTEGER)), '')) AS DOUBLE))"


@query(f"""WITH g AS (SELECT p_brand AS brand, split_part(p_name, ' ', 1) AS tk, min(lower(p_type)) AS tv FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), m AS (SELECT p_brand AS brand, split_part(p_name, ' ', 1) AS mk, min(lower(p_type)) AS mv FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL),
x AS (SELECT brand, tk, mk, CASE WHEN tk = mk THEN 1.0 ELSE list_cosine_similarity({_EMBED.format(t="tk")}, {_EMBED.format(t="mk")}) END AS ks, CASE WHEN tv = mv THEN 1.0 ELSE list_cosine_similarity({_EMBED.format(t="tv")}, {_EMBED.format(t="mv")}) END AS s FROM g JOIN m USING (brand)),
b AS (SELECT brand, tk FROM x WHERE ks >= 0.7 AND s > 0 GROUP BY ALL HAVING max(s) >= 0.8), n AS (SELECT brand, count(*) AS n FROM b GROUP BY brand), t AS (SELECT brand, count(*) AS t FROM g GROUP BY brand), u AS (SELECT brand, count(*) AS u FROM m GROUP BY brand), k AS (SELECT DISTINCT p_brand AS brand FROM part)
SELECT brand, CAST(coalesce(t, 0) AS INTEGER) AS n_truth, CAST(coalesce(u, 0) AS INTEGER) AS n_made, CAST(coalesce(n, 0) AS INTEGER) AS n_matched, round(CASE WHEN coalesce(t, 0) = 0 THEN CASE WHEN coalesce(u, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(n, 0) / CAST(t AS DOUBLE) END, 6) AS match_ratio
FROM k LEFT JOIN t USING (brand) LEFT JOIN u USING (brand) LEFT JOIN n USING (brand)""")
def param_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of the even parts of a brand against those of the odd ones, by embedded keys and values."""
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "brand")
    side = lambda odd: p.where(F.col("p_partkey") % 2 == odd).groupBy("brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key")).agg(F.min(F.lower("p_type")).alias("value"))
    c = params.compare(p.select("brand").distinct(), side(0), side(1), ["brand"], _letters)
    return _rounded(c.select("brand", "n_truth", "n_made", F.size("matched").alias("n_matched"), "match_ratio"), ["match_ratio"])


@query("WITH w AS (SELECT DISTINCT 'node' AS node, split_part(p_name, ' ', 1) AS param FROM part), g AS (SELECT row_number() OVER (ORDER BY p_name) AS pos, p_name AS key FROM (SELECT DISTINCT p_name FROM part)) SELECT node, param, min_by(key, pos) AS value FROM w JOIN g ON contains(key, param) OR contains(param, key) GROUP BY ALL")
def required_params(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_name").distinct()
    need = names.select(F.lit("node").alias("node"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("param")).distinct()
    given = ordering.positions(names, ["p_name"], "pos").select("pos", F.col("p_name").alias("key"), F.col("p_name").alias("value"))
    return params.required_matches(need, given)


@query()
def fuzzy_param_match(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: the matching-blocks ratio isn't in SQL."""
    names = table(spark, sf, "part").select("p_name").distinct()
    wanted = names.select(F.regexp_replace("p_name", " ", "_").alias("param"))
    return _rounded(params.fuzzy_matches(wanted, ordering.positions(names, ["p_name"], "pos").select("pos", F.col("p_name").alias("key"))), ["score"])


@query("WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS keyword FROM part), o AS (SELECT DISTINCT p_name AS node FROM part), r AS (SELECT keyword, node, row_number() OVER (PARTITION BY keyword ORDER BY node) AS rank FROM k JOIN o ON contains(node, keyword)) SELECT keyword, node, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def ontology_scan(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_name").distinct()
    return params.ontology_scan(names.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("keyword")).distinct(), names.select(F.col("p_name").alias("node"), F.lit("").alias("attrs")))


# --- reports -----------------------------------------------------------------------------------------------

@query(f"WITH {NODE_SQL}, e AS (SELECT min(f) AS lo, max(f) AS hi FROM node) SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(30, 1 + floor((f - lo) / (hi - lo) * 30)) END AS INTEGER) AS bin, count(*) AS n FROM node, e GROUP BY 1")
def histogram30(spark: SparkSession, sf: str) -> DataFrame:
    return report.histogram(_node_metrics(spark, sf), "node_f1")


@query(f"WITH {views.USAGE}, c AS (SELECT conv_id, prompt_tokens + completion_tokens AS tokens FROM u) SELECT conv_id, tokens, CAST(row_number() OVER (ORDER BY tokens, conv_id) AS BIGINT) AS position, CAST(sum(tokens) OVER (ORDER BY tokens, conv_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c")
def cumulative_cost(spark: SparkSession, sf: str) -> DataFrame:
    u = views.usage(spark, sf).withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return report.cumulative(u, "tokens", "conv_id").withColumn("position", F.col("position").cast("long"))


_SIX = {"node_precision": "node.p", "node_recall": "node.r", "node_f1": "node.f", "edge_precision": "coalesce(edge.p, 0)", "edge_recall": "coalesce(edge.r, 0)", "edge_f1": "coalesce(edge.f, 0)"}
_ALL_SQL = f"{NODE_SQL}, {EDGE_SQL}, six AS (SELECT node.template_id, {', '.join(f'{v} AS {k}' for k, v in _SIX.items())} FROM node LEFT JOIN edge USING (template_id))"


def _all_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _node_metrics(spark, sf).join(_edge_metrics(spark, sf), "template_id", "left").select("template_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _SIX])


@query(f"WITH {_ALL_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median FROM six" for c in _SIX))
def metric_overview(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(report.overview(_all_metrics(spark, sf), list(_SIX)), ["mean", "median"])


@query(f"WITH {_ALL_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM six" for i, a in enumerate(_SIX) for b in list(_SIX)[i + 1 :]))
def metric_correlation_all(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(report.correlations(_all_metrics(spark, sf), list(_SIX)), ["corr"])


@query(f"""WITH {NODE_SQL}, ends AS (SELECT min(f) AS lo, max(f) AS hi, count(f) AS n, stddev_samp(f) AS sd FROM node),
bins AS (SELECT least(floor((f - lo) / ((hi - lo) / 1024)), 1023) AS bin, count(*) AS c FROM node, ends GROUP BY 1),
grid AS (SELECT point, lo + (hi - lo) * point / 99 AS x, lo + (bin + 0.5) * ((hi - lo) / 1024) AS y, c, n, sd * pow(n, -0.2) AS h FROM bins, ends, unnest(range(0, 100)) AS t(point))
SELECT CAST(point AS INTEGER) AS point, round(min(x), 6) AS x, round(sum(c * exp(-0.5 * (x - y) * (x - y) / (h * h)) / (n * h * 2.5066282746310002)), 6) AS density FROM grid GROUP BY point""")
def metric_density(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(report.density(_node_metrics(spark, sf), "node_f1"), ["x", "density"]).select("point", "x", "density")


@query(f"WITH {NODE_SQL}, {views.USAGE} SELECT conv_id, prompt_tokens, completion_tokens, round(prompt_tokens / 1e6 * 2.5 + completion_tokens / 1e6 * 10.0, 9) AS total_cost, round(f, 6) AS node_f1 FROM u JOIN node ON conv_id = template_id")
def cost_versus_f1(spark: SparkSession, sf: str) -> DataFrame:
    """The points of the token scatter and of cost against F1."""
    joined = metrics.costs(views.usage(spark, sf)).join(_node_metrics(spark, sf), F.col("conv_id") == F.col("template_id"))
    return _rounded(_rounded(joined, ["total_cost"], 9), ["node_f1"]).select("conv_id", "prompt_tokens", "completion_tokens", "total_cost", "node_f1")


@query(f"WITH {NODE_SQL} SELECT 'node_precision' AS a, 'node_recall' AS b, round(corr(p, r), 6) AS corr FROM node UNION ALL SELECT 'node_precision', 'node_f1', round(corr(p, f), 6) FROM node UNION ALL SELECT 'node_recall', 'node_f1', round(corr(r, f), 6) FROM node")
def metric_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(report.correlations(_node_metrics(spark, sf), ["node_precision", "node_recall", "node_f1"]), ["corr"])


@query(f"WITH {NODE_SQL} SELECT template_id, round(p, 6) AS node_precision, round(r, 6) AS node_recall, round(f, 6) AS node_f1 FROM node ORDER BY template_id LIMIT 50")
def metric_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    c = ["node_precision", "node_recall", "node_f1"]
    return _rounded(report.heatmap(_node_metrics(spark, sf), "template_id", c), c)


@query("SELECT conv_id, a AS from_name, b AS to_name, count(*) AS n FROM (SELECT conv_id, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role AS b FROM conversations) WHERE a IS NOT NULL GROUP BY ALL")
def steps_to_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = normalize.step_edges(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return e.groupBy("conv_id", "from_name", "to_name").agg(F.count(F.lit(1)).alias("n"))


_CAP = "upper(left({t}, 1)) || substr({t}, 2)"


@query(f"""WITH n AS (SELECT user_id AS chain_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
e AS (SELECT chain_id, t AS s, lead(t) OVER (PARTITION BY chain_id ORDER BY i) AS d, i FROM n),
nodes AS (SELECT chain_id, string_agg('{{"id":"' || sha256('chain ' || chain_id || '|' || i || '|' || t) || '","name":"' || {_CAP.format(t="t")} || '","type":"' || t || '","typeVersion":1,"position":[' || (i * 300 + 250) || ',300],"parameters":{{}}}}', ',' ORDER BY i) AS j FROM n GROUP BY chain_id),
src AS (SELECT chain_id, s, min(i) AS i, string_agg('{{"node":"' || {_CAP.format(t="d")} || '","type":"main","index":0}}', ',' ORDER BY i) AS j FROM e WHERE d IS NOT NULL GROUP BY chain_id, s),
conn AS (SELECT chain_id, string_agg('"' || {_CAP.format(t="s")} || '":{{"main":[[' || j || ']]}}', ',' ORDER BY i) AS j FROM src GROUP BY chain_id)
SELECT chain_id, '{{"name":"chain ' || chain_id || '","nodes":[' || nodes.j || '],"connections":{{' || coalesce(conn.j, '') || '}},"active":false,"settings":{{}},"pinData":{{}}}}' AS document FROM nodes LEFT JOIN conn USING (chain_id)""")
def workflow_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON documents with hashed ids."""
    c = views.chains(spark, sf).withColumn("workflow_name", F.concat(F.lit("chain "), F.col("chain_id")))
    return report.workflow_json(c).select("chain_id", "document")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    return pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 20")
def limit_templates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(20)


@query()
def recommend(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: the whole recommendation pipeline, deterministic."""
    tree = taxonomy.search_leaves(_tree(spark, sf))
    # event types stand for node types: every leaf maps two of them
    types = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    n = F.pmod(F.xxhash64("path_str"), F.lit(5)).cast("int")
    leaves = tree.withColumn("mapped_nodes", F.array(F.concat(F.lit("webhook."), F.get(types, n)), F.concat(F.lit("code."), F.get(types, F.pmod(n + 1, F.lit(5)))), F.lit("noOp")))
    t = views.triples(spark, sf).select("head", "tail").distinct()
    edges = t.select(F.concat(F.lit("webhook."), "head").alias("head"), F.concat(F.lit("code."), "tail").alias("tail")).union(t.select(F.concat(F.lit("code."), "head"), F.lit("noOp"))).distinct()
    m = views.matrix(spark, sf).select(F.concat(F.lit("webhook."), "src").alias("src"), F.concat(F.lit("code."), "dst").alias("dst"), "score")
    need = spark.createDataFrame([("noOp", "done_message"), ("noOp", "recipient_email")], "node string, param string")
    text = "ECONOMY Brand#1 red widget automation, done_message='all done', then tell someone@example.org"
    out = pipelines.recommend(1, text, leaves, edges, m, need, intent=providers.fitted_intent(leaves))
    return out.select("rank", F.array_join("path", ">").alias("path"), F.round("chain_score", 6).alias("chain_score"), "document")
