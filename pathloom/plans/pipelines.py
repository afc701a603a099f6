"""The three pipelines: evaluate, generate, recommend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vector import cosine, use_case_score
from pathloom.operators import chains, graph, leafsearch, matching, metrics, normalize, params, report, search
from pathloom.operators.variants import flattened
from pathloom.sources.readers import pending

from .providers import embed_distinct, generate, hashed_embedding, offline_intent

# Node types of a workflow that nothing was found for.
MINIMAL = ["manualTrigger", "set", "noOp"]


def evaluate(templates: DataFrame, records: DataFrame, embed: Callable | None = hashed_embedding) -> DataFrame:
    """A row per template that has a record: metrics, or the record's error.

    Parameters are compared by the similarity of their embedded keys and values; without ``embed`` by equality.
    """
    t = templates.select("template_id", F.col("workflow.name").alias("template_name"))
    r = records.select("template_id", "error", F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"))
    rows = t.join(r, "template_id")
    fine = rows.where("error is null").select("template_id")
    g = normalize.ground_truth_nodes(templates).join(fine, "template_id", "left_semi")
    m = normalize.generated_nodes(records).join(fine, "template_id", "left_semi")
    pairs = matching.match_nodes(g, m)
    nodes = metrics.node_metrics(g, m)
    edges = metrics.edge_metrics(matching.typed_edges(normalize.ground_truth_edges(templates), g), matching.typed_edges(normalize.generated_edges(records), m))
    keys = ["template_id", "type", "rn"]
    given = lambda side: flattened(pairs.select(*keys, F.col(f"{side}_parameters").alias("p")), keys, "p")
    vectors = None if embed is None else lambda texts: embed_distinct(texts, "text", embed)
    compared = params.compare(pairs, given("g"), given("m"), keys, vectors)
    accuracy = params.parameter_accuracy(compared, "template_id")
    out = metrics.costs(rows.join(nodes, "template_id", "left").join(edges, "template_id", "left").join(accuracy, "template_id", "left"))
    scores = ["node_precision", "node_recall", "node_f1", "edge_precision", "edge_recall", "edge_f1", "parameter_accuracy"]
    return out.withColumns({c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0.0))) for c in scores}).withColumn("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))


def summarise(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary statistics and cost report of ``evaluate``."""
    return metrics.summary(results, ["node_f1", "edge_f1", "parameter_accuracy"], "error"), metrics.cost_report(results.where("error is null"))


def generate_missing(templates: DataFrame, done: DataFrame | None, call: Callable[[str], tuple[str, int, int]], limit: int | None = None, **settings) -> DataFrame:
    """Records of the templates that have none yet (resume), first ``limit`` by file."""
    todo = templates if limit is None else templates.orderBy("file").limit(limit)
    return generate(todo if done is None else pending(todo, done), call, **settings)


def score_leaves(requests: DataFrame, leaves: DataFrame, embed=hashed_embedding, k: int = 5) -> DataFrame:
    """request_id, rank, path_str, description, mapped_nodes, reward: the k best of all leaves for each request."""
    q = embed_distinct(requests, "goal_description", embed).withColumnsRenamed({"text": "goal_description", "embedding": "q"})
    d = embed_distinct(leaves, "combined_text", embed).withColumnsRenamed({"text": "combined_text", "embedding": "d"})
    return leafsearch.best_leaves(requests.join(q, "goal_description"), leaves.join(d, "combined_text"), k)


def case_scores(leaves: DataFrame, goal: DataFrame, embed=hashed_embedding) -> DataFrame:
    """path_str, case_score: how well a leaf's use cases match a goal (one row, q)."""
    cases = leaves.select("path_str", F.explode("example_use_cases").alias("text")).distinct()
    scored = cases.join(embed_distinct(cases, "text", embed), "text").crossJoin(F.broadcast(goal.select("q")))  # one row
    of = scored.groupBy("path_str").agg(F.collect_list(cosine(F.col("q"), F.col("embedding"))).alias("s"))  # a leaf's few use cases
    return of.select("path_str", use_case_score(F.col("s")).alias("case_score"))


def find_nodes(asked: DataFrame, leaves: DataFrame, ontology: DataFrame | None = None, embed=hashed_embedding, k: int = 5) -> DataFrame:
    """node: the node types that a request (one row of ``offline_intent``) is answered with.

    Those of the best leaves, completed by asked categories that no leaf covers; without any, those of the leaves
    that hold its keywords or match by use case; without these, the first ``ontology`` node types (node, attrs) that
    contain a keyword; at last a minimal workflow's, as far as the ontology has them.
    """
    one = asked.select("keywords", "function_categories").first()
    hits = graph.cut(score_leaves(asked, leaves, embed, k))
    if not hits.isEmpty():
        numbered = leaves.withColumn("pos", F.col("path_str"))
        return search.cover_categories(hits, numbered, one.function_categories, k).select(F.explode("mapped_nodes").alias("node")).distinct()
    goal = embed_distinct(asked, "goal_description", embed).select(F.col("embedding").alias("q"))
    known = leaves.join(case_scores(leaves, goal, embed), "path_str", "left") if "example_use_cases" in leaves.columns else leaves.withColumn("case_score", F.lit(0.0))
    words = [w for w in one.keywords if w.strip()]
    text = F.concat_ws(" ", "path_str", "description", F.array_join("mapped_nodes", " "))
    found = search.keyword_scan(known, words, text, F.coalesce("case_score", F.lit(0.0))).orderBy(F.desc("reward"), F.desc(F.size("keyword_matches")), "path_str").limit(k)
    nodes = graph.cut(found.select(F.explode("mapped_nodes").alias("node")).distinct())
    if not nodes.isEmpty() or ontology is None:
        return nodes
    near = params.ontology_scan(asked.select(F.explode("keywords").alias("keyword")).where("trim(keyword) <> ''"), ontology)
    nodes = graph.cut(near.orderBy("keyword", "rank").select("node").limit(k).distinct())
    return nodes if not nodes.isEmpty() else ontology.where(F.element_at(F.split("node", r"\."), -1).isin(MINIMAL)).select("node")


def recommend(request_id: int, text: str, leaves: DataFrame, edges: DataFrame, matrix: DataFrame, required: DataFrame, given: DataFrame | None = None, name: str = "Recommended workflow", k: int = 5, ontology: DataFrame | None = None, intent: Callable[[DataFrame], DataFrame] = offline_intent, embed=hashed_embedding) -> DataFrame:
    """Ranked candidate workflows for one request: rank, path, score, coverage, document.

    Leaves are searched, their nodes composed to chains, the chains ranked by the transition matrix, required
    parameters filled from the request's own (by exact name, by containment, by likeness), and the documents written.
    ``required`` is (node, param), ``given`` (pos, key, value), ``ontology`` (node, attrs).
    """
    spark = leaves.sparkSession
    asked = graph.cut(intent(spark.createDataFrame([(request_id, text)], "request_id int, text string")))
    nodes = find_nodes(asked, leaves, ontology, embed, k)
    found = graph.cut(graph.compose(edges, nodes))
    found = found.withColumn("chain_id", F.concat(F.format_string("%09.3f|", 1e4 - F.col("score")), F.array_join("path", ">")))
    ranked = graph.cut(chains.rank_candidates(found, matrix).limit(k))
    if given is None:
        given = asked.select(F.posexplode(F.map_entries("parameters")).alias("pos", "e")).select("pos", "e.key", "e.value")
    filled = params.fill(ranked.select(F.explode("path").alias("node")), required, given, strict=True)
    per_node = filled.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "value")))).alias("p"))
    all_params = per_node.agg(F.map_from_entries(F.collect_list(F.struct("node", "p"))).alias("parameters"))
    docs = report.workflow_json(ranked.crossJoin(all_params).withColumn("workflow_name", F.lit(name)), parameters="parameters")
    return graph.numbered(docs.select("chain_id", "path", "chain_score", "coverage", "document"), [], [F.desc("chain_score"), "chain_id"])
