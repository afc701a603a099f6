import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.operators import chains, graph, lineage, mapping, ordering, report, search, taxonomy
from pathloom.plans.queries import QUERIES
from pathloom.sources import readers


def edges(spark, rows):
    return spark.createDataFrame([(a, b, str(i), i) for i, (a, b) in enumerate(rows)], "head string, tail string, relation string, pos int")


def names(df):
    return {r.node for r in df.collect()}


def test_digraph_and_statistics(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "b"), ("c", "d")])
    d = graph.digraph(e, "pos")
    assert {(r.head, r.tail, r.relation) for r in d.collect()} == {("a", "b", "1"), ("b", "b", "2"), ("c", "d", "3")}
    s = graph.statistics(e).first()
    assert (s.n_nodes, s.n_edges, s.n_components, s.connected, s.density, s.average_degree) == (4, 3, 2, False, 0.25, 1.5)
    z = graph.statistics(edges(spark, []).limit(0)).first()
    assert (z.n_nodes, z.n_edges, z.density, z.average_degree) == (0, 0, 0.0, 0.0)


def test_components_of_a_long_chain(spark):
    rows = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y")]
    c = {r.node: r.component for r in graph.components(edges(spark, rows)).collect()}
    assert c["060"] == "000" and c["y"] == "x" and len(set(c.values())) == 2


def test_reach_levels_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("x", "a")])
    seed = spark.createDataFrame([("a",)], "node string")
    assert names(graph.reachable(e, seed)) == {"a", "b", "c", "d"}
    assert names(graph.reachable(e, seed, backward=True)) == {"a", "x"}
    assert {tuple(r.path) for r in graph.simple_paths(e, "a", "d").collect()} == {("a", "d"), ("a", "b", "c", "d")}
    assert graph.simple_paths(e, "a", "d", 2).count() == 1
    assert graph.topological_order(e) is None
    dag = e.where("relation <> '2'")
    assert {(r.node, r.level) for r in graph.topological_order(dag).collect()} == {("x", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)}
    assert graph.longest_path(e, graph.nodes_of(e)).first().path == ["x", "a", "b", "c", "d"]


def test_longest_path_has_no_cap(spark):
    e = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(11)])
    assert graph.longest_path(e, graph.nodes_of(e)).first().path == [f"n{i:02}" for i in range(12)]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), max_size=30), st.sets(st.sampled_from("bcdef"), max_size=4), st.integers(1, 4), st.integers(1, 6))
def test_best_paths_are_the_best_of_all(edges_, required, k, most):
    every, stack = [], [["a"]]
    while stack:
        path = stack.pop()
        if path[-1] == "g":
            every.append(path)
        elif len(path) <= most:
            stack += [[*path, y] for x, y in edges_ if x == path[-1] and y not in path]
    want = sorted((-round(len(required & set(p)) * 2.0 - len(p) * 0.1, 6), len(p), p) for p in every)[:k]
    assert graph.best_paths(edges_, "a", "g", required, k, most) == [(-s, p) for s, _, p in want]


def test_dense_module(spark):
    """A complete module of 40 nodes: more paths than can be listed, the best are found all the same."""
    n = ["aTrigger", *(f"n{i:02}" for i in range(38)), "noOp"]
    e = edges(spark, [(a, b) for a in n for b in n if a != b and a != "noOp"])
    out = graph.compose(e, graph.nodes_of(e)).orderBy(F.desc("score"), "length", "path").collect()
    assert [r.path for r in out][:2] == [["aTrigger", "noOp"], ["aTrigger", "n00", "noOp"]] and len(out) == 5
    e = edges(spark, [(a, b) for a in n[:22] for b in n[:22] if a != b])
    assert graph.simple_paths(e, "aTrigger", "n05", 4).count() == 1 + 20 + 20 * 19 + 20 * 19 * 18


def path_of(spark, rows, core=None):
    e = edges(spark, rows)
    nodes = graph.nodes_of(e)
    return graph.find_path(e, nodes, nodes if core is None else spark.createDataFrame([(c,) for c in core], "node string")).first().path


def test_find_path(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)]
    assert path_of(spark, chain) == [f"n{i:02}" for i in range(13)]
    # above 15 nodes: sources, core nodes, sinks
    assert path_of(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(19)], ["n03", "n10"]) == ["n00", "n02", "n03", "n04", "n09", "n10", "n11", "n19"]
    # preferred ends, by the last part of the name
    assert path_of(spark, [("a", "x.webhook"), ("x.webhook", "b"), ("b", "y.noOp"), ("y.noOp", "z"), ("b", "z")]) == ["x.webhook", "b", "y.noOp"]
    # where all degrees are equal, two sources and two sinks are tried; cycles are broken, sources come first
    assert path_of(spark, [("a", "b"), ("b", "c"), ("c", "a")]) == ["b", "c", "a"]
    assert set(path_of(spark, [("a", "b"), ("b", "a"), ("webhook", "q"), ("p", "noOp")], ["a", "b"])) == {"webhook", "a", "b", "noOp"}
    # of equally long paths the one with more core nodes
    assert path_of(spark, [("s", "a"), ("a", "t"), ("s", "b"), ("b", "t")], ["b"]) == ["s", "b", "t"]
    one = spark.createDataFrame([("only",)], "node string")
    assert graph.find_path(edges(spark, [("x", "y")]), one, one).first().path == ["only"]
    assert graph.find_path(edges(spark, [("x", "y")]), one.limit(0), one).isEmpty()


def test_compose(spark):
    e = edges(spark, [("aTrigger", "code1"), ("code1", "noOp"), ("aTrigger", "noOp"), ("z", "noOp")])
    n = graph.nodes_of(e)
    out = graph.compose(e, n).orderBy(F.desc("score")).collect()
    assert [(r.path, r.coverage_count, r.score) for r in out] == [(["aTrigger", "code1", "noOp"], 1, pytest.approx(1.7)), (["aTrigger", "noOp"], 0, pytest.approx(-0.2))]
    assert graph.compose(e, n.where("node <> 'aTrigger'")).isEmpty()  # no trigger, no candidate


def test_expand(spark):
    e = edges(spark, [("p2", "n"), ("p1", "n"), ("n", "s")])
    assert names(graph.expand(e, spark.createDataFrame([("n",)], "node string"))) == {"n", "p1", "s"}


def matrix(spark):
    return spark.createDataFrame([("a", "b", 0.5), ("b", "c", 2.0), ("a", "c", -1.0)], "src string, dst string, score double")


def test_chains(spark):
    c = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, []), (4, ["a", "c"]), (5, ["a", "b", "?"])], "chain_id int, path array<string>")
    got = {s: {r.chain_id: r.chain_score for r in chains.score_chains(c, matrix(spark), s).collect()} for s in chains.STRATEGIES}
    assert got["sum"] == {1: 1.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5}
    assert got["product"][1] == 0.5 and got["average"][1] == 0.75 and got["min"][1] == 0.5 and abs(got["geometric_mean"][1] - 0.5**0.5) < 1e-12
    assert all(got["min"][k] <= got["geometric_mean"][k] + 1e-12 <= got["average"][k] + 2e-12 for k in got["min"])
    assert [r.chain_id for r in chains.rank_candidates(c, matrix(spark), "sum", 0.1).collect()] == [1, 5]
    with pytest.raises(ValueError):
        chains.score_chains(c, matrix(spark), "max")
    assert [(r.dst, r.score) for r in chains.top_transitions(matrix(spark), 2, "a").orderBy("rank").collect()] == [("b", 0.5), ("c", 0.0)]
    assert chains.top_transitions(matrix(spark), 2, "?").isEmpty()


def test_model_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "type_type_mapping.json").write_text(json.dumps({"node_types": ["a", "b"]}))
    with pytest.raises(FileNotFoundError):
        readers.read_model(spark, str(tmp_path))
    np.save(tmp_path / "P.npy", np.array([[1.0], [2.0]]))
    np.save(tmp_path / "Q.npy", np.array([[3.0], [0.5]]))
    assert {(r.src, r.dst): r.score for r in readers.read_model(spark, str(tmp_path)).collect()}[("b", "a")] == 6.0
    np.save(tmp_path / "prediction.npy", np.eye(2))
    assert {(r.src, r.dst): r.score for r in readers.read_model(spark, str(tmp_path)).collect()}[("b", "a")] == 0.0


def test_mapping(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name_to_type": {"N1": "t", "N2": "t"}, "type_to_names": {"zz": []}, "name_frequency": {"N2": 3}}))
    m = readers.read_mapping(spark, str(tmp_path / "m.json"))
    assert mapping.most_common_name(m).first().name == "N2"
    assert mapping.names_of_types(m).first().names == ["N1", "N2"]
    new = spark.createDataFrame([("N1", "u", 1), ("N2", "u", 4), ("N3", "v", 1)], "name string, type string, freq long")
    assert {(r.name, r.type) for r in mapping.upsert(m, new).collect()} == {("N1", "t"), ("N2", "u"), ("N3", "v")}
    (tmp_path / "t.json").write_text(json.dumps({"triples": [["N1", "r", "N2"], ["N1", "r", "??"]]}))
    t = readers.read_triples(spark, str(tmp_path / "t.json"))
    assert [(r.head, r.tail) for r in mapping.typed_triples(t, m).collect()] == [("t", "t")]
    assert [r.name for r in mapping.unknown_names(t, m).collect()] == ["??"]
    (tmp_path / "o.json").write_text(json.dumps({"t": {"required_params": ["a"]}, "u": {}}))
    o = readers.read_ontology(spark, str(tmp_path / "o.json"))
    assert {r.node: r.required_params for r in o.collect()} == {"t": ["a"], "u": []}
    s = mapping.knowledge_graph_statistics(t, o).first()
    assert (s.n_triples, s.n_relations, s.ontology_size) == (2, 1, 2)


TREE = {"Taxonomy": {"1 Top": {"Description": "T", "Old": {"Description": "d", "Nodes": ["x", "y"]}, "Empty": {"Nodes": []}, "Sub": {"New": {"name": "Shown", "description": "e", "mapped_nodes": ["x"], "example_use_cases": ["u"]}}}, "Bare": "text"}}


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TREE))
    t = taxonomy.flatten(readers.read_taxonomy(spark, str(tmp_path / "t.json")))
    got = {" / ".join(r.path): (r.is_leaf, r.name, r.mapped_nodes) for r in t.collect()}
    assert got == {"1 Top": (False, "1 Top", []), "Bare": (True, "Bare", []), "1 Top / Old": (True, "Old", ["x", "y"]), "1 Top / Empty": (True, "Empty", []), "1 Top / Sub": (False, "Sub", []), "1 Top / Sub / New": (True, "Shown", ["x"])}
    s = taxonomy.statistics(t).first()
    assert (s.n_nodes, s.n_leaves, s.n_mapped, s.n_types, s.max_depth) == (6, 4, 3, 2, 3)
    assert {r.type: r.categories for r in taxonomy.types_to_categories(t).collect()}["x"] == ["1 Top -> Old", "1 Top -> Sub -> New"]
    assert {r.category for r in taxonomy.top_categories(t).collect()} == {"Top", "Bare"}
    assert taxonomy.search_leaves(t).count() == 2
    assert taxonomy.top_categories(t.limit(0)).first().category == "Default"
    (tmp_path / "u.json").write_text('{"Other": {}}')
    with pytest.raises(ValueError):
        taxonomy.flatten(readers.read_taxonomy(spark, str(tmp_path / "u.json")))
    assert {r["name"] for r in search.deepest(t).collect()} == {"Shown"}


def test_search(spark):
    rows = [("1 A -> b", "send email", ["x.gmail"], 0.5, 0.4, 0.0, 0), ("1 A -> c", "", ["y"], 0.3, 0.3, 0.1, 1), ("2 B -> d", "", ["z"], 0.35, 0.9, 0.0, 2)]
    df = spark.createDataFrame(rows, "path_str string, description string, mapped_nodes array<string>, reward double, semantic_score double, keyword_score double, pos int")
    assert [r.path_str for r in search.top_leaves(df, "path_str").collect()] == ["1 A -> b", "1 A -> c"]  # 0.35 isn't above 0.35
    base = df.where("pos = 2")
    out = search.cover_categories(base, df, ["Email"]).collect()
    assert [(r.path_str, r.reward) for r in out] == [("1 A -> b", 0.4), ("2 B -> d", 0.35)]
    assert search.cover_categories(base, df, ["email"]).count() == 1  # the name must be exact
    assert {(r.category, r.category_rank) for r in search.per_category(df, k=1).collect()} == {("A", 1), ("B", 1)}
    hits = search.keyword_scan(df, ["GMAIL", "mail"], F.concat_ws(" ", "path_str", "description", F.array_join("mapped_nodes", " "))).collect()
    assert [(r.keyword_matches, r.reward) for r in hits] == [(["gmail", "mail"], 0.5)]
    assert df.select(search.category_reward(F.lit("Taxonomy -> 2.1 Campaign Automation"), F.array(F.lit("campaign automation"), F.lit("zz"))).alias("r")).first().r == 0.5


def test_documents_and_tables(spark):
    c = spark.createDataFrame([(1, "w", ["p.aTrigger", "q.setX", "p.aTrigger"]), (2, "w", [])], "id int, workflow_name string, path array<string>")
    docs = {r.id: r.document for r in report.workflow_json(c).collect()}
    d = json.loads(docs[1])
    assert docs[2] is None and [n["position"] for n in d["nodes"]] == [[250, 300], [550, 300], [850, 300]]
    assert d["nodes"][0]["name"] == "A Trigger" and d["connections"]["Set X"]["main"][0][0]["node"] == "A Trigger"
    v = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "k int, v double")
    got = [(r.position, r.running) for r in report.cumulative(v, "v", "k").orderBy("position").collect()]
    want, total = [], 0.0
    for i, x in enumerate(sorted(float(i % 7) for i in range(50)), 1):
        total += x
        want.append((i, total))
    assert got == want
    assert report.histogram(v, "v").agg(F.sum("n")).first()[0] == 50


def test_cosine_topk_asks_with_all_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    s = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    np.fill_diagonal(s, -2)
    got = {}
    for r in QUERIES["cosine_topk"](spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.similarity
    assert got.keys() == {r.vec_id for r in rows}
    for i, r in enumerate(rows):
        assert [got[r.vec_id][k] for k in range(1, 6)] == pytest.approx(np.sort(s[i])[::-1][:5].tolist(), abs=2e-5)


def test_nearest_in_blocks(spark):
    """Over several blocks, with ties: equal vectors come by id."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(20, 6)), 4, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in search.nearest(df, 3, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: [j for j in range(i // 4 * 4, i // 4 * 4 + 4) if j != i] for i in range(80)}


def test_pairs_above_in_blocks(spark):
    """One frequent group over several blocks, against brute force; equal and zero vectors among them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5))
    x[10:14], x[20] = x[9], 0
    group = [0 if i % 5 else 1 for i in range(90)]
    df = spark.createDataFrame([(i, g, v.tolist()) for i, (g, v) in enumerate(zip(group, x))], "vec_id long, label int, embedding array<double>")
    got = {(r.a, r.b): r.similarity for r in search.pairs_above(df, 0.5, "label", block=16).collect()}
    with np.errstate(invalid="ignore"):
        s = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = {(i, j): s[i, j] for i in range(90) for j in range(i + 1, 90) if group[i] == group[j] and s[i, j] >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_positions(spark):
    """Positions and running sums of a skewed column, ties told apart by a second one."""
    df = spark.createDataFrame([(i, 5 if i % 3 else i) for i in range(500)], "id int, v int")
    got = ordering.positions(df, [F.col("v"), F.col("id")], "p", "v", "s").orderBy("p").collect()
    rows, total = sorted(((5 if i % 3 else i), i) for i in range(500)), 0
    for at, (r, (v, i)) in enumerate(zip(got, rows), 1):
        total += v
        assert (r.id, r.v, r.p, r.s) == (i, v, at, total)
    assert ordering.positions(df.limit(0), [F.col("v")]).isEmpty()


def test_free_names():
    assert lineage.free_names(["A", "b_", "b"], "a", "b", "a", "c") == ["a_", "b__", "a__", "c"]


def test_report_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "x double, y double")
    o = {r.metric: (r["mean"], r["median"]) for r in report.overview(df, ["x", "y"]).collect()}
    assert o["x"] == pytest.approx((x.mean(), np.median(x))) and o["y"] == pytest.approx((-x.mean(), -np.median(x)))
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in report.density(df, "x").collect():
        want = np.exp(-0.5 * ((r.x - x) / h) ** 2).sum() / (len(x) * h * (2 * np.pi) ** 0.5)
        assert abs(r.density - want) < 2e-3
    assert report.density(df.where("x > 100"), "x").isEmpty()


def test_expand_categories(spark):
    rows = [("1 Mail -> a", ["x"], 0.9, 0.0), ("1 Mail -> b", ["x", "y"], 0.4, 0.5), ("1 Mail -> c", ["x"], 0.1, 1.0), ("1 Mail -> d", ["x"], 0.3, 0.0), ("2 Data -> e", ["z"], 0.9, 0.9)]
    leaves = spark.createDataFrame(rows, "path_str string, mapped_nodes array<string>, semantic_score double, case_score double")
    hits = leaves.where("path_str in ('1 Mail -> a', '2 Data -> e')").withColumn("reward", F.lit(0.6))
    got = {r.path_str: round(r.reward, 6) for r in search.expand_categories(hits, leaves, ["mail"]).collect()}
    assert got == {"1 Mail -> a": 0.6, "2 Data -> e": 0.6, "1 Mail -> b": 0.45, "1 Mail -> d": 0.25}
    assert search.expand_categories(hits, leaves, ["mail"], top=1).count() == 1
    assert search.expand_categories(hits, leaves, []).count() == 2


def test_high_reward_and_ancestors(spark):
    df = spark.createDataFrame([("a", 0.3, None), ("b", 0.1, ["k"]), ("c", 0.1, [])], "path_str string, reward double, keyword_matches array<string>")
    assert {r.path_str for r in search.high_reward(df).collect()} == {"a", "b"} and search.high_reward(df.where("path_str = 'c'")).count() == 1
    got = taxonomy.ancestors(spark.createDataFrame([(["r", "s"],)], "path array<string>")).orderBy("step").collect()
    assert [r.ancestor for r in got] == [["r"], ["r", "s"]]
