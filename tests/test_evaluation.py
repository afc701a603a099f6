import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.operators import matching, metrics, normalize, params, report
from pathloom.plans import pipelines, providers
from pathloom.sources import readers, writers


def nodes(spark, rows):
    return spark.createDataFrame([(t, i, str(i) if len(r) < 2 else r[1], str(i), r[0]) for t, rs in rows.items() for i, r in enumerate(rs)], "template_id string, pos int, id string, name string, type string")


def test_worked_examples(spark):
    """8 made, 28 true, 7 matched; 3 and 19 edges, 1 shared; a chain of three against one of four."""
    g, m = nodes(spark, {"t": [("a",)] * 7 + [("g",)] * 21}), nodes(spark, {"t": [("a",)] * 7 + [("m",)]})
    r = metrics.node_metrics(g, m).first()
    assert (r.tp, r.fp, r.fn) == (7, 1, 21) and (round(r.node_precision, 3), round(r.node_recall, 3), round(r.node_f1, 3)) == (0.875, 0.25, 0.389)
    e = lambda rows: spark.createDataFrame([("t", a, b) for a, b in rows], "template_id string, from_type string, to_type string")
    r = metrics.edge_metrics(e([("x", str(i)) for i in range(19)]), e([("x", "0"), ("y", "1"), ("y", "2")])).first()
    assert (round(r.edge_precision, 3), round(r.edge_recall, 3), round(r.edge_f1, 3)) == (0.333, 0.053, 0.091)
    r = metrics.edge_metrics(e([("a", "b"), ("b", "c"), ("c", "d")]), e([("a", "b"), ("b", "c")])).first()
    assert r.edge_precision == 1.0 and abs(r.edge_recall - 2 / 3) < 1e-12 and abs(r.edge_f1 - 0.8) < 1e-12
    c = metrics.cost_report(metrics.costs(spark.createDataFrame([(1096474, 977496)], "prompt_tokens long, completion_tokens long"))).first()
    assert abs(c.total_cost - 12.516145) < 1e-9


def test_blank_ids_count_together(spark):
    g, m = nodes(spark, {"t": [("a", ""), ("b", "")]}), nodes(spark, {"t": [("a", "x")]})
    r = metrics.node_metrics(g, m).first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), min_size=1, max_size=6))
def test_bag_arithmetic(spark, a, b):
    g, m = nodes(spark, {"t": [(x,) for x in a]}), nodes(spark, {"t": [(x,) for x in b]})
    r = metrics.node_metrics(g, m).first()
    tp = sum(min(a.count(x), b.count(x)) for x in "abc")
    assert (r.tp, r.fp, r.fn) == (tp, len(b) - tp, len(a) - tp) and 0 <= r.node_f1 <= 1 and r.tp + r.fn == len(a)


def test_empty_summary(spark):
    r = metrics.summary(spark.createDataFrame([], "x double"), ["x"]).first()
    assert r.n == 0 and r.x_mean == r.x_std == r.x_max == 0.0 and r.error


TEMPLATE = {
    "metadata": {"id": 1},
    "workflow": {"name": "W", "description": " Do it ", "workflow": {
        "nodes": [
            {"id": "1", "name": "A", "type": "p.webhook", "parameters": {"path": "x", "o": {"k": 1}}},
            {"id": "2", "name": "B", "type": "p.httpRequest", "parameters": {}},
            {"id": "3", "name": "S", "type": "p.stickyNote", "parameters": {}},
        ],
        "connections": {"A": {"main": [[{"node": "B", "type": "main", "index": 0}, {"node": "S", "type": "main", "index": 0}], None], "ai": [[{"node": "B"}]]}, "S": {"main": [[{"node": "A"}]]}},
    }},
}
RECORD = {
    "template_id": "zzz", "error": None, "generated_at": "2024-01-01T00:00:00", "usage": {"prompt_tokens": 1000, "completion_tokens": 500, "total_tokens": 1500},
    "llm_response": {"mode": "create_workflow", "workflowPlan": {"name": "W", "nodes": [
        {"id": "n1", "label": "Hook", "nodeType": "webhook", "params": {"path": "x", "o": {"k": 2}}},
        {"id": "n2", "label": "Http", "nodeType": "http"}, {"id": "n2", "label": "Http2", "nodeType": "http"},
    ], "connections": [{"from": "n1", "to": "n2"}, {"from": "n1", "to": "ghost"}]}},
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for sub in ("templates", "records"):
        (d / sub).mkdir()
    (d / "templates/template_1_x.json").write_text(json.dumps(TEMPLATE))
    (d / "templates/template_2_y.json").write_text(json.dumps({"id": 2, "workflow": {"workflow": {"nodes": [], "connections": {}}}}))
    (d / "templates/template_3_bad.json").write_text("{not json")
    (d / "templates/template_index.json").write_text('{"id": 99}')
    (d / "records/generated_1.json").write_text(json.dumps(RECORD))
    (d / "records/generated_2.json").write_text(json.dumps({"template_id": "2", "error": "boom"}))
    return str(d)


def test_readers(spark, files):
    t = readers.read_templates(spark, f"{files}/templates")
    assert {(r.template_id, r.description) for r in t.collect()} == {("1", "Do it"), ("2", "")}
    assert readers.template_by_id(t, "1").first().template_id == "1" and readers.template_by_id(t, "7").isEmpty()
    assert readers.read_templates(spark, f"{files}/templates", limit=1).count() == 1
    r = readers.read_generated(spark, f"{files}/records")
    assert {x.template_id for x in r.collect()} == {"1", "2"}
    assert {x.template_id for x in readers.pending(t, r.where("template_id = '1'")).collect()} == {"2"}


def test_normalise(spark, files):
    t = readers.read_templates(spark, f"{files}/templates")
    assert [(r.name, r.type) for r in normalize.ground_truth_nodes(t).orderBy("pos").collect()] == [("A", "webhook"), ("B", "httpRequest")]
    assert [(r.from_name, r.to_name, r.to_input) for r in normalize.ground_truth_edges(t).collect()] == [("A", "B", 0)]
    r = readers.read_generated(spark, f"{files}/records")
    assert [(x.name, x.type) for x in normalize.generated_nodes(r).orderBy("pos").collect()] == [("Hook", "webhook"), ("Http", "httpRequest"), ("Http2", "httpRequest")]
    assert {(x.from_name, x.to_name) for x in normalize.generated_edges(r).collect()} == {("Hook", "Http2"), ("Hook", "ghost")}


def test_steps_win(spark, tmp_path):
    plan = {"nodes": [{"id": "x", "nodeType": "a"}], "steps": [{"id": "s", "type": "p.Code"}, {"type": "loop"}]}
    (tmp_path / "generated_5.json").write_text(json.dumps({"llm_response": {"mode": "create_workflow", "workflowPlan": plan}}))
    (tmp_path / "generated_6.json").write_text(json.dumps({"llm_response": {"mode": "chat", "reply": "hi"}}))
    r = readers.read_generated(spark, str(tmp_path))
    assert [(x.template_id, x.id, x.type) for x in normalize.generated_nodes(r).orderBy("pos").collect()] == [("5", "s", "code"), ("5", "step_1", "splitInBatches")]
    assert [(x.from_name, x.to_name) for x in normalize.generated_edges(r).collect()] == [("s", "step_1")]


def test_evaluate_and_write(spark, files, tmp_path):
    res = pipelines.evaluate(readers.read_templates(spark, f"{files}/templates"), readers.read_generated(spark, f"{files}/records"), embed=None)
    rows = {r.template_id: r for r in res.collect()}
    one = rows["1"]
    assert (one.tp, one.fp, one.fn) == (2, 0, 0)  # ids: both "n2" count as matched
    assert one.edge_recall == 1.0 and one.parameter_accuracy == pytest.approx((0.5 + 1.0) / 2)
    assert one.total_cost == pytest.approx(1000 * 2.5e-6 + 500 * 1e-5)
    assert rows["2"].error == "boom" and rows["2"].node_f1 is None
    summary, costs = pipelines.summarise(res)
    assert summary.first().n_failed == 1 and costs.first().n == 1
    writers.write_results(res, summary, costs, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/results_csv")).count() == 1


def test_parameters(spark):
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    df = lambda rows: spark.createDataFrame(rows, "p int, key string, value string")
    out = {r.p: r for r in params.compare(pairs, df([(1, "a", "x"), (1, "b", "y")]), df([(1, "a", "x"), (1, "b", "z"), (3, "c", "1")]), ["p"]).collect()}
    assert (out[1].match_ratio, out[1].matched, out[1].missing, out[1].extra) == (0.5, ["a"], ["b"], ["b"])
    assert out[2].match_ratio == 1.0 and out[3].match_ratio == 0.0


def test_fill_and_validate(spark):
    need = spark.createDataFrame([("n", "channelName"), ("n", "token"), ("o", "x")], "node string, param string")
    given_ = spark.createDataFrame([(0, "channel_name", "c"), (1, "other", None)], "pos int, key string, value string")
    chain = spark.createDataFrame([("n",)], "node string")
    out = {r.param: r.value for r in params.fill(chain, need, given_, strict=True).collect()}
    assert out == {"channelName": "c", "token": "<NEEDS_VALUE: token>"}
    assert {r.param for r in params.fill(chain, need, given_).collect()} == {"channel_name", "other"}
    v = params.validate(chain, need, spark.createDataFrame([("n", "token", "t")], "node string, param string, value string")).first()
    assert not v.valid and v.missing == ["channelName"]
    m = params.required_matches(need, spark.createDataFrame([(0, "TOKEN_id", None), (1, "my token", "v")], "pos int, key string, value string"))
    assert [(r.param, r.value) for r in m.collect() if r.param == "token"] == [("token", "v")]


def test_generate_and_resume(spark):
    t = spark.createDataFrame([("1", "Make é it"), ("2", " "), ("3", "流程"), ("4", "fail")], "template_id string, description string")

    def call(prompt):
        if prompt == "fail":
            raise RuntimeError("e" * 300)
        return f"<{prompt}>", 1, 2

    out = {r.template_id: r for r in pipelines.generate_missing(t, t.where("template_id = '9'"), call, retries=2, wait=0.0).collect()}
    assert out["1"].llm_response == "<Make  it>" and out["1"].completion_tokens == 2 and out["1"].error is None
    assert out["2"].error == "empty description" and "ASCII" in out["3"].error and out["4"].error.endswith("...") and len(out["4"].error) == 203
    e = providers.embed_distinct(t, "description").collect()
    assert len(e) == 4 and len(e[0].embedding) == providers.DIMENSIONS


def test_stream_sees_files_once(spark, files, tmp_path):
    from pathloom.streaming.resume import process_new

    seen = []
    for _ in range(2):
        process_new(spark, f"{files}/records", str(tmp_path / "cp"), lambda df, i: seen.append(sorted(r.template_id for r in df.collect())))
    assert sum(seen, []) == ["1", "2"]  # the file name gives the id, as in a batch


def test_parameters_by_meaning(spark):
    """Similar keys and values match, the most similar value wins, and extra ones are told."""
    vectors = {"url": [1.0, 0.0], "link": [0.9, 0.1], "size": [0.0, 1.0], "http://a": [1.0, 0.2], "http://b": [1.0, 0.3], "7": [0.0, 1.0], "zz": [-1.0, 0.0]}
    table = spark.createDataFrame(list(vectors.items()), "text string, embedding array<double>")
    pairs = spark.createDataFrame([(1,), (2,)], "p int")
    df = lambda rows: spark.createDataFrame(rows, "p int, key string, value string")
    truth, made = df([(1, "url", "http://a"), (1, "size", "7"), (2, "url", "zz")]), df([(1, "link", "http://b"), (1, "url", "zz"), (2, "link", "http://a")])
    out = {r.p: r for r in params.compare(pairs, truth, made, ["p"], lambda texts: texts.join(table, "text")).collect()}
    assert (out[1].matched, out[1].missing, out[1].extra, out[1].match_ratio) == (["url"], ["size"], ["url"], 0.5)
    assert (out[2].matched, out[2].extra, out[2].match_ratio) == ([], ["link"], 0.0)
    exact = {r.p: r.match_ratio for r in params.compare(pairs, truth, truth, ["p"], lambda texts: texts.join(table, "text")).collect()}
    assert exact == {1: 1.0, 2: 1.0}


def test_evaluate_by_meaning(spark, files):
    t, r = readers.read_templates(spark, f"{files}/templates"), readers.read_generated(spark, f"{files}/records")
    by = {e is None: pipelines.evaluate(t, r, embed=e).where("template_id = '1'").first().parameter_accuracy for e in (None, providers.hashed_embedding)}
    assert by[False] >= by[True]


def test_containing(spark):
    words = ["a", "ab", "abc", "xabcx", "bcd", "", "abcd", "zz"]
    df = spark.createDataFrame([(w,) for w in words], "n string")
    got = sorted((r.n, r.h) for r in params.containing(df, "n", df.withColumnRenamed("n", "h"), "h").collect())
    assert got == sorted((n, h) for n in words for h in words if n in h)


LEAVES = [
    (["Mail", "Send"], "send an email to people", ["p.emailTrigger", "p.code", "p.noOp"], ["send a mail"]),
    (["Data", "Rows"], "rows of a database", ["p.webhook", "p.filter", "p.noOp"], ["read rows"]),
]


@pytest.fixture(scope="module")
def leaves(spark):
    df = spark.createDataFrame(LEAVES, "path array<string>, description string, mapped_nodes array<string>, example_use_cases array<string>")
    p = F.array_join("path", " -> ")
    return df.withColumns({"path_str": p, "combined_text": F.concat(p, F.lit(": "), F.col("description"))})


def asked(spark, text, categories=(), **more):
    out = providers.offline_intent(spark.createDataFrame([(1, text)], "request_id int, text string"))
    return out.withColumn("function_categories", F.array(*[F.lit(c) for c in categories]).cast("array<string>"))


def found(df):
    return {r.node for r in df.collect()}


def test_nodes_of_a_request(spark, leaves):
    """The flow: leaves, covered categories, keywords, ontology, minimal workflow."""
    onto = spark.createDataFrame([("q.slackPost", ""), ("q.manualTrigger", ""), ("q.set", "")], "node string, attrs string")
    mail, rows = set(LEAVES[0][2]), set(LEAVES[1][2])
    assert found(pipelines.find_nodes(asked(spark, "Mail -> Send: send an email to people"), leaves, k=1)) == mail
    both = pipelines.find_nodes(asked(spark, "Mail -> Send: send an email to people", ["Database"]), leaves.where("path_str like 'Mail%'").union(leaves.where("path_str like 'Data%'")))
    assert found(both) >= mail
    assert found(pipelines.find_nodes(asked(spark, "qqqq wwww database kkkk vvvv jjjj"), leaves, onto)) == rows
    assert found(pipelines.find_nodes(asked(spark, "jjjj slack vvvv"), leaves.drop("example_use_cases"), onto)) == {"q.slackPost"}
    assert found(pipelines.find_nodes(asked(spark, "jjjj vvvv"), leaves.drop("example_use_cases"), onto)) == {"q.manualTrigger", "q.set"}
    assert pipelines.find_nodes(asked(spark, "jjjj vvvv"), leaves.drop("example_use_cases")).isEmpty()


def test_recommend_fills_from_the_request(spark, leaves):
    edges = spark.createDataFrame([("p.emailTrigger", "p.code"), ("p.code", "p.noOp")], "head string, tail string")
    matrix = spark.createDataFrame([("p.emailTrigger", "p.code", 0.5)], "src string, dst string, score double")
    need = spark.createDataFrame([("p.code", "language"), ("p.code", "channel"), ("p.noOp", "other")], "node string, param string")
    intent = lambda df: providers.offline_intent(df).withColumn("parameters", F.create_map(F.lit("language"), F.lit("py"), F.lit("my_channel_name"), F.lit("c1")))
    out = pipelines.recommend(1, "Mail -> Send: send an email to people", leaves, edges, matrix, need, k=1, intent=intent).first()
    doc = json.loads(out.document)
    by = {n["type"]: n["parameters"] for n in doc["nodes"]}
    assert out.path == ["p.emailTrigger", "p.code", "p.noOp"] and by["p.code"] == {"channel": "c1", "language": "py"} and by["p.noOp"] == {"other": "<NEEDS_VALUE: other>"}


def test_summary_text(spark):
    results = spark.createDataFrame([("1", None, 0.5, 0.25, 1.0, 1000, 500)], "template_id string, error string, node_f1 double, edge_f1 double, parameter_accuracy double, prompt_tokens long, completion_tokens long")
    text = report.summary_text(*pipelines.summarise(metrics.costs(results))).first().text
    assert "Total Templates: 1\nSuccessful: 1\nFailed: 0" in text and "  Mean: 0.500" in text and "Total Tokens: 1,500" in text and "$0.01 USD" in text and "$0.0075 USD" in text
    empty = report.summary_text(*pipelines.summarise(metrics.costs(results.limit(0)))).first().text
    assert "Warning: no evaluated rows" in empty and "(no successful generations)" in empty


def test_files_and_counts(spark, files):
    assert readers.template_count(readers.read_templates(spark, f"{files}/templates")) == 2
    assert set(writers.output_paths("o")) == {"llm_workflows", "evaluation_results", "visualizations"}
