from pyspark.sql import functions as F

from pathloom.functions import jsonx, stats, text, vector
from pathloom.operators import variants


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_keywords_and_terms(spark):
    t = "使用OCR流程 use the API now été JSON.parse data.base pack-base.httpRequest"
    got = one(spark, text.keywords(F.col("t")), t=t)
    assert {"api", "use", "now", "été", "json", "使用", "流程"} <= set(got) and "the" not in got
    terms = one(spark, text.technical_terms(F.col("t")), t=t)
    assert terms == sorted({"API", "JSON", "JSON.parse", "data.base", "base.httpRequest"})


def test_fallback_tokens(spark):
    assert one(spark, text.fallback_tokens(F.col("t")), t='The "Slack" message, to (me)! an ok {x}') == ["message", "slack"]


def test_filtered_keywords(spark):
    words, cats = F.array(*map(F.lit, ["AI", "slack", "Email ", "x"])), F.array(F.lit("email"))
    assert one(spark, text.filtered_keywords(words, cats)) == ["slack"]
    only = F.array(F.lit("AI"))
    assert one(spark, text.filtered_keywords(only, cats)) == ["AI"]


def test_types_and_names(spark):
    for raw, kind in (("a.b.httpRequest", "httpRequest"), ("HTTP", "httpRequest"), ("x.function", "code"), ("Loop", "splitInBatches"), ("@p/q.openAi", "openai"), ("IF", "if")):
        assert one(spark, text.canonical_type(F.col("t")), t=raw) == kind
    assert one(spark, text.display_name(F.col("t")), t="base.httpRequestTool") == "Http Request Tool"
    assert one(spark, text.without_number(F.col("t")), t="12 Sales 3") == "Sales 3"
    assert one(spark, text.without_number(F.col("t")), t="1.2 Sales") == "1.2 Sales"


def test_descriptions(spark):
    f = lambda t: one(spark, text.description_status(F.lit(t)))
    assert [f("x"), f("  "), f("流程"), f(None)] == ["ok", "empty", "no_ascii", "empty"]
    assert one(spark, text.short_error(F.lit("e" * 201))) == "e" * 200 + "..."
    assert one(spark, text.prompt("a {{ description }} b {{ description }}", F.lit("x"))) == "a x b x"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, vector.cosine(a, b)) - 2**-0.5) < 1e-12
    assert one(spark, vector.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert abs(one(spark, vector.use_case_score(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.1)))) - (0.35 + 0.3 * 0.4)) < 1e-12
    assert one(spark, vector.use_case_score(F.array(F.lit(0.1)))) == 0.0


def test_json_repair(spark):
    f = lambda t, g=jsonx.repaired: one(spark, F.try_variant_get(g(F.col("t")), "$.mode", "string"), t=t)
    for t in ('{"mode":"chat"}', '```json\n{"mode":"chat"}\n```', 'Sure! {"mode":"chat"} done'):
        assert f(t) == "chat" and f(t, jsonx.repaired_unfenced_first) == "chat"
    assert f("broken {") is None
    valid = lambda t: one(spark, jsonx.valid_response(F.try_parse_json("t")), t=t)
    assert [valid('{"mode":"chat"}'), valid('{"mode":"create_workflow"}'), valid('{"mode":"create_workflow","workflowPlan":{}}'), valid("{}"), valid("x")] == [True, False, True, False, False]


def test_flatten(spark):
    doc = '{"a":1,"b":{"c":true,"d":{"e":"x","n":null}},"l":[1,2],"f":1.5}'
    df = spark.createDataFrame([(7, doc)], "id int, t string").withColumn("v", F.parse_json("t"))
    assert {(r.key, r.value) for r in variants.flattened(df, ["id"], "v").collect()} == {("a", "1"), ("b.c", "true"), ("b.d.e", "x"), ("f", "1.5")}


def test_guards(spark):
    assert one(spark, stats.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, stats.f1(F.lit(0.0), F.lit(0.0))) == 0.0
    assert [one(spark, stats.bucket(F.lit(float(x)), F.lit(0.0), F.lit(30.0))) for x in (0, 29.5, 30)] == [1, 30, 30]
    assert one(spark, stats.bucket(F.lit(2.0), F.lit(2.0), F.lit(2.0))) == 1


def test_flatten_deep_and_wide(spark):
    """Forty levels, and clashing key names in the documents."""
    doc = '{"_path": 1, "_value": "v", "pos": true, "key": {"value": 2}, "deep": ' + '{"d":' * 40 + "7" + "}" * 40 + "}"
    df = spark.createDataFrame([(1, doc), (2, "[1]"), (3, None), (4, "{}")], "id int, t string").withColumn("v", F.parse_json("t"))
    got = {(r.id, r.key, r.value) for r in variants.flattened(df, ["id"], "v").collect()}
    assert got == {(1, "_path", "1"), (1, "_value", "v"), (1, "pos", "true"), (1, "key.value", "2"), (1, "deep" + ".d" * 40, "7")}


def test_acronyms(spark):
    assert one(spark, text.acronyms(F.col("t")), t="API aPI APIs ÉAPI API_ A URL,JSON-API 9AB") == ["API", "URL", "JSON"]


def test_durations(spark):
    got = [one(spark, text.duration(F.lit(x))) for x in (0.0, 59.9, 60.0, 3599.0, 3600.0, 7385.0)]
    assert got == ["0s", "59s", "1m 0s", "59m 59s", "1h 0m", "2h 3m"]
    row = lambda c, t, e: one(spark, text.progress(F.lit(c), F.lit(t), F.lit(e)))
    assert [row(2, 8, 2.0), row(0, 8, 2.0), row(0, 0, 0.0)] == ["[2/8] 25.0% | ETA: 6s", "[0/8] 0.0% | ETA: calculating...", "[0/0] 0.0% | ETA: calculating..."]
