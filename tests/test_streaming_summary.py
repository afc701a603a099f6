"""An incremental summary over batches of files equals that of all files at once."""

import json
import statistics

from pyspark.sql import functions as F

from pathloom.streaming import summary


def test_three_batches_one_replayed(spark, tmp_path):
    values = [[0.5, 0.25, 1.0], [0.0, 1e6], [0.75, 0.125, 0.5, 1.0]]
    n = 0
    for batch in values:
        (tmp_path / "in").mkdir(exist_ok=True)
        for v in batch:
            (tmp_path / "in" / f"generated_{n}.json").write_text(json.dumps({"template_id": str(n), "prompt_tokens": n, "completion_tokens": 2 * n}))
            n += 1
        score = {str(i): v for i, v in enumerate(x for b in values for x in b)}
        table = spark.createDataFrame(list(score.items()), "template_id string, f1 double")

        def evaluate(df, table=table):
            ids = df.select(F.regexp_extract("template_id", "([0-9]+)", 1).alias("template_id"))
            rows = ids.join(table, "template_id", "left")
            k = F.col("template_id").cast("long")
            return rows.withColumns({"f2": F.col("f1") * 2, "error": F.when(F.col("template_id") == "1", "bad"), "p": k, "c": 2 * k})

        out = summary.summarise_new(spark, f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/state", evaluate, ["f1", "f2"], "error", ("p", "c"))
    before = sorted(map(tuple, out.collect()))
    # the second batch is replayed
    again = evaluate(spark.createDataFrame([("3",), ("4",)], "template_id string"))
    summary.keep(summary.states(again, ["f1", "f2"], "error", ("p", "c")), 1, f"{tmp_path}/state")
    got = {r.metric: r for r in summary.summary(spark, f"{tmp_path}/state").collect()}
    assert sorted(got) == ["f1", "f2"] and sorted(map(tuple, got.values())) == before
    good = [v for i, v in enumerate(x for b in values for x in b) if i != 1]
    for name, k in (("f1", 1), ("f2", 2)):
        r, want = got[name], [k * v for v in good]
        assert (r.n, r.n_failed, r.min, r.max) == (len(want), 1, min(want), max(want))
        assert abs(r.mean - statistics.fmean(want)) < 1e-9 * 1e6 and abs(r.std - statistics.pstdev(want)) < 1e-6
        assert (r.prompt_tokens, r.completion_tokens) == (sum(range(n)), 2 * sum(range(n)))
        assert abs(r.total_cost - (sum(range(n)) * 2.5 + 2 * sum(range(n)) * 10) / 1e6) < 1e-12


def test_states_of_nothing(spark):
    none = spark.createDataFrame([], "f1 double")
    (r,) = summary.merged(summary.states(none, ["f1"])).collect()
    assert (r.n, r.n_failed, r.mean, r.std) == (0, 0, 0.0, 0.0)
