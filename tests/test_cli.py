import json

from pathloom import cli


def test_generate_resume_evaluate(spark, tmp_path):
    t, r, o, a = (str(tmp_path / x) for x in ("templates", "records", "out", "answers"))
    (tmp_path / "templates").mkdir()
    (tmp_path / "answers").mkdir()
    for i in (1, 2):
        doc = {"id": i, "workflow": {"name": f"W{i}", "description": f"make {i}", "workflow": {"nodes": [{"id": "1", "name": "A", "type": "x.webhook"}], "connections": {}}}}
        (tmp_path / f"templates/template_{i}_w.json").write_text(json.dumps(doc))
    plan = {"mode": "create_workflow", "workflowPlan": {"nodes": [{"id": "n", "label": "A", "nodeType": "webhook"}]}}
    rows = [{"prompt": f"make {i}", "answer": f"```json\n{json.dumps(plan)}\n```", "prompt_tokens": 10, "completion_tokens": 5} for i in (1, 2)]
    (tmp_path / "answers/a.json").write_text("\n".join(map(json.dumps, rows)))
    cli.run(["generate", "--templates", t, "--records", r, "--answers", a, "--limit", "1"])
    assert spark.read.json(r).count() == 1
    cli.run(["all", "--templates", t, "--records", r, "--answers", a, "--resume", "--out", o])
    assert spark.read.json(r).count() == 2
    s = spark.read.json(o + "/summary").first()
    assert (s.n, s.node_f1_mean) == (2, 1.0)
    assert spark.read.option("header", True).csv(o + "/results_csv").count() == 2
