"""Command line: ``python -m pathloom.cli generate|evaluate|all --templates DIR --records DIR [--out DIR] ...``

``generate`` needs ``--answers``, a folder of recorded answers (JSON lines: prompt, answer, prompt_tokens,
completion_tokens), as no service is built in; another callable can be passed to ``run``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import functions as F

from pathloom.functions.jsonx import repaired
from pathloom.functions.text import ascii_only
from pathloom.operators import report
from pathloom.operators.normalize import RECORD
from pathloom.plans import pipelines
from pathloom.session import session
from pathloom.sources import readers, writers


def recorded(spark, path: str) -> Callable[[str], tuple[str, int, int]]:
    """Answers by prompt; a bounded fixture, read on the driver."""
    rows = spark.read.schema("prompt string, answer string, prompt_tokens long, completion_tokens long").json(path).withColumn("prompt", ascii_only(F.col("prompt"))).collect()
    answers = {r.prompt: (r.answer, r.prompt_tokens, r.completion_tokens) for r in rows}

    def call(prompt: str) -> tuple[str, int, int]:
        return answers[prompt]

    return call


def generate(spark, templates: str, records: str, call, resume: bool, limit: int | None) -> None:
    """Appends a record file folder ``records``; with ``resume``, ids that have a record are skipped."""
    todo = readers.read_templates(spark, templates)
    try:
        done = spark.read.schema(RECORD).json(records).select("template_id") if resume else None
    except Exception as e:  # noqa: BLE001 - only a missing folder counts as nothing done
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    made = pipelines.generate_missing(todo, done, call, limit)
    usage = F.struct("prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    out = made.select("template_id", "error", F.current_timestamp().cast("timestamp_ntz").alias("generated_at"), usage.alias("usage"), F.from_json(F.to_json(repaired(F.col("llm_response"))), RECORD_ANSWER).alias("llm_response"))
    out.write.mode("append" if resume else "overwrite").json(records)


#: The type of llm_response within a record.
RECORD_ANSWER = RECORD.split("llm_response ", 1)[1]


def evaluate(spark, templates: str, records: str, out: str) -> None:
    result = pipelines.evaluate(readers.read_templates(spark, templates), spark.read.schema(RECORD).option("multiLine", False).json(records)).cache()
    summary, costs = pipelines.summarise(result)
    writers.write_results(result, summary, costs, out)
    print(report.summary_text(summary, costs).first().text)


def run(argv: list[str] | None = None, call: Callable[[str], tuple[str, int, int]] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pathloom")
    p.add_argument("command", choices=["generate", "evaluate", "all"])
    for name, needed in (("--templates", True), ("--records", True), ("--out", False), ("--answers", False)):
        p.add_argument(name, required=needed)
    p.add_argument("--resume", action="store_true")
    p.add_argument("--limit", type=int)
    a = p.parse_args(argv)
    spark = session()
    if a.command != "evaluate":
        if call is None and not a.answers:
            p.error("generate needs --answers")
        generate(spark, a.templates, a.records, call or recorded(spark, a.answers), a.resume, a.limit)
    if a.command != "generate":
        if not a.out:
            p.error("evaluate needs --out")
        evaluate(spark, a.templates, a.records, a.out)


if __name__ == "__main__":
    run()
