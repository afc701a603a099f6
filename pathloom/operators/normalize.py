"""Workflow documents to flat nodes and edges.

Both sides become nodes (template_id, pos, id, name, type, full_type, parameters) and edges (template_id,
from_name, to_name, from_output, to_input). Columns of documents that a rule needs and a file lacks read as
null and take the rule's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.text import canonical_type

#: Ground-truth templates and generated records, as read from JSON.
TEMPLATE = """id long, metadata struct<id: long>, workflow struct<name: string, description: string, workflow: struct<
  nodes: array<struct<id: string, name: string, type: string, parameters: variant>>,
  connections: map<string, struct<main: array<array<struct<node: string, type: string, index: int>>>>>>>"""
RECORD = """template_id string, error string, generated_at timestamp_ntz,
usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>,
llm_response struct<mode: string, reply: string, workflowPlan: struct<name: string,
  nodes: array<struct<id: string, name: string, label: string, nodeType: string, typeVersion: int, params: variant>>,
  connections: array<struct<`from`: string, `to`: string, outputIndex: int, inputIndex: int>>,
  steps: array<struct<id: string, type: string, params: variant>>>>"""


def with_template_id(templates: DataFrame) -> DataFrame:
    """template_id from metadata.id, else id; rows without either are dropped."""
    return templates.withColumn("template_id", F.coalesce(F.col("metadata.id"), F.col("id")).cast("string")).where("template_id is not null")


def _nodes(df: DataFrame, id_, name, kind, parameters) -> DataFrame:
    full = F.coalesce(kind, F.lit("unknown"))
    return df.select("template_id", "pos", F.coalesce(id_, F.lit("")).alias("id"), F.coalesce(name, F.lit("")).alias("name"), canonical_type(full).alias("type"), full.alias("full_type"), F.coalesce(parameters, F.parse_json(F.lit("{}"))).alias("parameters"))


def ground_truth_nodes(templates: DataFrame) -> DataFrame:
    """Nodes of templates, without annotation notes."""
    n = templates.select("template_id", F.posexplode("workflow.workflow.nodes").alias("pos", "n"))
    n = n.where(~F.lower(F.coalesce("n.type", F.lit(""))).contains("stickynote"))
    return _nodes(n, F.col("n.id"), F.col("n.name"), F.col("n.type"), F.col("n.parameters"))


def ground_truth_edges(templates: DataFrame) -> DataFrame:
    """Edges of the main channel whose both ends are kept nodes."""
    names = ground_truth_nodes(templates).select("template_id", "name").distinct()
    e = templates.select("template_id", F.explode("workflow.workflow.connections").alias("from_name", "c"))
    e = e.select("template_id", "from_name", F.posexplode("c.main").alias("from_output", "targets")).select("template_id", "from_name", "from_output", F.explode("targets").alias("t"))
    e = e.select("template_id", "from_name", F.col("t.node").alias("to_name"), "from_output", F.coalesce("t.index", F.lit(0)).alias("to_input"))
    return e.join(names.withColumnRenamed("name", "from_name"), ["template_id", "from_name"], "left_semi").join(names.withColumnRenamed("name", "to_name"), ["template_id", "to_name"], "left_semi").select("template_id", "from_name", "to_name", "from_output", "to_input")


def _plans(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that create: those with steps, and the others with nodes."""
    create = records.where("llm_response.mode = 'create_workflow'").select("template_id", F.col("llm_response.workflowPlan").alias("p"))
    steps = F.coalesce(F.size("p.steps"), F.lit(0)) > 0
    return create.where(steps), create.where(~steps & (F.coalesce(F.size("p.nodes"), F.lit(0)) > 0))


def generated_nodes(records: DataFrame) -> DataFrame:
    """Nodes of generated plans; a plan's steps win over its nodes."""
    with_steps, with_nodes = _plans(records)
    s = with_steps.select("template_id", F.posexplode("p.steps").alias("pos", "n")).withColumn("key", F.coalesce("n.id", F.concat(F.lit("step_"), F.col("pos"))))
    n = with_nodes.select("template_id", F.posexplode("p.nodes").alias("pos", "n")).withColumn("key", F.coalesce("n.id", "n.name", F.lit("unknown")))
    return _nodes(s, F.col("key"), F.col("key"), F.col("n.type"), F.col("n.params")).unionByName(_nodes(n, F.col("key"), F.coalesce("n.label", "key"), F.col("n.nodeType"), F.col("n.params")))


def step_edges(steps: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """by, from_name, to_name of a linear chain."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(order)
    return steps.withColumn("from_name", F.lag(name).over(w)).where("from_name is not null").select(*by, "from_name", F.col(name).alias("to_name"))


def generated_edges(records: DataFrame) -> DataFrame:
    """Edges of generated plans by node name; unknown ids stay, and the last node of an id names it."""
    with_steps, with_nodes = _plans(records)
    chain = step_edges(generated_nodes(records).join(with_steps.select("template_id").distinct(), "template_id", "left_semi"), ["template_id"], "pos", "name")
    names = generated_nodes(records).groupBy("template_id", "id").agg(F.max_by("name", "pos").alias("label"))
    c = with_nodes.select("template_id", F.explode("p.connections").alias("c")).select("template_id", F.coalesce("c.from", F.lit("")).alias("f"), F.coalesce("c.to", F.lit("")).alias("t"), F.coalesce("c.outputIndex", F.lit(0)).alias("from_output"), F.coalesce("c.inputIndex", F.lit(0)).alias("to_input"))
    for end, out in (("f", "from_name"), ("t", "to_name")):
        c = c.join(names.select("template_id", F.col("id").alias(end), F.col("label").alias(out)), ["template_id", end], "left").withColumn(out, F.coalesce(out, end))
    zero = F.lit(0)
    return chain.select("template_id", "from_name", "to_name", zero.alias("from_output"), zero.alias("to_input")).unionByName(c.select("template_id", "from_name", "to_name", "from_output", "to_input"))
