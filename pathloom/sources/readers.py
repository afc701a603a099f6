"""Readers of workflow, graph, taxonomy and model files."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.normalize import RECORD, TEMPLATE, with_template_id
from pathloom.operators.variants import entries

INDEX_FILE = "template_index.json"


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files, each one document; a missing path is an error."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_variant(spark: SparkSession, path: str, column: str = "tree") -> DataFrame:
    """One VARIANT per JSON document."""
    return spark.read.option("multiLine", True).option("singleVariantColumn", column).json(path)


def read_templates(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Ground-truth templates of a folder by file name, without the index file and broken files."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").schema(f"{TEMPLATE}, _bad string").json(path)
    df = df.withColumn("file", F.col("_metadata.file_name")).where((F.col("file") != INDEX_FILE) & F.col("_bad").isNull()).drop("_bad")
    df = with_template_id(df).withColumn("description", F.coalesce(F.trim("workflow.description"), F.lit("")))
    return df if limit is None else df.orderBy("file").limit(limit)


def template_count(templates: DataFrame) -> int:
    return templates.count()


def template_by_id(templates: DataFrame, template_id: str) -> DataFrame:
    """The first file named template_<id>_*.json; empty if there is none."""
    return templates.where(F.col("file").rlike(f"^template_{re.escape(str(template_id))}_")).orderBy("file").limit(1)


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """Generated records of a folder; the file name gives the id."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", "generated_*.json").schema(RECORD).json(path)
    return df.withColumn("template_id", id_of_file())


def id_of_file() -> Column:
    """The template id in the name of a record file."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^generated_(.*)\.json$", 1)


def pending(todo: DataFrame, done: DataFrame, key: str = "template_id") -> DataFrame:
    """What isn't done: resume."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """head, relation, tail, pos of a file {"triples": [[head, relation, tail], ...]}."""
    df = read_json(spark, path, "triples array<array<string>>").select(F.posexplode("triples").alias("pos", "t"))
    return df.select(F.get("t", F.lit(0)).alias("head"), F.get("t", F.lit(1)).alias("relation"), F.get("t", F.lit(2)).alias("tail"), "pos")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """node, required_params of a file {node: {"required_params": [...]}}."""
    e = entries(read_variant(spark, path, "v"), "v", [], "node", "value")
    return e.select("node", F.coalesce(F.try_variant_get("value", "$.required_params", "array<string>"), F.array().cast("array<string>")).alias("required_params"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """name, type, freq of a mapping file; the reverse map is derived, not read."""
    df = read_json(spark, path, "name_to_type map<string,string>, name_frequency map<string,bigint>")
    return df.select(F.explode("name_to_type").alias("name", "type"), "name_frequency").select("name", "type", F.coalesce(F.try_element_at("name_frequency", F.col("name")), F.lit(1)).alias("freq"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return read_variant(spark, path, "tree")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, score of a model folder: the prediction matrix, else the product of two factor matrices, else
    an error. Matrices are small ``.npy`` files beside ``type_type_mapping.json``; read on the driver."""
    import json

    import numpy as np
    import pyarrow as pa

    with open(os.path.join(path, "type_type_mapping.json")) as f:
        types = np.array(json.load(f)["node_types"])
    whole, factors = os.path.join(path, "prediction.npy"), [os.path.join(path, n) for n in ("P.npy", "Q.npy")]
    if os.path.exists(whole):
        m = np.load(whole)
    elif all(map(os.path.exists, factors)):
        p, q = map(np.load, factors)
        m = p @ q.T
    else:
        raise FileNotFoundError(f"no transition model in {path}")
    n = len(types)
    return spark.createDataFrame(pa.table({"src": pa.array(np.repeat(types, n)), "dst": pa.array(np.tile(types, n)), "score": pa.array(m.ravel().astype(float))}))


def config(path: str, key: str = "api_key", variable: str = "OPENAI_API_KEY", fallback: str | None = None) -> dict:
    """A YAML or JSON settings file; ${VARIABLE} in ``key`` resolves from the environment, then ``fallback``, else fails."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml

        out = yaml.safe_load(text)
    except ImportError:
        import json

        out = json.loads(text)
    if out.get(key) == f"${{{variable}}}":
        out[key] = os.environ.get(variable) or fallback
        if not out[key]:
            raise ValueError(f"{variable} is not set")
    return out
