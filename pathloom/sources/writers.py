"""Writers of records, results and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the flat table of results.
FLAT = ["template_id", "template_name", "node_precision", "node_recall", "node_f1", "edge_precision", "edge_recall", "edge_f1", "parameter_accuracy", "prompt_tokens", "completion_tokens", "total_tokens", "total_cost"]


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_records(records: DataFrame, path: str, key: str = "template_id") -> None:
    """A folder per record id; only the ids that are written are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def output_paths(path: str) -> dict[str, str]:
    """Where under ``path`` what is written goes; Spark makes the folders."""
    return {"llm_workflows": f"{path}/llm_generated_workflows", "evaluation_results": path, "visualizations": f"{path}/visualizations"}


def write_results(results: DataFrame, summary: DataFrame, costs: DataFrame, path: str) -> None:
    """Details, summary and cost report as JSON, and a flat CSV of evaluated rows."""
    write_json(results, f"{path}/details")
    write_json(summary, f"{path}/summary")
    write_json(costs, f"{path}/costs")
    flat = results.where("error is null").select(*[c for c in FLAT if c in results.columns])
    flat.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/results_csv")


def write_documents(chains: DataFrame, path: str) -> None:
    """Workflow documents as JSON lines."""
    chains.where(F.col("document").isNotNull()).select("document").write.mode("overwrite").text(path)
