"""Incremental evaluation: new record files since the last run, by file streaming with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.operators.normalize import RECORD
from pathloom.sources.readers import id_of_file


def process_new(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Runs ``handle(batch, number)`` on generated records that no earlier run has seen, then stops.

    As in ``read_generated``, the file name gives a record's id.
    """
    stream = spark.readStream.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "generated_*.json").json(path).withColumn("template_id", id_of_file())
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
