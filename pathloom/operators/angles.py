"""Leaders: a bounded number of directions, to which vectors are dealt, so that angles between them can be bounded.

Angles obey the triangle inequality: two vectors at angles a and b from a leader are |a - b| to a + b apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEADERS, SAMPLE, SLACK = 256, 16, 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaders(rows: DataFrame, column: str, most: int = LEADERS) -> np.ndarray:
    """At most ``most`` directions of a vector column (without zero vectors), as far apart as can be.

    Of a sample by hash, ``SAMPLE`` times as many as leaders, each next leader is the one farthest from all before.
    """
    some = rows.select(F.col(column).alias("d")).distinct().orderBy(F.xxhash64("d"), "d").limit(SAMPLE * most).toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    x = unit(matrix(some.column("d").combine_chunks()))
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def with_leader(rows: DataFrame, column: str, centres: np.ndarray) -> DataFrame:
    """``rows`` with leader (the nearest of ``centres``) and near (the angle to it)."""
    shared, at = rows.sparkSession.sparkContext.broadcast(centres), rows.columns.index(column)
    schema = rows.select("*", F.lit(0).alias("leader"), F.lit(0.0).alias("near")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = unit(matrix(batch.column(at))) @ shared.value.T
                best = c.argmax(1)
                angle = np.arccos(np.clip(c[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "leader", "near"])

    return rows.mapInArrow(run, schema)
