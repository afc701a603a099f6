"""Cutting lineage through the shared checkpoint folder, and the iterations that need it."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a local session (as in tests) gets a temporary
    folder; on a cluster, whose machines don't share one, that is an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = os.path.join(tempfile.gettempdir(), "pathloom-checkpoints")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder: it survives lost executors.

    A checkpoint keeps the planner's estimate of its size, which a join multiplies. In a loop that joins a frame with itself the
    estimate's digits double each round, until planning takes all the time; a senseless estimate is dropped.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    plan = out._jdf.queryExecution().analyzed()
    if int(str(plan.stats().sizeInBytes())) >= 1 << 60:
        session = out.sparkSession
        out = DataFrame(session._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False), session)
    return out


def counted(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``df``, cut, and how many of its rows meet ``condition`` (all, without one), counted in the same job.

    Rows of a task that was run again may count twice, so the number is exact as to whether it is 0.
    """
    seen = Observation()
    out = cut(df.observe(seen, (F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n")))
    return out, int(seen.get.get("n") or 0)


def release(*frames: DataFrame) -> None:
    """Deletes the files of frames that ``cut`` returned and nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, lengthened until no name of ``taken`` (case aside) is among them."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by repeated contraction: (id, component), the component being its smallest id.

    ``edges``: two columns of one type; loops and repeats don't matter, null ends are ignored. Each round, every
    vertex points to the smallest vertex beside it, pointers are followed to their roots, and the
    edges are rewritten between roots, of which there are at most half as many; stars, cliques and sorted chains
    vanish in one or two rounds. All rounds are aggregations with map-side combining and plain joins, one job
    each; nothing is gathered on the driver. Only ids that occur in an edge between two ids are returned; an
    empty input gives an empty result.
    """
    left, n = counted(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    names = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id"))
    lefts, jumps = [left], []
    while n:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        jump = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")))
        # each vertex's pointer is followed to its root, three steps a job
        moved = 1
        while moved:
            to = jump.select(F.col("v").alias("w"), F.col("m").alias("n"))
            twice = jump.select("v", "m").join(to, F.col("m") == F.col("w"), "left").select("v", F.coalesce("n", "m").alias("m"))
            step = twice.join(to, F.col("m") == F.col("w"), "left").select("v", F.coalesce("n", "m").alias("m"), (F.col("n") < F.col("m")).alias("moved"))
            done, (jump, moved) = jump, counted(step, F.col("moved"))
            release(done)
        jumps.append(jump)
        to = jump.select("v", "m")
        heads = left.join(to, left.a == F.col("v")).select(F.col("m").alias("a"), "b")
        tails = to.select(F.col("v").alias("w"), F.col("m").alias("n"))
        left, n = counted(heads.join(tails, F.col("b") == F.col("w")).select(F.least("a", "n").alias("a"), F.greatest("a", "n").alias("b")).where("a <> b").distinct())
        lefts.append(left)
    for jump in jumps:
        names = names.join(jump.select("v", "m"), F.col("component") == F.col("v"), "left").select("id", F.coalesce("m", "component").alias("component"))
    out = cut(names)
    release(*lefts, *jumps)
    return out
