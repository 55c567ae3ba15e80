"""Shared steps: table access, written intermediate tables, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import read_table, spread  # noqa: F401 (for the queries and the pipeline)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns of these names renamed, so that an operator may add its own; and what brings a result back to the
    columns of ``df``."""
    taken = {n.lower() for n in names}
    moved: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in taken:
            moved[c] = fresh(df, "aside_" + c)
    return df.withColumnsRenamed(moved), lambda out: out.select(*(F.col(moved.get(c, c)).alias(c) for c in df.columns))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one: there, it is a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='millrace-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later steps survive lost
    executors and do not compute it twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_table(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name.rsplit("/", 2)[1] == "millrace":
            folder = path(name)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps now: Spark deletes them once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _settled(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and no ``v`` has any: the edges are stars around their smallest nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("low"))
    return nodes.where("out > 1 or (out = 1 and low = 0)").isEmpty()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` as rows ``(node, component)``, the
    component being its smallest node.

    Alternates the large-star and small-star steps until nothing changes. Each step keeps, for a
    node, only the smallest neighbour (a combinable minimum), so no neighbourhood is gathered.
    Nodes without edges have no row. The result reads a table of its own, not ``edges``.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        if _settled(now):
            break
        before, both = now, now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        large = written(large)
        release_table(low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        for table in (before, large, low):
            release_table(table)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
