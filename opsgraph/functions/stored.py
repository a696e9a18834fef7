"""Cutting lineage in loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a new one under /tmp; never on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that isn't there yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark removes a job's shuffle files when the job ends; by default it waits for the driver's collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, the job's shuffle files go, and later plans know its size and read only the columns they need."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a stored() table that nothing reads any more."""
    spark = table.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def smallest_reached(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of the undirected links (a, b) reaches. One join and one checkpoint a round."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        # The label of a neighbour, and the label of one's own label, which halves the way to go.
        spread = both.join(label, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "label")
        jump = label.alias("x").join(label.alias("y"), F.col("x.label") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.label").alias("label"))
        new = cut(label.union(spread).union(jump).groupBy("id").agg(F.min("label").alias("label")))
        if not new.join(label, ["id", "label"], "left_anti").limit(1).count():
            return new
        label = new
