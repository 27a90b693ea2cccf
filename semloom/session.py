"""Session helpers: checkpoints in the cluster's shared folder, checked broadcasts, numbering without a single task."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side is broadcast once it has been counted; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Parts a core that rows are spread over.
PARTS = 4


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder of spark.checkpoint.dir, which all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as written to the shared folder by columns: for what is read several times, a few columns or rows at a time."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all of Spark runs in this process, else
    an error, as executors elsewhere couldn't reach it."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return tempfile.mkdtemp(prefix="semloom-")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows. It is counted, so pass one that is cheap to read."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt out to all cores, if it is read in few parts: a table of one small file would else be one
    task's, however much is made of each row. Only what is read shuffles; streams and what shuffled already stay."""
    if df.isStreaming:
        return df
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= PARTS * cores:
        return df
    return df.repartition(PARTS * cores)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """df with consecutive numbers in the given total order: rows are range-partitioned and sorted, numbered within each
    partition, and offset by the partitions before, of which only the counts are gathered."""
    spread = df.repartitionByRange(*order).withColumn("_part_", F.spark_partition_id())
    spread = checkpoint(spread)
    counts = spread.groupBy("_part_").agg(F.count("*").alias("_n_"))
    before = Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part_", F.coalesce(F.sum("_n_").over(before), F.lit(0)).alias("_off_"))
    own = Window.partitionBy("_part_").orderBy(*order)
    out = spread.join(F.broadcast(offsets), "_part_").withColumn(name, F.row_number().over(own) + F.col("_off_") + (start - 1))
    return out.drop("_part_", "_off_")
