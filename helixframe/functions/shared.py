"""Checkpoints, and running totals and row numbers that need no single task."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark is this process alone, as in tests, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: a folder is needed that driver and executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="helixframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, written once; later steps read the columns that they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, order: list[str | Column], value: str | Column, out: str) -> DataFrame:
    """df with the sum of value over all rows before each in the given order (which should have no ties)."""
    return running_totals(df, order, {out: value})


def running_totals(df: DataFrame, order: list[str | Column], values: dict[str, str | Column]) -> DataFrame:
    """df with a column for each of `values`: its sum over all rows before each in the given order (which should have no ties).

    Rows are range-partitioned and written once; a running sum inside each partition is lifted by the totals of the
    partitions before it, of which there are as many as shuffle partitions.
    """
    n = range(len(values))
    given = [(F.col(v) if isinstance(v, str) else v).cast("bigint").alias(f"__value{i}") for i, v in enumerate(values.values())]
    placed = saved(df.select("*", *given).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part").agg(*[F.sum(f"__value{i}").alias(f"__total{i}") for i in n])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shuffle partition
    lifts = totals.select("__part", *[F.coalesce(F.sum(f"__total{i}").over(before), F.lit(0)).alias(f"__lift{i}") for i in n])
    inner = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *[F.coalesce(F.sum(f"__value{i}").over(inner), F.lit(0)).alias(f"__inner{i}") for i in n])
    lifted = summed.join(F.broadcast(lifts), "__part").withColumns({out: F.col(f"__inner{i}") + F.col(f"__lift{i}") for i, out in enumerate(values)})
    return lifted.drop("__part", *[f"__{c}{i}" for i in n for c in ("value", "inner", "lift")])


def row_numbers(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """df with 0, 1, 2, ... in the given order."""
    return running_total(df, order, F.lit(1), out)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that makes far more of each row than moving it costs.

    A table of a few large row groups is dealt out; one of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
