"""Dealing small inputs over all cores before work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _bytes(size: str) -> int:
    text = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text.rstrip("kmgt")) << unit


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its estimated size would not fill one scan partition for each.

    A small file is often one row group and so one task.  Large inputs have partitions enough and
    pass through without a shuffle, and so do streams.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) else df
