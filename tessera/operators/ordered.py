"""Global order without a single task: ranks and running sums by range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def running(df: DataFrame, order: list[Column], add: Column, name: str = "run", by: str | None = None) -> DataFrame:
    """df with the running sum of `add` in the given order, within each value of `by`: rows are dealt by range, each partition's sums per
    value go to all partitions after it (one row a partition and value), and only local sums are windows."""
    keys = ([F.col(by)] if by else []) + order
    dealt = df.withColumn("_add", add).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "dealt")
    group = ["_part"] + ([by] if by else [])
    sums = dealt.groupBy(*group).agg(F.sum("_add").alias("_sum"))
    before = Window.partitionBy(*([by] if by else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    local = F.sum("_add").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = ["_part"] + ([by] if by else [])
    joined = dealt.withColumn("_local", local).join(starts, on)
    return joined.withColumn(name, F.col("_start") + F.col("_local")).drop("_add", "_part", "_start", "_local")


def ranked(df: DataFrame, order: list[Column], name: str = "rank", by: str | None = None) -> DataFrame:
    """df with row numbers from 1 in the given order."""
    return running(df, order, F.lit(1).cast("long"), name, by)
