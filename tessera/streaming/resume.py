"""Resumable processing: what is still to do, and an appending stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tasks(entries: DataFrame, replicates: int) -> DataFrame:
    return entries.select("entry", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))


def remaining(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a row that ended well."""
    return wanted.join(done.where("error is null or error = ''").select("entry", "replicate"), ["entry", "replicate"], "left_anti")


def completeness(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """entry, expected, present of entries that lack rows."""
    have = done.where("error is null or error = ''").select("entry", "replicate").distinct().groupBy("entry").agg(F.count("*").alias("present"))
    want = wanted.groupBy("entry").agg(F.count("*").alias("expected"))
    return want.join(have, "entry", "left").select("entry", "expected", F.coalesce("present", F.lit(0)).alias("present")).where("present < expected")


def append_stream(source: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Apply a step to each micro-batch and append its rows; restarts from the checkpoint. Each batch has a folder of its own, which a
    batch that is tried again writes anew, so no row comes twice. read_appended() reads them."""

    def write(df: DataFrame, batch: int) -> None:
        step(df).write.mode("overwrite").json(f"{path}/batch={batch}")

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
