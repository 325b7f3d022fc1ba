"""JSON lines: strict and tolerant scans, sinks, and field aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """Rows of .jsonl or .jsonl.gz; blank lines are skipped; a broken line raises, or is dropped if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, append: bool = False) -> int:
    """Write and return the number of rows written, which is observed as they are."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").option("compression", "gzip" if gzip else "none").json(path)
    return seen.get["n"]


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that exists and isn't blank."""
    return F.coalesce(*[F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df.columns], F.lit(None))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines or CSV by suffix."""
    kind = path.removesuffix(".gz").rpartition(".")[2]
    return spark.read.format({"jsonl": "json", "json": "json", "csv": "csv"}.get(kind, "parquet")).load(path)
