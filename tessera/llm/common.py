"""What the corpus operators share: shared storage, row keys and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute is used below)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import drop_materialized, materialize

__all__ = ["binary", "boxed", "drop_materialized", "frequent_keys", "keyed_texts", "materialize", "read_table", "release_memory", "row_or_key", "schema_with", "slices", "small_batches", "unboxed"]

#: Bytes of the Arrow batches that workers get.
BATCH_BYTES = 1 << 20
#: Keys that may be called frequent: those with more than one in so many rows, so there are never more of them.
MOST_FREQUENT = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session from now on cuts Arrow batches at BATCH_BYTES, unless it has set a bound of its own. By default a batch is
    10,000 rows, of any size: an executor's allocator keeps buffers of tens of MB for every thread that once had one."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m") in ("64m", "64MB", "67108864", "67108864b"):
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def frequent_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The keys of counts (keys, n) with more than one in MOST_FREQUENT of all rows: by arithmetic at most MOST_FREQUENT keys, so the
    result may be broadcast whatever the table's size."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return materialize(counts.where(F.col(n) > max(1, total // MOST_FREQUENT)).select(*keys), "frequent")


def row_or_key(key: str, hot: Column) -> Column:
    """The key to join by: the key itself, or a number of the row's own where the row is hot (and needs no partner)."""
    return F.when(hot, F.xxhash64(F.monotonically_increasing_id(), F.lit("row"))).otherwise(F.col(key))


def keyed_texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and a key (k1, k2) that is never null and equal only for rows with equal doc_id and equal text."""
    return small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *extra,
    ).withColumns({"k1": F.coalesce("doc_id", F.lit(-(2**63))), "k2": F.xxhash64("text", F.lit("row"))})


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, where their names can't clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("row"), F.struct(*(docs[c] for c in docs.columns if c not in ("doc_id", "text")) or [F.lit(None).cast("int").alias("none")]).alias("columns")).alias("box"))


def unboxed(result: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` in their order and types; n_chars follows the text."""
    own = {"doc_id": F.col("doc_id").cast(like.schema["doc_id"].dataType), "text": F.col("text")}
    if "n_chars" in like.columns:
        own["n_chars"] = F.length("text").cast(like.schema["n_chars"].dataType)
    return result.select(*(own.get(c, F.col("box.columns").getField(c)).alias(c) for c in like.columns))


def schema_with(ddl: str, source: DataFrame, extra: tuple[str, ...]) -> T.StructType:
    out = T.StructType.fromDDL(ddl)
    for x in extra:
        out = out.add(x, source.schema[x].dataType)
    return out


def binary(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def release_memory() -> None:
    """Give back what this worker's allocators keep but don't use: Spark reuses workers, so one stage's peak would stay through the
    next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about most_bytes of the column, one row at least; at the end the worker's unused memory
    goes back."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = [x or 0 for x in pa.compute.binary_length(col).to_pylist()]
        start = total = 0
        for i, s in enumerate(sizes):
            if i > start and total + s > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += s
        yield batch.slice(start)
    release_memory()
