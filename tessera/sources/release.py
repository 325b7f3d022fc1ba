"""Scans of part of a file, sinks that replace or report, and the layout of a release."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SECRETS
from ..operators.ordered import ranked
from .jsonl import write_jsonl

MODELS = "outputs/{model}/{kind}"


def load_outputs(spark: SparkSession, root: str, model: str, kind: str, schema: str) -> DataFrame:
    """Rows of a model's outputs under root; a model that isn't there raises ValueError."""
    path = f"{root}/" + MODELS.format(model=model, kind=kind)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"no outputs of {model}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def limited(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the given order: a scan of part of a table, for trials."""
    return df.orderBy(*order).limit(n)


def limited_path(path: str, n: int | None) -> str:
    """Where a limited run writes, so that it never stands for a whole one."""
    return f"{path}.limit{n}" if n else path


def only_ids(df: DataFrame, ids: str, column: str = "id") -> DataFrame:
    """Rows whose id is in a list parted by commas."""
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    return df.where(F.col(column).cast("string").isin(wanted))


def replace_jsonl(df: DataFrame, path: str) -> None:
    """Write beside the path, then put it in its place: readers see the old rows or the new ones."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".tmp"))
    df.write.mode("overwrite").json(path + ".tmp")
    files = at.getFileSystem(conf)
    files.delete(at, True)
    if not files.rename(new, at):
        raise OSError(f"can't put {path} in place")


def concat_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of several parquet sources; columns that a source lacks are null."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def shards(df: DataFrame, path: str, by: str, rows: int = 250) -> None:
    """A folder a value of `by`, files of at most `rows` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(by).json(path)


def redact(df: DataFrame, pattern: str = SECRETS, mark: str = "[REDACTED_TOKEN]") -> DataFrame:
    """df with the secrets in every string replaced, however deep in structs, arrays and map values it lies."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.regexp_replace(c, pattern, mark)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(clean(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields))


def preview(df: DataFrame, score: str, id_: str, head: int = 40, tenths: int = 10) -> DataFrame:
    """part, rank and all columns: the best rows, and one from each tenth of the order."""
    placed = ranked(df, [F.desc(score), F.col(id_)])
    n = df.count()
    places = {min(n - 1, n * d // tenths) + 1 for d in range(tenths)} if n else set()
    part = F.when(F.col("rank") <= head, "head")
    tenth = F.when(F.col("rank").isin(sorted(places)), "tenth")
    return placed.withColumn("part", F.explode(F.filter(F.array(part, tenth), lambda x: x.isNotNull())))


def summary(df: DataFrame, column: str, points: tuple[int, ...] = (0, 10, 25, 50, 75, 90, 99, 100)) -> DataFrame:
    """One row: how many rows, and percentiles of a column."""
    return df.agg(F.count("*").alias("n"), F.percentile(column, F.array(*(F.lit(p / 100) for p in points))).alias("percentiles"))


def fingerprint(df: DataFrame, model: str, order: str, text: str, rows: int = 200, chars: int = 200) -> str:
    """A digest of a table's content that an embedding cache is kept under: model, number of rows, and the heads of `rows` evenly spaced
    rows and the last."""
    n = df.count()
    step = max(1, n // rows)
    picked = ranked(df, [F.col(order)]).where(((F.col("rank") - 1) % step == 0) & (F.col("rank") <= rows * step) | (F.col("rank") == n))
    heads = picked.orderBy("rank").select(F.left(text, F.lit(chars)).alias("h")).agg(F.sha2(F.array_join(F.collect_list("h"), "\x1f"), 256)).first()[0]
    return sha256(f"{model}|{n}|{heads}".encode()).hexdigest()


def export_release(prompts: DataFrame, framings: DataFrame, outputs: DataFrame, root: str) -> dict[str, int]:
    """The layout of a release: prompts with secrets redacted, framings, outputs by model; failed rows and unknown ids stay out."""
    known = prompts.select("id")
    good = outputs.where("error IS NULL OR error = ''").join(known, "id", "left_semi").drop("error")
    counts = {"prompts": write_jsonl(redact(prompts), f"{root}/prompts"), "framings": write_jsonl(framings.join(known, "id", "left_semi"), f"{root}/framings")}
    good.write.mode("overwrite").option("compression", "gzip").partitionBy("model").json(f"{root}/outputs")
    return counts | {"outputs": good.count()}
