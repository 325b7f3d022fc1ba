"""Clusters of repeated free-text answers, and how framed answers follow the direct ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as fn
from ..functions.text import stem
from .graph import components

#: Least cosines of answers with common wording, and of any; most words of an answer that may lie inside another.
WORDING_FLOOR, SYNONYM, MOST_WORDS = 0.55, 0.85, 3


def answer_edges(keys: DataFrame, floor: float = WORDING_FLOOR, synonym: float = SYNONYM, by: str = "entry") -> DataFrame:
    """entry, a, b of the keys (entry, key, embedding) of a family that mean the same: equal stems or containment with a cosine of
    `floor`, or a cosine of `synonym`. Keys of one family meet; a family has few distinct answers."""
    words = F.split("key", " ")
    k = keys.select(by, "key", "embedding", words.alias("words"), F.transform(words, stem).alias("stems"))
    pairs = k.alias("x").join(k.alias("y"), (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x.key") < F.col("y.key")))
    cosine = F.aggregate(F.zip_with("x.embedding", "y.embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    wx, wy = F.array_distinct("x.words"), F.array_distinct("y.words")
    inside = (F.least(F.size(wx), F.size(wy)) <= MOST_WORDS) & ((F.size(F.array_except(wx, wy)) == 0) | (F.size(F.array_except(wy, wx)) == 0))
    wording = (F.col("x.stems") == F.col("y.stems")) | inside
    met = pairs.select(F.col(f"x.{by}").alias(by), F.col("x.key").alias("a"), F.col("y.key").alias("b"), wording.alias("wording"), cosine.alias("cosine"))
    return met.where((F.col("cosine") >= synonym) | (F.col("wording") & (F.col("cosine") >= floor))).select(by, "a", "b")


def clusters(responses: DataFrame, embeddings: DataFrame, lemma: fn.Lemma = fn.regular, floor: float = WORDING_FLOOR, synonym: float = SYNONYM, by: str = "entry") -> DataFrame:
    """entry, canonical, count, rate, surface_forms, lemma_keys, first: a row a cluster of responses (entry, pos, response).

    Responses meet by canonical key, keys by answer_edges on embeddings (key, embedding). A cluster's name is its commonest surface form
    (ties: the smaller), its keys come in the order in which they were first seen, and `first` is the first place of the cluster."""
    found = responses.where(F.trim(F.coalesce("response", F.lit(""))) != "").withColumn("key", fn.canonical(F.col("response"), lemma))
    surfaces = found.groupBy(by, "key", "response").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    keys = surfaces.select(by, "key").distinct().join(embeddings, "key")
    name = lambda c: F.concat(F.col(by).cast("string"), F.lit("\x1f"), F.col(c))
    roots = components(answer_edges(keys, floor, synonym, by).select(name("a").alias("a"), name("b").alias("b")))
    placed = surfaces.withColumn("node", name("key")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_key = Window.partitionBy(by, "root", "key")
    rows = placed.withColumn("seen", F.min("first").over(per_key)).groupBy(by, "root").agg(
        F.sum("n").alias("count"),
        F.min(F.struct((-F.col("n")).alias("n"), "response")).alias("best"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("response", "n")))).alias("surface_forms"),
        F.transform(F.array_sort(F.collect_set(F.struct("seen", "key"))), lambda k: k["key"]).alias("lemma_keys"),
        F.min("first").alias("first"),
    )
    rate = F.col("count") / F.sum("count").over(Window.partitionBy(by))
    return rows.select(by, F.col("best.response").alias("canonical"), "count", rate.alias("rate"), "surface_forms", "lemma_keys", "first")


def _names() -> Column:
    return F.array_distinct(F.concat(F.array("canonical"), "lemma_keys"))


def framed_follow(direct: DataFrame, framed: DataFrame, lemma: fn.Lemma = fn.regular, by: str = "entry") -> DataFrame:
    """entry, mode, dr, fr, flip_target, flip_rate: of direct and framed clusters, what share of the framed answers is the same answer as
    the direct mode, by any name or key of the two clusters, and the largest framed cluster that isn't (ties: seen first)."""
    order = F.struct((-F.col("count")).alias("n"), "first", "canonical")
    top = direct.groupBy(by).agg(F.min_by(F.struct("canonical", "rate", _names().alias("names")), order).alias("m"))
    top = top.select(by, F.col("m.canonical").alias("mode"), F.col("m.rate").alias("dr"), F.transform("m.names", lambda t: fn.forms(t, lemma)).alias("forms"))
    f = framed.select(by, F.col("canonical"), "count", F.col("rate").alias("share"), "first", F.transform(_names(), lambda t: fn.forms(t, lemma)).alias("own"))
    met = top.join(f, by, "left").withColumn("is_mode", F.exists("own", lambda x: F.exists("forms", lambda y: fn.same(x, y))))
    other = F.when(F.col("canonical").isNotNull() & ~F.col("is_mode"), F.struct((-F.col("count")).alias("n"), "first", "canonical", "share"))
    got = met.groupBy(by, "mode", "dr").agg(F.sum(F.when(F.col("is_mode"), F.col("count")).otherwise(0)).alias("hit"), F.sum("count").alias("n"), F.min(other).alias("o"))
    return got.select(by, "mode", "dr", F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0)).alias("fr"), F.col("o.canonical").alias("flip_target"), F.coalesce("o.share", F.lit(0.0)).alias("flip_rate"))
