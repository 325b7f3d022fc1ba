"""Connected components of a table of links, by rounds on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_materialized, materialize


def is_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is an u."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), "v"))
    return not seen.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least <> most").agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes of links (a, b) that aren't roots, by rounds of a large-star and a
    small-star step; their number grows with the logarithm of the table."""
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    while not is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v"))
        before, now = now, materialize(small.distinct(), "star")
        drop_materialized(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
