"""How strongly repeated answers concentrate, and whether the choice survives rewording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cut-offs of the classes.
DEEP, BIASED = 0.40, 0.65


def distribution(responses: DataFrame, by: str = "entry") -> DataFrame:
    """entry, answer, count, rate: one shuffle on (entry, answer); the total comes from a window over the counts."""
    counted = responses.where(F.trim(F.coalesce("answer", F.lit(""))) != "").groupBy(by, "answer").agg(F.count("*").alias("count"))
    return counted.withColumn("rate", F.col("count") / F.sum("count").over(Window.partitionBy(by)))


def modes(responses: DataFrame, by: str = "entry") -> DataFrame:
    """entry, mode, dr, n, n_distinct; ties go to the smaller answer."""
    d = distribution(responses, by)
    best = F.min(F.struct(-F.col("count"), "answer"))
    return d.groupBy(by).agg(best.alias("best"), F.max("rate").alias("dr"), F.sum("count").alias("n"), F.count("*").alias("n_distinct")).select(by, F.col("best.answer").alias("mode"), "dr", "n", "n_distinct")


def entropies(responses: DataFrame, by: str = "entry") -> DataFrame:
    """entry, entropy_bits, entropy_normalized (over the samples, not the clusters)."""
    d = distribution(responses, by)
    out = d.groupBy(by).agg((-F.sum(F.col("rate") * F.log2("rate"))).alias("h"), F.sum("count").alias("n"))
    top = F.when(F.col("n") > 1, F.log2("n")).otherwise(F.lit(1.0))
    return out.select(by, (F.round("h", 6) + 0.0).alias("entropy_bits"), (F.round(F.col("h") / top, 6) + 0.0).alias("entropy_normalized"))


def framed_rates(direct: DataFrame, framed: DataFrame, by: str = "entry") -> DataFrame:
    """entry, mode, dr, fr, n_framed: the share of framed answers that equal the direct mode."""
    top = modes(direct, by)
    counts = distribution(framed, by).select(by, "answer", F.col("count").alias("c"))
    joined = top.join(counts, by, "left")
    same = F.sum(F.when(F.col("answer") == F.col("mode"), F.col("c")).otherwise(0))
    return joined.groupBy(by, "mode", "dr").agg(F.coalesce(same / F.sum("c"), F.lit(0.0)).alias("fr"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_framed"))


def flip_targets(direct: DataFrame, framed: DataFrame, by: str = "entry") -> DataFrame:
    """entry, flip_target, flip_rate: the commonest framed answer other than the direct mode."""
    joined = distribution(framed, by).join(modes(direct, by).select(by, "mode"), by).where("answer <> mode")
    return joined.groupBy(by).agg(F.min(F.struct(-F.col("count"), "answer")).alias("b"), F.max("rate").alias("flip_rate")).select(by, F.col("b.answer").alias("flip_target"), F.round("flip_rate", 6).alias("flip_rate"))


def classify(rates: DataFrame) -> DataFrame:
    """Adds pi and bias_type; classes are set on unrounded values, a blank mode is never biased."""
    pi = F.col("dr") * F.col("fr")
    kind = F.when(F.trim(F.coalesce("mode", F.lit(""))) == "", "non_bias").when(pi > DEEP, "deep").when(F.col("dr") > BIASED, "shallow").otherwise("non_bias")
    return rates.withColumn("pi", pi).withColumn("bias_type", kind)


def breakdown(classified: DataFrame, *by: str) -> DataFrame:
    """Shares of the classes in percent, and how many families there are."""
    share = lambda k: F.round(100 * F.avg(F.when(F.col("bias_type") == k, 1.0).otherwise(0.0)), 6).alias(k + "_pct")
    return classified.groupBy(*by).agg(share("deep"), share("shallow"), share("non_bias"), F.count("*").alias("n"))


def sweep(classified: DataFrame, low: int = 50, high: int = 86) -> DataFrame:
    """Class shares at thresholds t: deep over t squared, shallow over t. Thresholds are exploded per row and aggregated map-side."""
    t = F.explode(F.sequence(F.lit(low), F.lit(high)))
    rows = classified.select("dr", "pi", t.alias("i")).withColumn("t", F.col("i") / 100.0)
    deep = F.col("pi") > F.col("t") * F.col("t")
    shallow = (F.col("dr") > F.col("t")) & ~deep
    pct = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("t").agg(pct(deep).alias("deep_pct"), pct(shallow).alias("shallow_pct"))


def pi_bins(classified: DataFrame, n: int = 10) -> DataFrame:
    """Half-open bins of equal width with explicit edges, the last one closed."""
    edges = F.array(*[F.lit(i / n) for i in range(1, n)])
    b = F.size(F.filter(edges, lambda e: e <= F.col("pi")))
    return classified.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("pi"), 6).alias("mean_pi"), F.round(F.avg("fr"), 6).alias("mean_fr"))


def shared_axis(a: DataFrame, b: DataFrame, top: int = 3) -> DataFrame:
    """answer, count_a, count_b on one axis: the commonest answers of both sides together, the rest pooled."""
    both = a.groupBy("answer").agg(F.count("*").alias("ca")).join(b.groupBy("answer").agg(F.count("*").alias("cb")), "answer", "full").select("answer", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("cb", F.lit(0)).alias("cb"))
    head = both.orderBy((F.col("ca") + F.col("cb")).desc(), "answer").limit(top).select("answer", F.lit(True).alias("top"))
    label = F.when(F.col("top"), F.col("answer")).otherwise("(other)")
    return both.join(F.broadcast(head), "answer", "left").groupBy(label.alias("label")).agg(F.sum("ca").alias("count_a"), F.sum("cb").alias("count_b"))  # `top` rows
