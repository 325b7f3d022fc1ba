"""Mixtures of sources, samples, slices and sequences on the documents table; characters stand for tokens."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mixing as ops
from ..operators.ordered import ranked, running
from .registry import query, table

CUT = "(doc_id * 2654435761) % 4294967296"


def _order():
    return [(F.col("doc_id") * 2654435761) % 4294967296, F.col("doc_id")]


SIZES = "s AS (SELECT source, count(*) AS n, 1.0 + (ascii(right(source, 1)) % 4) AS ratio, 1.0 + (ascii(right(source, 1)) % 2) AS repeat FROM documents GROUP BY 1)"


def _sources(spark, sf_dir):
    k = F.ascii(F.right("source", F.lit(1)))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", "n", (1.0 + k % 4).alias("ratio"), (1.0 + k % 2).alias("repeat"))


@query(f"""WITH {SIZES}, i AS (SELECT *, sum(n) OVER () * ratio::DOUBLE / sum(ratio::DOUBLE) OVER () AS ideal FROM s), u AS (SELECT *, n * least(repeat::DOUBLE, greatest(ideal / n, 1.0)) AS usable FROM i),
f AS (SELECT *, least(1.0, min(usable / ideal) OVER ()) AS factor FROM u) SELECT source, floor(ideal * factor)::BIGINT AS size FROM f""")
def sample_sizes(spark, sf_dir):
    return ops.sample_sizes(_sources(spark, sf_dir))


@query("""WITH RECURSIVE s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, least(count(*), 60) AS n, (1.0 + (ascii(right(source, 1)) % 4))::DOUBLE AS ratio FROM documents GROUP BY 1),
w AS (SELECT 0 AS round, (SELECT least(900, sum(n)) FROM s)::BIGINT AS left_, (SELECT list(0::BIGINT ORDER BY i) FROM s) AS take, (SELECT list(n ORDER BY i) FROM s) AS cap, (SELECT list(ratio ORDER BY i) FROM s) AS ratio
 UNION ALL
 SELECT round + 1, left_ - list_sum(g)::BIGINT, list_transform(range(1, len(take) + 1), lambda k: take[k] + g[k]), cap, ratio FROM (
  SELECT *, list_transform(range(1, len(take) + 1), lambda k: base[k] + (list_contains(list_slice(list_reverse_sort(list_filter(list_transform(range(1, len(take) + 1), lambda k: {'r': ideal[k] - floor(ideal[k]), 'k': k}), lambda x: take[x.k] + base[x.k] < cap[x.k])), 1, (left_ - list_sum(base))::BIGINT), {'r': ideal[k] - floor(ideal[k]), 'k': k}))::INT::BIGINT) AS g FROM (
   SELECT *, list_transform(range(1, len(take) + 1), lambda k: least(floor(ideal[k])::BIGINT, cap[k] - take[k])) AS base FROM (
    SELECT *, list_transform(range(1, len(take) + 1), lambda k: CASE WHEN take[k] < cap[k] THEN left_ * ratio[k] / list_sum(list_transform(range(1, len(take) + 1), lambda j: CASE WHEN take[j] < cap[j] THEN ratio[j] ELSE 0.0::DOUBLE END)) ELSE 0.0::DOUBLE END) AS ideal FROM w WHERE left_ > 0))))
SELECT s.source, (SELECT arg_max(take, round) FROM w)[s.i + 1] AS take FROM s""")
def apportion_capped(spark, sf_dir):
    """900 documents by ratio, at most 60 of a source; what a full source can't take goes to the others."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.least(F.count("*"), F.lit(60)).alias("n"))
    s = ranked(s, [F.col("source")], "i").select("source", "i", "n", (1.0 + F.ascii(F.right("source", F.lit(1))) % 4).cast("double").alias("ratio"))
    return ops.apportion(s, 900)


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {CUT}, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents), c AS (SELECT doc_id, source, 70 // n + (k <= 70 % n)::INT AS copies FROM r)
SELECT doc_id, source, unnest(range(1, copies + 1))::INT AS copy FROM c WHERE copies > 0""")
def resample_to_target(spark, sf_dir):
    """Each source up or down to 70 documents: full repeats, and the head of a shuffled order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    placed = ranked(d, _order(), "k", "source").join(F.broadcast(sizes), "source")  # a row a source
    copies = F.floor(F.lit(70) / F.col("n")) + (F.col("k") <= F.lit(70) % F.col("n")).cast("int")
    return placed.withColumn("c", copies.cast("int")).where("c > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("copy"))


@query("""WITH s AS (SELECT source, sum(n_chars)::BIGINT AS n, 0.05 AS ratio FROM documents GROUP BY 1) SELECT source, n, floor(200000 * ratio)::BIGINT AS needed, floor(n * 0.5 * 2)::BIGINT AS most, floor(n * 0.5 * 2) < floor(200000 * ratio) AS short, ceil(floor(200000 * ratio) / n)::BIGINT AS passes FROM s""")
def mixture_needs(spark, sf_dir):
    """What each source must give to 200,000 characters, the most that half of it twice gives, and in how many passes."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).withColumn("needed", F.floor(F.lit(200000) * F.lit(0.05)))
    return s.select("source", "n", "needed", F.floor(F.col("n") * 0.5 * 2).alias("most"), (F.floor(F.col("n") * 0.5 * 2) < F.col("needed")).alias("short"), F.ceil(F.col("needed") / F.col("n")).alias("passes"))


TAKE = 30_000


@query(f"""WITH h AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY {CUT}, doc_id) AS run, sum(n_chars) OVER (PARTITION BY source) AS have FROM documents),
c AS (SELECT doc_id, source, {TAKE} // have AS full_, run <= {TAKE} % have AS more FROM h) SELECT doc_id, source, (full_ + more::INT)::BIGINT AS copies FROM c WHERE full_ + more::INT > 0""")
def document_sample(spark, sf_dir):
    """Whole documents to a number of characters a source: full repeats, then a shuffled order as far as it goes without running over."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    have = d.groupBy("source").agg(F.sum("n_chars").alias("have"))
    h = running(d, _order(), F.col("n_chars"), "run", "source").join(F.broadcast(have), "source")  # a row a source
    copies = F.floor(F.lit(TAKE) / F.col("have")) + (F.col("run") <= F.lit(TAKE) % F.col("have")).cast("int")
    return h.select("doc_id", "source", copies.alias("copies")).where("copies > 0")


@query("SELECT source, sum(n_chars // 512)::BIGINT AS instances, (floor(sum(n_chars // 512) * 0.25 / 4) * 4)::BIGINT AS taken FROM documents GROUP BY 1")
def instance_sample(spark, sf_dir):
    """Instances of 512 characters a source, and a quarter of them in whole groups of four."""
    n = F.floor(F.col("n_chars") / 512)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).alias("instances")).withColumn("taken", F.floor(F.col("instances") * 0.25 / 4) * 4)


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n, sum(n_chars) OVER (ORDER BY doc_id) AS run, sum(n_chars) OVER () AS total FROM documents)
SELECT doc_id, pos BETWEEN n - 150 AND n - 21 AS in_slice, run <= floor(total * 0.8) AS left_side FROM r""")
def slice_and_split(spark, sf_dir):
    """The slice [-150:-20] of the documents in id order, and a split at 0.8 of all characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    total = d.agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))
    r = running(ranked(d, [F.col("doc_id")], "k"), [F.col("doc_id")], F.col("n_chars")).crossJoin(F.broadcast(total))  # one row
    return r.select("doc_id", F.col("k").between(F.col("n") - 149, F.col("n") - 20).alias("in_slice"), (F.col("run") <= F.floor(F.col("total") * 0.8)).alias("left_side"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, i, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS start FROM w WHERE suffix(w, '.'))
SELECT doc_id, count(*) AS spans, max(i - start)::BIGINT AS longest, sum((i - start) * (i - start))::BIGINT AS squares FROM b GROUP BY 1""")
def end_marked_spans(spark, sf_dir):
    """Spans of a stream that end at a mark: words up to one with a full stop. A fold over the row, without a shuffle of words."""
    words = F.split("text", " ")
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.endswith("."), i + 1)), lambda x: x.isNotNull())
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", ends.alias("e")).where(F.size("e") > 0)
    spans = F.zip_with("e", F.concat(F.array(F.lit(0)), F.slice("e", F.lit(1), F.size("e") - 1)), lambda a, b: (a - b).cast("long"))
    d = d.select("doc_id", spans.alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("spans"), F.array_max("s").alias("longest"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("squares"))


@query("SELECT doc_id, start, least(n_chars - start, 1000)::BIGINT AS n, start = 0 AS kept_if_truncated FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars, 1), 1000)) AS start FROM documents)")
def long_fragments(spark, sf_dir):
    """Documents cut into pieces of 1,000; with truncation instead only the first piece stays."""
    return ops.fragments(table(spark, sf_dir, "documents"), "n_chars", 1000).select("doc_id", "start", "n", (F.col("start") == 0).alias("kept_if_truncated"))


@query()  # each bin depends on all before it; tested against a plain walk and the published goldens
def best_fit_packs(spark, sf_dir):
    """Pieces of documents packed longest first into sequences of 1,000, source by source."""
    pieces = ops.fragments(table(spark, sf_dir, "documents").where("n_chars > 0"), "n_chars", 1000)
    return ops.best_fit_decreasing(pieces, 1000, "source", ("doc_id", "start"))


@query("""WITH b AS (SELECT doc_id, n_chars, CASE WHEN n_chars >= 32 THEN least(11, floor(log2(n_chars)))::INT END AS e FROM documents), c AS (SELECT e, count(*) AS n FROM b WHERE e IS NOT NULL GROUP BY 1)
SELECT e AS exponent, n AS instances, n // (8192 // (1 << e)) AS batches, (n // (8192 // (1 << e))) * (8192 // (1 << e)) AS used FROM c""")
def length_curriculum(spark, sf_dir):
    """Documents by the power of two below their length, and how many batches of 8,192 each such bucket fills."""
    e = F.least(F.lit(11), F.floor(F.log2("n_chars"))).cast("int")
    c = table(spark, sf_dir, "documents").where("n_chars >= 32").groupBy(e.alias("exponent")).agg(F.count("*").alias("instances"))
    of = F.floor(F.lit(8192) / F.expr("shiftleft(1, exponent)"))
    return c.withColumn("batches", F.floor(F.col("instances") / of)).withColumn("used", F.col("batches") * of).select("exponent", "instances", "batches", "used")


@query(f"""WITH r AS (SELECT conv_id, turn, text, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS run, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, n FROM r WHERE run <= 600 OR k = 1""")
def prefix_budget(spark, sf_dir):
    """The first turns of a conversation within a budget of characters, one at least."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return r.withColumn("run", F.sum("n").over(w)).withColumn("k", F.row_number().over(w)).where("run <= 600 OR k = 1").select("conv_id", "turn", "n")


PORTIONS = {"src1": 0.5, "src2": 0.25}


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {CUT}, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM r WHERE k <= floor(n * CASE source WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 0.25 ELSE 0.1 END)""")
def portion_sample(spark, sf_dir):
    """A fixed share of each source, by a shuffled order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    share = F.lit(0.1)
    for k, v in PORTIONS.items():
        share = F.when(F.col("source") == k, v).otherwise(share)
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    return ranked(d, _order(), "k", "source").join(F.broadcast(sizes), "source").where(F.col("k") <= F.floor(F.col("n") * share)).select("doc_id", "source")


@query("""WITH c AS (SELECT n_chars, (n_chars + 511) // 512 AS chunks FROM documents WHERE n_chars > 0) SELECT chunks, count(*) AS docs, sum(n_chars)::BIGINT AS used, sum(chunks * 512 - n_chars)::BIGINT AS padding FROM c GROUP BY 1""")
def padded_chunks(spark, sf_dir):
    """Fixed chunks of 512 a document, and the padding that they need."""
    c = table(spark, sf_dir, "documents").where("n_chars > 0").select("n_chars", F.floor((F.col("n_chars") + 511) / 512).alias("chunks"))
    return c.groupBy("chunks").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("used"), F.sum(F.col("chunks") * 512 - F.col("n_chars")).alias("padding"))


@query("SELECT max(doc_id) AS largest, CASE WHEN max(doc_id) < 256 THEN 'uint8' WHEN max(doc_id) < 65536 THEN 'uint16' WHEN max(doc_id) < 4294967296 THEN 'uint32' ELSE 'uint64' END AS dtype FROM documents")
def smallest_dtype(spark, sf_dir):
    """The narrowest unsigned type that holds all ids."""
    top = table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("largest"))
    dtype = F.lit("uint64")
    for bits in (32, 16, 8):
        dtype = F.when(F.col("largest") < 2**bits, f"uint{bits}").otherwise(dtype)
    return top.withColumn("dtype", dtype)


