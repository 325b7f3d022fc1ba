"""Answer concentration on the driver's tables: lineitem's return flags stand for answers, odd lines for direct samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import concentration as ops
from ..streaming import resume
from .registry import query, table


def _sides(spark, sf_dir, *extra) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_returnflag").alias("answer"), (F.col("l_linenumber") % 2).alias("odd"), *extra)
    return rows.where("odd = 1"), rows.where("odd = 0")


def _classified(spark, sf_dir) -> DataFrame:
    return ops.classify(ops.framed_rates(*_sides(spark, sf_dir)))


D = """
WITH r AS (SELECT l_orderkey AS entry, l_returnflag AS answer, l_linenumber % 2 = 1 AS direct FROM lineitem),
c AS (SELECT entry, answer, count(*) AS n FROM r WHERE direct GROUP BY 1, 2),
m AS (SELECT entry, arg_min(answer, (-n, answer)) AS mode, max(n) / sum(n) AS dr, sum(n)::BIGINT AS n, count(*) AS n_distinct FROM c GROUP BY 1),
fc AS (SELECT entry, answer, count(*) AS n FROM r WHERE NOT direct GROUP BY 1, 2),
f AS (SELECT m.entry, mode, dr, coalesce(sum(CASE WHEN fc.answer = mode THEN fc.n ELSE 0 END) / sum(fc.n), 0.0) AS fr, coalesce(sum(fc.n), 0)::BIGINT AS n_framed FROM m LEFT JOIN fc ON m.entry = fc.entry GROUP BY 1, 2, 3),
k AS (SELECT *, dr * fr AS pi, CASE WHEN dr * fr > 0.4::DOUBLE THEN 'deep' WHEN dr > 0.65::DOUBLE THEN 'shallow' ELSE 'non_bias' END AS bias_type FROM f)
"""


@query(D + "SELECT entry, answer, n AS count, round(n / sum(n) OVER (PARTITION BY entry), 6) AS rate FROM c")
def answer_distribution(spark, sf_dir):
    return ops.distribution(_sides(spark, sf_dir)[0]).withColumn("rate", F.round("rate", 6))


@query(D + "SELECT entry, mode, round(dr, 6) AS dr, n, n_distinct FROM m")
def mode_rate(spark, sf_dir):
    return ops.modes(_sides(spark, sf_dir)[0]).withColumn("dr", F.round("dr", 6))


@query(D + """, p AS (SELECT entry, n, n / sum(n) OVER (PARTITION BY entry) AS p FROM c)
SELECT entry, round(-sum(p * log2(p)), 6) + 0.0 AS entropy_bits, round(-sum(p * log2(p)) / CASE WHEN sum(n) > 1 THEN log2(sum(n)) ELSE 1 END, 6) + 0.0 AS entropy_normalized FROM p GROUP BY 1""")
def entropy(spark, sf_dir):
    return ops.entropies(_sides(spark, sf_dir)[0])


@query(D + "SELECT entry, mode, round(dr, 6) AS dr, round(fr, 6) AS fr, n_framed FROM f")
def framed_rate(spark, sf_dir):
    return ops.framed_rates(*_sides(spark, sf_dir)).select("entry", "mode", F.round("dr", 6).alias("dr"), F.round("fr", 6).alias("fr"), "n_framed")


@query(D + """, x AS (SELECT fc.entry, fc.answer, fc.n, fc.n / sum(fc.n) OVER (PARTITION BY fc.entry) AS rate, mode FROM fc JOIN m ON fc.entry = m.entry)
SELECT entry, arg_min(answer, (-n, answer)) AS flip_target, round(max(rate), 6) AS flip_rate FROM x WHERE answer <> mode GROUP BY 1""")
def flip_target(spark, sf_dir):
    return ops.flip_targets(*_sides(spark, sf_dir))


@query(D + "SELECT entry, mode, round(dr, 6) AS dr, round(fr, 6) AS fr, round(pi, 6) AS pi, bias_type FROM k")
def classify_families(spark, sf_dir):
    return _classified(spark, sf_dir).select("entry", "mode", *[F.round(c, 6).alias(c) for c in ("dr", "fr", "pi")], "bias_type")


def _share(k: str) -> str:
    return f"round(100 * avg(CASE WHEN bias_type = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS {k}_pct"


SHARES = ", ".join(map(_share, ("deep", "shallow", "non_bias"))) + ", count(*) AS n"


@query(D + f"SELECT {SHARES} FROM k")
def class_breakdown(spark, sf_dir):
    return ops.breakdown(_classified(spark, sf_dir))


def _by_model(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey"), F.col("l_suppkey") % 4).alias("entry"), F.col("l_returnflag").alias("answer"), (F.col("l_linenumber") % 2).alias("odd"))
    return ops.classify(ops.framed_rates(rows.where("odd = 1"), rows.where("odd = 0"))).withColumn("model", F.substring_index("entry", "-", -1))


M = D.replace("l_orderkey AS entry", "l_orderkey || '-' || (l_suppkey % 4) AS entry")


@query(M + f"SELECT split_part(entry, '-', 2) AS model, {SHARES} FROM k GROUP BY 1")
def class_share_by_model(spark, sf_dir):
    return ops.breakdown(_by_model(spark, sf_dir), "model")


@query(M + f", s AS (SELECT split_part(entry, '-', 2) AS model, {SHARES} FROM k GROUP BY 1) SELECT round(avg(deep_pct), 5) AS deep_pct, round(avg(shallow_pct), 5) AS shallow_pct, count(*) AS models FROM s")
def mean_class_share(spark, sf_dir):
    s = ops.breakdown(_by_model(spark, sf_dir), "model")
    return s.agg(F.round(F.avg("deep_pct"), 5).alias("deep_pct"), F.round(F.avg("shallow_pct"), 5).alias("shallow_pct"), F.count("*").alias("models"))


@query(D + """, t AS (SELECT i / 100.0::DOUBLE AS t FROM range(50, 87) x(i))
SELECT t, round(100 * avg(CASE WHEN pi > t * t THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS deep_pct, round(100 * avg(CASE WHEN dr > t AND NOT pi > t * t THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS shallow_pct FROM k, t GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    return ops.sweep(_classified(spark, sf_dir))


@query(D + """SELECT len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: e::DOUBLE <= pi))::INT AS bin, count(*) AS n, round(avg(pi), 6) AS mean_pi, round(avg(fr), 6) AS mean_fr FROM k GROUP BY 1""")
def pi_bins(spark, sf_dir):
    return ops.pi_bins(_classified(spark, sf_dir))


@query(D + "SELECT round(corr(pi, CASE WHEN fr > 0 THEN 1.0 ELSE 0.0 END), 5) AS r, round(avg(CASE WHEN pi <= 0.4::DOUBLE THEN fr END), 6) AS low, round(avg(CASE WHEN pi > 0.4::DOUBLE THEN fr END), 6) AS high, round(avg(CASE WHEN round(pi, 6) < 0.1::DOUBLE THEN fr END), 6) AS first_bin, round(avg(CASE WHEN round(pi, 6) >= 0.8::DOUBLE THEN fr END), 6) AS last_bin FROM k WHERE dr > 0.65::DOUBLE")
def pi_match(spark, sf_dir):
    k = _classified(spark, sf_dir).where(F.col("dr") > ops.BIASED)
    mean = lambda c, name: F.round(F.avg(F.when(c, F.col("fr"))), 6).alias(name)
    pi, r = F.col("pi"), F.round("pi", 6)
    return k.agg(F.round(F.corr("pi", F.when(F.col("fr") > 0, 1.0).otherwise(0.0)), 5).alias("r"), mean(pi <= 0.4, "low"), mean(pi > 0.4, "high"), mean(r < 0.1, "first_bin"), mean(r >= 0.8, "last_bin"))


@query("""WITH r AS (SELECT l_orderkey AS entry, l_partkey % 2 AS side, l_returnflag AS answer, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT entry, side, arg_min(answer, (-n, answer)) AS mode, max(n) / sum(n) AS dr FROM r GROUP BY 1, 2)
SELECT count(*) AS n, sum((a.mode = b.mode)::INT)::BIGINT AS same, round(avg((a.mode = b.mode)::INT::DOUBLE), 6) AS rate FROM m a JOIN m b USING (entry) WHERE a.side = 0 AND b.side = 1 AND a.dr > 0.65::DOUBLE""")
def cross_model_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_returnflag").alias("answer"), (F.col("l_partkey") % 2).alias("side"))
    a, b = ops.modes(rows.where("side = 0")).where(F.col("dr") > ops.BIASED), ops.modes(rows.where("side = 1")).select("entry", F.col("mode").alias("other"))
    same = (F.col("mode") == F.col("other")).cast("int")
    return a.join(b, "entry").agg(F.count("*").alias("n"), F.sum(same).alias("same"), F.round(F.avg(same.cast("double")), 6).alias("rate"))


@query("""WITH b AS (SELECT event_type AS answer, sum((user_id % 2 = 0)::INT) AS ca, sum((user_id % 2 = 1)::INT) AS cb FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY ca + cb DESC, answer) AS r FROM b)
SELECT CASE WHEN r <= 3 THEN answer ELSE '(other)' END AS label, sum(ca)::BIGINT AS count_a, sum(cb)::BIGINT AS count_b FROM r GROUP BY 1""")
def shared_axis(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("answer"), "user_id")
    return ops.shared_axis(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"))


@query("""WITH t AS (SELECT o_orderkey AS entry, i AS replicate FROM orders, range(1, 8) x(i)), d AS (SELECT l_orderkey AS entry, l_linenumber AS replicate FROM lineitem WHERE l_linestatus <> 'F')
SELECT entry, replicate::INT AS replicate FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.entry = t.entry AND d.replicate = t.replicate)""")
def resume_remaining(spark, sf_dir):
    return resume.remaining(*_progress(spark, sf_dir))


def _progress(spark, sf_dir):
    want = resume.tasks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry")), 7)
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("replicate"), F.when(F.col("l_linestatus") == "F", "failed").alias("error"))
    return want, done


@query("""WITH p AS (SELECT l_orderkey AS entry, count(DISTINCT l_linenumber) AS present FROM lineitem WHERE l_linestatus <> 'F' AND l_linenumber BETWEEN 1 AND 7 GROUP BY 1)
SELECT o_orderkey AS entry, 7::BIGINT AS expected, coalesce(present, 0) AS present FROM orders LEFT JOIN p ON entry = o_orderkey WHERE coalesce(present, 0) < 7""")
def completeness_report(spark, sf_dir):
    return resume.completeness(*_progress(spark, sf_dir))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, round(max(n) / 30.0, 6)::DOUBLE AS top1, round(1 - max(n) / 30.0::DOUBLE, 6) AS score, CASE WHEN max(n) / 30.0::DOUBLE > 0.65 THEN 'FAILURE' WHEN max(n) / 30.0::DOUBLE >= 0.5 THEN 'PARTIAL' ELSE 'OK' END AS band FROM c GROUP BY 1""")
def top1_share_band(spark, sf_dir):
    top = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg((F.max("count") / 30.0).alias("t"))
    band = F.when(F.col("t") > 0.65, "FAILURE").when(F.col("t") >= 0.5, "PARTIAL").otherwise("OK")
    return top.select("user_id", F.round("t", 6).alias("top1"), F.round(1 - F.col("t"), 6).alias("score"), band.alias("band"))


@query("SELECT event_id, event_type || '_' || user_id || '_' || row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS uid FROM events")
def occurrence_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("_", "event_type", "user_id", n).alias("uid"))


@query("""WITH a AS (SELECT n_regionkey AS entity, list(n_name ORDER BY n_name) AS items FROM nation GROUP BY 1)
SELECT entity, i::INT AS i, items[(i % len(items)) + 1] AS answer FROM a, range(30) x(i)""")
def cyclic_pad(spark, sf_dir):
    a = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("entity")).agg(F.array_sort(F.collect_list("n_name")).alias("items"))
    return a.select("entity", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"), "items").select("entity", "i", F.element_at("items", (F.col("i") % F.size("items") + 1).cast("int")).alias("answer"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, avg(l_extendedprice) OVER w AS m, stddev_pop(l_extendedprice) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, round((x - m) / (s + 1e-8), 4) + 0.0 AS advantage FROM g WHERE s > 0.000001""")
def group_advantage(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.avg("l_extendedprice").over(w).alias("m"), F.stddev_pop("l_extendedprice").over(w).alias("s"))
    return g.where("s > 0.000001D").select("l_orderkey", "l_linenumber", (F.round((F.col("x") - F.col("m")) / (F.col("s") + 1e-8), 4) + 0.0).alias("advantage"))


@query("SELECT l_orderkey, arg_min(l_linenumber, (-l_extendedprice, l_linenumber)) AS best, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) AS worst FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def best_worst_of_n(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(-F.col("l_extendedprice"), "l_linenumber")).alias("b"), F.min(F.struct("l_extendedprice", "l_linenumber")).alias("w"), F.count("*").alias("n"))
    return g.where("n > 1").select("l_orderkey", F.col("b.l_linenumber").alias("best"), F.col("w.l_linenumber").alias("worst"))


@query("""WITH m AS (SELECT l_orderkey, l_suppkey % 3 AS response, avg(l_quantity) AS score FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, max(score) AS hi, min(score) AS lo, arg_min(response, (-score, response)) AS chosen, arg_min(response, (score, response)) AS rejected, count(*) AS n FROM m GROUP BY 1)
SELECT l_orderkey, chosen, rejected, round(hi - lo, 6) AS margin FROM g WHERE n >= 2 AND hi - lo > 1""")
def binarize_margin(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("response")).agg(F.avg("l_quantity").alias("score"))
    g = m.groupBy("l_orderkey").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.min(F.struct(-F.col("score"), "response")).alias("c"), F.min(F.struct("score", "response")).alias("r"), F.count("*").alias("n"))
    return g.where("n >= 2 and hi - lo > 1").select("l_orderkey", F.col("c.response").alias("chosen"), F.col("r.response").alias("rejected"), F.round(F.col("hi") - F.col("lo"), 6).alias("margin"))


@query("""WITH v AS (SELECT l_orderkey, l_shipmode_ AS vote, count(*) AS n FROM (SELECT l_orderkey, l_linestatus || l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1, 2)
SELECT l_orderkey, arg_min(vote, (-n, vote)) AS winner, max(n) AS votes, count(*) AS options FROM v GROUP BY 1""")
def majority_vote(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_linestatus", "l_returnflag").alias("vote")).count()
    return v.groupBy("l_orderkey").agg(F.min(F.struct(-F.col("count"), "vote")).alias("b"), F.max("count").alias("votes"), F.count("*").alias("options")).select("l_orderkey", F.col("b.vote").alias("winner"), "votes", "options")


@query("SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 3) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 3) AS view FROM events GROUP BY 1")
def pivot_ratings(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return p.select("user_id", F.round("click", 3).alias("click"), F.round("view", 3).alias("view"))
