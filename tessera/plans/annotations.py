"""Annotation agreement, exact tests and ordered folds over small groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import query, table

SPAN, DISCOUNT = 400, 0.99 * 0.95


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 9, taken back by eight factors; right to about 1e-12."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    steps = F.ln(x - 1)
    for i in range(2, 9):
        steps = steps + F.ln(x - i)
    return series - steps


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table: the sum over tables of the same margins that are no likelier, within a relative 1e-7."""
    row, col, n = a + b, a + c, a + b + c + d
    margins = log_factorial(row) + log_factorial(c + d) + log_factorial(col) + log_factorial(b + d) - log_factorial(n)
    chance = lambda k: F.exp(margins - log_factorial(k) - log_factorial(row - k) - log_factorial(col - k) - log_factorial(n - row - col + k))
    all_ = F.transform(F.sequence(F.greatest(F.lit(0).cast("long"), row + col - n), F.least(row, col)), chance)
    return F.least(F.lit(1.0), F.aggregate(F.filter(all_, lambda p: p <= chance(a) * (1 + 1e-7)), F.lit(0.0), lambda s, p: s + p))


@query("""WITH t AS (SELECT l_suppkey, sum((l_returnflag = 'R' AND l_linestatus = 'F')::INT)::BIGINT AS a, sum((l_returnflag = 'R' AND l_linestatus <> 'F')::INT)::BIGINT AS b,
  sum((l_returnflag <> 'R' AND l_linestatus = 'F')::INT)::BIGINT AS c, sum((l_returnflag <> 'R' AND l_linestatus <> 'F')::INT)::BIGINT AS d FROM lineitem GROUP BY 1),
k AS (SELECT *, unnest(generate_series(greatest(0, a + a + b + c - (a + b + c + d)), least(a + b, a + c))) AS k FROM t),
p AS (SELECT *, exp(lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(k+1) - lgamma(a+b-k+1) - lgamma(a+c-k+1) - lgamma(d-a+k+1)) AS p FROM k),
o AS (SELECT l_suppkey, p AS seen FROM p WHERE k = a)
SELECT l_suppkey, a, b, c, d, round(least(1.0, sum(p) FILTER (WHERE p <= seen * (1 + 1e-7))), 6)::DOUBLE AS p FROM p JOIN o USING (l_suppkey) GROUP BY 1, 2, 3, 4, 5""")
def fisher_two_sided(spark, sf_dir):
    hit, late = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    n = lambda c: F.sum(c.cast("int"))
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(n(hit & late).alias("a"), n(hit & ~late).alias("b"), n(~hit & late).alias("c"), n(~hit & ~late).alias("d"))
    return t.withColumn("p", F.round(fisher_exact(*(F.col(x) for x in "abcd")), 6))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber AS t, row_number() OVER w AS i, l_quantity + 0.99 * coalesce(lead(l_tax) OVER w, 0) - l_tax AS delta FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax))
SELECT x.l_orderkey, x.t, round(sum(y.delta * pow({DISCOUNT}, y.i - x.i)), 4)::DOUBLE AS advantage FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND y.i >= x.i GROUP BY x.l_orderkey, x.t, x.i""")
def advantage_recursion(spark, sf_dir):
    """A[t] = delta[t] + discount * A[t + 1], folded from the last step of each order."""
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("r"), F.col("l_tax").alias("v"))))).alias("s"))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v"), F.expr("cast(array() as array<struct<t: int, a: double>>)").alias("out"))

    def step(acc, x):
        a = (x["r"] + 0.99 * acc["v"] - x["v"] + F.lit(DISCOUNT) * acc["a"]).cast("double")
        return F.struct(a.alias("a"), x["v"].cast("double").alias("v"), F.concat(acc["out"], F.array(F.struct(x["t"].alias("t"), a.alias("a")))).alias("out"))

    got = steps.select("l_orderkey", F.explode(F.aggregate("s", start, step)["out"]).alias("x"))
    return got.select("l_orderkey", F.col("x.t").alias("t"), F.round("x.a", 4).alias("advantage"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, i, n AS filled, 0::BIGINT AS pack FROM t WHERE i = 1 UNION ALL
 SELECT t.conv_id, t.turn, t.i, CASE WHEN p.filled + t.n > {SPAN} THEN t.n ELSE p.filled + t.n END, p.pack + (p.filled + t.n > {SPAN})::INT FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1)
SELECT conv_id, turn, pack FROM p""")
def next_fit_packs(spark, sf_dir):
    """Turns in order; a pack is closed when the next turn would exceed the span, and a longer turn has a pack of its own."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("pack"), F.expr("cast(array() as array<struct<turn: bigint, pack: bigint>>)").alias("out"))

    def step(acc, x):
        full = (F.size(acc["out"]) > 0) & (acc["filled"] + x["n"] > SPAN)
        pack = acc["pack"] + full.cast("long")
        return F.struct(F.when(full, x["n"]).otherwise(acc["filled"] + x["n"]).alias("filled"), pack.alias("pack"), F.concat(acc["out"], F.array(F.struct(x["turn"].alias("turn"), pack.alias("pack")))).alias("out"))

    return turns.select("conv_id", F.explode(F.aggregate("s", start, step)["out"]).alias("x")).select("conv_id", "x.turn", "x.pack")


@query("""WITH a AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT count(*) AS instances, round(avg((f[1] = 'A')::INT), 6) AS accepted, round(avg((f[1] = 'R')::INT), 6) AS rejected, round(avg((f[1] = 'N')::INT), 6) AS tied, sum((len(f) > 1)::INT)::BIGINT AS twice,
 round(avg((f[1] = f[2])::INT) FILTER (WHERE len(f) > 1), 6) AS exact,
 round(avg(CASE WHEN f[1] = f[2] THEN 1.0::DOUBLE WHEN f[1] = 'N' OR f[2] = 'N' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE len(f) > 1), 6) AS relaxed FROM a""")
def annotator_agreement(spark, sf_dir):
    """Win rates of first annotations; agreement of the first two, half where one alone is a tie."""
    f = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(f.alias("f")).select(F.col("f")[0].alias("x"), F.get("f", F.lit(1)).alias("y"), (F.size("f") > 1).alias("two"))
    share = lambda v: F.round(F.avg((F.col("x") == v).cast("int")), 6)
    same, tie = F.col("x") == F.col("y"), (F.col("x") == "N") | (F.col("y") == "N")
    return a.agg(
        F.count("*").alias("instances"), share("A").alias("accepted"), share("R").alias("rejected"), share("N").alias("tied"), F.sum(F.col("two").cast("int")).alias("twice"),
        F.round(F.avg(F.when(F.col("two"), same.cast("int"))), 6).alias("exact"), F.round(F.avg(F.when(F.col("two"), F.when(same, 1.0).when(tie, 0.5).otherwise(0.0))), 6).alias("relaxed"),
    )
