"""Corpus work: quality filters, decontamination, mixing, packing, verifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import EDGE_AFTER, EDGE_BEFORE
from ..operators import grams
from ..operators.ordered import running
from .registry import query, table


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), c AS (SELECT doc_id, trim(l) AS item, count(*) AS n FROM p WHERE length(trim(l)) >= 10 GROUP BY 1, 2)
SELECT doc_id, count(*) AS repeated_items, max(n) AS most FROM c WHERE n > 1 GROUP BY 1""")
def line_repeats(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.trim("l").alias("item")).where(F.length("item") >= 10)
    return p.groupBy("doc_id", "item").agg(F.count("*").alias("n")).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("repeated_items"), F.max("n").alias("most"))


def _repeats(spark, sf_dir, mark, least):
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", mark)).alias("l")).select("doc_id", F.trim("l").alias("item")).where(F.length("item") >= least)
    return p.groupBy("doc_id", "item").agg(F.count("*").alias("n")).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("repeated_items"), F.max("n").alias("most"))


REPEATS = """WITH p AS (SELECT doc_id, trim(unnest(string_split(text, {mark}))) AS item FROM documents), c AS (SELECT doc_id, item, count(*) AS n FROM p WHERE length(item) >= {least} GROUP BY 1, 2)
SELECT doc_id, count(*) AS repeated_items, max(n) AS most FROM c WHERE n > 1 GROUP BY 1"""


@query(REPEATS.format(mark="chr(10)", least=5))
def line_repeats_all(spark, sf_dir):
    """Lines of 5 code points and more, as the reference takes them; line_repeats takes those of 10."""
    return _repeats(spark, sf_dir, "\n", 5)


@query(REPEATS.format(mark="chr(10) || chr(10)", least=10))
def paragraph_repeats(spark, sf_dir):
    return _repeats(spark, sf_dir, "\n\n", 10)


@query(r"""WITH p AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS island FROM p WHERE length(l) >= 10)
SELECT doc_id, max(n) AS longest_run FROM (SELECT doc_id, l, island, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1 HAVING max(n) > 1""")
def consecutive_repeats(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select("doc_id", "i", F.trim("x").alias("l")).where(F.length("l") >= 10)
    g = p.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "l").orderBy("i")))
    return g.groupBy("doc_id", "l", "island").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("longest_run")).where("longest_run > 1")


@query(r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM d)
SELECT doc_id, count(*) AS repeated, max(n) AS most FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""")
def ngram_repeats(spark, sf_dir):
    return grams.repeats(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[äöüß]')) AS hits, round(len(regexp_extract_all(text, '[äöüß]')) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0 AND len(regexp_extract_all(text, '[äöüß]')) / length(text) >= 0.01")
def script_ratio(spark, sf_dir):
    hits = F.regexp_count("text", F.lit("[äöüß]")).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"), (hits / F.nullif(F.length("text"), F.lit(0))).alias("r")).where("r >= 0.01D")
    return d.select("doc_id", "hits", F.round("r", 6).alias("ratio"))


@query("SELECT d.doc_id, lang FROM documents d WHERE lower(lang) = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def toxic_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lower(lang) = 'en'").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(r"SELECT conv_id, bool_or(regexp_matches(lower(text), '\b(openai|chatgpt|claude|gemini|the)\b')) AS named, sum(len(regexp_extract_all(text, '(19|20)[0-9]{2}')))::BIGINT AS years FROM conversations GROUP BY 1")
def provider_mentions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.bool_or(F.lower("text").rlike(f"{EDGE_BEFORE}(openai|chatgpt|claude|gemini|the){EDGE_AFTER}")).alias("named"), F.sum(F.regexp_count("text", F.lit("(19|20)[0-9]{2}")).cast("long")).alias("years"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s) <> '')) AS sentences, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS lines, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^\s*[-*]'))) AS bullets FROM documents")
def structure_counts(spark, sf_dir):
    lines = F.split("text", "\n")
    n = lambda a: F.size(a).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(F.filter(F.split("text", "[.!?]+"), lambda s: F.trim(s) != "")).alias("sentences"), n(F.filter(lines, lambda s: F.trim(s) != "")).alias("lines"), n(F.filter(lines, lambda s: s.rlike(r"^\s*[-*]"))).alias("bullets"))


SPLIT = r"""[ ,.?!:;()"\-\n\\]"""
GRAMS = f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{SPLIT}'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '{SPLIT}'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM d),
bg AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g, unnest(range(1, len(w) - 6)) AS s, len(w) AS n FROM b),
last AS (SELECT item_id, g, max(s) AS s, any_value(n) AS n FROM bg GROUP BY 1, 2),
hit AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(s, s + 8)) AS p FROM dg JOIN last USING (g)),
sc AS (SELECT doc_id, item_id, count(*) / any_value(n) AS score FROM hit GROUP BY 1, 2)
"""


def _scores(spark, sf_dir):
    """doc_id, item_id, score: the share of an item's token places that eight-word runs shared with the document cover."""
    found = grams.shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 8, SPLIT)
    hit = found.select("doc_id", "item_id", "n", F.explode(F.sequence("s", F.col("s") + 7)).alias("p")).distinct()
    return hit.groupBy("doc_id", "item_id").agg((F.count("*") / F.first("n")).alias("score"))


@query(GRAMS + "SELECT doc_id, item_id, round(score, 6) AS score FROM sc")
def ngram_decontaminate(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(GRAMS + "SELECT item_id, round(max(score), 6) AS best, count(*) AS docs, max(score) > 0.5 AS contaminated FROM sc GROUP BY 1")
def decontam_scores(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("item_id").agg(F.round(F.max("score"), 6).alias("best"), F.count("*").alias("docs"), (F.max("score") > 0.5).alias("contaminated"))


@query(GRAMS + ", bad AS (SELECT DISTINCT doc_id FROM sc WHERE score > 0.5) SELECT count(*) AS n, (SELECT count(*) FROM bad) AS removed, round(100.0 * (count(*) - (SELECT count(*) FROM bad)) / count(*), 6)::DOUBLE AS kept_pct FROM documents")
def decontam_keep_rate(spark, sf_dir):
    bad = _scores(spark, sf_dir).where(F.col("score") > 0.5).select("doc_id").distinct().withColumn("bad", F.lit(1))
    j = table(spark, sf_dir, "documents").select("doc_id").join(bad, "doc_id", "left")
    return j.agg(F.count("*").alias("n"), F.count("bad").alias("removed"), F.round(100.0 * (F.count("*") - F.count("bad")) / F.count("*"), 6).alias("kept_pct"))


@query("""WITH s AS (SELECT source, sum(n_chars)::BIGINT AS have FROM documents GROUP BY 1), t AS (SELECT *, 100000 * have / sum(have) OVER () AS ideal FROM s), f AS (SELECT source, floor(ideal)::BIGINT AS base, ideal - floor(ideal) AS r FROM t)
SELECT source, base + CASE WHEN row_number() OVER (ORDER BY round(r, 9) DESC, source DESC) <= 100000 - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM f""")
def mixture_apportion(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("have"))
    every = Window.partitionBy()  # one row a source
    f = s.withColumn("ideal", 100000 * F.col("have") / F.sum("have").over(every)).select("source", F.floor("ideal").alias("base"), (F.col("ideal") - F.floor("ideal")).alias("r"))
    rank = F.row_number().over(Window.orderBy(F.round("r", 9).desc(), F.desc("source")))
    return f.withColumn("k", rank).select("source", (F.col("base") + F.when(F.col("k") <= 100000 - F.sum("base").over(every), 1).otherwise(0)).alias("take"))


@query("""WITH h AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS run FROM documents)
SELECT doc_id, source, run::BIGINT AS run FROM h WHERE run <= 20000""")
def token_sample(spark, sf_dir):
    order = [(F.col("doc_id") * 2654435761) % 4294967296, F.col("doc_id")]
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return running(d, order, F.col("n_chars"), "run", "source").where("run <= 20000").select("doc_id", "source", "run")


@query("""WITH r AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS start FROM documents), t AS (SELECT source, floor(sum(n_chars) / 4096)::BIGINT AS chunks FROM documents GROUP BY 1),
x AS (SELECT doc_id, source, unnest(range((start // 4096)::BIGINT, ((start + n_chars - 1) // 4096)::BIGINT + 1)) AS chunk, start, n_chars FROM r WHERE n_chars > 0)
SELECT doc_id, x.source, chunk, (least(start + n_chars, (chunk + 1) * 4096) - greatest(start, chunk * 4096))::BIGINT AS length FROM x JOIN t USING (source) WHERE chunk < chunks""")
def concat_chunk(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "source", "n_chars")
    d = running(d, [F.col("doc_id")], F.col("n_chars"), "run", "source").withColumn("start", F.col("run") - F.col("n_chars"))
    t = d.groupBy("source").agg(F.floor(F.sum("n_chars") / 4096).alias("chunks"))
    x = d.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / 4096), F.floor((F.col("start") + F.col("n_chars") - 1) / 4096)))).join(t, "source").where("chunk < chunks")
    return x.select("doc_id", "source", "chunk", (F.least(F.col("start") + F.col("n_chars"), (F.col("chunk") + 1) * 4096) - F.greatest("start", F.col("chunk") * 4096)).alias("length"))


@query("SELECT doc_id, p::INT AS exponent, (n_chars >> (p + 1)) << (p + 1) AS start FROM documents, range(5, 12) x(p) WHERE (n_chars % 4096) & (1 << p) <> 0")
def power_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(5), F.lit(11))).alias("exponent"))
    bit = F.expr("shiftleft(1L, exponent)")
    return d.where(F.col("n_chars").bitwiseAND(F.lit(4095)).bitwiseAND(bit) != 0).select("doc_id", "exponent", F.expr("shiftleft(shiftright(n_chars, exponent + 1), exponent + 1)").alias("start"))


def capped_powers(rows, length, low, high):
    """doc_id, exponent, start: pieces of 2^high characters first, then one for each bit of the rest from 2^low on, largest first."""
    whole = F.expr(f"transform(slice(sequence(0L, shiftright({length}, {high})), 1, int(shiftright({length}, {high}))), i -> struct({high} AS exponent, shiftleft(i, {high}) AS start))")
    bits = F.expr(f"transform(filter(sequence({low}, {high} - 1), p -> ({length} & shiftleft(1L, p)) <> 0), p -> struct(p AS exponent, shiftleft(shiftright({length}, p + 1), p + 1) AS start))")
    return rows.select("doc_id", F.explode(F.concat(whole, bits)).alias("x")).select("doc_id", "x.exponent", "x.start")


@query("""SELECT doc_id, 11 AS exponent, unnest(range(n_chars // 2048)) * 2048 AS start FROM documents
UNION ALL SELECT doc_id, p::INT AS exponent, (n_chars >> (p + 1)) << (p + 1) AS start FROM documents, range(5, 11) x(p) WHERE (n_chars & (1 << p)) <> 0""")
def power_pieces(spark, sf_dir):
    """All of a document: powers above the cap of 2^11 become pieces of the cap. power_buckets is its part of n_chars % 4096."""
    return capped_powers(table(spark, sf_dir, "documents"), "n_chars", 5, 11)


@query("""WITH c AS (SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1)
SELECT source, docs, chars, round(100.0 * docs / sum(docs) OVER (), 6)::DOUBLE AS docs_pct, round(100.0 * chars / sum(chars) OVER (), 6)::DOUBLE AS chars_pct FROM c""")
def source_token_stats(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    pct = lambda x: F.round(100.0 * F.col(x) / F.sum(x).over(Window.partitionBy()), 6).alias(x + "_pct")
    return c.select("source", "docs", "chars", pct("docs"), pct("chars"))


@query("""SELECT count(*) AS n, round(avg(n_chars), 5) AS mean, round(stddev_samp(n_chars), 5) AS std, min(n_chars) AS low, max(n_chars) AS high, """ + ", ".join(f"sum((n_chars > {k})::INT)::BIGINT AS over_{k}" for k in (512, 1024, 2048, 4096)) + " FROM documents")
def length_summary(spark, sf_dir):
    over = [F.sum((F.col("n_chars") > k).cast("int")).alias(f"over_{k}") for k in (512, 1024, 2048, 4096)]
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 5).alias("mean"), F.round(F.stddev_samp("n_chars"), 5).alias("std"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), *over)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '[-+]?[0-9]*\.[0-9]+|[0-9]+') AS n FROM documents) SELECT doc_id, n[-1] AS last_number FROM t WHERE len(n) > 0""")
def last_number(spark, sf_dir):
    n = F.regexp_extract_all(F.regexp_replace("text", "([0-9]),([0-9])", "$1$2"), F.lit(r"([-+]?[0-9]*\.[0-9]+|[0-9]+)"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where(F.size("n") > 0).select("doc_id", F.element_at("n", -1).alias("last_number"))


@query(r"""WITH a AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations), c AS (SELECT conv_id, turn, w, count(*) AS n FROM a GROUP BY 1, 2, 3), t AS (SELECT conv_id, turn, sum(n) AS total FROM c GROUP BY 1, 2),
o AS (SELECT x.conv_id, x.turn, sum(least(x.n, y.n)) AS o FROM c x JOIN c y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 AND x.w = y.w GROUP BY 1, 2)
SELECT o.conv_id, o.turn, round(2 * o / (p.total + q.total), 6) AS f1 FROM o JOIN t p ON p.conv_id = o.conv_id AND p.turn = o.turn JOIN t q ON q.conv_id = o.conv_id AND q.turn = o.turn + 1""")
def token_f1(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n"))
    t = c.groupBy("conv_id", "turn").agg(F.sum("n").alias("total"))
    y = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "w", F.col("n").alias("m"))
    o = c.join(y, ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("o"))
    q = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("total").alias("total2"))
    return o.join(t, ["conv_id", "turn"]).join(q, ["conv_id", "turn"]).select("conv_id", "turn", F.round(2 * F.col("o") / (F.col("total") + F.col("total2")), 6).alias("f1"))


@query(r"""SELECT doc_id, contains(text, 'the') AS keyword, len(regexp_extract_all(lower(text), '\bthe\b')) AS frequency, length(text) - length(replace(lower(text), 'e', '')) AS letters, NOT contains(text, ',') AS no_commas, text = lower(text) AS is_lower, text = upper(text) AS is_upper, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(text, '\*[^*\n]+\*')) AS highlights FROM documents WHERE regexp_full_match(text, '[\x00-\x7F]*')""")
def constraint_checks(spark, sf_dir):
    t = F.col("text")
    n = lambda c: c.cast("long")
    return table(spark, sf_dir, "documents").where(t.rlike(r"\A[\x00-\x7F]*\z")).select(
        "doc_id", t.contains("the").alias("keyword"), n(F.regexp_count(F.lower(t), F.lit(r"\bthe\b"))).alias("frequency"), n(F.length(t) - F.length(F.replace(F.lower(t), F.lit("e"), F.lit("")))).alias("letters"), (~t.contains(",")).alias("no_commas"),
        (t == F.lower(t)).alias("is_lower"), (t == F.upper(t)).alias("is_upper"), n(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))).alias("words"), n(F.regexp_count(t, F.lit(r"\*[^*\n]+\*"))).alias("highlights"),
    )


#: What Python's str.split() splits at, and its \w; Java's and DuckDB's own classes are others.
SPACE, WORD = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", r"[\p{L}\p{N}_]"


@query()
def constraint_checks_all(spark, sf_dir):
    """constraint_checks of every document, whatever its characters; a null text is empty. No SQL: case mappings differ (upper of \u00df)."""
    t = F.coalesce("text", F.lit(""))
    n = lambda c: c.cast("long")
    count = lambda pattern: n(F.regexp_count(t, F.lit(pattern)))
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.contains("the").alias("keyword"), count(f"(?<!{WORD})[Tt][Hh][Ee](?!{WORD})").alias("frequency"), count("[Ee]").alias("letters"), (~t.contains(",")).alias("no_commas"),
        (t == F.lower(t)).alias("is_lower"), (t == F.upper(t)).alias("is_upper"), n(F.size(F.filter(F.split(t, SPACE), lambda w: w != ""))).alias("words"), count(r"\*[^*\n]+\*").alias("highlights"),
    )


@query("SELECT doc_id, round(1 - abs(length(text) - 1500) / 1500.0::DOUBLE, 6) AS reward, round(CASE WHEN length(text) >= 1500 THEN 1.0 ELSE length(text) / 1500.0::DOUBLE END, 6) AS up_to FROM documents")
def length_reward(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(1 - F.abs(n - 1500) / 1500.0, 6).alias("reward"), F.round(F.when(n >= 1500, 1.0).otherwise(n / 1500.0), 6).alias("up_to"))
