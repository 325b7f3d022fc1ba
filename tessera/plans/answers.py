"""Answer forms, matches and clusters on the driver's tables: part names and their variants stand for free-text answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as fn
from ..functions.text import NUMBER_WORDS, STOPWORDS, SUFFIXES
from ..operators import clusters as ops
from .registry import query, table

VARIANT = """CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || 's' WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN '1st ' || p_name || ' of 7'
 WHEN 4 THEN 'The ' || p_name || ' expansions' ELSE 'other thing' END"""


def _variant():
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    return (
        F.when(k == 0, F.concat(F.upper(n), F.lit("s"))).when(k == 1, F.replace(n, F.lit(" "), F.lit("-"))).when(k == 2, F.split_part(n, F.lit(" "), F.lit(1)))
        .when(k == 3, F.concat(F.lit("1st "), n, F.lit(" of 7"))).when(k == 4, F.concat(F.lit("The "), n, F.lit(" expansions"))).otherwise("other thing")
    )


def _map(table_: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table_.items()) + "}"


def _lemma(t: str) -> str:
    return f"""CASE WHEN length({t}) > 4 AND suffix({t}, 'ies') THEN left({t}, -3) || 'y' WHEN length({t}) > 4 AND regexp_matches({t}, '(ss|sh|ch|x|z)es$') THEN left({t}, -2)
 WHEN length({t}) > 3 AND suffix({t}, 's') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN left({t}, -1) ELSE {t} END"""


NUMBERS = {str(i): w for i, w in enumerate(fn.COUNT_WORDS)} | fn.ORDINALS


def _words(text: str) -> str:
    form = f"CASE WHEN regexp_matches(t, '^[a-z]+$') THEN coalesce({_map(fn.VERBS)}[{_lemma('t')}], {_lemma('t')}) ELSE coalesce({_map(NUMBERS)}[t], t) END"
    return f"list_transform(regexp_extract_all(lower(regexp_replace({text}, '[-_]', ' ', 'g')), '{fn.ANSWER_TOKEN}'), lambda t: {form})"


def _stem(t: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix({t}, '{s}') AND length({t}) >= {len(s) + 4} THEN left({t}, -{len(s)})" for s in SUFFIXES) + f" ELSE {t} END"


def _canonical(text: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({text}), '[a-zA-Z0-9]+'), lambda t: t NOT IN ({', '.join(repr(w) for w in STOPWORDS)}))"
    return f"coalesce(nullif(array_to_string(list_transform({kept}, lambda t: CASE WHEN regexp_matches(t, '^[a-z]+$') THEN {_lemma('t')} ELSE t END), ' '), ''), lower({text}))"


def _same(wa: str, sa: str, wb: str, sb: str) -> str:
    return f"(len({wa}) > 0 AND len({wb}) > 0 AND ({wa} = {wb} OR {sa} = {sb} OR list_has_all({wa}, {wb}) OR list_has_all({wb}, {wa})))"


@query(f"""WITH v AS (SELECT p_partkey, {VARIANT} AS a FROM part), w AS (SELECT p_partkey, {_words('a')} AS w, {_canonical('a')} AS canonical FROM v)
SELECT p_partkey, array_to_string(w, ' ') AS lemmas, array_to_string(list_transform(w, lambda s: {_stem('s')}), ' ') AS stems, canonical FROM w""")
def answer_forms(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", fn.forms(_variant()).alias("f"), fn.canonical(_variant()).alias("canonical"))
    return v.select("p_partkey", F.array_join("f.words", " ").alias("lemmas"), F.array_join("f.stems", " ").alias("stems"), "canonical")


@query(f"""WITH v AS (SELECT p_partkey, {_words('p_name')} AS wa, {_words(VARIANT)} AS wb FROM part),
s AS (SELECT *, list_transform(wa, lambda s: {_stem('s')}) AS sa, list_transform(wb, lambda s: {_stem('s')}) AS sb FROM v)
SELECT p_partkey, {_same('wa', 'sa', 'wb', 'sb')} AS same FROM s""")
def surface_match(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", fn.forms(F.col("p_name")).alias("a"), fn.forms(_variant()).alias("b"))
    return v.select("p_partkey", fn.same(F.col("a"), F.col("b")).alias("same"))


#: Cosines of these tables are small: no two vectors reach the defaults.
FLOOR, SYNONYM = -0.05, 0.28

CLUSTERS = f"""WITH RECURSIVE r AS (SELECT p_partkey % 80 AS entry, p_partkey AS pos, {VARIANT} AS response FROM part), k AS (SELECT *, {_canonical('response')} AS key FROM r),
v AS (SELECT key, embedding::DOUBLE[] AS e FROM (SELECT key, min(pos) % 500 AS vec_id FROM k GROUP BY 1) JOIN embeddings USING (vec_id)),
w AS (SELECT DISTINCT entry, key, e, string_split(key, ' ') AS w, list_transform(string_split(key, ' '), lambda s: {_stem('s')}) AS s FROM k JOIN v USING (key)),
p AS (SELECT x.entry, x.key AS a, y.key AS b FROM w x JOIN w y ON x.entry = y.entry AND x.key < y.key WHERE list_dot_product(x.e, y.e) >= {SYNONYM}
  OR (list_dot_product(x.e, y.e) >= {FLOOR} AND (x.s = y.s OR (least(len(list_distinct(x.w)), len(list_distinct(y.w))) <= 3 AND (list_has_all(x.w, y.w) OR list_has_all(y.w, x.w)))))),
b AS (SELECT * FROM p UNION ALL SELECT entry, b, a FROM p),
reach AS (SELECT DISTINCT entry, key, key AS root FROM k UNION SELECT b.entry, b.b, reach.root FROM reach JOIN b ON b.entry = reach.entry AND b.a = reach.key WHERE reach.root < b.b),
root AS (SELECT entry, key, min(root) AS root FROM reach GROUP BY 1, 2),
f AS (SELECT entry, root, key, response, count(*) AS n, min(pos) AS first FROM k JOIN root USING (entry, key) GROUP BY 1, 2, 3, 4),
ks AS (SELECT entry, root, list(key ORDER BY seen) AS keys FROM (SELECT entry, root, key, min(first) AS seen FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT entry, root, sum(n)::BIGINT AS count, arg_min(response, (-n, response)) AS canonical, string_agg(response || '=' || n, '|' ORDER BY response) AS surface_forms, min(first) AS first FROM f GROUP BY 1, 2),
d AS (SELECT entry, canonical, count, count / sum(count) OVER (PARTITION BY entry) AS rate, surface_forms, keys, first FROM c JOIN ks USING (entry, root))
"""


def _clusters(spark, sf_dir):
    r = table(spark, sf_dir, "part").select((F.col("p_partkey") % 80).alias("entry"), F.col("p_partkey").alias("pos"), _variant().alias("response"))
    keys = r.groupBy(fn.canonical(F.col("response")).alias("key")).agg((F.min("pos") % 500).alias("vec_id"))
    return ops.clusters(r, keys.join(table(spark, sf_dir, "embeddings"), "vec_id").select("key", "embedding"), floor=FLOOR, synonym=SYNONYM)


@query(CLUSTERS + "SELECT entry, canonical, count, round(rate, 6) AS rate, surface_forms, array_to_string(keys, '|') AS lemma_keys FROM d")
def answer_clusters(spark, sf_dir):
    form = F.transform(F.map_entries("surface_forms"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return _clusters(spark, sf_dir).select("entry", "canonical", "count", F.round("rate", 6).alias("rate"), F.array_join(form, "|").alias("surface_forms"), F.array_join("lemma_keys", "|").alias("lemma_keys"))


@query(CLUSTERS + f""", n AS (SELECT entry // 2 AS family, entry % 2 AS framed, canonical, count, rate, first, list_transform(list_distinct(list_prepend(canonical, keys)), lambda a: {_words('a')}) AS ws FROM d),
q AS (SELECT *, list_transform(ws, lambda w: list_transform(w, lambda s: {_stem('s')})) AS ss FROM n),
m AS (SELECT * FROM q WHERE framed = 0 QUALIFY row_number() OVER (PARTITION BY family ORDER BY count DESC, first, canonical) = 1),
j AS (SELECT m.family, m.canonical AS mode, m.rate AS dr, q.canonical, q.count, q.rate, q.first,
  len(list_filter(range(1, len(q.ws) + 1), lambda i: len(list_filter(range(1, len(m.ws) + 1), lambda h: {_same('q.ws[i]', 'q.ss[i]', 'm.ws[h]', 'm.ss[h]')})) > 0)) > 0 AS hit FROM m LEFT JOIN q ON q.family = m.family AND q.framed = 1)
SELECT family, mode, round(dr, 6) AS dr, coalesce(round(sum(CASE WHEN hit THEN count ELSE 0 END) / sum(count), 6), 0.0)::DOUBLE AS fr,
 arg_min(canonical, (-count, first, canonical)) FILTER (WHERE canonical IS NOT NULL AND NOT hit) AS flip_target, coalesce(round(arg_min(rate, (-count, first, canonical)) FILTER (WHERE canonical IS NOT NULL AND NOT hit), 6), 0.0)::DOUBLE AS flip_rate FROM j GROUP BY 1, 2, 3""")
def framed_match(spark, sf_dir):
    """Families of even entries (direct) and the odd ones after them (framed)."""
    c = _clusters(spark, sf_dir).withColumn("framed", F.col("entry") % 2).withColumn("family", F.floor(F.col("entry") / 2)).drop("entry")
    got = ops.framed_follow(c.where("framed = 0"), c.where("framed = 1"), by="family")
    return got.select("family", "mode", F.round("dr", 6).alias("dr"), F.round("fr", 6).alias("fr"), "flip_target", F.round("flip_rate", 6).alias("flip_rate"))


@query(f"""WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' "' || upper(event_type) || '!" ' WHEN 1 THEN 'Seven.' WHEN 2 THEN 'no;  ' || event_type ELSE NULL END AS x, event_type || '_' || user_id AS entity FROM events),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(coalesce(x, ''))), '[.,;:!?"''`]', '', 'g'), '\\s+', ' ', 'g')) AS p FROM a)
SELECT event_id, coalesce({_map(NUMBER_WORDS)}[p], p) AS plain, trim(lower(x), '."'' ') AS trimmed, split_part(entity, '_', -1) AS domain, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')), lambda t: t NOT IN ('choose', 'a', 'random', 'of', 'the', 'type', 'kind'))), ' ') AS key_words, least(entity, 'click_7') || chr(31) || greatest(entity, 'click_7') AS pair FROM n""")
def answer_keys(spark, sf_dir):
    k, t = F.col("event_id") % 4, F.col("event_type")
    x = F.when(k == 0, F.concat(F.lit(' "'), F.upper(t), F.lit('!" '))).when(k == 1, "Seven.").when(k == 2, F.concat(F.lit("no;  "), t))
    a = table(spark, sf_dir, "events").select("event_id", x.alias("x"), F.concat_ws("_", "event_type", "user_id").alias("entity"))
    return a.select(
        "event_id", fn.plain(F.col("x")).alias("plain"), F.btrim(F.lower("x"), F.lit(".\"' ")).alias("trimmed"), F.substring_index("entity", "_", -1).alias("domain"),
        F.array_join(fn.key_words(F.col("x")), " ").alias("key_words"), fn.pair_key(F.col("entity"), F.lit("click_7")).alias("pair"),
    )


@query(f"""WITH a AS (SELECT user_id, CASE WHEN value < 20 THEN 'seven' WHEN value < 40 THEN '7' WHEN value < 50 THEN 'three' ELSE event_type END AS answer, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT user_id, coalesce({_map(NUMBER_WORDS)}[answer], answer) AS label, sum(n)::BIGINT AS count FROM a GROUP BY 1, 2) SELECT user_id, label, count, round(count / sum(count) OVER (PARTITION BY user_id), 6) AS rate FROM m""")
def number_collapse(spark, sf_dir):
    """A distribution after number words and digits are one answer."""
    v = F.col("value")
    answer = F.when(v < 20, "seven").when(v < 40, "7").when(v < 50, "three").otherwise(F.col("event_type"))
    m = table(spark, sf_dir, "events").groupBy("user_id", answer.alias("a")).count().groupBy("user_id", fn.digits(F.col("a")).alias("label")).agg(F.sum("count").alias("count"))
    return m.withColumn("rate", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("user_id")), 6))
