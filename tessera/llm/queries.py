"""The queries of the corpus operators and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, html, lines, near, packing, passages, rules, search, suffixes, units
from .common import read_table


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(read_table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op2_line_dedup, op3_bpe, op4_packing, op5_quality_rules, op7_topk_search, op8_quality_classifier, op10_html_extraction)}

ORACLES: dict[str, str] = {
    # Keys by code points: the classes are ASCII. A text's lines are numbered to be joined again in order.
    "op2_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row, doc_id
""",
    "op7_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.group_near(read_table(spark, sf_dir, "documents"), width=4).drop("k1", "k2", "root")


QUERIES["op6_minhash_near_dedup"] = op6_minhash_near_dedup
ORACLES["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a WHERE r.root < l.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(read_table(spark, sf_dir, "documents"))


QUERIES["op1_suffix_dedup"] = op1_suffix_dedup


def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that went as one text, start-end in bytes joined by commas."""
    found = units.dedup_units(read_table(spark, sf_dir, "documents"), least=1)
    return found.withColumn("removed", F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


QUERIES["op9_unit_dedup"] = op9_unit_dedup
# Ids are unique in these tables, so that a row's rank needs no hash of its text.
ORACLES["op9_unit_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, strlen(line) AS n, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, key <> '' AND row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, pos) > 1 AS gone,
        (sum(n + 1) OVER (PARTITION BY doc_id ORDER BY pos) - n - 1)::BIGINT AS start FROM k)
SELECT doc_id, (sum(n) + count(*) - 1)::BIGINT AS n_bytes, count(*) AS n_units, sum(gone::INT)::BIGINT AS n_removed,
       coalesce(string_agg(start || '-' || (start + n), ',' ORDER BY pos) FILTER (WHERE gone), '') AS removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, wherever in a line they lie; spans as in op9_unit_dedup, which does whole lines."""
    found = passages.dedup_passages(read_table(spark, sf_dir, "documents"), words=51)
    return found.withColumn("removed", F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


QUERIES["op9_passage_dedup"] = op9_passage_dedup
# A unit is a word and the white space after it. Ids are unique in these tables, so that a row's rank needs no hash of its text.
ORACLES["op9_passage_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS u,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(l) - 49)) AS i, l FROM d),
w AS (SELECT doc_id, i, array_to_string(l[i:i+50], ' ') AS passage FROM g),
f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS doc0, first_value(i) OVER o AS i0 FROM w WINDOW o AS (PARTITION BY passage ORDER BY doc_id NULLS FIRST, i)),
c AS (SELECT doc_id, i + 50 AS z, CASE WHEN doc_id IS NOT DISTINCT FROM doc0 THEN greatest(i, i0 + 51) ELSE i END AS a FROM f WHERE doc_id IS DISTINCT FROM doc0 OR i <> i0),
x AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS pos FROM c),
s AS (SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS pos FROM d),
m AS (SELECT s.*, x.pos IS NOT NULL AS gone, strlen(regexp_extract(unit, '^[^\x20\x09-\x0D]+')) AS n FROM s LEFT JOIN x ON s.doc_id IS NOT DISTINCT FROM x.doc_id AND s.pos = x.pos),
r AS (SELECT *, sum(strlen(unit)) OVER o - strlen(unit) AS place, coalesce(lag(gone) OVER o, false) AS gone_before, coalesce(lead(gone) OVER o, false) AS gone_next FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, sum(gone::INT)::BIGINT AS n_removed, list(place ORDER BY pos) FILTER (WHERE gone AND NOT gone_before) AS a, list(place + n ORDER BY pos) FILTER (WHERE gone AND NOT gone_next) AS z,
        string_agg(CASE WHEN gone AND gone_next THEN '' WHEN gone THEN substr(unit, length(regexp_extract(unit, '^[^\x20\x09-\x0D]+')) + 1) ELSE unit END, '' ORDER BY pos) AS kept FROM r GROUP BY doc_id),
t AS (SELECT d.*, k.* EXCLUDE (doc_id), regexp_extract(text, '^[\x20\x09-\x0D]*') AS lead_in FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id)
SELECT doc_id, strlen(text)::BIGINT AS n_bytes, len(u)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(array_to_string(list_transform(list_zip(a, z), lambda y: (strlen(lead_in) + y[1])::BIGINT || '-' || (strlen(lead_in) + y[2])::BIGINT), ','), '') AS removed,
       sha256(lead_in || coalesce(kept, '')) AS kept_sha256
FROM t
"""
