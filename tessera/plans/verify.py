"""Answer checks and constraints, on texts of the driver's tables with tags, boxes and numbers put into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verify as fn
from .registry import query, table

RESPONSES = """(SELECT conv_id, turn, text, concat(CASE turn % 3 WHEN 0 THEN '<think>so' || left(text, 30) || '</think>' WHEN 1 THEN '' ELSE 'The answer is: ' END, CASE conv_id % 4 WHEN 0 THEN '<answer>' || left(text, 60) || '</answer>' WHEN 1 THEN left(text, 40) WHEN 2 THEN 'it is 1,234.5' ELSE 'so \\boxed{x^{2} + {' || turn || '}} ok' END) AS response, left(text, 40) AS label, [left(text, 25), reverse(left(text, 20))] AS labels FROM conversations WHERE text IS NOT NULL)"""


def _responses(spark, sf_dir):
    t, turn = F.col("text"), F.col("turn")
    head = F.when(turn % 3 == 0, F.concat(F.lit("<think>so"), F.left(t, F.lit(30)), F.lit("</think>"))).when(turn % 3 == 1, "").otherwise("The answer is: ")
    k = F.col("conv_id") % 4
    tail = F.when(k == 0, F.concat(F.lit("<answer>"), F.left(t, F.lit(60)), F.lit("</answer>"))).when(k == 1, F.left(t, F.lit(40))).when(k == 2, "it is 1,234.5").otherwise(F.concat(F.lit("so \\boxed{x^{2} + {"), turn, F.lit("}} ok")))
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", "text", F.concat(head, tail).alias("response"), F.left(t, F.lit(40)).alias("label"), F.array(F.left(t, F.lit(25)), F.reverse(F.left(t, F.lit(20)))).alias("labels"))


def _squad(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def _f1(a: str, b: str) -> str:
    w = lambda x: f"list_filter(string_split({_squad(x)}, ' '), lambda w: w <> '')"
    both = f"list_sum(list_prepend(0, list_transform(list_intersect({w(a)}, {w(b)}), lambda u: least(len(list_filter({w(a)}, lambda x: x = u)), len(list_filter({w(b)}, lambda x: x = u))))))"
    return f"(CASE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {both} / (len({w(a)}) + len({w(b)})) END)"


LAST = r"coalesce(regexp_extract_all(regexp_replace(response, '([0-9]),([0-9])', '\1\2', 'g'), '[-+]?[0-9]*\.[0-9]+|[0-9]+')[-1], regexp_replace(response, '([0-9]),([0-9])', '\1\2', 'g'))"
BARE = "trim(replace(replace(string_split(response, '</think>')[-1], '<answer>', ''), '</answer>', ''))"
BOX = r"regexp_extract_all(response, '\\boxed\{(" + fn.braces() + r")\}', 1)[-1]"


@query(rf"""SELECT conv_id, turn, {BARE} AS answer, {LAST} AS last_number, lower({LAST}) = '1234.5' AS number_ok, {_squad(BARE)} = {_squad('label')} AS string_ok,
 {_squad(f"CASE WHEN contains({BARE}, 'The answer is: ') THEN string_split({BARE}, 'The answer is: ')[-1] ELSE {BARE} END")} = {_squad('label')} AS prefix_ok, {BOX} AS boxed FROM {RESPONSES}""")
def answer_checks(spark, sf_dir):
    """Answers after thinking against a label: by last number, by normalised string, after a prefix, and what the last box holds."""
    r, answer = F.col("response"), fn.after_thinking(F.col("response"))
    after = F.when(answer.contains("The answer is: "), F.substring_index(answer, "The answer is: ", -1)).otherwise(answer)
    return _responses(spark, sf_dir).select(
        "conv_id", "turn", answer.alias("answer"), fn.last_number(r).alias("last_number"), fn.number_match(r, F.lit("1234.5")).alias("number_ok"), (fn.squad(answer) == fn.squad(F.col("label"))).alias("string_ok"),
        (fn.squad(after) == fn.squad(F.col("label"))).alias("prefix_ok"), fn.boxed(r).alias("boxed"),
    )


TAGGED = "trim(regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1))"
BEST = f"greatest({_f1(TAGGED, 'labels[1]')}, {_f1(TAGGED, 'labels[2]')})"


@query(f"SELECT conv_id, turn, round(CASE WHEN {TAGGED} = '' THEN 0.0::DOUBLE WHEN {BEST} = 0 THEN 0.1::DOUBLE ELSE {BEST} END, 6) AS reward FROM {RESPONSES} WHERE conv_id % 2 = 0")
def tagged_f1(spark, sf_dir):
    """F1 of a tagged answer, the best over its labels."""
    return _responses(spark, sf_dir).where("conv_id % 2 = 0").select("conv_id", "turn", F.round(fn.tagged_f1(F.col("response"), F.col("labels")), 6).alias("reward"))


@query(f"""WITH r AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN ['GSM8K', 'length'] WHEN 1 THEN ['string', 'Unknown'] ELSE ['Length', 'gsm8k'] END AS names FROM {RESPONSES}), u AS (SELECT conv_id, turn, response, label, lower(unnest(names)) AS name FROM r),
s AS (SELECT conv_id, turn, name, CASE name WHEN 'gsm8k' THEN (lower({LAST}) = '1234.5')::INT * 10.0 WHEN 'string' THEN ({_squad(BARE)} = {_squad('label')})::INT * 5.0 WHEN 'length' THEN 1 - abs(length(response) - 60) / 60.0 END::DOUBLE AS score FROM u)
SELECT conv_id, turn, round(coalesce(sum(score), 0.0), 6)::DOUBLE AS reward, round(sum(score) FILTER (WHERE name = 'gsm8k'), 6)::DOUBLE AS gsm8k, round(sum(score) FILTER (WHERE name = 'length'), 6)::DOUBLE AS length, count(score) AS known FROM s GROUP BY 1, 2""")
def dispatched_rewards(spark, sf_dir):
    """Each response is checked by the verifiers that its row names, whatever their case; unknown names count nothing."""
    k = F.col("conv_id") % 3
    names = F.when(k == 0, F.array(F.lit("GSM8K"), F.lit("length"))).when(k == 1, F.array(F.lit("string"), F.lit("Unknown"))).otherwise(F.array(F.lit("Length"), F.lit("gsm8k")))
    u = _responses(spark, sf_dir).withColumn("name", F.explode(F.transform(names, F.lower)))
    r, name = F.col("response"), F.col("name")
    score = (
        F.when(name == "gsm8k", fn.number_match(r, F.lit("1234.5")).cast("int") * 10.0)
        .when(name == "string", (fn.squad(fn.after_thinking(r)) == fn.squad(F.col("label"))).cast("int") * 5.0)
        .when(name == "length", 1 - F.abs(F.length(r) - 60) / 60.0)
    )
    s = u.select("conv_id", "turn", "name", score.alias("score"))
    part = lambda n: F.round(F.sum(F.when(F.col("name") == n, F.col("score"))), 6).alias(n)
    return s.groupBy("conv_id", "turn").agg(F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6).alias("reward"), part("gsm8k"), part("length"), F.count("score").alias("known"))


ODD = """concat(CASE doc_id % 6 WHEN 0 THEN '<<A title>>' || chr(10) WHEN 1 THEN '* one' || chr(10) || '- two' || chr(10) || chr(10) || '***' || chr(10) WHEN 2 THEN '"' ELSE '' END, coalesce(text, ''), CASE doc_id % 6 WHEN 2 THEN '"' WHEN 3 THEN chr(10) || 'P.S. see [address] and [name]' WHEN 4 THEN ' SECTION 1 a SECTION 2 b ****** Is there anything else?' ELSE '' END)"""
SENTENCES = r"len(list_filter(string_split_regex(t, '[.!?]+[ \n]'), lambda s: trim(s, ' ' || chr(10)) <> ''))"


@query(rf"""WITH d AS (SELECT doc_id, {ODD} AS t FROM documents), m AS (SELECT *, list_filter(string_split_regex(t, '\n\n'), lambda p: p <> '') AS ps FROM d)
SELECT doc_id, NOT regexp_matches(t, '(?i)(random|forbidden)') AS no_forbidden, len(string_split(t, '***' || chr(10))) - 1 AS dividers, len(ps) AS paragraphs, lower(regexp_extract(ps[1], '^[A-Za-z]+', 0)) AS first_word, {SENTENCES} AS sentences,
 regexp_matches(t, 'P\.S\.') AS postscript, len(regexp_extract_all(t, '\[[^\[\]]*\]')) AS placeholders, len(regexp_extract_all(t, '(?m)^[*-] ')) AS bullets, regexp_matches(t, '<<[^\n]+>>') AS title, len(regexp_extract_all(t, 'SECTION [0-9]+')) AS sections,
 len(string_split(t, '******')) = 2 AS two_responses, len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) AS capital_words, suffix(trim(t), 'Is there anything else?') AS end_phrase, starts_with(t, '"') AND suffix(t, '"') AND length(t) > 1 AS quoted, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) BETWEEN 90 AND 110 AS about_100_words FROM m""")
def constraint_checks_more(spark, sf_dir):
    """Further constraints, as predicates of a text."""
    t = F.col("t")
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(ODD.replace("chr(10)", "char(10)")).alias("t"))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    size = lambda a: F.size(a).cast("long")
    d = d.withColumn("ps", F.filter(F.split("t", "\n\n"), lambda p: p != ""))
    return d.select(
        "doc_id", (~t.rlike("(?i)(random|forbidden)")).alias("no_forbidden"), (size(F.split("t", r"\*\*\*\n")) - 1).alias("dividers"), size("ps").alias("paragraphs"), F.lower(F.regexp_extract(F.get("ps", F.lit(0)), "^[A-Za-z]+", 0)).alias("first_word"),
        size(F.filter(F.split("t", r"[.!?]+[ \n]"), lambda s: F.btrim(s, F.lit(" \n")) != "")).alias("sentences"), t.rlike(r"P\.S\.").alias("postscript"), n(r"\[[^\[\]]*\]").alias("placeholders"), n("(?m)^[*-] ").alias("bullets"), t.rlike(r"<<[^\n]+>>").alias("title"),
        n("SECTION [0-9]+").alias("sections"), (F.size(F.split("t", r"\*\*\*\*\*\*")) == 2).alias("two_responses"), size(F.filter(F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: w.rlike("^[A-Z]{2,}$"))).alias("capital_words"), F.trim(t).endswith("Is there anything else?").alias("end_phrase"),
        (t.startswith('"') & t.endswith('"') & (F.length(t) > 1)).alias("quoted"), F.size(fn.words(t)).between(90, 110).alias("about_100_words"),
    )
