"""Filters of texts and conversations: kinds of passages, repetition verdicts, languages, tags, turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import repetition as fn
from ..functions.text import EDGE
from .registry import query, table

#: Classes of Python's patterns as both engines read them.
W, S = r"[\p{L}\p{N}_]", r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _re(*patterns: str) -> str:
    """Python patterns, any of them, as a pattern of Unicode classes within an SQL literal."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return joined.replace(r"\w", W).replace(r"\d", r"\p{Nd}").replace(r"\s", S).replace("'", "''")


def _q(word: str) -> str:
    return word.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


KINDS = ("formula", "statement", "phrase", "complex", "transition", "lists", "lines")
PASSAGES = f"""p AS (SELECT doc_id, p FROM (SELECT doc_id, {_strip('unnest(string_split(text, chr(10) || chr(10)))')} AS p FROM documents) WHERE p <> ''),
f AS (SELECT doc_id, p, regexp_matches(p, '[{"".join(chr(92) + c for c in fn.SIGNS)}]') OR regexp_matches(p, '{_re(*fn.FORMULA)}') AS formula,
 ((regexp_matches(p, '{_re(fn.OPEN)}') OR regexp_matches(p, '{_re(fn.CLOSED_ONLY)}')) AND NOT regexp_matches(p, '{_re(fn.PAIRED)}')) OR regexp_matches(p, '(?i){_re(*fn.STATEMENT)}') AS statement,
 ({" OR ".join(f"contains(lower(p), '{_q(w)}')" for w in fn.PHRASES)}) OR (regexp_matches(p, '{_re(fn.COMPARISON)}') AND NOT ({" OR ".join(f"contains(lower(p), '{w}')" for w in fn.CODE_WORDS)})) AS phrase,
 regexp_matches(p, '{_re(*fn.COMPLEX)}') AS complex, lower(p) IN ({", ".join(f"'{w}'" for w in fn.TRANSITIONS)}) AS transition,
 len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches({_strip('x')}, '{_re(fn.NUMBERED)}'))) >= 2 OR len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches({_strip('x')}, '{_re(fn.BULLET)}'))) >= 2 AS lists,
 contains(p, chr(10)) AS lines FROM p)
"""


def _rows(docs: DataFrame, say, schema: str) -> DataFrame:
    """mapInArrow of say(text) -> tuple or None on (doc_id, text)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *found) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (found := say(t or "")) is not None]
            c = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(x, pa.string() if " string" in k else pa.int64()) for x, k in zip(c, schema.split(", "), strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@query("WITH " + PASSAGES + "SELECT doc_id, count(*) AS passages, " + ", ".join(f"sum({k}::INT)::BIGINT AS {k}" for k in KINDS) + " FROM f GROUP BY 1")
def passage_kinds(spark, sf_dir):
    """How many paragraphs of a text are of each kind."""

    def say(text):
        own = fn.paragraphs(text)
        tests = (fn.is_formula, fn.is_statement, fn.is_phrase, fn.is_complex, fn.is_transition, fn.is_list, lambda p: "\n" in p)
        return (len(own), *(sum(map(f, own)) for f in tests)) if own else None

    return _rows(table(spark, sf_dir, "documents"), say, "doc_id long, passages long, " + ", ".join(f"{k} long" for k in KINDS))


@query()  # its rule has no SQL of a bearable length; tested against a plain reading of the rule
def block_repetition(spark, sf_dir):
    """Texts that repeat themselves block by block, with the reason and the block, at thresholds that these tables reach."""
    return _rows(table(spark, sf_dir, "documents"), lambda t: fn.repetition(t, 3, 8, 3), "doc_id long, reason string, block string")


def _positions(mark: str, least: int) -> str:
    return f"""WITH p AS (SELECT doc_id, unnest(string_split(text, {mark})) AS x, generate_subscripts(string_split(text, {mark}), 1) AS i FROM documents), t AS (SELECT doc_id, {_strip('x')} AS item, i FROM p),
k AS (SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM t WHERE item <> ''), n AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item ORDER BY place) AS island FROM k WHERE length(item) >= {least}),
r AS (SELECT doc_id, item, island, count(*) AS run, min(place) AS first FROM n GROUP BY 1, 2, 3)
SELECT doc_id, item, sum(run)::BIGINT AS total, max(run) AS longest_run, min(first)::BIGINT AS first FROM r GROUP BY 1, 2 HAVING sum(run) > 1"""


@query(_positions("chr(10)", 10))
def block_runs(spark, sf_dir):
    """Lines, as paragraphs, of 10 code points and more that occur twice in a text: how often, the longest run of neighbours, the first place."""
    schema = "doc_id long, item string, total long, longest_run long, first long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = fn.paragraphs((t or "").replace("\n", "\n\n"))
                rows += [(i, r.block, r.total, r.run, own.index(r.block)) for r in fn.repeats(own, 10)]
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), *(pa.array(x, pa.int64()) for x in c[2:])], names=[x.split()[0] for x in schema.split(", ")])

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@query()  # runs of periods have no set form; tested against a search of all places and periods
def periodic_runs(spark, sf_dir):
    """The run of one period of words with most repeats, of texts that have one of three or more."""

    def say(text):
        numbers: dict[str, int] = {}
        period, times, start = fn.periodic_run([numbers.setdefault(w, len(numbers)) for w in text.split()])
        return (period, times, start) if times else None

    return _rows(table(spark, sf_dir, "documents"), say, "doc_id long, period long, times long, start long")


#: The range of Chinese characters that the filter counts.
CJK = r"[\x{4e00}-\x{9fff}]"
LAST = "WITH l AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1)"
HAN = "CASE conv_id % 4 WHEN 0 THEN text || chr(20013) || chr(25991) WHEN 1 THEN chr(20013) || chr(25991) || left(text, 8) ELSE text END"


def _last(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query(LAST + f", h AS (SELECT conv_id, {HAN} AS text FROM l) SELECT conv_id, len(regexp_extract_all(text, '{CJK}')) AS hits, round(len(regexp_extract_all(text, '{CJK}')) / length(text), 6) AS ratio FROM h WHERE length(text) > 0 AND len(regexp_extract_all(text, '{CJK}')) > 0 AND len(regexp_extract_all(text, '{CJK}')) / length(text) >= 0.05")
def cjk_ratio(spark, sf_dir):
    """Last assistant turns with Chinese characters at a share of 0.05 or more; some turns here get two such characters."""
    t, k = F.col("text"), F.col("conv_id") % 4
    han = F.lit("中文")
    h = _last(spark, sf_dir).select("conv_id", F.when(k == 0, F.concat(t, han)).when(k == 1, F.concat(han, F.left(t, F.lit(8)))).otherwise(t).alias("text"))
    hits = F.regexp_count("text", F.lit(CJK)).cast("long")
    return h.select("conv_id", hits.alias("hits"), (hits / F.nullif(F.length("text"), F.lit(0))).alias("r")).where("hits > 0 AND r >= 0.05D").select("conv_id", "hits", F.round("r", 6).alias("ratio"))


TAGGED = "CASE conv_id % 5 WHEN 0 THEN '<think>' || text || '</think><answer>' || left(text, 20) || '</answer>' WHEN 1 THEN '<think>' || text || '</think>' WHEN 2 THEN '<answer>' || text || '</answer> tail' WHEN 3 THEN text || '</think> <answer> so 1,234.5 </answer>' ELSE text END"
FULL, THINK, SOFT = r"(?s)^<think>.*</think>\s*<answer>.*</answer>$", r"(?s)^<think>.*</think>.*$", r"(?s)^.*?</think>\s*<answer>.*?</answer>"


def _tagged(spark, sf_dir) -> DataFrame:
    return _last(spark, sf_dir).select("conv_id", F.expr(TAGGED).alias("text"))


@query(LAST + f""", g AS (SELECT conv_id, {TAGGED} AS text FROM l) SELECT conv_id, regexp_matches(text, '{FULL}') AS both_tags, regexp_matches(text, '{THINK}') AS think_tag, CASE WHEN regexp_matches(text, '{SOFT}') THEN 1.0 ELSE 0.0 END::DOUBLE AS soft_reward,
 md5(replace(replace(text, '<answer>', ''), '</answer>', '')) AS without_answer, md5(CASE WHEN contains(text, '<answer>') THEN text ELSE '<answer>' || text || '</answer>' END) AS with_answer, trim(replace(replace(string_split(text, '</think>')[-1], '<answer>', ''), '</answer>', '')) AS answer FROM g""")
def think_tags(spark, sf_dir):
    """Validity of think and answer tags, tags added and removed, and what is left after the thinking."""
    t = F.col("text")
    bare = lambda c: F.replace(F.replace(c, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit(""))
    return _tagged(spark, sf_dir).select(
        "conv_id", t.rlike(FULL).alias("both_tags"), t.rlike(THINK).alias("think_tag"), F.when(t.rlike(SOFT), 1.0).otherwise(0.0).alias("soft_reward"), F.md5(bare(t)).alias("without_answer"),
        F.md5(F.when(t.contains("<answer>"), t).otherwise(F.concat(F.lit("<answer>"), t, F.lit("</answer>")))).alias("with_answer"), F.trim(bare(F.substring_index(t, "</think>", -1))).alias("answer"),
    )


CUTOFF = r"(?i)\b(?:knowledge|training)[ -](?:cutoff|cut-off)[^.]{0,40}|\b(?:as of|until|up to) (?:my|the) (?:last|latest) [a-z]+"
CUT = "CASE conv_id % 9 WHEN 0 THEN text || ' My knowledge cutoff is May 2023. As of my last update, yes.' WHEN 1 THEN text || ' until the latest news' ELSE text END"


@query(f"WITH c AS (SELECT conv_id, role, {CUT} AS text FROM conversations), m AS (SELECT conv_id, role, regexp_extract_all(text, '{CUTOFF}') AS m FROM c) SELECT role, sum(len(m))::BIGINT AS mentions, sum((len(m) > 0)::INT)::BIGINT AS turns, count(DISTINCT conv_id) FILTER (WHERE len(m) > 0) AS removed, (SELECT count(DISTINCT conv_id) FROM m WHERE conv_id NOT IN (SELECT conv_id FROM m WHERE len(m) > 0)) AS kept FROM m GROUP BY 1")
def cutoff_mentions(spark, sf_dir):
    """Mentions of a model's knowledge cutoff by role, and how many conversations stay when those with one go."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.regexp_count(F.expr(CUT), F.lit(CUTOFF.replace(r"\b", EDGE))).cast("long").alias("m"))
    bad = c.where("m > 0").select("conv_id").distinct()
    kept = c.select("conv_id").distinct().join(bad, "conv_id", "left_anti").agg(F.count("*").alias("kept"))
    by = c.groupBy("role").agg(F.sum("m").alias("mentions"), F.sum((F.col("m") > 0).cast("int")).alias("turns"), F.count_distinct(F.when(F.col("m") > 0, F.col("conv_id"))).alias("removed"))
    return by.crossJoin(F.broadcast(kept))  # one row


@query("""WITH t AS (SELECT conv_id, turn, role, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations), s AS (SELECT conv_id, sum(n + 6)::BIGINT AS tokens, bool_or(text IS NULL OR trim(text) = '') AS has_empty, bool_or(role = 'system') AS has_system, count(*) AS turns FROM t GROUP BY 1)
SELECT conv_id, tokens, tokens <= 300 AS kept, has_empty, has_system, turns + (NOT has_system)::INT AS turns_with_system FROM s""")
def conversation_budget(spark, sf_dir):
    """Words of a conversation (and six a turn) within a budget, empty turns, and turns after a system prompt is put before those without."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum((n + 6).cast("long")).alias("tokens"), F.bool_or(F.col("text").isNull() | (F.trim("text") == "")).alias("has_empty"), F.bool_or(F.col("role") == "system").alias("has_system"), F.count("*").alias("turns"))
    return s.select("conv_id", "tokens", (F.col("tokens") <= 300).alias("kept"), "has_empty", "has_system", (F.col("turns") + (~F.col("has_system")).cast("int")).alias("turns_with_system"))


BUDGET = 120


@query(f"""WITH RECURSIVE u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) + 6 AS n FROM conversations WHERE role <> 'system' AND text IS NOT NULL),
p AS (SELECT conv_id, i // 2 AS pair, sum(n)::BIGINT AS n, count(*) AS turns FROM u GROUP BY 1, 2), q AS (SELECT conv_id, pair, n, row_number() OVER (PARTITION BY conv_id ORDER BY pair) AS k FROM p WHERE turns = 2 AND n <= {BUDGET}),
w AS (SELECT conv_id, pair, k, n AS filled, 0::BIGINT AS part FROM q WHERE k = 1 UNION ALL SELECT q.conv_id, q.pair, q.k, CASE WHEN w.filled + q.n > {BUDGET} THEN q.n ELSE w.filled + q.n END, w.part + (w.filled + q.n > {BUDGET})::INT FROM w JOIN q ON q.conv_id = w.conv_id AND q.k = w.k + 1)
SELECT conv_id, pair, part FROM w""")
def conversation_split(spark, sf_dir):
    """Pairs of turns in order, dealt into parts within a budget of words; a pair over the budget goes."""
    n = (F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")) + 6).cast("long")
    u = table(spark, sf_dir, "conversations").where("role <> 'system' AND text IS NOT NULL").select("conv_id", "turn", n.alias("n")).withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    pairs = u.groupBy("conv_id", F.floor(F.col("i") / 2).alias("pair")).agg(F.sum("n").alias("n"), F.count("*").alias("turns")).where(f"turns = 2 AND n <= {BUDGET}")

    def parts(pdf):
        pdf = pdf.sort_values("pair")
        filled, part, out = 0, 0, []
        for k in pdf["n"].tolist():
            if filled and filled + k > BUDGET:
                filled, part = 0, part + 1
            filled += k
            out.append(part)
        return pdf[["conv_id", "pair"]].assign(part=out)

    return pairs.groupBy("conv_id").applyInPandas(parts, "conv_id long, pair long, part long")


MARK_H, MARK_A = "\n\nHuman: ", "\n\nAssistant: "


@query("""WITH d AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' ELSE chr(10) || chr(10) || 'Assistant: ' END || text, '' ORDER BY turn) AS x FROM conversations WHERE role <> 'system' AND text IS NOT NULL GROUP BY 1),
s AS (SELECT conv_id, string_split_regex(x, '\\n\\n(Human|Assistant): ')[2:] AS t, regexp_extract_all(x, '\\n\\n(Human|Assistant): ', 1) AS r FROM d),
v AS (SELECT conv_id, t, r, len(list_filter(t, lambda y: trim(y, ' ' || chr(10)) = '')) = 0 AND r[-1] = 'Assistant' AND len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> CASE WHEN i % 2 = 1 THEN 'Human' ELSE 'Assistant' END)) = 0 AS ok FROM s)
SELECT conv_id, len(t) AS turns, ok, md5(array_to_string(t, '|')) AS digest FROM v""")
def dialogue_turns(spark, sf_dir):
    """Dialogue strings cut at their marks; valid if no turn is empty, sides alternate from the human's and the assistant has the last word."""
    line = F.concat(F.when(F.col("role") == "user", MARK_H).otherwise(MARK_A), "text")
    d = table(spark, sf_dir, "conversations").where("role <> 'system' AND text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("m"))
    x = F.array_join(F.col("m.l"), "")
    t, r = F.split(x, "\n\n(?:Human|Assistant): "), F.regexp_extract_all(x, F.lit("\n\n(Human|Assistant): "), 1)
    s = d.select("conv_id", F.slice(t, 2, F.size(t)).alias("t"), r.alias("r"))
    want = F.transform("r", lambda _, i: F.when(i % 2 == 0, "Human").otherwise("Assistant"))
    ok = ~F.exists("t", lambda y: F.btrim(y, F.lit(" \n")) == "") & (F.element_at("r", -1) == "Assistant") & (F.col("r") == want)
    return s.select("conv_id", F.size("t").cast("long").alias("turns"), ok.alias("ok"), F.md5(F.array_join("t", "|")).alias("digest"))


@query("""SELECT doc_id, source, 'tessera' AS origin FROM documents WHERE source NOT IN ('src1', 'src2') AND lower(lang) = 'de' UNION ALL SELECT item_id, NULL, 'benchmark' FROM benchmark""")
def source_union(spark, sf_dir):
    """Named sources go, one language stays, and another table follows with a constant for its origin."""
    d = table(spark, sf_dir, "documents").where(~F.col("source").isin("src1", "src2") & (F.lower("lang") == "de")).select("doc_id", "source", F.lit("tessera").alias("origin"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("origin"))
    return d.unionByName(b, allowMissingColumns=True)


@query("""SELECT source, count(*) AS n, sum(k::INT)::BIGINT AS kept, sum((NOT k)::INT)::BIGINT AS filtered FROM (SELECT source, coalesce(length(text), 0) BETWEEN 200 AND 5000 AND NOT regexp_matches(coalesce(text, ''), '[#*$%&|<>]{3}') AS k FROM documents) GROUP BY 1""")
def kept_and_filtered(spark, sf_dir):
    """Rows that a filter keeps and those that it takes out, counted by source."""
    t = F.coalesce("text", F.lit(""))
    k = F.length(t).between(200, 5000) & ~t.rlike("[#*$%&|<>]{3}")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(k.cast("int")).alias("kept"), F.sum((~k).cast("int")).alias("filtered"))
