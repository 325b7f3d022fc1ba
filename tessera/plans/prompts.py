"""Building a prompt set: extraction, filters, ranking, similarity, deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import refusal, text
from ..functions.text import NUMBER_WORDS
from ..operators import grams
from ..operators import selection as ops
from ..operators.ordered import ranked
from ..sources.shared import materialize
from .registry import query, table

#: Documents with a word or two put before them, so that these tables' prose has prompts among it.
PROMPTS = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Choose a random word: ' WHEN 1 THEN 'Write a Python function that generates a RANDOM ' WHEN 2 THEN 'Randomly pick an item ' ELSE '' END || text AS text FROM documents)"""


def _prompts(spark, sf_dir):
    k = F.col("doc_id") % 5
    head = F.when(k == 0, "Choose a random word: ").when(k == 1, "Write a Python function that generates a RANDOM ").when(k == 2, "Randomly pick an item ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text").alias("text"))


@query(f"SELECT count(*) AS n_in, sum(k::INT)::BIGINT AS n_keyword, sum((k AND b)::INT)::BIGINT AS n_noise, sum((k AND NOT b)::INT)::BIGINT AS n_kept FROM (SELECT contains(lower(text), 'random') AS k, (" + " OR ".join(f"contains(lower(text), '{w}')" for w in ops.NOISE) + f") AS b FROM {PROMPTS})")
def keyword_funnel(spark, sf_dir):
    return ops.funnel(_prompts(spark, sf_dir))


RANKED = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM {docs}),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), nd AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + (SELECT n FROM nd)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 200000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
s AS (SELECT i AS seed, string_split(p, ' ') AS w FROM (VALUES {seeds}) v(i, p)),
sg AS (SELECT seed, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS term FROM s),
sw AS (SELECT seed, term, (1 + ln(count(*))) * any_value(idf) AS w FROM sg JOIN idf USING (term) GROUP BY 1, 2),
q AS (SELECT seed, term, w / sqrt(sum(w * w) OVER (PARTITION BY seed)) AS qw FROM sw),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
dt AS (SELECT doc_id, seed, round(sum(w.w * qw) / any_value(norm), 6) AS score FROM w JOIN q USING (term) JOIN nm USING (doc_id) GROUP BY 1, 2),
b AS (SELECT doc_id, max(score) AS score, arg_max(seed, (score, -seed)) AS seed FROM dt GROUP BY 1),
ranked AS (SELECT doc_id, coalesce(score, 0.0)::DOUBLE AS score, coalesce(seed, 0)::INT AS seed FROM documents LEFT JOIN b USING (doc_id))
"""
FOUR = ("the of", "that was the", "la de", "und der")
_seeds = lambda phrases: ", ".join(f"({i}, '{p}')" for i, p in enumerate(phrases))


@query(RANKED.replace("{docs}", "documents").replace("{seeds}", _seeds(FOUR)) + "SELECT * FROM ranked")
def tfidf_rank(spark, sf_dir):
    return grams.tfidf(table(spark, sf_dir, "documents"), FOUR)


@query(RANKED.replace("{docs}", PROMPTS).replace("{seeds}", _seeds(ops.SEEDS)) + "SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score, seed FROM ranked WHERE score >= 0.01")
def prompt_candidates(spark, sf_dir):
    """Prompts by the nearest of the twelve phrases, best first, cut at a least score."""
    got = grams.tfidf(_prompts(spark, sf_dir), ops.SEEDS).where("score >= 0.01")
    return ranked(materialize(got, "scored"), [F.desc("score"), F.col("doc_id")])  # dealing by range reads its input twice


@query(RANKED.replace("{docs}", PROMPTS).replace("{seeds}", _seeds(ops.SEEDS)) + "SELECT seed, count(*) AS n, round(min(score), 6) AS low, round(avg(score), 5) AS mean, round(max(score), 6) AS high FROM ranked WHERE score > 0 GROUP BY 1")
def seed_histogram(spark, sf_dir):
    return grams.tfidf(_prompts(spark, sf_dir), ops.SEEDS).where("score > 0").groupBy("seed").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("low"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.max("score"), 6).alias("high"))


@query(r"""WITH w AS (SELECT source, lower(unnest(regexp_extract_all(text, '[a-zA-Z'']+'))) AS w FROM documents), c AS (SELECT source, w, count(*) AS n FROM w WHERE length(w) > 2 AND w NOT IN ('the', 'and', 'that') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM c) SELECT source, r::INT AS rank, w AS term, n FROM r WHERE r <= 6""")
def top_terms(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z']+)"), 1)).alias("w")).select("source", F.lower("w").alias("term"))
    c = w.where((F.length("term") > 2) & ~F.col("term").isin("the", "and", "that")).groupBy("source", "term").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "term"))).where("rank <= 6").select("source", "rank", "term", "n")


@query("SELECT unnest([0, 10, 25, 50, 75, 90, 99, 100]) AS p, round(unnest(quantile_cont(n_chars, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])), 6) AS chars FROM documents")
def length_percentiles(spark, sf_dir):
    p = [0, 10, 25, 50, 75, 90, 99, 100]
    got = table(spark, sf_dir, "documents").agg(F.percentile("n_chars", F.array(*[F.lit(x / 100) for x in p])).alias("v"))
    return got.select(F.explode(F.arrays_zip(F.array(*map(F.lit, p)).alias("p"), F.col("v"))).alias("z")).select(F.col("z.p").alias("p"), F.round("z.v", 6).alias("chars"))


#: Responses put together from words of an event, in a text that both engines read.
SAYS = """concat(CASE WHEN event_id % 3 = 0 THEN 'I say ' ELSE '' END, CASE WHEN event_id % 7 < 6 THEN '{' ELSE '' END, CASE event_id % 11 WHEN 0 THEN ' Hard to say ' WHEN 1 THEN 'No preference' WHEN 2 THEN concat('As a neutral ', event_type)
 WHEN 3 THEN concat('neither is ', event_type) WHEN 4 THEN 'SEVEN' WHEN 5 THEN ' ' WHEN 6 THEN 'Yes' WHEN 7 THEN concat(event_type, ' ', user_id) WHEN 8 THEN 'i''ll pass' ELSE event_type END, CASE WHEN event_id % 7 < 6 THEN '} or {b}' ELSE '' END)"""


@query("""WITH x AS (SELECT event_id, """ + SAYS + """ AS response FROM events),
h AS (SELECT event_id, response, regexp_extract(response, '\\{([^{}]+)\\}', 1) AS h FROM x), i AS (SELECT *, lower(trim(h)) AS t FROM h),
r AS (SELECT *, CASE WHEN trim(response) = '' OR h = '' THEN 'no_brace' WHEN t = '' THEN 'empty_brace' WHEN t IN (""" + ", ".join("'" + w.replace("'", "''") + "'" for w in refusal.TOKENS) + """) THEN 'soft_token'
 WHEN """ + " OR ".join("starts_with(t, '" + w.replace("'", "''") + "')" for w in refusal.PREFIXES) + f""" THEN 'soft_prefix' END AS reason FROM i)
SELECT event_id, reason IS NOT NULL AS refused, CASE WHEN reason IS NULL THEN coalesce(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in NUMBER_WORDS.items())}}}[t], t) END AS answer, reason FROM r""")
def refusal_classify(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", refusal.brace_answer(F.expr(SAYS)).alias("a")).select("event_id", "a.*")


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM part""")
def squad_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.squad(F.col("p_name")).alias("normal"))


@query(r"""WITH t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS token FROM documents)
SELECT token, CASE """ + " ".join(f"WHEN suffix(token, '{s}') AND length(token) >= {len(s) + 4} THEN left(token, length(token) - {len(s)})" for s in text.SUFFIXES) + " ELSE token END AS stem FROM t")
def stem_strip(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1)).alias("t")).select(F.lower("t").alias("token")).distinct()
    return t.select("token", text.stem(F.col("token")).alias("stem"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[A-Za-z0-9+/_-]{24,}', '[REDACTED_TOKEN]', 'g')) AS chars, len(regexp_extract_all(text, '[A-Za-z0-9+/_-]{24,}')) AS hits, sha256(regexp_replace(text, '[A-Za-z0-9+/_-]{24,}', '[REDACTED_TOKEN]', 'g')) AS digest FROM documents""")
def redact_tokens(spark, sf_dir):
    p = "[A-Za-z0-9+/_-]{24,}"
    out = text.redacted(F.col("text"), p)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(out).cast("long").alias("chars"), F.regexp_count("text", F.lit(p)).cast("long").alias("hits"), F.sha2(out, 256).alias("digest"))


@query("""WITH u AS (SELECT conv_id, min(turn) AS ut FROM conversations WHERE role IN ('user', 'human') GROUP BY 1), a AS (SELECT c.conv_id, ut, min(turn) AS at_ FROM conversations c JOIN u ON c.conv_id = u.conv_id AND turn > ut WHERE role IN ('assistant', 'gpt', 'bot', 'model') GROUP BY 1, 2)
SELECT a.conv_id, x.text AS user_prompt, y.text AS assistant_response FROM a JOIN conversations x ON x.conv_id = a.conv_id AND x.turn = ut JOIN conversations y ON y.conv_id = a.conv_id AND y.turn = at_""")
def first_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role").isin("user", "human")).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("u"))
    a = c.where(F.col("role").isin("assistant", "gpt", "bot", "model")).join(u, "conv_id").where("turn > u.turn").groupBy("conv_id", "u").agg(F.min(F.struct("turn", "text")).alias("a"))
    return a.select("conv_id", F.col("u.text").alias("user_prompt"), F.col("a.text").alias("assistant_response"))


@query("SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_assistant(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("turn"))


@query("""WITH c AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system')
SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alternates, count(*) AS turns FROM c GROUP BY 1""")
def role_alternation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return c.groupBy("conv_id").agg(F.bool_and(F.col("role") == F.when(F.col("i") % 2 == 0, "user").otherwise("assistant")).alias("alternates"), F.count("*").alias("turns"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'System: ' END || text, chr(10) || chr(10) ORDER BY turn) AS flat, bool_or(text IS NULL OR trim(text) = '') AS has_empty FROM conversations GROUP BY 1")
def flatten_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: "), "text")
    g = c.select("conv_id", "turn", line.alias("l"), (F.col("text").isNull() | (F.trim("text") == "")).alias("e")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "l"))).alias("m"), F.bool_or("e").alias("has_empty"))
    return g.select("conv_id", F.array_join(F.col("m.l"), "\n\n").alias("flat"), "has_empty")


SIM = "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(SIM + " SELECT a, b, round(s, 6) AS sim FROM p WHERE s >= 0.3")
def cosine_pairs(spark, sf_dir):
    return ops.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.3)


@query(SIM + ", d AS (SELECT a AS v FROM p WHERE s >= 0.3 UNION ALL SELECT b FROM p WHERE s >= 0.3) SELECT vec_id, 1 + count(v) AS family_size FROM embeddings LEFT JOIN d ON v = vec_id GROUP BY 1")
def family_size(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ends = ops.neighbours(e, 0.3)
    return e.select("vec_id").join(ends, "vec_id", "left").select("vec_id", (1 + F.coalesce("n", F.lit(0))).alias("family_size"))


@query("SELECT doc_id, text_id, copies FROM (SELECT doc_id, min(doc_id) OVER w AS text_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)) WHERE doc_id = text_id")
def exact_dedup_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", F.col("doc_id").alias("text_id"), "copies")


@query("SELECT min(doc_id) AS doc_id, count(*) AS duplicate_count, sum(n_chars)::BIGINT AS total_chars, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("h"))
    g = d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("duplicate_count"), F.sum("n_chars").alias("total_chars"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.where("duplicate_count > 1").drop("h")
