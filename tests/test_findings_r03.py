"""Findings of the third round: queries on odd rows against their SQL, and steps in bounded blocks against brute force."""

import random
import re
import time

import duckdb
import numpy as np
import pandas as pd

from tessera.catalog import ORACLES, QUERIES
from tessera.functions import repetition as fn
from tessera.operators import grams, selection
from tessera.plans import prompts

SF = "/root/testdata/sf0.001"


def same(spark, folder, name, **tables):
    """The query's rows, after a comparison with its SQL on the same tables."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


TURNS = "conv_id long, turn long, role string, text string"
TEXTS = "doc_id long, text string"


def test_phrases_are_not_broadcast_with_texts(spark, tmp_path):
    texts = ["the", "the, man", "The man saw the dog", "please tell me about the man", "please tell me about the dog.", None, "", "a b c d e f g a b c d", "a b c d", "b-c?d", "b c d e", "the", "a b c d e f"]
    rows = [(i % 9, i // 9, "user" if i % 4 else "assistant", texts[i * 7 % len(texts)]) for i in range(40)] + [(20 + i, 0, "user", x) for i, x in enumerate(texts)]
    assert len(same(spark, tmp_path, "phrase_match", conversations=(rows, TURNS))) > 10
    plan = QUERIES["phrase_match"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join [key" in plan and "BroadcastHashJoin [key" not in plan


def test_articles_next_to_letters_of_other_scripts(spark, tmp_path):
    odd = ["çané enle", "éa de l'île", "the thé", "a\x0ba the\x0bend", "añ ña a", "an an\tthe\na", "anë thè_a", "Èvi rerevi çané enle en, leierê. Éonéier oueau les anêle de.", "Eauré élevi. Des laèeuxéan reauxè de ouletion. Ierpaé la de "]
    rows = [(4 * i, t, "user", x) for i, x in enumerate(odd) for t in range(3)]
    assert same(spark, tmp_path, "tagged_f1", conversations=(rows, TURNS))
    for name in ("answer_checks", "provider_mentions", "dispatched_rewards"):
        assert same(spark, tmp_path, name, conversations=(rows, TURNS))


def test_ratio_of_an_empty_text(spark, tmp_path):
    assert [r[0] for r in same(spark, tmp_path, "script_ratio", documents=([(1, ""), (2, "äö"), (3, None), (4, "no")], TEXTS))] == [2]


def unit(n, seed, dim=6):
    rng, rows = random.Random(seed), []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dim)]
        size = sum(x * x for x in v) ** 0.5
        rows.append((i * 3, [x / size for x in v]))
    return rows


VECTORS = "vec_id long, embedding array<double>"


def small_steps(monkeypatch):
    """Limits so small that every loop turns often."""
    for name, value in {"BLOCK_VALUES": 60, "SLAB_VALUES": 40, "MOST_QUERIES": 3, "MOST_DRIVEN": 7}.items():
        monkeypatch.setattr(selection, name, value)


def test_partner_whose_cosine_rounds_up_to_the_band(spark, tmp_path, monkeypatch):
    small_steps(monkeypatch)
    edge = [(0, [1.0, 0.0]), (3, [0.1999996, (1 - 0.1999996**2) ** 0.5]), (6, [-1.0, 0.0])]  # 0.2 once rounded
    assert ("3", "0") in {(str(a), str(b)) for a, b in same(spark, tmp_path, "judged_merge", embeddings=(edge, VECTORS))}
    assert len(same(spark, tmp_path, "judged_merge", embeddings=(unit(60, 2), VECTORS))) == 60


def test_nearest_in_slabs_with_ties(spark, tmp_path, monkeypatch):
    small_steps(monkeypatch)
    rows = [(i, v) for i, (_, v) in enumerate(unit(60, 6))] + [(60 + i, [1.0] + [0.0] * 5) for i in range(30)]  # equal rows tie
    assert same(spark, tmp_path, "vector_contamination", embeddings=(rows, VECTORS))


def test_family_sizes_in_slabs(spark, tmp_path, monkeypatch):
    small_steps(monkeypatch)
    assert len(same(spark, tmp_path, "family_size", embeddings=(unit(50, 3), VECTORS))) == 50


def test_greedy_makes_no_pairs(spark, tmp_path, monkeypatch):
    small_steps(monkeypatch)
    monkeypatch.setattr(selection, "cosine_pairs", None)  # not called
    for rows in (unit(50, 4), unit(50, 5, 40), []):  # many alike, few alike, none
        assert bool(same(spark, tmp_path, "greedy_select", embeddings=(rows, VECTORS))) == bool(rows)
        assert bool(same(spark, tmp_path, "greedy_reassign", embeddings=(rows, VECTORS))) == bool(rows)


def test_workers_hold_one_slab_of_pairs(spark, monkeypatch):
    small_steps(monkeypatch)
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], VECTORS)  # all alike: as many pairs as there can be
    shapes = selection._block_pairs(rows, lambda slabs: (pd.DataFrame({"n": [s.size]}) for _, _, s in slabs), "n long")
    assert 0 < max(r["n"] for r in shapes.collect()) <= selection.SLAB_VALUES
    assert selection.cosine_pairs(rows, 0.9).count() == 50 * 49 // 2


def test_ties_at_the_end_of_the_vocabulary(spark, monkeypatch):
    rng = random.Random(11)
    words = ["äb", "the", "of", "x_1", "2", "Zoo", "中文", "a", "b", "c"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) or None) for i in range(60)], TEXTS).repartition(3)
    monkeypatch.setattr(grams, "MOST_CHARS", 90)
    for size in (1, 7, 20, 60, 100, 5000):  # within ties of two occurrences and more, and of one
        keys, df = grams._top_keys(docs, 3, size)
        want = {grams._term_key(r["term"], grams._Words()): r["df"] for r in grams.vocabulary(docs, 3, size).collect()}
        assert dict(zip(keys.tolist(), df.tolist(), strict=True)) == want and sorted(want) == keys.tolist()


def test_terms_are_counted_by_hash(spark, monkeypatch):
    monkeypatch.setattr(grams, "vocabulary", None)  # no term of the corpus is dealt while ones seen twice fill the vocabulary
    docs = spark.createDataFrame([(i, "the of the of that was") for i in range(9)] + [(9, None), (10, "")], TEXTS)
    got = {r["doc_id"]: (r["score"] > 0, r["seed"]) for r in grams.tfidf(docs, ("the of", "that was"), size=4).collect()}
    assert got[0] == (True, 0) and got[9] == got[10] == (False, 0)


def test_scores_are_made_once_before_they_are_ranked(spark, tmp_path, monkeypatch):
    made, write = [], prompts.materialize
    monkeypatch.setattr(prompts, "materialize", lambda df, label: made.append(label) or write(df, label))
    rows = [(i, w, "s", "en", len(w)) for i, w in enumerate(["apple pear plum"] * 9 + ["plum"] * 3)]
    assert same(spark, tmp_path, "prompt_candidates", documents=(rows, "doc_id long, text string, source string, lang string, n_chars long"))
    assert made == ["scored"]


def test_heads_beyond_any_pattern(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéñ中 ") for _ in range(60))
    items = [(i, word()) for i in range(10_500)] + [(20_000, "x" * 39), (20_001, None), (20_002, items_end := "y" * 40 + "!"), (20_003, items_end)]
    docs = [(i, "z" * (i % 5) + items[i * 31][1][: 38 + i % 5] + word(), f"s{i % 3}") for i in range(200)] + [(300, "y" * 40, None), (301, None, "s1"), (302, "", "s9"), (303, "y" * 39, "s1"), (304, "y" * 90, "s1")]
    tables = {"benchmark": (items, "item_id long, text string"), "documents": (docs, "doc_id long, text string, source string")}
    assert any(r[1] for r in same(spark, tmp_path, "contamination_matrix", **tables))
    tables["benchmark"] = ([], "item_id long, text string")
    assert not any(r[1] for r in same(spark, tmp_path, "contamination_matrix", **tables))


def test_kinds_by_marks_are_kinds_by_patterns():
    rng = random.Random(10)
    parts = ["import ", "x", "(", ")", "[", "]", "{", " for ", "math.", "a_1", " = ", "**", "2", "/", "lambda ", ":", "def ", "f", "-", "*", "\n", "1. ", "é", "·", " ", "while ", "+", "<"]
    every = lambda patterns, flags=0: re.compile("|".join(f"(?:{p})" for p in patterns), flags)
    formula, statement, complex_ = every(fn.FORMULA), every(fn.STATEMENT, re.I), every(fn.COMPLEX)
    signs, open_, closed, paired = re.compile("[" + re.escape(fn.SIGNS) + "]"), re.compile(fn.OPEN), re.compile(fn.CLOSED_ONLY), re.compile(fn.PAIRED)
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert fn.is_formula(t) == bool(signs.search(t) or formula.search(t)), t
        assert fn.is_statement(t) == bool(((open_.search(t) or closed.search(t)) and not paired.search(t)) or statement.search(t)), t
        assert fn.is_complex(t) == bool(complex_.search(t)), t


def test_kinds_look_at_a_beginning_once():
    text = "wort " * 20_000  # patterns of a beginning are not tried at every place
    start = time.process_time()
    assert not (fn.is_statement(text) or fn.is_formula(text) or fn.is_complex(text))
    assert time.process_time() - start < 0.02
