"""Queries that cover their whole table, against brute force."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import selection
from tessera.plans import corpus
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_powers_over_the_cap(spark):
    begin = {1: 0, 2: 13, 3: 19}
    rows = spark.createDataFrame([(1, 13), (2, 6), (3, 3)], "doc_id long, n_chars long")
    got = sorted([begin[r["doc_id"]] + r["start"], begin[r["doc_id"]] + r["start"] + 2 ** r["exponent"]] for r in corpus.capped_powers(rows, "n_chars", 1, 2).collect())
    assert got == [[0, 4], [4, 8], [8, 12], [13, 17], [17, 19], [19, 21]]  # the reference's golden: buckets 2 and 4
    lengths = [0, 31, 32, 2047, 2048, 4095, 4096, 6149, 24_783]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_chars long")
    pieces = {i: [] for i in range(len(lengths))}
    for r in corpus.capped_powers(rows, "n_chars", 5, 11).orderBy("doc_id", "start").collect():
        pieces[r["doc_id"]].append((r["start"], 2 ** r["exponent"]))
    for i, n in enumerate(lengths):  # one after the other, largest first, all but the last n % 32
        assert [s for s, _ in pieces[i]] == [sum(k for _, k in pieces[i][:j]) for j in range(len(pieces[i]))]
        assert sum(k for _, k in pieces[i]) == n // 32 * 32 and all(k <= 2048 for _, k in pieces[i])


def checks(t):
    """As the reference's checkers count: str.lower, str.upper, str.split and Python's word edges."""
    return (
        "the" in t, sum(w == "the" for w in re.findall(r"\b\w+\b", t.lower())), t.lower().count("e"), "," not in t,
        t == t.lower(), t == t.upper(), len(t.split()), len(re.findall(r"\*[^*\n]+\*", t)),
    )


def test_constraints_of_any_text(spark, tmp_path):
    columns = ["keyword", "frequency", "letters", "no_commas", "is_lower", "is_upper", "words", "highlights"]
    odd = [None, "", "über the Theé thé the", "STRASSE ß", "ÄÖÜ É", "äöü é", "a b c\x1cd\x85e​f", "thé _the the1 the² THE中 the", "İ the", "ΑΣ ας", "*ä* *b\nc* **", "中文,the。", "ﬁ Ŀ ǅ"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in QUERIES["constraint_checks_all"](spark, str(tmp_path)).collect()}
    assert got == {i: checks(t or "") for i, t in rows}
    ascii_only = {r["doc_id"]: tuple(r[c] for c in columns) for r in QUERIES["constraint_checks"](spark, str(tmp_path)).where(F.col("doc_id") >= 100).collect()}
    assert ascii_only and all(got[i] == x for i, x in ascii_only.items())


def test_greedy_walks_long_chains(spark):
    n = 120  # i is linked with i + 1: two ids are decided a round
    nodes, links = spark.range(n).withColumnRenamed("id", "vec_id"), spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    want = list(range(0, n, 2))
    assert sorted(r["id"] for r in selection.greedy_keep(nodes, links).collect()) == want


def test_greedy_in_rounds(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(150)})
    kept = []
    for i in range(80):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    nodes, links = spark.range(80).withColumnRenamed("id", "vec_id"), spark.createDataFrame([(b, a) for a, b in pairs], "a long, b long")
    for most in (0, 40):  # rounds to the end; rounds, then a walk
        assert sorted(r["id"] for r in selection.greedy_keep(nodes, links, most).collect()) == kept


def test_repeats_of_short_lines(spark, tmp_path):
    rows = [(1, "12345\n12345 \nx\nx"), (2, "1234\n1234"), (3, "0123456789\n\n0123456789\n\n12345\n\n12345")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select("doc_id", "repeated_items", "most").collect()))
    assert got("line_repeats_all") == [(1, 1, 2), (3, 2, 2)]
    assert got("paragraph_repeats") == [(3, 1, 2)]
