"""Corpus operators against brute force, exact round trips and held-out labels, on small tables with odd rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, html, lines, near, packing, rules, search, suffixes, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, box string, k1 string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    out = [None, "", " \n\t", "a", "é" * 150, "x" * 1000, "<|endoftext|> a's  b\n\n c\x1cd"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(10, 150))) for _ in range(50)]
    common = " ".join(rng.choice(words) for _ in range(60))
    out += [out[20]] * 4 + [out[21] + " more", "Menu LINE\n" + out[22], out[25][:40] + common + out[26], out[27] + common]
    out += [f"{out[30 + i]}\n  menu line \nend {i}" for i in range(12)]
    return out + [" ".join(rng.choice(words) for _ in range(6000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 9 else i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[12], rows[9]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def every(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.mark.parametrize("most", [4000, 2])
def test_suffix_dedup(docs, empty, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    rows = [(i, t.encode()) for i, t in every(docs)]
    count = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want.append((i, len(t), len(t) - len(kept), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert ordered(suffixes.dedup_substrings(docs), *cols) == sorted(want, key=repr)
    assert suffixes.dedup_substrings(empty).count() == 0


def test_interval_expansion():
    rng = random.Random(3)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [b"a" * 40]
    for least in (5, 9, 20):
        count = Counter(c[k : k + least] for c in contexts for k in range(len(c) - least + 1))
        for c, flags in zip(contexts, suffixes.repeated_starts(contexts, least)):
            assert flags.tolist() == [count[c[k : k + least]] > 1 for k in range(len(c) - least + 1)]


def test_line_dedup(docs, empty):
    rows = every(docs)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
    want = []
    for i, t in rows:
        kept = [x for x in t.split("\n") if count[key(x)] < 10]
        want.append((i, len(t.split("\n")), len(t.split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert ordered(lines.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    assert lines.dedup_lines(empty).count() == 0


def test_line_index_is_reversible(docs):
    first, second = docs.where("doc_id < 40"), docs.where("doc_id >= 40")
    a = lines.LineIndex.build(first)
    b = a.insert(second).delete(second)
    assert ordered(a.counts, "digest", "n_docs") == ordered(b.counts, "digest", "n_docs")


def test_cuckoo_filter():
    own = [hashlib.md5(b"%d" % i).digest() for i in range(5000)]
    f = lines.CuckooFilter(len(own))
    f.insert(own)
    f = lines.CuckooFilter.load(f.dump())
    assert f.holds(own).all()
    assert f.holds([hashlib.md5(b"no%d" % i).digest() for i in range(5000)]).mean() < 0.01
    f.delete(own[:2500])
    assert f.holds(own[2500:]).all() and f.holds(own[:2500]).mean() < 0.05


def test_bpe(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = []
    for i, x in every(docs):
        ids = t.encode(x, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert ordered(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip(empty).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert sorted(r["text"] for r in back.collect()) == sorted(x for _, x in every(docs))


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.default_path())
    pieces = packing.pack_documents(docs).collect()
    sequences, total = defaultdict(list), 0
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        total += p["length"]
    assert total == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in every(docs))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
        assert sum(s[-1]) <= 4096
    import zlib

    by_id = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in every(docs)}
    for p in pieces:
        own = by_id[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert packing.pack_documents(empty).count() == 0


def test_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.judge_documents(docs, labels).collect()}
    want = set()
    for i, t in every(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(8)}
        own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    assert got == want
    assert rules.judge_documents(empty, labels).count() == 0
    assert rules.judge_documents(docs, labels.where("false")).count() == docs.count()
    assert rules.keep_good(docs, labels).columns == docs.columns


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 1, (500, 4)), rng.normal(7, 0.5, (10, 4))])
    score = rules.IsolationForest(rows).score(rows)
    assert score[500:].min() > np.quantile(score[:500], 0.98)


def test_near(docs, empty):
    rows = every(docs)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = [(d, len(sets[i]), d if not sets[i] else least.get(find(i)), d == least.get(find(i)) if sets[i] else True) for i, (d, _) in enumerate(rows)]
    got = ordered(near.group_near(docs, width=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(a, b, c, k if d_ is None else d_) for (a, b, c, k), d_ in zip(want, [None] * len(want))], key=repr)
    assert near.group_near(empty).count() == 0


@pytest.mark.parametrize("block", [8192, 4])
def test_search(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (400, 8)) * rng.lognormal(0, 1, (400, 1)))]
    rows += [(401, None), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, rows[0][1]), (405, []), (None, rows[3][1]), rows[7], rows[50], rows[7]]
    table = spark.createDataFrame([(*r, "clash", 1.0, 2) for r in rows], "vec_id long, embedding array<double>, v string, norm double, block int")
    got = defaultdict(list)
    for r in search.top_k(table, bucket=64, block=block).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    own = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and None not in v and v[0] == v[0]]
    for q in range(0, 400, 50):
        mine = [v for i, v in own if i == q]
        want = sorted((-sum(a * b for a, b in zip(mine[0], v)), i) for i, v in own if i != q)[:5]
        assert sorted(got[q]) == sorted([(n + 1, i, -s) for n, (s, i) in enumerate(want)] * len(mine))
    assert not search.top_k(table.where("false")).count()


def test_classifier(spark, docs, empty):
    rng = random.Random(8)
    good = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(120)]
    bad = ["".join(rng.choice("abcdefgh#*$ ") for _ in range(900)) for _ in range(120)]
    net = classifier.ByteNet().fit([t.encode() for t in good[:80] + bad[:80]], np.array([1.0] * 80 + [0.0] * 80, np.float32))
    assert net.score([t.encode() for t in good[80:]]).min() > net.score([t.encode() for t in bad[80:]]).max()
    late = "".join(rng.choice("abcdefgh ") for _ in range(50_000)) + bad[100] * 3
    assert net.score([late.encode()])[0] < net.score([late[:50_000].encode()])[0]  # the end of a long text counts
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    got = classifier.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert classifier.score_documents(empty, labels.where("false")).count() == 0


def test_html(spark):
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three, and more of it.<p>Four &lt;five&gt;, six. Seven.</article><div class='comments'><p class=comment>No.</p></div><footer>&copy; me</footer>"
    assert html.trained().extract(page) == "A & B\n\nOne two three, and more of it.\n\nFour <five>, six. Seven."
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "plain  text")], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html.extract_pages(rows).collect()) == [0, 0, 10, 63, 63]
    assert html.extract_pages(rows.where("false")).count() == 0


def test_html_keeps_bare_and_linked_blocks():
    say = html.trained().extract
    assert say("<p>Hello there</p>") == "Hello there"
    assert say("<article><p>One, two. Three.</p><p><a href='/y'>Linked paragraph only</a></p><p>More text here.</p></article>") == "One, two. Three.\n\nLinked paragraph only\n\nMore text here."
    for tag in ("svg", "select", "iframe", "noscript"):
        assert say(f"<html><body><article><h1>Title</h1><{tag}><p>A paragraph after it, which goes on. And more of it.</p></article></body></html>").endswith("A paragraph after it, which goes on. And more of it.")
    assert say("<html><body><article><p>First of it, and more. Yes.</p><figure><img src=i><figcaption>What the picture shows</figcaption></figure></article></body></html>") == "First of it, and more. Yes.\n\nWhat the picture shows"
    assert say("<html><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a><li><a href=/b>News</a></ul></nav></body></html>") == ""
    assert say("x" * 3_000_000) == "x" * 3_000_000


def test_html_messages_are_exact():
    """Marginals by messages against sums over all states of small trees."""
    model = html.trained()
    rng = random.Random(1)
    for page, _ in html.labelled_pages(150, seed=3):
        nodes, _ = html.parse(page)
        if len(nodes) > 11:
            nodes, _ = html.parse(f"<div class='ad'><p>{rng.random()}, a. b</p><a href=x>y</a></div><p>Word. <b>c</b></p>")
        at = {id(x): i for i, x in enumerate(nodes)}
        own = [[sum(model.weights[f][s] for f in html.features(x) if f in model.weights) for s in (0, 1)] for x in nodes]
        total, one = 0.0, [0.0] * len(nodes)
        for bits in range(1 << len(nodes)):
            s = [bits >> i & 1 for i in range(len(nodes))]
            p = np.exp(model.root[s[0]] + sum(own[i][s[i]] for i in range(len(nodes))) + sum(model.pair[s[at[id(x.parent)]], s[i]] for i, x in enumerate(nodes) if x.parent))
            total += p
            for i in range(len(nodes)):
                one[i] += p * s[i]
        got = model.marginals(nodes)
        assert all(abs(one[i] / total - got[id(x)]) < 1e-9 for i, x in enumerate(nodes))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_html_on_the_tables(spark):
    """The pages' articles, read by their own marks: every article whole, and no menu, advert or footer."""
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?(?:p|h1)\b[^>]*>", "\0", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " "))
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", x))).strip() for x in inner.split("\0")]
        want = "\n\n".join(x for x in blocks if x)
        assert got[r["page_id"]] == (want, len(want))


def test_unit_dedup(spark, docs, empty):
    passage = " a passage Of over twenty bytes "
    odd = [(70, f"x\n{passage}\n{passage.strip().upper()}\nshort"), (71, passage), (71, "other\n" + passage), (72, ""), (73, None), (74, "own line of one row\nx"), (74, "own line of one row\nx")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash") for i, t in odd], SCHEMA))
    rows = sorted(every(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}).encode()
    for least in (20, 1):
        seen, want = set(), []
        for i, text in rows:
            spans, at, kept = [], 0, []
            for line in text.split("\n"):
                k, n = key(line), len(line.encode())
                if len(k) >= least and k in seen:
                    spans.append((at, at + n))
                else:
                    kept.append(line)
                seen.add(k)
                at += n + 1
            want.append((i, len(text.encode()), text.count("\n") + 1, len(spans), spans, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        got = [(r["doc_id"], r["n_bytes"], r["n_units"], r["n_removed"], [tuple(x) for x in r["removed"]], r["kept_sha256"]) for r in units.dedup_units(docs, least).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert units.dedup_units(empty).count() == 0


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now, ids = docs, []
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / f"s{len(ids)}"))
        now = spark.read.parquet(str(tmp_path / f"s{len(ids)}"))
        ids.append(sorted(r["doc_id"] or -1 for r in now.collect()))
    assert ids[1] == ids[0] and set(ids[2]) <= set(ids[1]) and ids[3] == ids[2]
    assert len({20, 57, 58, 59, 60} & set(ids[2])) == 1  # one of the copies stays
    assert not now.where(F.lower("text").contains("menu line")).count()
    assert pipeline.STAGES[-1][1](spark, now, str(tmp_path)).select("doc_id").distinct().count() == len(set(ids[3]))
