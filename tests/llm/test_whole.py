"""Registered corpus queries do the whole job: rows that a narrower form of them would leave out."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import classifier, common, lines, near, packing, passages, queries, rules, search, suffixes

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_unit_dedup_takes_short_lines(spark, tmp_path):
    rows = [(1, "ok\n\nfirst"), (2, " OK \nä\n\n"), (3, "Ä\nä\nok\nlast")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_unit_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["removed"] for r in got] == ["", "0-4", "3-5,6-8"]
    kept = ["ok\n\nfirst", "ä\n\n", "Ä\nlast"]  # the first of a line stays, and empty lines do
    assert [r["kept_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in kept]


def test_passages_inside_lines_go(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, f"ok\nhead {passage} tail"), (2, f"OK\nother start\t{passage.upper().replace(' ', chr(10), 5)} other tail"), (3, passage[:-4] + "\nok"), (4, None), (5, " a" * 500)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_passage_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    at = len("OK\nother start\t")
    assert [r["removed"] for r in got] == ["", f"{at}-{at + len(passage)}", "", "", "103-1000"]  # a run keeps one passage
    kept = [rows[0][1], "OK\nother start\t other tail", rows[2][1], "", " a" * 51 + " "]
    assert [r["kept_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in kept]
    assert [r["n_removed"] for r in got] == [0, 51, 0, 0, 449]


def test_passages_against_a_sequential_walk(spark, monkeypatch):
    monkeypatch.setattr(passages, "MOST_HELD", 500)
    rng, gap = random.Random(5), (" ", "\n", " \t", "\x0b\r\n")
    say = lambda n, of: "".join(rng.choice(of) + rng.choice(gap) for _ in range(n))
    common = say(30, [f"é{i}" for i in range(9)])
    texts = [None, "", " \n", "a", common, "a " * 100, "a b c " * 40, "x\x1cy\x85z " * 30, say(3000, "abcdE")]
    texts += [rng.choice(("", " ")) + say(rng.randint(0, 60), ["a", "B", "cé", "D" * 9]) + common[rng.randint(0, 40) :] + say(rng.randint(0, 60), "uvw") for _ in range(60)]
    rows = [(None if i == 20 else 100 - i, t) for i, t in enumerate(texts)] + [(200, texts[8]), (201, common), (201, common), (201, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for words in (3, 12, 25):
        first, want = {}, []
        for nth, (i, text) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
            data = (text or "").encode()
            found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
            own, gone = [data[x:y].lower() for x, y in found], set()
            for s in range(len(own) - words + 1):
                doc, at = first.setdefault(tuple(own[s : s + words]), (nth, s))
                if (doc, at) != (nth, s):
                    gone.update(range(max(s, at + words) if doc == nth else s, s + words))
            spans = []
            for p in sorted(gone):
                spans[-1:] = [(spans[-1][0], found[p][1])] if p - 1 in gone else [*spans[-1:], found[p]]
            kept = b"".join(data[x:y] for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)], strict=True))
            want.append((i, len(data), len(found), len(gone), spans, hashlib.sha256(kept).hexdigest()))
        got = [(r["doc_id"], r["n_bytes"], r["n_words"], r["n_removed"], [tuple(x) for x in r["removed"]], r["kept_sha256"]) for r in passages.dedup_passages(docs, words).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert sum(r[3] > 0 for r in want) > 20
    assert passages.dedup_passages(docs.limit(0)).count() == 0


def test_search_with_a_negative_axis():
    rng = np.random.default_rng(3)
    for d in (2, 3, 16):  # the longest rows are 0.65 rad off the axis, which all others and the queries are near
        p = rng.normal(0, 0.02, (900, d))
        off = np.where(np.arange(900) < 830, rng.uniform(-0.1, 0.1, 900), 0.65)
        p[:, 0], p[:, 1] = -np.cos(off), p[:, 1] + np.sin(off)
        p = np.floor(256 * 40 * p * np.where(np.arange(900) < 830, rng.uniform(1, 1.04, 900), 1.1)[:, None])
        norm, q = np.linalg.norm(p, axis=1), p[:60].copy()
        order = np.argsort(-norm, kind="stable")
        best = search.Best(np.arange(60), 5)
        for at in range(0, 900, 64):
            own = order[at : at + 64]
            search.search_bucket(best, q, np.linalg.norm(q, axis=1), p[own], norm[own], own)
        for i in range(60):
            want = sorted((-int(q[i] @ p[j]), j) for j in range(900) if j != i)[:5]
            assert list(zip((-best.score[i]).tolist(), best.who[i].tolist())) == want, (d, i)


def test_lines_move_in_stored_filters(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 40)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    base = [(i, "\n".join(f"line {j}" for j in range(150) if i < 3 or j >= 50 and i < 2 + j % 2)) for i in range(4)]
    more = [(10, "line 7\nnew line"), (11, "line 8\nline 9\nnew line"), (12, "new line\nline 60\nline 61")]
    answer = lambda index, docs: sorted(map(tuple, index.apply(docs).collect()))
    both = frame(base + more)
    now = lines.LineIndex.build(frame(base), 3)
    assert now.shards > 1
    was, rebuilt, fewer = answer(now, both), answer(lines.LineIndex.build(both, 3), both), answer(lines.LineIndex.build(frame(base[1:] + more), 3), both)
    assert was != rebuilt != fewer
    full = []
    build = lines.build_filters
    monkeypatch.setattr(lines, "build_filters", lambda f, s, only=None: full.append(only) or build(f, s, only))
    grown = now.insert(frame(more))
    assert answer(grown, both) == rebuilt
    assert answer(grown.delete(frame(base[:1])), both) == fewer
    assert answer(grown.delete(frame(more)), both) == was
    assert None not in full  # none built all filters anew
    for index in (grown, grown.delete(frame(more))):
        held = {r["shard"]: lines.CuckooFilter.load(bytes(r["filter"])) for r in index.filters.collect()}
        digests = [bytes(r["digest"]) for r in index.frequent.collect()]
        assert all(held[s].holds([d])[0] for d, s in zip(digests, lines.shard_of(digests, index.shards).tolist()))
        assert sum(int((f.slots > 0).sum()) + sum(f.spilled.values()) for f in held.values()) == len(digests)


def test_filters_give_back_what_spilled():
    alike = [b"\x01" * 6 + b"\x07\x00" + i.to_bytes(8, "little") for i in range(0, 12 * 4096, 4096)]  # one fingerprint, one bucket pair
    f = lines.CuckooFilter(8)
    f.insert(alike)
    assert f.spilled and f.holds(alike).all()
    f.delete(alike[:9])
    f = lines.CuckooFilter.load(f.dump())
    assert f.holds(alike[9:]).all() and sum(f.spilled.values()) + int((f.slots > 0).sum()) == 3
    f.delete(alike[9:])
    assert not f.holds(alike).any()


def test_lines_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 7, 60, 1 + i % 3)) + "\neverywhere") for i in range(40)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lines, "SHARD_KEYS", 12)
    index = lines.LineIndex.build(docs)
    assert index.shards > 1
    want = sorted(map(tuple, index.apply(docs).collect()))
    assert any(r[2] for r in want)
    monkeypatch.setattr(lines, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, index.apply(docs).collect())) == want
    again = index.delete(docs.where("doc_id < 30")).insert(docs.where("doc_id < 30"))
    assert sorted(map(tuple, again.apply(docs).collect())) == want


def brute(rows, least=200):
    """doc_id, n_bytes, n_removed, kept_sha256 by counting every string."""
    count = {}
    for _, t in rows:
        for k in range(len(t) - least + 1):
            count[t[k : k + least]] = count.get(t[k : k + least], 0) + 1
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_long_text_over_the_edge_of_a_part(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(suffixes, "PART", 3000)
    long = bytearray(rng.integers(97, 123, 40_000, dtype=np.uint8).tobytes())
    long[2900:3200] = long[20_000:20_300]  # over the edge of the first part
    rows = [(1, bytes(long)), (2, b"q" * 50 + bytes(long[8_990:9_300]) + b"z" * 50), (3, bytes(long[:199]))]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixes.dedup_substrings(docs).collect())
    assert got == brute(rows) and got[0][2] >= 900


def test_two_megabytes_of_one_text(spark):
    rng = np.random.default_rng(6)
    long = bytearray(rng.integers(97, 123, 2_200_000, dtype=np.uint8).tobytes())
    at = [suffixes.PART * k - 150 for k in (1, 9)]
    long[at[1] : at[1] + 400] = long[at[0] : at[0] + 400]
    row = spark.createDataFrame([(1, bytes(long).decode())], "doc_id long, text string")
    r = suffixes.dedup_substrings(row).first()
    assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(long), 800, 2)


def test_copies_are_fetched_once(spark):
    rng = np.random.default_rng(7)
    text = rng.integers(97, 123, 900, dtype=np.uint8).tobytes().decode()
    variant = text[:450] + "#" + text[451:]
    docs = spark.createDataFrame([(i, text) for i in range(1000)] + [(5000, variant), (5001, "short"), (5001, "short")], "doc_id long, text string")
    texts = suffixes.named(docs)
    need = suffixes.sort_out(suffixes.find_runs(texts, 200, 40)).where("need")
    bodies = suffixes.fetch(texts, need, 200, 40)
    assert 0 < bodies.count() == need.dropDuplicates(["h", "th", "pos"]).count() < 30
    got = {(r["n_bytes"], r["n_removed"]) for r in suffixes.dedup_substrings(docs).collect()}
    assert got == {(900, 900), (900, 899), (5, 0)}


def plain_score(net, text):
    """The network's score by loops over positions, filters and chunks."""
    size = net.step * net.block
    n = max(1, -(-len(text) // size))
    data = text.ljust(n * size, b"\0") + bytes(net.width)
    blocks = []
    for b in range(n):
        tops = []
        for f in range(net.filters):
            tops.append(max(sum(float(net.table[k, data[(b * net.block + i) * net.step + k], f]) for k in range(net.width)) for i in range(net.block)))
        blocks.append([max(0.0, x + float(net.bias[f])) for f, x in enumerate(tops)])
    chunks = [[max(x, y) for x, y in zip(blocks[b], blocks[b + 1 if b + 1 < n else max(b - 1, 0)])] for b in range(n)]
    vector = [sum(c[f] for c in chunks) / n for f in range(net.filters)] + [max(c[f] for c in chunks) for f in range(net.filters)]
    return 1 / (1 + math.exp(-sum(a * float(w) for a, w in zip(vector, net.out)) - float(net.out_bias[0])))


def test_network_by_loops():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc #") for _ in range(n)) for n in (0, 1, 255, 256, 257, 900)] + [bytes(8)]
    net = classifier.ByteNet().fit(texts * 3, np.array([1, 0, 1, 0, 1, 0, 1] * 3, np.float32), epochs=2)
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-5)  # all at once, of differing lengths


def test_network_learns_from_bounded_bytes(spark):
    docs = spark.createDataFrame([(i, f"{'ab' if i % 2 else '##'} " * 200) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert isinstance(classifier.train(docs, labels), classifier.ByteNet)
    assert classifier.train(docs, labels, most_bytes=10) == 0.5  # room for no text


SF = "/root/testdata/sf0.01"


def held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None}
    return {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0}


def test_classifier_query_on_held_out_labels(spark):
    if not os.path.isdir(SF):
        return
    got = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, SF).collect()}
    labels = {i: q for i, q in held_out(spark).items() if i in got}
    assert all(got[i]["held_out"] for i in labels)
    good, bad = ([got[i]["score"] for i, q in labels.items() if q == x] for x in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.97
    assert np.mean([a >= 0.3 for a in good]) > 0.97


def test_rules_on_labels_that_the_forest_has_not_seen(spark):
    if not os.path.isdir(SF):
        return
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    unseen = held_out(spark)
    got = {r["doc_id"]: r for r in rules.judge_documents(docs, labels.where(~labels["doc_id"].isin(list(unseen)))).collect()}
    lost = lambda q: np.mean([not got[i]["kept"] for i, x in unseen.items() if x == q and not (q and got[i]["base_failed"])])
    assert lost(0) > 0.6 and lost(1) < 0.06


def test_forest_by_loops(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg#") * rng.randint(1, 9) for _ in range(rng.randint(5, 80)))) for i in range(80)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(80)], "doc_id long, quality int")
    forest, limit = rules.fit_forest(docs, labels)
    harmonic = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(stats):
        total = 0.0
        for feature, cut, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = int(left[at] if stats[feature[at]] <= cut[at] else right[at])
            total += path[at]
        return 2 ** (-total / len(forest.trees) / harmonic(forest.sample))

    counts = {i: rules.text_counts(t.encode()) for i, t in rows}
    fit = sorted((score(s) for i, (c, s) in counts.items() if c[0] >= 20 and i % 5), reverse=True)
    assert math.isclose(limit, fit[min(len(fit) - 1, int(len(fit) * 0.008))], rel_tol=1e-9)
    got = {r["doc_id"]: r["kept"] for r in rules.judge_documents(docs, labels).collect()}
    for i, (c, s) in counts.items():
        if abs(score(s) - limit) > 1e-9:
            assert got[i] == (c[0] >= 20 and 100 * c[4] <= 30 * c[0] and score(s) <= limit)


def test_packing_with_another_tokenizer(tmp_path):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = packing.default_path().replace("word_bpe_49k.json", name)
        encoder, plain = packing.WordEncoder(path), Tokenizer.from_file(path)
        for t in (*packing.PROBES, "Some more Text, with É and\n\n lines.  End", ""):
            assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_rules_learn_from_all_labels(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefg#") * rng.randint(1, 9) for _ in range(rng.randint(15, 40)))) for i in range(6000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(6000)], "doc_id long, quality int")
    forest, limit = rules.fit_forest(docs.repartition(5), labels)
    counts = [rules.text_counts(t.encode()) for _, t in rows]
    stats = np.array([s for c, s in counts if c[0] >= 20])
    good = np.sort(forest.score(np.array([s for i, (c, s) in enumerate(counts) if c[0] >= 20 and i % 5])))[::-1]
    assert limit == good[int(len(good) * 0.008)]
    # what a tree is grown on comes from all of them, in the same way for any partitions, and is held to its size
    again, same = rules.fit_forest(docs.repartition(3), labels)
    assert same == limit and all((x == y).all() for a, b in zip(forest.trees, again.trees, strict=True) for x, y in zip(a, b, strict=True))
    at = spark.createDataFrame([(i % 3 * 2**33 + i // 3, s.tolist()) for i, s in enumerate(stats)], "at long, stats array<double>")
    drawn = rules.draw(at, 400, 32)
    assert len(drawn) == 400 and all(len(np.unique(x, axis=0)) <= len(x) == 32 for x in drawn)
    places = {s.tobytes() for x in drawn for s in x}
    assert places <= {s.tobytes() for s in stats} and len(places) > 0.9 * len({s.tobytes() for s in stats})  # 12,800 draws
    assert len(rules.draw(at.limit(20), 3, 32)[0]) == 20


def test_largest_by_rank(spark):
    values = [0.5, 0.5, 0.5 + 1e-9, 0.25, 1.0, 1.0, 0.0]
    for before, want in enumerate(sorted(values, reverse=True)):
        assert rules.largest(spark.createDataFrame([(x,) for x in values], "score double"), before) == want


def test_sets_deal_only_the_wanted_texts(spark):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(f"{rng.getrandbits(40):x}" for _ in range(500))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = common.keyed_texts(docs)
    wanted = common.materialize(keyed.where("doc_id % 20 = 0 or doc_id is null and k2 % 20 = 0").select("k1", "k2", F.monotonically_increasing_id().alias("node")), "wanted")
    key = lambda d: {(r["k1"], r["k2"]) for r in d.select("k1", "k2").collect()}
    few = key(near.likely(keyed, wanted))
    assert key(wanted) <= few and len(few) < 150 and near.likely(keyed, wanted.where("false")).isEmpty()
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    dealt = lambda: sum(stages().apply(i).shuffleWriteBytes() for i in range(stages().size()))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = common.materialize(docs, "docs")
        before = dealt()
        got = {r["node"]: r["own"] for r in near.sets(docs, wanted, 5).collect()}
        assert dealt() - before < sum(len(t) for _, t in rows) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    texts = {(r["k1"], r["k2"]): r["text"] for r in keyed.collect()}
    own = near.Shingler(5, 1, 1)
    assert got == {r["node"]: own.set_of(texts[r["k1"], r["k2"]].encode()).view(np.int64).tolist() for r in wanted.collect()}
