"""Word n-grams of texts, counted inside the row: no n-gram of the corpus is shuffled unless the answer needs it."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_materialized, materialize

#: n-grams of a benchmark that may be broadcast; a larger one is joined by n-gram.
MOST_BROADCAST = 2_000_000
#: Terms that a worker counts before it hands them on.
MOST_HELD = 300_000
WORD = re.compile(r"\w+")


def spans(words: list[str], low: int, high: int) -> list[str]:
    """All runs of low to high words, joined by a space."""
    out = []
    for k in range(low, high + 1):
        out += words if k == 1 else map(" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return out


def repeats(docs: DataFrame, n: int = 3, least: int = 2, id_: str = "doc_id") -> DataFrame:
    """doc_id, repeated, most: how many different n-grams of a text occur `least` times or more, and the highest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = [c for c in Counter(spans((t or "").lower().split(), n, n)).values() if c >= least]
                if counts:
                    rows.append((i, len(counts), max(counts)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[id_, "repeated", "most"])

    return docs.select(F.col(id_).cast("long"), "text").mapInArrow(run, f"{id_} long, repeated long, most long")


def shared_spans(docs: DataFrame, items: DataFrame, n: int, split: str) -> DataFrame:
    """doc_id, item_id, n, s: places of each item's n-grams (the last of equal ones) that a document holds too."""
    words = re.compile(split)
    read: Callable[[str | None], list[str]] = lambda t: [w for w in words.split((t or "").lower()) if w]

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = read(t)
                rows += [(i, g, s, len(w)) for g, s in {g: s for s, g in enumerate(spans(w, n, n))}.items()]
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["item_id", "g", "s", "n"])

    grams = items.select(F.col("item_id").cast("long"), "text").mapInArrow(of_items, "item_id long, g string, s long, n long")
    held = None
    if grams.count() <= MOST_BROADCAST:
        table: dict[str, list[tuple[int, int, int]]] = {}
        for r in grams.collect():
            table.setdefault(r["g"], []).append((r["item_id"], r["n"], r["s"]))
        held = docs.sparkSession.sparkContext.broadcast(table)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g in set(spans(read(t), n, n)):
                    if held is None:
                        rows.append((i, g, None, None, None))
                    else:
                        rows += [(i, None, *hit) for hit in held.value.get(g, ())]
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "g", "item_id", "n", "s"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of_docs, "doc_id long, g string, item_id long, n long, s long")
    return found.drop("g") if held is not None else found.select("doc_id", "g").join(grams, "g").select("doc_id", "item_id", "n", "s")


def vocabulary(docs: DataFrame, high: int, size: int) -> DataFrame:
    """term, df: the `size` terms of most occurrences (ties: the smaller term), with the number of documents that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf: Counter = Counter()
        df: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(tf), pa.string()), pa.array(list(tf.values()), pa.int64()), pa.array([df[t] for t in tf], pa.int64())], names=["term", "tf", "df"])
            tf.clear()
            df.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                own = Counter(spans(WORD.findall((t or "").lower()), 1, high))
                tf.update(own)
                df.update(own.keys())
                if len(tf) > MOST_HELD:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return counted.orderBy(F.desc("tf"), "term").limit(size).select("term", "df")


#: Characters of the texts that a worker hashes at once.
MOST_CHARS = 4_000_000


class _Words(dict):
    """64-bit hashes of words, the same in every process; emptied when it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_HELD:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def _factor(k: int, j: int) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(f"{k} {j}".encode(), digest_size=8).digest(), "little") | 1)


def _hashed(texts: list[str | None], high: int, memo: _Words) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """All words of the texts, and for each length up to `high`: a hash, the text's place and the first word's place of every n-gram, texts
    in order. Of 10^9 different n-grams some that matter to a vocabulary of 200,000 share a hash with a chance of 10^-5."""
    own = [WORD.findall((t or "").lower()) for t in texts]
    flat = list(chain.from_iterable(own))
    h = np.fromiter(map(memo.__getitem__, flat), np.uint64, len(flat))
    doc = np.repeat(np.arange(len(own)), list(map(len, own)))
    out = []
    for k in range(1, high + 1):
        n = max(0, len(h) - k + 1)
        at = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
        keys = np.zeros(len(at), np.uint64)
        for j in range(k):
            keys += h[at + j] * _factor(k, j)
        out.append((keys.view(np.int64), doc[at], at))
    return flat, out


def chunks(texts: Iterable) -> Iterator[list]:
    """Lists of texts of about MOST_CHARS together."""
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t or "")
        if chars > MOST_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _bits(known: np.ndarray) -> np.ndarray:
    """Which low ends of hashes are known, for a first look that costs no search."""
    out = np.zeros(1 << 22, bool)
    out[known & (len(out) - 1)] = True
    return out


def _lookup(known: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that are known, and theirs in `known`, which ascends."""
    hit = np.flatnonzero(bits[keys & (len(bits) - 1)])
    at = np.searchsorted(known, keys[hit]).clip(max=len(known) - 1)
    ok = known[at] == keys[hit]
    return hit[ok], at[ok]


def _term_key(term: str, memo: _Words) -> int:
    words = term.split(" ")
    total = sum(memo[w] * int(_factor(len(words), j)) for j, w in enumerate(words)) % 2**64
    return total - 2**64 if total >= 2**63 else total


def _top_keys(docs: DataFrame, high: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and document counts of the terms that vocabulary() gives. Hashes are counted in place of terms; only the terms
    that tie with the last place are spelt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for texts in chunks(t for b in batches for t in b.column(0).to_pylist()):
            parts = _hashed(texts, high, memo)[1]
            keys, doc = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(keys, kind="stable")  # texts stay in order within a hash
            keys, doc = keys[order], doc[order]
            new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
            starts = np.flatnonzero(new)
            seen = new.copy()
            seen[1:] |= doc[1:] != doc[:-1]
            df = np.add.reduceat(seen.astype(np.int64), starts) if len(starts) else starts
            yield pa.record_batch([pa.array(keys[starts]), pa.array(np.diff(np.r_[starts, len(keys)])), pa.array(df)], names=["key", "tf", "df"])

    texts = docs.select("text")
    sums = texts.mapInArrow(count, "key long, tf long, df long").groupBy("key").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    counts = materialize(sums.where("tf > 1"), "counts")
    have, last = 0, None
    for r in counts.groupBy("tf").count().orderBy(F.desc("tf")).toLocalIterator():
        have, last = have + r["count"], r["tf"]
        if have >= size:
            break
    if have < size:  # terms seen once belong to the vocabulary, too: few texts
        memo = _Words()
        top = {_term_key(r["term"], memo): r["df"] for r in vocabulary(docs, high, size).toLocalIterator()}
        keys, df = np.array(list(top), np.int64), np.array(list(top.values()), np.int64)
    else:
        rows = counts.where(F.col("tf") >= last).toPandas()
        tied = np.sort(rows.loc[rows["tf"] == last, "key"].to_numpy())
        keep = rows["tf"] > last
        if have > size:
            shared = docs.sparkSession.sparkContext.broadcast(tied)

            def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                memo, wanted = _Words(), shared.value
                found, bits = np.zeros(len(wanted), bool), _bits(wanted)
                for texts in chunks(t for b in batches for t in b.column(0).to_pylist()):
                    flat, parts = _hashed(texts, high, memo)
                    for k, (keys, _, at) in enumerate(parts, 1):
                        hit, place = _lookup(wanted, bits, keys)
                        hit, place = hit[~found[place]], place[~found[place]]
                        own, first = np.unique(place, return_index=True)
                        found[own] = True
                        yield pa.record_batch([pa.array(wanted[own]), pa.array([" ".join(flat[i : i + k]) for i in at[hit[first]].tolist()], pa.string())], names=["key", "term"])

            names = texts.mapInArrow(spell, "key long, term string").distinct().orderBy("term").limit(size - int(keep.sum()))
            keep |= (rows["tf"] == last) & rows["key"].isin([r["key"] for r in names.collect()])
        else:
            keep |= rows["tf"] == last
        keys, df = rows.loc[keep, "key"].to_numpy(), rows.loc[keep, "df"].to_numpy()
    drop_materialized(counts)
    order = np.argsort(keys)
    return keys[order], df[order]


def tfidf(docs: DataFrame, seeds: tuple[str, ...], high: int = 3, size: int = 200_000) -> DataFrame:
    """doc_id, score, seed: cosine with the nearest seed phrase (ties: the first), sublinear term counts and smooth idf, both
    L2-normalised, over a vocabulary of at most `size` terms. That bound holds for what is collected and broadcast, too."""
    n_docs = docs.count()
    keys, df = _top_keys(docs, high, size)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    memo, place = _Words(), {k: i for i, k in enumerate(keys.tolist())}
    weights = np.zeros((len(seeds), len(keys) + 1))
    for i, phrase in enumerate(seeds):
        own = Counter(spans(WORD.findall(phrase.lower()), 1, high))
        known = {place[k]: c for t, c in own.items() if (k := _term_key(t, memo)) in place}
        for at, c in known.items():
            weights[i, at] = (1 + math.log(c)) * idf[at]
        weights[i] /= math.sqrt((weights[i] ** 2).sum()) or 1.0
    asked = np.flatnonzero(weights.any(0))
    shared = docs.sparkSession.sparkContext.broadcast((keys, idf, asked, weights[:, asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, asked, weights = shared.value
        memo, bits = _Words(), _bits(known)
        for b in batches:
            score, seed = [], []
            for texts in chunks(b.column(1).to_pylist()):
                codes = []
                for keys, doc, _ in _hashed(texts, high, memo)[1] if len(known) else ():
                    hit, at = _lookup(known, bits, keys)
                    codes.append(doc[hit] * len(known) + at)
                codes, tf = np.unique(np.concatenate(codes or [np.empty(0, np.int64)]), return_counts=True)
                doc, at = np.divmod(codes, max(1, len(known)))
                w = (1 + np.log(tf)) * idf[at]
                norm = np.sqrt(np.bincount(doc, w * w, len(texts)))
                mine = np.flatnonzero(np.isin(at, asked))
                column = np.searchsorted(asked, at[mine])
                dots = np.array([np.bincount(doc[mine], w[mine] * q[column], len(texts)) for q in weights]).reshape(len(weights), len(texts))
                with np.errstate(invalid="ignore", divide="ignore"):
                    all_ = np.where(norm > 0, dots / norm, 0.0).T.tolist()
                for found in all_:
                    found = [round(x, 6) for x in found]
                    score.append(max(found, default=0.0))
                    seed.append(found.index(score[-1]) if found else 0)
            yield pa.record_batch([b.column(0), pa.array(score, pa.float64()), pa.array(seed, pa.int32())], names=["doc_id", "score", "seed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, seed int")
