"""Substring dedup by hashing windows of words: the earliest occurrence of a passage stays, the others go, wherever in a line they lie.

A passage is `words` neighbouring words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Its first place is the smallest (doc_id, text hash, word
number), null ids first; everywhere else its words go, and of white space what lies between two words that go. An occurrence that
overlaps its own first place loses only the words after it, so that a text of one word said a thousand times keeps one passage.

Only windows that may occur twice are exchanged: equal windows have an equal least gram of GRAM words, so these grams are counted first
(about one word in 22 begins one), and those found twice or more are broadcast as a bit filter of 16 MB at most, which lets through
all of them and a few others (more beyond 8.4 million grams). A row of the exchange is a run of windows with one least gram, or a single
window, dealt by its digest, where that gram is frequent: of a passage which a third of all rows hold, the windows over its ends differ
from row to row. First places are found among the windows that a worker holds, then over all. Windows count as equal if their least
grams' hashes and their own 64-bit digests are.

Null and empty texts keep what they have, and texts of fewer words than a passage do. Rows equal in id and text are ranked one after the
other: all but one of them lose every passage. Very long texts are read whole; ties can't be, since a place is one word of one row. An
empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, drop_materialized, frequent_keys, keyed_texts, materialize, slices
from .near import BITS_A_ROW, MOST_BITS, mixed

#: Words of the grams that windows are told apart by before they are hashed.
GRAM = 8
#: Windows or grams that a worker holds before it hands on what is first among them.
MOST_HELD = 400_000
#: Odd, and 5 modulo 8: a power less one has few factors of two, so that words changing places change a window's digest.
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def digests(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number for each `width` neighbouring hashes, the same wherever they stand."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)))
    return (sums[width:] - sums[:-width]) * powers(pow(BASE, -1, 1 << 64), len(hashes) - width + 1)


def sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """least (minimum or maximum) of each `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x, n = least(x[:-n], x[n:]), 2 * n
    return least(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def windows(text: bytes, words: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, hashes of all grams, and of each window its least gram's hash and its digest."""
    found = text.lower().split()
    if len(found) < words:
        return len(found), *(np.empty(0, np.uint64),) * 3
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), np.uint64).reshape(-1, 2)
    grams = mixed(digests(hashes[:, 0], min(GRAM, words)))
    return len(found), grams, sliding(np.minimum, grams, words - min(GRAM, words) + 1), digests(hashes[:, 1], words)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in bytes of each word."""
    own = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], (own != 32) & ((own < 9) | (own > 13)), [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def repeated_grams(keyed: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The bit filter of the grams that are least in a window at two places or more, and the frequent ones of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            return pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["gram", "n"])

        for b in slices(batches):
            for text in binary(b.column("text")):
                _, grams, least, _ = windows(text, words)
                if len(least):  # a gram is chosen where it equals the least of a window that holds it
                    wide = len(grams) - len(least) + 1
                    around = np.zeros(wide - 1, np.uint64)
                    held.append(grams[sliding(np.maximum, np.concatenate((around, least, around)), wide) == grams])
                    n += len(held[-1])
                if n > MOST_HELD:
                    yield flush()
                    held, n = [], 0
        yield flush()

    twice = materialize(keyed.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"), "grams")
    bits = 1 << 15
    while bits < min(MOST_BITS, BITS_A_ROW * twice.count()):
        bits *= 2
    bit = F.pmod("gram", F.lit(bits)) + 1  # bitmap functions number the first bit 1
    marks = twice.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("marks"))
    out = np.zeros(bits // 8, np.uint8)
    for r in marks.collect():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["marks"], np.uint8)
    frequent = frequent_keys(twice, ["gram"], "n")
    often = np.array([r["gram"] for r in frequent.collect()], np.int64).view(np.uint64)
    drop_materialized(twice, frequent)
    return out, often


def may_repeat(least: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bit = least & np.uint64(8 * len(marks) - 1)
    return (marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def first_places(keyed: DataFrame, words: int, grams) -> DataFrame:
    """k1, k2, pos, n: runs of n windows, each of them the first occurrence of its passage, among those that may repeat."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            least, digest = (np.concatenate([x[i] for x in held]) if held else np.empty(0, np.uint64) for i in range(2))
            k1, k2, pos = (np.concatenate([x[i] for x in held]) if held else np.empty(0, np.int64) for i in range(2, 5))
            order = np.lexsort((pos, k2, k1, digest, least))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(least[order]) != 0) | (np.diff(digest[order]) != 0)
            stay = order[new]
            stay = stay[np.lexsort((pos[stay], k2[stay], k1[stay]))]
            least, digest, k1, k2, pos = (x[stay] for x in (least, digest, k1, k2, pos))
            cut = np.ones(len(stay), bool)
            often = np.isin(least, grams.value[1])
            cut[1:] = often[1:] | (np.diff(least) != 0) | (np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(pos) != 1)
            at = np.flatnonzero(cut)
            ends = pa.py_buffer((np.append(at, len(stay)) * 8).astype(np.int32))
            own = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(np.ascontiguousarray(digest))])
            dealt = np.where(often, digest, least)[at].view(np.int64)
            return pa.record_batch([pa.array(dealt), pa.array(least[at].view(np.int64)), *(pa.array(x[at]) for x in (k1, k2, pos)), own], names=["dealt", "least", "k1", "k2", "pos", "digests"])

        for b in slices(batches):
            for k1, k2, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), binary(b.column("text")), strict=True):
                _, _, least, digest = windows(text, words)
                pos = np.flatnonzero(may_repeat(least, grams.value[0]))
                if len(pos):
                    held.append((least[pos], digest[pos], np.full(len(pos), k1), np.full(len(pos), k2), pos))
                    n += len(pos)
                if n > MOST_HELD:
                    yield flush()
                    held, n = [], 0
        yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for b in batches:
            rows = []
            for dealt, least, k1, k2, pos, own in zip(*(b.column(c).to_pylist() for c in ("dealt", "least", "k1", "k2", "pos", "digests")), strict=True):
                if (dealt, least) != last:
                    last, seen = (dealt, least), set()
                own = np.frombuffer(own, np.uint64).tolist()
                new = np.array([d not in seen for d in own])
                seen.update(own)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], new, [False])).astype(np.int8))).tolist()
                rows += [(k1, k2, pos + x, y - x) for x, y in zip(edges[::2], edges[1::2], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "pos", "n"])

    found = keyed.select("text", "k1", "k2").mapInArrow(find, "dealt long, least long, k1 long, k2 long, pos long, digests binary")
    return found.repartition("dealt").sortWithinPartitions("dealt", "least", "k1", "k2", "pos").mapInArrow(choose, "k1 long, k2 long, pos long, n long")


def cut_words(least: np.ndarray, digest: np.ndarray, n: int, words: int, stays: list | None, marks: np.ndarray) -> np.ndarray:
    """Which of a text's n words go; stays are the runs of its windows that are first places, None where all of another row's are."""
    gone, first = may_repeat(least, marks), np.zeros(len(least), bool)
    for s in stays or ():
        first[s["pos"] : s["pos"] + s["n"]] = True
    at = np.flatnonzero(gone & ~first)
    _, index, own = np.unique(digest, return_index=True, return_inverse=True)
    before = index[own[at]]  # where the text has the same window first
    start = np.where(first[before], np.maximum(at, before + words), at)
    edges = np.bincount(start, minlength=n + 1) - np.bincount(at + words, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def dedup_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_words, n_removed (words), removed (start and end in bytes of each run that went), kept_sha256."""
    keyed = keyed_texts(docs)
    grams = docs.sparkSession.sparkContext.broadcast(repeated_grams(keyed, words))
    stays = first_places(keyed, words, grams).groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "n")).alias("stays"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, stay, nth in zip(binary(b.column("text")), b.column("stays").to_pylist(), b.column("nth").to_pylist(), strict=True):
                n, _, least, digest = windows(text, words)
                gone = cut_words(least, digest, n, words, stay if nth == 1 else None, grams.value[0]) if len(least) else np.zeros(n, bool)
                spans, kept, at = [], hashlib.sha256(), 0
                if gone.any():
                    starts, ends = word_places(text)
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    for x, y in zip(starts[edges[::2]].tolist(), ends[edges[1::2] - 1].tolist(), strict=True):
                        kept.update(text[at:x])
                        spans.append({"start": x, "end": y})
                        at = y
                kept.update(text[at:])
                rows.append((len(text), n, int(gone.sum()), spans, kept.hexdigest()))
            c = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], span), pa.array(c[4], pa.string())], names=["doc_id", "n_bytes", "n_words", "n_removed", "removed", "kept_sha256"])

    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    joined = keyed.join(stays, ["k1", "k2"], "left").withColumn("nth", nth)
    return joined.select("doc_id", "text", "stays", "nth").mapInArrow(cut, "doc_id long, n_bytes long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_sha256 string")
