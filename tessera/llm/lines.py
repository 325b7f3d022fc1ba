"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased; its digest is 128 bits.  The reference
count of a digest is the number of document rows that hold it; it lives in an exact table (digest, n_docs) of all digests, also of
those under the threshold.  Every shard keeps a cuckoo filter of the digests at or above it.  Documents can be inserted and deleted:
counts move up and down, digests enter and leave the stored filter of their shard, which is built anew only if it has no room.  A line
is dropped if the filter of its shard holds it and the exact table confirms it; a filter alone never decides.  Filters are broadcast
while their total size is below a checked bound; beyond it every task's distinct digests are dealt to the filter of their shard.

Null and empty texts are one empty line; empty keys are never dropped.  Repeated rows count as documents of their own.  Null ids pass.
A count that ties with the threshold drops the line.  Very long texts are read whole, lines of any length; an empty table gives no
rows.  Other columns pass only where they are named in `extra`, as one struct, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, keyed_texts, materialize, schema_with, slices, small_batches

#: Bytes of filters that may be broadcast.
MOST_BROADCAST = 64 << 20
#: Digests that one filter shard holds, about.
SHARD_KEYS = 200_000


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = text.split(b"\n")
    return lines, [x.strip(b" \t\n\x0b\x0c\r").lower() for x in lines]


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a digest lies in one of two buckets, which know each other by the fingerprint.

    What doesn't fit after the kicks is counted by fingerprint and bucket pair, so that no insertion is ever lost and each can be taken
    out again: places of one fingerprint and pair are alike, wherever they lie."""

    def __init__(self, keys: int, slots: np.ndarray | None = None, spilled: dict[bytes, int] | None = None):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / 4 / 0.8))))
        self.slots = np.zeros((self.buckets, 4), np.uint16) if slots is None else slots.reshape(-1, 4)
        self.buckets = len(self.slots)
        self.spilled: Counter = Counter(spilled or {})

    def places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        prints = (words[:, 0] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (words[:, 1] % np.uint64(self.buckets)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ ((np.asarray(prints, np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def insert(self, digests: list[bytes]) -> None:
        slots, state = self.slots, 12345
        for d, p, a, b in zip(digests, *[x.tolist() for x in self.places(digests)], strict=True):
            at = a if 0 in slots[a] else b
            for _ in range(200):
                free = np.flatnonzero(slots[at] == 0)
                if len(free):
                    slots[at, free[0]] = p
                    break
                state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                j = (state >> 8) & 3
                p, slots[at, j] = int(slots[at, j]), p
                at = int(self.other(at, p))
            else:  # full: the last fingerprint has no room, so its bucket pair is kept exactly
                self.spilled[self._name(p, at, int(self.other(at, p)))] += 1

    @staticmethod
    def _name(p: int, a: int, b: int) -> bytes:
        return int(p).to_bytes(2, "little") + int(min(a, b)).to_bytes(8, "little")

    def delete(self, digests: list[bytes]) -> None:
        """Take out digests that were inserted; others must not be given."""
        for p, a, b in zip(*[x.tolist() for x in self.places(digests)], strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.slots[at] == p)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break
            else:
                name = self._name(p, a, b)
                if self.spilled[name] <= 1:
                    del self.spilled[name]
                else:
                    self.spilled[name] -= 1

    def holds(self, digests: list[bytes]) -> np.ndarray:
        prints, a, b = self.places(digests)
        found = (self.slots[a] == prints[:, None]).any(1) | (self.slots[b] == prints[:, None]).any(1)
        if self.spilled:
            found |= np.array([self._name(p, x, y) in self.spilled for p, x, y in zip(prints, a, b, strict=True)], bool)
        return found

    def dump(self) -> bytes:
        rows = [k + n.to_bytes(4, "little") for k, n in sorted(self.spilled.items())]
        return len(rows).to_bytes(4, "little") + b"".join(rows) + self.slots.tobytes()

    @staticmethod
    def load(blob: bytes) -> CuckooFilter:
        n = int.from_bytes(blob[:4], "little")
        rows = [blob[4 + 14 * i : 18 + 14 * i] for i in range(n)]
        return CuckooFilter(0, np.frombuffer(blob[4 + 14 * n :], np.uint16).copy(), {r[:10]: int.from_bytes(r[10:], "little") for r in rows})


def shard_of(digests: list[bytes], shards: int) -> np.ndarray:
    """By the last three bytes of a digest, which sharded() reads as well."""
    return (np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)[:, 1] & np.uint64(0xFFFFFF)).astype(np.int64) % shards


def count_lines(docs: DataFrame, sign: int = 1) -> DataFrame:
    """(digest, n_docs): what the documents add to the reference counts; sign -1 for documents to delete. Counted per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array([sign * n for n in counts.values()], pa.int64())], names=["digest", "n"])
            counts.clear()
            return out

        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            for text in binary(b.column("text")):
                counts.update(map(digest, {k for k in line_keys(text)[1] if k}))
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    return small_batches(docs).select("text").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n_docs"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """The exact table after insertions and deletions; digests whose count falls to zero leave it."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("digest").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


def sharded(digests: DataFrame, shards: int) -> DataFrame:
    """The rows with the shard of their digest."""
    return digests.withColumn("shard", (F.conv(F.hex(F.expr("substring(digest, 14, 3)")), 16, 10).cast("long") % shards).cast("int"))


def build_filters(frequent: DataFrame, shards: int, only: list[int] | None = None) -> DataFrame:
    """(shard, filter): a cuckoo filter for every shard of the frequent digests, or for those named only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = sorted(map(bytes, pdf["digest"]))
        own = CuckooFilter(len(digests))
        own.insert(digests)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [own.dump()]})

    table = sharded(frequent.select("digest"), shards)
    if only is not None:
        table = table.where(F.col("shard").isin(only))
    return table.groupBy("shard").applyInPandas(run, "shard int, filter binary")


def update_filters(filters: DataFrame, moved: DataFrame, frequent: DataFrame, shards: int) -> DataFrame:
    """filters after the digests of moved (digest, enters) have entered or left; only filters without room are built anew."""

    def run(key: tuple, own: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        if not len(moves):
            return own[["shard", "filter"]]
        blob = None
        if len(own):
            f = CuckooFilter.load(bytes(own["filter"].iloc[0]))
            come, go = [sorted(map(bytes, moves.loc[moves["enters"] == x, "digest"])) for x in (True, False)]
            if np.count_nonzero(f.slots) + len(come) - len(go) <= 0.9 * f.slots.size:
                if go:
                    f.delete(go)
                if come:
                    f.insert(come)
                blob = f.dump()
        return pd.DataFrame({"shard": [int(key[0])], "filter": [blob]})

    done = materialize(filters.groupBy("shard").cogroup(sharded(moved, shards).groupBy("shard")).applyInPandas(run, "shard int, filter binary"), "filters")
    full = [r["shard"] for r in done.where("filter IS NULL").select("shard").collect()]
    return materialize(done.where("filter IS NOT NULL").unionByName(build_filters(frequent, shards, full)), "filters") if full else done


class LineIndex:
    """Reference counts of all lines and stored filters of a corpus; insert() and delete() return a new index, so any step can be taken back."""

    def __init__(self, counts: DataFrame, least: int = 10, shards: int = 0, filters: DataFrame | None = None):
        """counts: materialized, of every digest, so that one below the threshold can come to it."""
        self.counts, self.least = counts, least
        self.frequent = materialize(counts.where(F.col("n_docs") >= least).select("digest"), "frequent")
        self.total = self.frequent.count()
        self.shards = shards or max(1, -(-self.total // SHARD_KEYS))
        self.filters = materialize(build_filters(self.frequent, self.shards), "filters") if filters is None else filters

    @staticmethod
    def build(docs: DataFrame, least: int = 10) -> LineIndex:
        return LineIndex(materialize(count_lines(docs), "lines"), least)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(count_lines(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._moved(count_lines(docs, -1))

    def _moved(self, change: DataFrame) -> LineIndex:
        change = materialize(change, "change")
        out = LineIndex(materialize(merge_counts(self.counts, change), "lines"), self.least, self.shards, self.filters)
        old = F.coalesce(self.counts["n_docs"], F.lit(0))
        both = change.withColumnRenamed("n_docs", "by").join(self.counts, "digest", "left").select("digest", (old >= self.least).alias("was"), (old + F.col("by") >= self.least).alias("enters"))
        out.filters = update_filters(self.filters, both.where("was <> enters").select("digest", "enters"), out.frequent, self.shards)
        return out

    def apply(self, docs: DataFrame, with_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 (and text, with the columns named in extra) of every row of docs under this index."""
        keyed = keyed_texts(docs)
        found = self._broadcast(keyed) if self.total * 8 <= MOST_BROADCAST else self._dealt(keyed)  # a filter has 2.5 to 5 bytes a digest
        # A digest that a third of all rows hold isn't a hot key here: the semi join is against distinct digests and AQE splits skew.
        dropped = found.join(self.frequent, "digest", "left_semi").groupBy("k1", "k2").agg(F.collect_set("digest").alias("dropped"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_128_digest
            for b in slices(batches):
                n, gone, sha, texts = [], [], [], []
                for text, drop in zip(binary(b.column("text")), b.column("dropped").to_pylist(), strict=True):
                    if drop:
                        lines, keys = line_keys(text)
                        drop = set(drop)
                        kept = [x for x, k in zip(lines, keys, strict=True) if not k or digest(k) not in drop]
                        n.append(len(lines))
                        gone.append(len(lines) - len(kept))
                        text = b"\n".join(kept)
                    else:
                        n.append(text.count(b"\n") + 1)
                        gone.append(0)
                    sha.append(hashlib.sha256(text).hexdigest())
                    texts.append(text if with_text else b"")
                columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
                names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("text")
                yield pa.record_batch([*columns, *(b.column(x) for x in extra)], names=[*names, *extra])

        schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
        joined = keyed_texts(docs, *extra).join(dropped, ["k1", "k2"], "left")
        return joined.select("doc_id", "text", "dropped", *extra).mapInArrow(cut, schema_with(schema, joined, extra))

    def _broadcast(self, keyed: DataFrame) -> DataFrame:
        """(k1, k2, digest) of the lines that the filters hold, which every task has."""
        shards = self.shards
        blobs = keyed.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.load(v) for k, v in blobs.value.items()}
            for b in line_digests(batches):
                flat = b.column("digest").to_pylist()
                kept, shard = np.zeros(len(flat), bool), shard_of(flat, shards)
                for s in np.unique(shard).tolist():
                    if s in filters:
                        own = np.flatnonzero(shard == s)
                        kept[own] = filters[s].holds([flat[i] for i in own.tolist()])
                yield b.filter(pa.array(kept))

        return keyed.select("text", "k1", "k2").mapInArrow(probe, "k1 long, k2 long, digest binary")

    def _dealt(self, keyed: DataFrame) -> DataFrame:
        """The same where the filters are too large to broadcast: lines go to their shard's filter, which comes before them in order.
        Each filter goes to as many tasks as there are deals of a shard, so that a shard with a very common line is no single task."""
        deals = max(1, -(-int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // self.shards))
        lines = sharded(keyed.select("text", "k1", "k2").mapInArrow(line_digests, "k1 long, k2 long, digest binary"), self.shards)
        lines = lines.withColumns({"deal": F.pmod(F.xxhash64("k1", "k2"), F.lit(deals)).cast("int"), "filter": F.lit(None).cast("binary")})
        filters = self.filters.select(F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), F.lit(None).cast("binary").alias("digest"), "shard", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "filter")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = held = None
            for b in batches:
                groups = list(zip(b.column("shard").to_pylist(), b.column("deal").to_pylist(), strict=True))
                kept, digests = np.zeros(b.num_rows, bool), b.column("digest").to_pylist()
                at = 0
                while at < len(groups):
                    end = at
                    while end < len(groups) and groups[end] == groups[at]:
                        end += 1
                    if digests[at] is None:
                        now, held = groups[at], CuckooFilter.load(b.column("filter")[at].as_py())
                        at += 1
                    if at < end and groups[at] == now:  # a shard without a frequent digest has no filter
                        kept[at:end] = held.holds(digests[at:end])
                    at = end
                yield b.filter(pa.array(kept)).select(["k1", "k2", "digest"])

        ordered = lines.select(filters.columns).unionByName(filters).repartition("shard", "deal").sortWithinPartitions("shard", "deal", F.col("filter").isNull())
        return ordered.mapInArrow(probe, "k1 long, k2 long, digest binary")


def line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, digest of the distinct lines of each row that aren't empty."""
    digest = xxhash.xxh3_128_digest
    for b in slices(batches):
        keys = [list(map(digest, {k for k in line_keys(t)[1] if k})) for t in binary(b.column("text"))]
        rows = pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in keys]))
        if len(rows):
            yield pa.record_batch([b.column("k1").take(rows), b.column("k2").take(rows), pa.array([d for k in keys for d in k], pa.binary())], names=["k1", "k2", "digest"])


def dedup_lines(docs: DataFrame, least: int = 10, with_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Drop every line whose key at least `least` documents hold."""
    return LineIndex.build(docs, least).apply(docs, with_text, extra)
