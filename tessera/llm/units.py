"""Substring dedup by line hashing: the earliest occurrence of a line stays, the others go, with their original offsets kept.

A unit is a line, normalised as in lines.line_keys; units whose key is shorter than `least` bytes stay (op9 gives 1: only empty keys
stay). Every digest has one first place, the smallest (doc_id, text hash, line number) with null ids first, and a unit stays only
there: so the first places, grouped by document, tell all that goes, and no digest is ever joined with its occurrences. First places
are found within a worker, then within a partition, then over all, so that a line which a third of all rows hold is no hot key.

Null and empty texts are one empty line, and keep it. Rows equal in id and text are ranked one after the other: all but one of them
lose every unit. Very long texts are read whole; ties can't be, since a place is one line of one row. An empty table gives no rows.
Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, keyed_texts, slices
from .lines import line_keys

#: Digests whose first places a worker holds before it hands them on.
MOST_HELD = 50_000


def first_places(keyed: DataFrame, least: int) -> DataFrame:
    """digest, place: the first occurrence of each unit."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int]] = {}
        digest = xxhash.xxh3_128_digest

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held.values(), strict=True)) or [()] * 3
            out = pa.record_batch([pa.array(held, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=["digest", "k1", "k2", "pos"])
            held.clear()
            return out

        for b in slices(batches):
            for k1, k2, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), binary(b.column("text")), strict=True):
                for i, key in enumerate(line_keys(text)[1]):
                    if len(key) >= least:
                        d = digest(key)
                        place = k1, k2, i
                        if place < held.setdefault(d, place):
                            held[d] = place
                if len(held) > MOST_HELD:
                    yield flush()
        yield flush()

    found = keyed.select("text", "k1", "k2").mapInArrow(find, "digest binary, k1 long, k2 long, pos long")
    return found.groupBy("digest").agg(F.min(F.struct("k1", "k2", "pos")).alias("place"))


def dedup_units(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, n_bytes, n_units, n_removed, removed (start and end in bytes of each unit that went), kept_sha256."""
    keyed = keyed_texts(docs)
    stays = first_places(keyed, least).groupBy("place.k1", "place.k2").agg(F.collect_list("place.pos").alias("stays"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, stay, nth in zip(binary(b.column("text")), b.column("stays").to_pylist(), b.column("nth").to_pylist(), strict=True):
                lines, keys = line_keys(text)
                first, at, spans, kept = set(stay or ()) if nth == 1 else (), 0, [], []
                for i, (line, key) in enumerate(zip(lines, keys, strict=True)):
                    if len(key) < least or i in first:
                        kept.append(line)
                    else:
                        spans.append({"start": at, "end": at + len(line)})
                    at += len(line) + 1
                rows.append((len(text), len(lines), len(spans), spans, hashlib.sha256(b"\n".join(kept)).hexdigest()))
            c = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], span), pa.array(c[4], pa.string())], names=["doc_id", "n_bytes", "n_units", "n_removed", "removed", "kept_sha256"])

    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    joined = keyed.join(stays, ["k1", "k2"], "left").withColumn("nth", nth)
    return joined.select("doc_id", "text", "stays", "nth").mapInArrow(cut, "doc_id long, n_bytes long, n_units long, n_removed long, removed array<struct<start: long, end: long>>, kept_sha256 string")
