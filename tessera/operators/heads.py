"""Documents that hold one of many literal strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .grams import chunks

#: Bytes of a string that are hashed; strings have as many at least.
HEAD = 40


def _words(data: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """A hash of the bytes first to last (a multiple of 8) after each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(first, last, 8):
        word = np.zeros(len(at), np.uint64)
        for j in range(8):
            word |= data[at + (k + j)].astype(np.uint64) << np.uint64(8 * j)
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def holders(docs: DataFrame, heads: dict[str, list[int]]) -> DataFrame:
    """doc_id, source, eval of each document that holds a head, for each number of that head. A place is a candidate by its first two
    bytes, then by eight, then by HEAD of them, and in the end by the whole head."""
    raw = {h.encode(): e for h, e in heads.items()}
    joined = np.frombuffer(b"".join(h[:HEAD] for h in raw) or b"\0", np.uint8)
    starts = np.arange(len(raw)) * HEAD
    two = np.zeros(1 << 16, bool)
    two[joined[starts].astype(np.int64) | joined[starts + 1].astype(np.int64) << 8] = True
    by_hash: dict[int, list[bytes]] = {}
    for h, k in zip(raw, _words(joined, starts, 0, HEAD).tolist(), strict=True):
        by_hash.setdefault(k, []).append(h)
    shared = docs.sparkSession.sparkContext.broadcast((raw, two, np.unique(_words(joined, starts, 0, 8)), by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, two, eight, by_hash = shared.value
        for b in batches:
            ids, sources, done, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), 0, []
            for texts in chunks(b.column(2).to_pylist()):
                own = [(t or "").encode() for t in texts]
                joined = b"\xff".join(own) + b"\xff" * HEAD  # no text holds that byte
                data = np.frombuffer(joined, np.uint8)
                begin = np.cumsum([0] + [len(x) + 1 for x in own])
                pair = data[1 : len(data) - HEAD + 1].astype(np.uint16) << np.uint16(8)
                pair |= data[: len(data) - HEAD]
                at = np.flatnonzero(two[pair])
                at = at[np.isin(_words(data, at, 0, 8), eight)]
                found = set()
                for place, k in zip(at.tolist(), _words(data, at, 0, HEAD).tolist(), strict=True):
                    for h in by_hash.get(k, ()):
                        if joined.startswith(h, place):
                            i = done + int(np.searchsorted(begin, place, "right")) - 1
                            found |= {(i, e) for e in raw[h]}
                rows += [(ids[i], sources[i], e) for i, e in found]
                done += len(texts)
            c = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64())], names=["doc_id", "source", "eval"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, eval long")
