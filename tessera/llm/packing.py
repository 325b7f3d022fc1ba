"""Harmonic packing of token sequences.

A document's remainder of r tokens (after whole sequences are cut off) belongs to the reciprocal-capacity class k = capacity // r,
at most `classes`; a bin of class k takes exactly k such remainders.  What a bin lacks to its capacity is filled with the head of
the next document that arrives, since documents may be cut freely.  Every partition packs for itself in one pass and holds at most
the open bins of the classes; what is open at its end first fills the bin that still takes heads and is then laid end to end and cut
at capacity and at powers of two.  So at most one sequence a partition needs padding: the bin that takes heads, if all that is open
doesn't fill it.

Null and empty texts are one piece with the end id.  Null and repeated ids pass through, each row is packed on its own.  Very long
texts are encoded whole and cut at capacity; an empty table gives no rows; there are no ties, and documents of one class keep their
order.  Other columns take no part, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices

WORD = re.compile(r"[^ \n\t\r]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words that are Latin letters, then signs: their ids are those of the lower-case letters, then those of the signs.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*|]*)")
#: Texts on which a tokenizer must show that it reads words one by one, and simple words as SIMPLE says.
PROBES = ("The end, of it.", " two  spaces\nand a\tline ", "É#1 don't STOP!?", "naïve $$$ ÜBER%% a", "x")


class Words(dict):
    """Word to ids, little-endian unsigned 32-bit; a missing word is encoded by the tokenizers library."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.simple = tokenizer, False

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        m = SIMPLE.fullmatch(word) if self.simple else None
        if m and (core := m[1].lower()) != word:
            found = self[core] + self[m[2]] if m[2] else self[core]
        else:
            found = self.encoded(word)
        self[word] = found
        return found


class WordEncoder:
    """Ids of whole texts by the tokenizers library. If its pattern never spans white space, every distinct word is encoded once; a
    tokenizer that reads PROBES otherwise gets whole texts."""

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.known = Words(tokenizer)
        self.keep = keep
        join = lambda t: b"".join([self.known.encoded(w) for w in WORD.findall(t)])
        self.by_words = all(join(t) == self.known.encoded(t) for t in PROBES)
        words = [m for t in PROBES for w in WORD.findall(t) if (m := SIMPLE.fullmatch(w))]
        self.known.simple = all(self.known.encoded(m[0]) == self.known.encoded(m[1].lower()) + self.known.encoded(m[2]) for m in words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return [self.known.encoded(t) for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        get, find = self.known.__getitem__, WORD.findall
        return [b"".join(map(get, find(t))) for t in texts]


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


class HarmonicPacker:
    """Streams documents into sequences; pieces come out as tuples in SCHEMA's order."""

    def __init__(self, capacity: int = 4096, classes: int = 64, first_id: int = 0):
        self.capacity, self.classes, self.next = capacity, classes, first_id
        self.waiting: dict[int, list[tuple]] = {k: [] for k in range(1, classes + 1)}
        self.gap = 0  # of the one bin that still takes heads
        self.open = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    @staticmethod
    def _piece(doc_id, ids: bytes, start: int, length: int, total: int, sequence: int, offset: int) -> tuple:
        return doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, offset

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        total, start, out = len(ids) // 4, 0, []
        if self.gap:
            head = min(self.gap, total)
            out.append(self._piece(doc_id, ids, 0, head, total, self.open, self.capacity - self.gap))
            self.gap -= head
            start = head
        while total - start >= self.capacity:
            out.append(self._piece(doc_id, ids, start, self.capacity, total, self._new(), 0))
            start += self.capacity
        if total > start:
            k = min(self.classes, self.capacity // (total - start))
            row = self.waiting[k]
            row.append((doc_id, ids[4 * start :], start, total))
            if len(row) == k:
                self.waiting[k] = []
                self.open, at = self._new(), 0
                for d, own, s, t in row:
                    out.append((d, s, len(own) // 4, zlib.crc32(own), t, self.open, at))
                    at += len(own) // 4
                self.gap = self.capacity - at
        return out

    def finish(self) -> list[tuple]:
        """Fill the open bin with what waits, then cut the rest at capacity and at powers of two."""
        rest = [x for row in self.waiting.values() for x in row]
        left = sum(len(x[1]) // 4 for x in rest)
        room: list[tuple[int, int, int]] = []  # sequence, offset, tokens
        used = 0 if not self.gap else self.capacity - self.gap
        if self.gap:
            take = min(self.gap, left)
            if take == self.gap or not used:
                room.append((self.open, used, take))
                left -= take
            else:  # the open bin stays short: it ends where its tokens end
                room.append((self.open, used, take))
                left = 0
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            room.append((self._new(), 0, size))
            left -= size
        self.gap, out, at = 0, [], 0
        for d, own, s, t in rest:
            n, done = len(own) // 4, 0
            while done < n:
                while not room[at][2]:
                    at += 1
                sequence, offset, size = room[at]
                take = min(size, n - done)
                out.append((d, s + done, take, zlib.crc32(own[4 * done : 4 * (done + take)]), t, sequence, offset))
                room[at] = (sequence, offset + take, size - take)
                done += take
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, classes: int = 64, end_id: int = 2) -> DataFrame:
    """One row per piece, in SCHEMA's columns; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path or default_path())
        packer = HarmonicPacker(capacity, classes, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 7
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in slices(batches):
            found = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                found += packer.add(doc_id, ids + end)
            yield rows(found)
        yield rows(packer.finish())

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
