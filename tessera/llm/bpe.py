"""Byte-level BPE encoding and decoding with a pair occurrence index.

All distinct pre-tokens of a block of documents are laid out in one symbol array.  An index maps every adjacent pair that has a
merge rank to all of its positions; active ranks are taken in ascending order, every position of that pair is merged at once, and
the lists of the neighbouring pairs are updated.  Encoded pieces are kept by text, so each distinct piece is merged once a worker.

Null texts encode as empty; empty texts give no ids.  Repeated rows and null ids pass through unchanged, one output row per input row.
Very long texts are encoded whole; of equal pairs the leftmost is merged first, so there are no ties; an empty table gives no rows;
other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: The published pre-tokenisation pattern of byte-level BPE.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space beyond space, tab and line ends; where it occurs, texts aren't cut before they are matched.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: bytes that print stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairIndexBpe:
    """A vocabulary and its merges, read from a tokenizers JSON file."""

    def __init__(self, path: str, keep: int = 700_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.first_ids = np.array([vocab[c] for c in letters], np.int32)
        self.pairs = []
        self.rank = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            ids = vocab[a], vocab[b], vocab[a + b]
            if self.rank.setdefault(ids[0] * self.size + ids[1], len(self.pairs)) == len(self.pairs):
                self.pairs.append(ids)
        self.first_rank = np.array([[self.rank.get(int(a) * self.size + int(b), -1) for b in self.first_ids] for a in self.first_ids], np.int32)
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.text = [str(i) for i in range(self.size)]
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit bytes, by the pair occurrence index."""
        size, rank = self.size, self.rank
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        n = len(raw)
        stops = np.zeros(n, bool)
        stops[ends] = True
        ids = np.where(stops, -1, self.first_ids[raw])
        found = self.first_rank[raw[:-1], raw[1:]]
        found[stops[:-1] | stops[1:]] = -1
        places = np.flatnonzero(found >= 0)
        order = places[np.argsort(found[places], kind="stable")]
        ranks, starts = np.unique(found[order], return_index=True)
        index = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(order, starts[1:]), strict=True)} if len(order) else {}
        sym = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        active = list(index)
        heapq.heapify(active)
        pop, push, pairs = heapq.heappop, heapq.heappush, self.pairs
        while active:
            r = pop(active)
            row = index.pop(r, None)
            if row is None:
                continue
            a, b, c = pairs[r]
            if a == b:
                row.sort()
            right = c * size
            for i in row:
                j = after[i]
                if sym[i] != a or sym[j] != b:
                    continue
                k = after[j]
                sym[i], sym[j], after[i] = c, -2, k
                before[k] = i
                p = before[i]
                if p >= 0 and (x := sym[p]) >= 0 and (r2 := rank.get(x * size + c)) is not None:
                    if r2 in index:
                        index[r2].append(p)
                    else:
                        index[r2] = [p]
                        push(active, r2)
                if (x := sym[k]) >= 0 and (r2 := rank.get(right + x)) is not None:
                    if r2 in index:
                        index[r2].append(i)
                    else:
                        index[r2] = [i]
                        push(active, r2)
        ids = np.array(sym, np.int64)
        kept = np.cumsum(ids >= 0)[ends] * 4
        flat = ids[ids >= 0].astype("<u4").tobytes()
        return [flat[x:y] for x, y in zip([0, *kept[:-1].tolist()], kept.tolist(), strict=True)]

    def _learn(self, pieces: set[str]) -> None:
        known, words = self.known, self.words
        parts = [(p, PIECES.findall(p)) for p in pieces]
        new = list({w for _, ws in parts for w in ws if w not in words})
        words.update(zip(new, self.merge([w.encode() for w in new]) if new else [], strict=True))
        for p, ws in parts:
            known[p] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit arrays."""
        cut = []
        for t in texts:
            spans = self.cut_added.split(t) if self.cut_added and any(x in t for x in self.added) else [t]
            cut.append([s if i % 2 else CHUNK.findall(s) if not RARE_SPACE.search(s) else [s] * bool(s) for i, s in enumerate(spans)])
        if len(self.known) > self.keep:
            self.known.clear()
        if len(self.words) > self.keep:
            self.words.clear()
        known = self.known
        new = {p for spans in cut for s in spans if isinstance(s, list) for p in s if p not in known}
        if new:
            self._learn(new)
        out = []
        for spans in cut:
            out.append(np.frombuffer(b"".join([np.array([self.added[s]], "<u4").tobytes() if isinstance(s, str) else b"".join(map(known.__getitem__, s)) for s in spans]), "<u4"))
        return out

    def decode(self, ids) -> str:
        """The text of the ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_LOADED: dict[str, PairIndexBpe] = {}


def loaded(path: str) -> PairIndexBpe:
    """One vocabulary per worker process."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: every whole text encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for b in slices(batches):
            ids = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows doc_id, ids array<int>; null ids decode as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode what was encoded, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for b in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode([t or "" for t in b.column("text").to_pylist()]):
                own = ids.tolist()
                n.append(len(own))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.text.__getitem__, own)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
