"""Substring dedup by suffix order: every byte covered by a repeated string of `least` bytes goes.

Within a shard, the contexts brought together are read as one collection: its Burrows-Wheeler transform is built, and intervals are
extended backward breadth first, so that common prefixes of neighbouring suffixes come out by increasing value; the expansion stops
at `least`, and what is still unset then has a common prefix of `least` bytes or more.

Sharding: every string of `least` bytes has a minimizer, the smallest hash among its `anchor`-byte substrings, so equal strings have
equal minimizers at equal places.  The starts of a text fall into runs with one minimizer; a run's context is the bytes its strings
cover.  Runs are dealt by minimizer hash; only minimizers that occur with two different contexts need the transform, and equal
contexts go through it once.  A minimizer with very many different contexts is split into finer cells (the strings at given places
around it, keyed by the bytes that these share) until a group is small or holds single strings, so no task holds an unbounded group.

Texts are UTF-8 bytes; null is empty; texts under `least` bytes keep everything.  A text that occurs in two rows or more repeats as
a whole.  Null ids and repeated rows pass through, one output row each.  Very long texts are searched in parts that overlap by
`least` - 1 bytes, so that every string lies in exactly one; an empty table gives no rows.  There are no ties: a byte goes or stays by
the counts alone.  Other columns pass only where they are named in `extra`, as one struct, so their names can't clash.

A text is named by 64 bits (th) and 22 more, which lie above the offset in every place (pos, start, end), so that a place names its
text again.  Texts that more than one in 10,000 rows share (at most 10,000 texts) are dealt over all tasks in the last join: they
repeat as a whole and need no ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, drop_materialized, frequent_keys, materialize, release_memory, row_or_key, schema_with, slices, small_batches
from .near import mixed

#: Bytes of one text that are searched for minimizers at once; longer texts are read in overlapping parts.
PART = 1 << 17
#: Contexts of one minimizer that one transform takes; beyond it the group is split into cells.
MOST_CONTEXTS = 4000
#: Places of a minimizer in its strings are split by these widths, one after the other, where a group is too large.
CELLS = (64, 16, 4, 1)
BASE = 0x9E3779B97F4A7C15 | 1
#: Bits of an offset in a text; more bits of the text's name lie above them.
OFFSET = 41
#: Contexts that a task remembers, to know those that it has met.
MOST_SEEN = 200_000


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % 2**64
    return out


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def runs(text: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run with one minimizer, the minimizer's place, and its hash."""
    n = len(text)
    if n < least:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if not _TABLES or len(_TABLES[0][0]) < n:
        size = max(PART, n)
        _TABLES[:] = [(_powers(size, BASE), _powers(size, pow(BASE, -1, 2**64)))]
    up, down = _TABLES[0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    hashes = mixed((sums[anchor:] - sums[: n - anchor + 1]) * up[: n - anchor + 1])
    keys = (hashes & np.uint64(0xFFFFFFFFFFE00000)) | np.arange(len(hashes), dtype=np.uint64)  # 43 bits of hash, then the place
    width = least - anchor + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, 2**64 - 1, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - least + 1
    place = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0x1FFFFF)).astype(np.int64)
    edges = np.flatnonzero(np.diff(place))
    first, last = np.concatenate([[0], edges + 1]), np.concatenate([edges, [starts - 1]])
    return first, last, place[first], hashes[place[first]]


def parts(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """A text in parts of PART bytes, each string of `least` bytes in exactly one."""
    at = 0
    while True:
        yield at, text[at : at + PART]
        at += PART - least + 1
        if at + least > len(text):
            return


def repeated_starts(contexts: list[bytes], least: int) -> list[np.ndarray]:
    """For each context, whether the string of `least` bytes at each start also starts elsewhere in the collection.

    The collection ends each context with a mark of its own.  Boundaries between neighbouring suffixes whose common prefix is known
    to be shorter than the current value are set; each round extends the intervals between them backward by one symbol."""
    m = len(contexts)
    lengths = np.array([len(c) for c in contexts])
    n = int(lengths.sum()) + m
    ends = np.cumsum(lengths + 1) - 1
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    sym = raw.astype(np.int32) + m
    sym[ends] = np.arange(m)
    left = (np.repeat(ends, lengths + 1) - np.arange(n)).astype(np.int32)  # bytes before the mark
    # Suffix order by doubling: seven bytes first; a suffix that has met its mark is ordered by the mark.
    key = np.zeros(n, np.int64)
    for i in range(7):
        key <<= 9
        take = np.flatnonzero(left[: n - i] >= i) if i else np.arange(n)
        at = take + i
        key[take] |= np.where(left[at] > 0, raw[at].astype(np.int64) + 1, 0)
    order, span = np.argsort(key), 7
    at = np.flatnonzero(left[order] < span)
    met = order[at]
    order[at] = met[np.lexsort((met, key[met]))]  # equal suffixes that have met their marks follow the marks
    while True:
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | (left[order[1:]] < span)
        del ordered
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new) - 1
        if new.all() or span > int(lengths.max()):
            break
        again = np.zeros(n, np.int64)
        again[: n - span] = rank[span:]
        again[left < span] = 0
        key = rank.astype(np.int64) * (n + 1) + again
        del rank, again
        order, span = np.argsort(key), span * 2
    del key, rank, left
    before = np.empty(n, np.int32)
    before[1:], before[0] = sym[:-1], sym[-1]
    bwt = before[order]
    del before, sym, raw
    back = np.argsort(bwt.astype(np.uint16) if m + 256 < 65536 else bwt, kind="stable").astype(np.int32)  # row of the first column to row of the transform
    column = bwt[back]
    forward = np.empty(n, np.int32)
    forward[back] = np.arange(n, dtype=np.int32)
    same = np.zeros(n, bool)
    same[1:] = (column[1:] == column[:-1]) & (column[1:] >= m)
    fresh = np.flatnonzero(~same)
    unset = same.copy()
    # rows of the transform that are neighbours and equal: a boundary between them is handed on directly
    pair = np.zeros(n, bool)
    pair[1:] = (bwt[1:] == bwt[:-1]) & (bwt[1:] >= m)
    # other boundaries of the first column lie above wider ranges of the transform
    wide = np.flatnonzero(same)
    low, high = back[wide - 1], back[wide]
    apart = high > low + 1
    wide, low, high = wide[apart].astype(np.int32), low[apart], high[apart]
    del bwt, back, column, same
    for _ in range(1, least):
        if not len(fresh):
            break
        direct = forward[fresh[pair[fresh]]]
        if len(wide):
            if len(fresh) > n >> 5:
                mask = np.zeros(n, bool)
                mask[fresh] = True
                seen = np.cumsum(mask, dtype=np.int32)
                hit = seen[high] > seen[low]  # a boundary of the value before lies in the range: this one has the next value
            else:
                hit = np.searchsorted(fresh, high, "right") > np.searchsorted(fresh, low, "right")
            direct = np.concatenate([direct, wide[hit]])
            wide, low, high = wide[~hit], low[~hit], high[~hit]
        fresh = np.sort(direct[unset[direct]])
        unset[fresh] = False
    unset = np.flatnonzero(unset)
    twice = np.zeros(n, bool)
    twice[order[unset]] = True
    twice[order[unset - 1]] = True
    return [twice[e - k : e - least + 1] if k >= least else np.empty(0, bool) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _spans(flags: np.ndarray, offset: int, least: int) -> list[tuple[int, int]]:
    """Covered byte ranges of the flagged starts, joined where they touch."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > least)
    return [(offset + int(a), offset + int(b) + least) for a, b in zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])], strict=True)]


def find_runs(texts: DataFrame, least: int, anchor: int) -> DataFrame:
    """(deal, h, ctx, th, pos, len, done): runs of every distinct text of a partition; within a partition, runs whose context
    has been seen at another place are done and are dealt evenly, so that a context that many texts share isn't a hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        seen: dict[int, int] = {}
        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, most_bytes=1 << 20):
            columns: list[list] = [[], [], [], [], [], [], []]
            for th, tag, text in zip(b.column("th").to_pylist(), b.column("tag").to_pylist(), binary(b.column("text")), strict=True):
                if len(text) < least or (th, tag) in met:
                    continue
                met.add((th, tag))
                if len(met) > MOST_SEEN:
                    met.clear()
                for at, part in parts(text, least):
                    first, last, _, h = runs(np.frombuffer(part, np.uint8), least, anchor)
                    ctx = [digest(part[x : y + least]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                    own = h.view(np.int64).tolist()
                    done = []
                    for c in ctx:
                        k = seen.get(c, 0)
                        done.append(k >= 2)  # two places have gone to the shuffle: the context is known as repeated there
                        seen[c] = k + 1
                    pos = (first + (at | tag)).tolist()
                    columns[0] += [digest(b"%d %d" % (th, p)) if d else x for x, d, p in zip(own, done, pos, strict=True)] if any(done) else own
                    columns[1] += own
                    columns[2] += ctx
                    columns[3] += [th] * len(own)
                    columns[4] += pos
                    columns[5] += (last - first + least).tolist()
                    columns[6] += done
            if len(seen) > MOST_SEEN:
                seen.clear()
            signed = lambda v: pa.array(np.array([x & 0xFFFFFFFFFFFFFFFF for x in v], np.uint64).view(np.int64))
            yield pa.record_batch([signed(columns[0]), signed(columns[1]), signed(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.bool_())], names=["deal", "h", "ctx", "th", "pos", "len", "done"])

    return texts.select("text", "th", "tag").mapInArrow(run, "deal long, h long, ctx long, th long, pos long, len int, done boolean")


def sort_out(found: DataFrame) -> DataFrame:
    """(h, th, pos, len, need): runs whose whole context repeats (need false), and one run of each context of the minimizers that
    have several (need true). Reads sorted rows as a stream and keeps one row between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "ctx", "th", "pos", "len"]
        kept: list[np.ndarray] | None = None  # the last row so far
        kept_same, kept_more = False, False  # it equals the row before in context; its minimizer had another context before
        for b in _with_end(batches):
            done = np.zeros(0, bool)
            if b is not None:
                done = b.column("done").to_numpy(zero_copy_only=False)
                columns = [b.column(x).to_numpy() for x in names]
                if done.any():
                    yield pa.record_batch([*(pa.array(columns[i][done]) for i in (0, 2, 3, 4)), pa.array(np.zeros(int(done.sum()), bool))], names=["h", "th", "pos", "len", "need"])
                    columns = [c[~done] for c in columns]
                if not len(columns[0]):
                    continue
                if kept is not None:
                    columns = [np.concatenate([k, c]) for k, c in zip(kept, columns, strict=True)]
            elif kept is None:
                return
            else:
                columns = kept
            h, ctx, th, pos, _ = columns
            n = len(h)
            same_h, same_c = np.zeros(n, bool), np.zeros(n, bool)
            same_h[1:] = h[1:] == h[:-1]
            same_c[1:] = same_h[1:] & (ctx[1:] == ctx[:-1])
            copy = np.zeros(n, bool)
            copy[1:] = same_c[1:] & (th[1:] == th[:-1]) & (pos[1:] == pos[:-1])
            if copy.any():
                keep = ~copy
                columns = [c[keep] for c in columns]
                h, ctx, th, pos, _ = columns
                same_h, same_c, n = same_h[keep], same_c[keep], int(keep.sum())
            if kept is not None:
                same_c[0] = kept_same
            # whether the minimizer had another context before the row's own context
            more = np.zeros(n, bool)
            start = np.maximum.accumulate(np.where(same_h, 0, np.arange(n)))
            begin = np.maximum.accumulate(np.where(same_c, 0, np.arange(n)))
            more = begin > start
            if kept is not None and kept_more:
                more |= start == 0
            last = b is None
            upto = n if last else n - 1
            next_h = np.append(same_h[1:], False)
            next_c = np.append(same_c[1:], False)
            whole = (same_c | next_c)[:upto]
            need = (~next_c & (more | next_h))[:upto]
            for flags, value in ((whole, False), (need, True)):
                at = np.flatnonzero(flags)
                if len(at):
                    yield pa.record_batch([*(pa.array(columns[i][at]) for i in (0, 2, 3, 4)), pa.array(np.full(len(at), value))], names=["h", "th", "pos", "len", "need"])
            kept = [c[n - 1 :] for c in columns]
            kept_same, kept_more = bool(same_c[n - 1]), bool(more[n - 1])

    ordered = found.repartition("deal").sortWithinPartitions("done", "h", "ctx", "th", "pos")
    return ordered.mapInArrow(run, "h long, th long, pos long, len int, need boolean")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def fetch(texts: DataFrame, need: DataFrame, least: int, anchor: int) -> DataFrame:
    """(h, th, pos, place, body): the contexts of the needed runs, and where in them the minimizer lies. One row of each distinct
    text is asked: equal rows are put together before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most_bytes=1 << 20):
            out: list[tuple] = []
            for th, tag, text, rows in zip(b.column("th").to_pylist(), b.column("tag").to_pylist(), binary(b.column("text")), b.column("rows").to_pylist(), strict=True):
                for r in rows:
                    at = r["pos"] - tag
                    if at >> OFFSET:
                        continue  # a place in another text of this th
                    body = text[at : at + r["len"]]
                    first, _, place, _ = runs(np.frombuffer(body, np.uint8), least, anchor)
                    out.append((r["h"], th, r["pos"], int(place[0]), body))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["h", "th", "pos", "place", "body"])

    wanted = need.groupBy("th").agg(F.collect_list(F.struct("h", "pos", "len")).alias("rows"))
    one = texts.where(F.octet_length("text") >= least).groupBy("th", "tag").agg(F.first("text").alias("text"))
    return one.join(wanted, "th").select("th", "tag", "text", "rows").mapInArrow(run, "h long, th long, pos long, place int, body binary")


def expand(bodies: DataFrame, least: int, most_bytes: int = 1 << 18) -> DataFrame:
    """(th, start, end): bytes covered by repeated strings, by the transform over whole groups, several groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[bytes, int, int]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            by_body: dict[bytes, list[tuple[int, int]]] = {}
            for body, th, pos in waiting:
                by_body.setdefault(body, []).append((th, pos))
            found = []
            for (_, places), flags in zip(by_body.items(), repeated_starts(list(by_body), least), strict=True):
                for th, pos in places:
                    found += [(th, x, y) for x, y in _spans(flags, pos, least)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["th", "start", "end"])

        for b in batches:
            for h, th, pos, body in zip(*(b.column(x).to_pylist() for x in ("h", "th", "pos", "body")), strict=True):
                if size > most_bytes and h != last:
                    yield flush()
                    waiting, size = [], 0
                waiting.append((body, th, pos))
                size += len(body)
                last = h
        if waiting:
            yield flush()
        release_memory()

    ordered = bodies.select("h", "th", "pos", "body").repartition("h").sortWithinPartitions("h")
    return ordered.mapInArrow(run, "th long, start long, end long")


def split_cells(bodies: DataFrame, least: int, anchor: int, width: int) -> DataFrame:
    """Contexts cut into cells of `width` places of the minimizer, keyed by the bytes that all strings of a cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = least - anchor
        for b in batches:
            out: list[tuple] = []
            for h, th, pos, place, body in zip(*(b.column(x).to_pylist() for x in ("h", "th", "pos", "place", "body")), strict=True):
                starts = len(body) - least + 1
                # the string at start s has the minimizer at place - s, between 0 and top
                for cell in range((place - starts + 1) // width, place // width + 1):
                    s0, s1 = max(0, place - (cell * width + width - 1)), min(starts - 1, place - cell * width)
                    if s0 > s1:
                        continue
                    lowest, highest = place - min(top, cell * width + width - 1), place - cell * width  # of the whole cell
                    core = body[max(highest, 0) : lowest + least]
                    key = xxhash.xxh3_64_intdigest(b"%d %d %d " % (h, width, cell) + core)
                    out.append((key - 2**64 if key >= 2**63 else key, th, pos + s0, place - s0, body[s0 : s1 + least]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["h", "th", "pos", "place", "body"])

    return bodies.mapInArrow(run, "h long, th long, pos long, place int, body binary")


def named(docs: DataFrame, *extra: str) -> DataFrame:
    """text (null as empty), th and tag of every row, and what is named in extra."""
    tag = F.shiftleft(F.xxhash64(F.lit("tag"), "text").bitwiseAND(F.lit((1 << (63 - OFFSET)) - 1)), OFFSET)
    return small_batches(docs).select(F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra).withColumns({"th": F.xxhash64("text"), "tag": tag})


def covered(texts: DataFrame, least: int = 200, anchor: int = 40) -> DataFrame:
    """(th, start, end) of bytes that repeated strings cover, of texts as named() gives them; ranges may overlap. Copies of whole
    texts aren't among them."""
    found = materialize(sort_out(find_runs(texts, least, anchor)), "runs")
    out = [found.where("not need").selectExpr("th", "pos start", "pos + len end")]
    need = found.where("need")
    hot = need.groupBy("h").count().where(F.col("count") > MOST_CONTEXTS).select("h")
    bodies = materialize(fetch(texts, need, least, anchor), "contexts")
    if hot.isEmpty():
        out.append(expand(bodies, least))
        return out[0].unionByName(out[1])
    hot = materialize(hot, "hot")
    out.append(expand(bodies.join(hot, "h", "left_anti"), least))
    large = bodies.join(hot, "h", "left_semi")
    for width in CELLS:
        cells = materialize(split_cells(large.select("h", "th", "pos", "place", "body"), least, anchor, width), "cells").withColumn("digest", F.md5("body"))
        by_body = cells.groupBy("h", "digest").agg(F.min("th").alias("t0"), F.max("th").alias("t1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
        same = materialize(by_body.select("h", "digest", ((F.col("t0") != F.col("t1")) | (F.col("p0") != F.col("p1"))).alias("twice"), "t0"), "bodies")
        several = same.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        joined = materialize(cells.join(same, ["h", "digest"]).join(several, "h", "left"), "cells")
        out.append(joined.where("twice").selectExpr("th", "pos start", "pos + octet_length(body) end"))
        # one row of each body goes on, and only where the cell has several
        ones = joined.where("n > 1 and th = t0").dropDuplicates(["h", "digest"])
        out.append(expand(ones.where(F.col("n") <= MOST_CONTEXTS), least))
        if width == 1:
            break
        before, large = large, materialize(ones.where(F.col("n") > MOST_CONTEXTS).select("h", "th", "pos", "place", "body"), "large")
        drop_materialized(same, before)
        if large.isEmpty():
            break
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def dedup_substrings(docs: DataFrame, least: int = 200, anchor: int = 40, with_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and text, with the columns named in extra) of every row of docs."""
    texts = named(docs)
    gone = covered(texts, least, anchor)
    copies = materialize(texts.where(F.octet_length("text") >= least).groupBy("th", "tag").count().where("count > 1"), "copies")
    hot = F.broadcast(frequent_keys(copies, ["th", "tag"], "count").withColumn("hot", F.lit(True)))  # at most MOST_FREQUENT rows
    # one row a text: its ranges as one sorted array, and the names of texts with copies
    ranges = gone.unionByName(copies.selectExpr("th", "tag start", "-1L end")).groupBy("th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    own = named(docs, F.col("doc_id").cast("long").alias("doc_id"), *extra).join(hot, ["th", "tag"], "left")
    own = own.withColumn("key", row_or_key("th", F.col("hot").isNotNull())).drop("th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, texts = [], []
            for text, tag, whole, found in zip(binary(b.column("text")), b.column("tag").to_pylist(), b.column("hot").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                at, kept, spans, end = 0, [], 0, -1
                mine = [(r["start"] - tag, r["end"] - tag) for r in found or () if r["start"] >> OFFSET == tag >> OFFSET]
                if len(text) >= least and (whole or any(y < 0 for _, y in mine)):
                    mine = [(0, len(text))]
                for x, y in mine:
                    y = min(y, len(text))
                    if x > end:
                        kept.append(text[at:x])
                        spans += 1
                        end = y
                    end = max(end, y)
                    at = end
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
                texts.append(rest if with_text else b"")
            columns = list(zip(*rows, strict=True))
            arrays = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string()))  # a cut may fall inside a character
                names.append("text")
            yield pa.record_batch([*arrays, *(b.column(x) for x in extra)], names=[*names, *extra])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    joined = own.join(ranges.withColumnRenamed("th", "key"), "key", "left")
    return joined.select("doc_id", "text", "tag", "hot", "ranges", *extra).mapInArrow(run, schema_with(schema, own, extra))
