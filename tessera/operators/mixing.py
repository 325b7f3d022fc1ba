"""How much of each source goes into a mixture, and how documents become sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_sizes(sources: DataFrame, target: float | None = None) -> DataFrame:
    """source, size: how many items of each source (source, n, ratio, repeat) a mixture takes, true to its ratios.

    Ratios are normalised; a source may be repeated up to `repeat` times, as far as the target (all items, if none is given) asks for
    it; one common factor shrinks all sizes until none exceeds what its source gives. Sizes are cut to whole numbers. One row a source."""
    every = Window.partitionBy()
    ideal = (F.lit(target) if target else F.sum("n").over(every)) * F.col("ratio") / F.sum("ratio").over(every)
    s = sources.withColumn("ideal", ideal).withColumn("usable", F.col("n") * F.least(F.col("repeat"), F.greatest(F.col("ideal") / F.col("n"), F.lit(1.0))))
    factor = F.least(F.lit(1.0), F.min(F.col("usable") / F.col("ideal")).over(every))
    return s.withColumn("size", F.floor(F.col("ideal") * factor).cast("long")).select("source", "size")


def apportion(sources: DataFrame, total: int) -> DataFrame:
    """source, take: `total` items by ratio (source, i, n, ratio), largest remainders first (ties: the higher index), no source beyond
    its n. What a full source can't take goes round again. One row a source: they are folded in one task."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("i")
        names, caps, ratios = rows["source"].tolist(), rows["n"].tolist(), rows["ratio"].tolist()
        take, left = [0] * len(names), min(total, sum(caps))
        while left:
            open_ = [k for k in range(len(names)) if take[k] < caps[k]]
            share = sum(ratios[k] for k in open_)
            ideal = {k: left * ratios[k] / share for k in open_}
            gain = {k: min(int(ideal[k]), caps[k] - take[k]) for k in open_}
            rest = left - sum(gain.values())
            for k in sorted(open_, key=lambda k: (ideal[k] - int(ideal[k]), k), reverse=True):
                if rest and take[k] + gain[k] < caps[k]:
                    gain[k] += 1
                    rest -= 1
            for k, g in gain.items():
                take[k] += g
            left = rest
        yield pd.DataFrame({"source": names, "take": take})

    return sources.coalesce(1).mapInPandas(deal, "source string, take long")


def fragments(docs: DataFrame, length: str, most: int) -> DataFrame:
    """docs with start and n: documents cut into pieces of at most `most`."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col(length) - 1, F.lit(0)), F.lit(most).cast("long"))
    cut = docs.withColumn("start", F.explode(starts))
    return cut.withColumn("n", F.least(F.col(length) - F.col("start"), F.lit(most).cast("long")))


class BestFit:
    """Bins of one capacity: an item goes to the bin with the least room that still holds it, the longest waiting among equals."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rooms: list[int] = []  # sorted rooms that some bin has
        self.waiting: dict[int, deque[int]] = {}

    def add(self, size: int) -> int:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            room, bin_ = self.capacity, self.bins
            self.bins += 1
        else:
            room = self.rooms[at]
            row = self.waiting[room]
            bin_ = row.popleft()
            if not row:
                del self.waiting[room], self.rooms[at]
        if room > size:
            if room - size not in self.waiting:
                insort(self.rooms, room - size)
                self.waiting[room - size] = deque()
            self.waiting[room - size].append(bin_)
        return bin_


def best_fit_decreasing(pieces: DataFrame, capacity: int, by: str, id_: tuple[str, ...]) -> DataFrame:
    """by, id, n, bin: pieces (by, id, n) of each group packed longest first (ties: by id) by BestFit, as rows stream through a task; the
    state is at most `capacity` rooms and their open bins. Groups are dealt by key: make shards of a large source."""
    schema = pieces.select(by, *id_, "n").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packer = None, BestFit(capacity)
        for pdf in batches:
            bins = []
            for group, n in zip(pdf[by].tolist(), pdf["n"].tolist(), strict=True):
                if group != now:
                    now, packer = group, BestFit(capacity)
                bins.append(packer.add(n))
            yield pdf.assign(bin=bins)

    ordered = pieces.select(by, *id_, "n").repartition(by).sortWithinPartitions(by, F.desc("n"), *id_)
    return ordered.mapInPandas(run, schema.add("bin", "long"))


def growth_shares(n: int, levels: int) -> list[int]:
    """n batches dealt over levels by odds 1, 2, 4, ..; the last absorbs what rounding leaves."""
    odds = [1 << e for e in range(levels)]
    out = [n * o // sum(odds) for o in odds]
    out[-1] += n - sum(out)
    return out
