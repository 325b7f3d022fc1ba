"""MinHash near-dedup with odd sketches.

A document's set holds its distinct word shingles as 64-bit hashes.  Documents with equal sets form a class, and only one row a class
goes on.  MinHash samples make band keys; classes that share a band key are candidates.  The samples are also folded into an odd
sketch, a bitmap in which each sample toggles one bit: the population count of the XOR of two sketches estimates how many samples
differ, precisely where similarity is high.  Candidates within the count that the threshold allows (with four deviations to spare)
are confirmed on the full sets.

Completeness without all pairs of a group: first every class is compared with leaders of its buckets, the classes that share most
buckets, and linked classes form components; then, in buckets that still hold several components, the classes outside the largest
one are compared with the leaders of these and of the largest; last, those that are still outside are compared with all classes of
other components in their bucket.  Any linked pair that shares a bucket is then joined or was compared.  Components come from alternating
large-star and small-star steps on tables in the shared folder; nodes are numbered so that the classes with most shared buckets, which
the links of the first comparison lead to, come first, and so most links form stars from the start.

Texts without words have no set and are linked with nothing; shorter texts than a shingle are one shingle.  Null ids get the smallest
id of their component, or their own null, and are kept only in the latter case.  Repeated rows are links of one another, as copies.
A similarity that ties with the threshold links.  Very long texts are read whole; an empty table gives no rows; group_near takes no
other columns, and keep_one passes all of them, as one struct while it works, so their names can't clash.  Empty rows and rows of sets
that more than one in 10,000 rows share are dealt over all tasks in the last join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, boxed, drop_materialized, frequent_keys, keyed_texts, materialize, slices, unboxed

SKETCH_WORDS = 32
#: MinHash samples that a sketch folds; the first of them make the bands.
SAMPLES = 512
#: Bits of a filter over wanted rows: so many a row, and so many in all (16 MB).
BITS_A_ROW, MOST_BITS = 16, 1 << 27


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets, MinHash bands and odd sketches of texts; word hashes are kept within a worker up to a bound."""

    def __init__(self, width: int, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.bands, self.rows = width, bands, rows
        n = max(SAMPLES, bands * rows)
        self.seeds = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.factors = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.places = np.arange(n, dtype=np.uint64) << np.uint64(32)
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(rows)], np.uint64)
        self.words: dict[bytes, int] = {}

    def set_of(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        words = text.lower().split()  # of bytes: only A-Z change and only ASCII white space parts words
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > 500_000:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            ids = [known[w] for w in words]
        h = np.array(ids, np.uint64)
        if len(h) < self.width:
            return mixed(np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words))], np.uint64))
        out = np.zeros(len(h) - self.width + 1, np.uint64)
        for i in range(self.width):
            out = mixed(out + h[i : i + len(out)] + np.uint64(i + 1))
        return np.unique(out)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes.astype(np.uint32)
        out = np.full(len(self.seeds), 2**32 - 1, np.uint32)
        for at in range(0, len(low), 2048):
            np.minimum(out, ((low[at : at + 2048, None] ^ self.seeds) * self.factors).min(0), out=out)
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        s = samples[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        return mixed((mixed(s) * self.powers).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).astype(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        bits = mixed(self.places | samples.astype(np.uint64)) % np.uint64(64 * SKETCH_WORDS)
        odd = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def most_apart(samples: int, similarity: float, deviations: float = 4.0) -> int:
    """The popcount that sketches of sets at the similarity exceed with negligible chance: the mean at that similarity and so many
    deviations, of the samples and of the parity of the bits they toggle."""
    m = 64 * SKETCH_WORDS
    n = 2 * samples * (1 - similarity)
    mean = m / 2 * (1 - np.exp(-2 * n / m))
    parity = m / 4 * (1 - np.exp(-4 * n / m)) - n * np.exp(-4 * n / m)
    drawn = (2 * np.exp(-2 * n / m)) ** 2 * samples * similarity * (1 - similarity)
    return int(np.ceil(mean + deviations * np.sqrt(parity + drawn)))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One row a document: doc_id, k1, k2, n, fp (128 bits of the set; null if empty), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(width, bands, rows)
        for b in slices(batches):
            n, prints, keys, sketches = [], [], [], []
            for text in binary(b.column("text")):
                s = own.set_of(text)
                n.append(len(s))
                if len(s):
                    m = own.samples(s)
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(own.band_keys(m))
                    sketches.append(own.sketch(m))
                else:
                    prints.append(None)
                    keys.append([])
                    sketches.append([])
            columns = [b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "k1", "k2", "n", "fp", "bands", "sketch"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, fp binary, bands array<long>, sketch array<long>")


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose key (k1, k2) may be among the wanted ones: all that are, and one in BITS_A_ROW or so of the others, so that their
    texts needn't be dealt. A filter with MOST_BITS lets more of the others through, no fewer of the wanted."""
    bit = F.pmod(F.xxhash64("k1", "k2", F.lit("bit")), F.lit(max(1, min(MOST_BITS, BITS_A_ROW * wanted.count()))))
    marks = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("marks"))
    own = rows.withColumn("bit", bit).withColumns({"bucket": F.bitmap_bucket_number("bit"), "bit": F.bitmap_bit_position("bit")})
    byte = F.conv(F.hex(F.expr("substring(marks, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return own.join(F.broadcast(marks), "bucket").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(rows.columns)


def sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, own: the full sets of the nodes whose representative rows (k1, k2, node) are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(width, 1, 1)
        for b in slices(batches):
            yield pa.record_batch([b.column("node"), pa.array([own.set_of(t).view(np.int64) for t in binary(b.column("text"))], pa.list_(pa.int64()))], names=["node", "own"])

    rows = likely(keyed_texts(docs), wanted).join(wanted, ["k1", "k2"]).dropDuplicates(["node"])  # rows equal in id and text are one representative
    return rows.select("text", "node").mapInArrow(run, "node long, own array<long>")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    wanted = materialize(nodes.join(ends, "node", "left_semi").select("k1", "k2", "node"), "wanted")
    own = materialize(sets(docs, wanted, width), "sets")
    drop_materialized(wanted)
    got = pairs.join(own.select(F.col("node").alias("a"), F.col("own").alias("sa")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    linked = materialize(got.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    drop_materialized(own)
    return linked


def is_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is an u."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), "v"))
    return not seen.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least <> most").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes that aren't roots, by rounds of a large-star and a small-star step."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    while not is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v"))
        before, now = now, materialize(small.distinct(), "star")
        drop_materialized(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def group_near(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 28, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, k1, k2 of every document."""
    rows_ = materialize(signatures(docs, width, bands, rows), "signatures")
    classes = rows_.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("min_id"), F.min_by(F.struct("k1", "k2"), F.struct("k1", "k2")).alias("k"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    )
    classes = materialize(classes.select("fp", "min_id", "k.k1", "k.k2", "bands", "sketch", "copies"), "classes")

    member = classes.select("fp", F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(member.join(sizes, "key"), "buckets")  # only buckets of two classes or more
    weight = shared.groupBy("fp").agg(F.sum("n").alias("weight"))  # a class that shares many buckets is near the middle of its group
    # nodes are numbered in that order, once and for all: the numbers are written
    names = [f"s{i}" for i in range(SKETCH_WORDS)]
    nodes = classes.join(weight, "fp").select("fp", "k1", "k2", "weight", "bands", *(F.col("sketch")[i].alias(n) for i, n in enumerate(names)))
    order = F.col("weight").desc(), F.col("fp")
    nodes = materialize(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "nodes")
    before, shared = shared, materialize(shared.join(nodes.select("fp", "node"), "fp").select("key", "node"), "buckets")
    drop_materialized(before)
    sketch = nodes.select("node", *names)
    apart = lambda x, y: sum((F.bit_count(F.col(f"{x}.{n}").bitwiseXOR(F.col(f"{y}.{n}"))) for n in names[1:]), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    limit = most_apart(max(SAMPLES, bands * rows), percent / 100)

    def measured(pairs: DataFrame, a: str, b: str) -> DataFrame:
        """The pairs whose sketches are near enough, with their distance d."""
        got = pairs.join(sketch.alias("x"), F.col(a) == F.col("x.node")).select(a, b, F.struct(*(f"x.{n}" for n in names)).alias("x"))
        return got.join(sketch.alias("y"), F.col(b) == F.col("y.node")).select(a, b, apart("x", "y").alias("d")).where(F.col("d") <= limit)

    # first, every class meets the leaders of its buckets: the nearest one and the one with most weight
    leaders = shared.groupBy("key").agg(F.min("node").alias("to"))
    stars = shared.withColumnRenamed("node", "from").join(leaders, "key").where("from <> to").select("from", "to").distinct()
    best = measured(stars, "from", "to").groupBy("from").agg(F.min("to").alias("heavy"), F.min_by("to", F.struct("d", "to")).alias("close"))
    first = best.select("from", F.explode(F.array_distinct(F.array("heavy", "close"))).alias("to")).select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"))
    tested = materialize(first.distinct(), "pairs")
    roots = components(confirmed(docs, nodes, tested, width, percent))

    def still_mixed() -> DataFrame:
        """key, node, root, major of the buckets that hold several components."""
        placed = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        counted = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        major = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1").select("key", "major")
        return placed.join(major, "key")

    # then, the classes outside the largest component of a bucket meet the leaders of what remains, and of the largest component
    rest = still_mixed()
    heads = rest.groupBy("key").agg(F.min(F.when(F.col("root") != F.col("major"), F.struct("node", "root"))).alias("own"), F.min(F.when(F.col("root") == F.col("major"), F.struct("node", "root"))).alias("other"))
    outside = rest.where("root <> major").join(heads, "key").select("node", "root", F.explode(F.array("own", "other")).alias("to")).where("root <> to.root")
    pairs = outside.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct()
    again = materialize(measured(pairs, "a", "b").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
    more = confirmed(docs, nodes, again, width, percent)
    tested = tested.unionByName(again)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    # last, what is still apart in a bucket meets all of it
    mixed_ = materialize(still_mixed().join(nodes.select("node", "bands", *names), "node"), "mixed")
    here = F.col("x.key") == F.array_min(F.array_intersect("x.bands", "y.bands"))  # a pair comes out of one of its buckets only
    cross = mixed_.where("root <> major").alias("x").join(
        mixed_.alias("y"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))) & (apart("x", "y") <= limit) & here,
    )
    cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    left = materialize(cross.join(tested, ["a", "b"], "left_anti"), "pairs")
    drop_materialized(mixed_)
    if not left.isEmpty():
        more = confirmed(docs, nodes, left, width, percent)
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    placed = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "fp"), "node")
    placed = placed.join(nodes.select(F.col("node").alias("root"), F.col("fp").alias("root_fp")), "root").select("fp", "root_fp")
    rooted = classes.select("fp", "min_id").join(placed, "fp", "left").select("fp", "min_id", F.coalesce("root_fp", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("min_id").alias("component_id"))
    found = materialize(rooted.join(least, "root").select("fp", "component_id", "root"), "found")
    # rows with empty sets need no partner, and what the frequent sets need is small enough to be broadcast
    hot = F.broadcast(found.join(F.broadcast(frequent_keys(classes, ["fp"], "copies")), "fp").select("fp", F.struct("component_id", "root").alias("hot")))
    out = rows_.select("doc_id", "n", "fp", "k1", "k2").join(hot, "fp", "left")
    own = F.when(F.col("fp").isNull() | F.col("hot").isNotNull(), F.unhex(F.hex(F.monotonically_increasing_id()))).otherwise(F.col("fp"))
    out = out.withColumn("key", own).join(found.select(F.col("fp").alias("key"), F.struct("component_id", "root").alias("cold")), "key", "left").withColumn("at", F.coalesce("hot", "cold"))
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("at.component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "k1", "k2", F.col("at.root").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, the one with the smallest id (null last); rows with empty sets all stay."""
    found = group_near(docs, width, percent).withColumn("late", F.col("doc_id").isNull())
    least = F.struct("late", "k1", "k2")
    first = found.where("root is not null").groupBy("root").agg(F.min(least).alias("k")).select("k.k1", "k.k2")
    stay = materialize(first.unionByName(found.where("root is null").select("k1", "k2")).distinct().withColumn("stays", F.lit(True)), "kept")
    rows = keyed_texts(boxed(docs), "box").join(stay, ["k1", "k2"])
    # rows equal in id and text are copies of one another; those without words are linked with nothing
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return unboxed(rows.withColumn("nth", nth).where((F.col("nth") == 1) | ~worded), docs)
