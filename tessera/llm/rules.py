"""Quality rules judged by an isolation forest on rule statistics.

Words are runs of other than ASCII white space.  Each text gives counts (see STATISTICS); a base rule fails texts of under 20 words
or with over 30 % of their words in repeated 8-word windows.  An isolation forest turns the statistics into path lengths over random
splits; each of its trees is grown on `sample` rows, as the method has it, drawn from all labelled rows.  The threshold on the anomaly
score is the one that, over all labelled rows, removes the most rows labelled 0 while at most `most_lost` of those labelled 1 go: an
exact rank, found by counts.  Texts over it are rejected.  Rows that fail by length take no part in either.

Null and empty texts have no words and fail the base rule.  Ties at the threshold are kept.  With no labelled rows only the base rule
holds.  Rows labelled more than once take their lowest label.  Null ids and repeated rows pass through, one output row each.  Very long
texts are counted whole; an empty table gives no rows.  judge_documents takes no other columns; keep_good passes all, by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, drop_materialized, materialize, slices, small_batches

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["mean_word", "symbols_per_word", "dup_lines", "repeat_words", "upper", "other_signs", "distinct_words"]
LETTERS = bytes(range(65, 91))
SIGNS = b"!?\"()[]{}@^~=+_/\\:;"
#: Steps of the scores by which the threshold's rank is found; only the scores of one step go to the driver.
STEPS = 1 << 16


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more. Windows are named exactly, by doubling: 2, 4, then 8 words."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    names, span = ids.astype(np.int64), 1
    while span < width:
        pairs = names[: len(names) - span] * (int(names.max()) + 1) + names[span:]
        span *= 2
        if span < width:
            names = np.unique(pairs, return_inverse=True)[1]
    ordered = np.argsort(pairs, kind="stable")
    same = pairs[ordered[1:]] == pairs[ordered[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[ordered[1:][same]] = True
    twice[ordered[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_counts(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and STATISTICS of one text in UTF-8."""
    words = text.split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    word_bytes = b"".join(words)
    chars = len(word_bytes.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(np.array(ids, np.int64)) if n > len(numbers) else 0
    m = max(n, 1)
    upper = len(word_bytes) - len(word_bytes.translate(None, LETTERS))
    signs = len(word_bytes) - len(word_bytes.translate(None, SIGNS))
    return [n, chars, symbols, dup, repeat], [chars / m, symbols / m, dup / max(1, len(lines)), repeat / m, upper / max(1, chars), signs / m, len(numbers) / m ** 0.9]


class IsolationForest:
    """Trees of random splits over small samples; the score is 2 to the power of minus the mean path length over its expectation."""

    def __init__(self, rows: np.ndarray | list[np.ndarray], trees: int = 400, sample: int = 32, seed: int = 11):
        """Each tree is grown on `sample` of the rows; a list gives the rows of each tree, equally many."""
        rng = np.random.default_rng(seed)
        drawn = rows if isinstance(rows, list) else [rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)] for _ in range(trees)]
        self.sample = len(drawn[0])
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        self.trees = [self._grow(own, rng) for own in drawn]

    @staticmethod
    def expected(n) -> np.ndarray:
        """The mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(own: np.ndarray, depth: int) -> int:
            at = len(feature)
            for x in (feature, cut, left, right, path):
                x.append(0)
            low, high = own.min(0), own.max(0)
            free = np.flatnonzero(high > low)
            feature[at] = -1
            path[at] = depth + float(self.expected(len(own)))
            if depth < self.depth and len(own) > 1 and len(free):
                f = int(rng.choice(free))
                c = float(rng.uniform(low[f], high[f]))
                below = own[:, f] <= c
                if below.any() and not below.all():
                    feature[at], cut[at] = f, c
                    left[at] = node(own[below], depth + 1)
                    right[at] = node(own[~below], depth + 1)
            return at

        node(rows, 0)
        return tuple(map(np.array, (feature, cut, left, right, path)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                below = rows[every, np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(below, left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(self.expected(self.sample)), 1e-9))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, quality of at most `most` labelled documents, chosen by a hash of the id. The bound makes the broadcast side small."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and stats (STATISTICS) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [text_counts(t) for t in binary(b.column("text"))]
            counts = zip(*(r[0] for r in rows), strict=True)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["doc_id", *COUNTS, "stats"])

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow column of STATISTICS."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def draw(rows: DataFrame, trees: int, sample: int, seed: int = 11) -> list[np.ndarray]:
    """For each tree the stats of `sample` rows (all, if there are fewer), drawn from all rows by their ranks; rows hold `at`, their
    partition and place as monotonically_increasing_id gives them. Only drawn rows go to the driver."""
    sizes = sorted(map(tuple, rows.groupBy(F.shiftright("at", 33)).count().collect()))
    ends = np.cumsum([n for _, n in sizes])
    rng = np.random.default_rng(seed)
    ranks = [rng.choice(int(ends[-1]), min(sample, int(ends[-1])), replace=False) for _ in range(trees)]
    every = np.unique(np.concatenate(ranks))
    part = np.searchsorted(ends, every, "right")
    at = (np.array([p for p, _ in sizes])[part] << 33) + every - (ends - [n for _, n in sizes])[part]
    wanted = rows.sparkSession.createDataFrame([(x,) for x in at.tolist()], "at long")
    found = np.array([r["stats"] for r in sorted(rows.join(F.broadcast(wanted), "at").select("at", "stats").collect())])
    return [found[np.searchsorted(every, x)] for x in ranks]


def largest(scores: DataFrame, before: int) -> float:
    """The score (0 to 1) that has `before` others before it from the largest down, exactly: first its step by counts, then its rank there."""
    for column in (F.floor(F.col("score") * STEPS), F.col("score")):
        for key, n in sorted(map(tuple, scores.groupBy(column.alias("key")).count().collect()), reverse=True):
            if before < n:
                break
            before -= n
        scores = scores.where(column == key)
    return key


def fit(rows: DataFrame, labels: DataFrame, most_lost: float = 0.008, trees: int = 400, sample: int = 32) -> tuple[IsolationForest | None, float]:
    """A forest and its threshold, from all labelled ones of rows as counted() gives them."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = rows.where("n_words >= 20").join(quality, "doc_id").select("doc_id", "stats", "quality")
    # in one order, whatever the partitions, so that draws are the same
    known = materialize(known.repartitionByRange("doc_id", "stats").sortWithinPartitions("doc_id", "stats").withColumn("at", F.monotonically_increasing_id()), "labelled")
    forest, limit = None, float("inf")
    if known.count() >= 8:
        forest = IsolationForest(draw(known, trees, sample))
        model = rows.sparkSession.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.record_batch([pa.array(model.value.score(matrix(b.column("stats"))))], names=["score"])

        good = materialize(known.where("quality = 1").select("stats").mapInArrow(run, "score double"), "scores")
        if n := good.count():
            limit = largest(good, min(n - 1, int(n * most_lost)))
        drop_materialized(good)
    drop_materialized(known)
    return forest, limit


def fit_forest(docs: DataFrame, labels: DataFrame, **settings) -> tuple[IsolationForest | None, float]:
    """A forest and its threshold, from all labelled ones of docs."""
    rows = materialize(counted(docs), "counted")
    model = fit(rows, labels, **settings)
    drop_materialized(rows)
    return model


def verdicts(counts: np.ndarray, stats: np.ndarray, forest: IsolationForest | None, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the base rule fails, whether the text is kept, and the anomaly score."""
    score = forest.score(stats) if forest else np.zeros(len(stats))
    failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
    return failed, ~failed & (score <= limit), score


def judge_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, anomaly of every document; settings as for fit."""
    rows = materialize(counted(docs), "counted")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, **settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([b.column(c).to_numpy() for c in COUNTS], 1)
            found = verdicts(counts, matrix(b.column("stats")), *model.value)
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", *COUNTS)), *map(pa.array, found)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns as they are, that the rules keep."""
    model = docs.sparkSession.sparkContext.broadcast(fit_forest(docs, labels, **settings))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [text_counts(t) for t in binary(b.column(at))]
            yield b.filter(pa.array(verdicts(np.array([x[0] for x in found]), np.array([x[1] for x in found]), *model.value)[1]))

    return docs.mapInArrow(run, docs.schema)
