"""Exact top-k inner-product search by norm-bucketed retrieval.

Candidates are dealt by range of their length into buckets, longest first within a task.  For a query q with the current k-th score t
in the task, a bucket whose longest vector is l can only help where the local cosine threshold c = t / (|q| l) is at most 1.  Per
bucket and query group the pruning is chosen from c: below `switch` by length (only candidates with |q| |p| >= t are verified), above
it by coordinates (on the query's largest coordinates, a unit candidate p with cos(q, p) >= c must have p_f of at least
q_f c - sqrt((1 - c^2)(1 - q_f^2)) if q_f >= -c, and always within sqrt(2 (1 - c)) of q_f).  What is left is verified by its exact integer product.  Queries come in blocks of bounded
size: a block is broadcast, meets all rows in one pass, and its results are written before its broadcast is destroyed and the next
block comes.  Every task returns at most k rows a query, and one more top-k joins the tasks.

Components x become floor(256 x).  Vectors that are null, or hold null or non-finite components, take no part; an empty vector has
products of zero with empty vectors; only vectors of one dimension meet.  Rows with the query's own id are not its candidates.  All
other rows are: repeated rows are each a candidate, and a repeated query has a list of its own.  Null ids take no part.  Ties go to
the smaller id.  An empty table gives no rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import drop_materialized, materialize, small_batches

SLACK = 1e-6


def quantized(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, v array<double> of whole numbers, norm; only vectors that take part."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def dot(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where it is exact, else with Python's integers (clipped to a long)."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2**53:
        return (q @ p.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(q).dot(whole(p).T), -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of every query seen so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return np.where(self.who[:, -1] == np.iinfo(np.int64).max, -np.inf, self.score[:, -1].astype(float))

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """scores (rows, ids) of which those not allowed don't count."""
        if scores.shape[1] > 4 * self.k:  # what can't come in isn't sorted
            part = np.where(allowed, scores, np.iinfo(np.int64).min)
            cut = np.maximum(np.partition(part, -self.k, 1)[:, -self.k], self.score[rows, -1])
            hit = allowed & (scores >= cut[:, None])
            full = np.flatnonzero(hit.any(1))
            for i in full.tolist():
                own = np.flatnonzero(hit[i])
                self._merge(rows[i], scores[i, own], ids[own])
            return
        for i in np.flatnonzero(allowed.any(1)).tolist():
            own = np.flatnonzero(allowed[i])
            self._merge(rows[i], scores[i, own], ids[own])

    def _merge(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, w = np.concatenate([self.score[row], scores]), np.concatenate([self.who[row], ids])
        order = np.lexsort((w, ~s))[: self.k]
        self.score[row], self.who[row] = s[order], w[order]


def search_bucket(best: Best, q: np.ndarray, q_norm: np.ndarray, p: np.ndarray, p_norm: np.ndarray, ids: np.ndarray, switch: float = 0.7, focus: int = 3, group: int = 256) -> None:
    """Bring a bucket, sorted by falling length, before all queries of its dimension."""
    longest = p_norm[0]
    unit = p / np.maximum(p_norm, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(best.floor() == -np.inf, -np.inf, best.floor() / (q_norm * longest))
    c = np.where(np.isnan(c), -np.inf, c)
    open_ = np.flatnonzero(c <= 1 + SLACK)
    by_length = open_[c[open_] < switch]
    for at in range(0, len(by_length), group):
        rows = by_length[at : at + group]
        need = best.floor()[rows] / np.maximum(q_norm[rows], 1e-300)
        n = int(np.searchsorted(-p_norm, -(need.min() - SLACK * (1 + abs(need.min()))), "right")) if np.isfinite(need.min()) and need.min() > 0 else len(p)
        if n:
            best.offer(rows, dot(q[rows], p[:n]), ids[:n], ids[None, :n] != best.ids[rows, None])
    for row in open_[c[open_] >= switch].tolist():
        u, cut = q[row] / q_norm[row], min(1.0, float(c[row])) - SLACK
        keep = np.ones(len(p), bool)
        for f in np.argsort(-np.abs(u))[:focus].tolist():
            reach = np.sqrt(max(0.0, (1 - cut * cut) * (1 - u[f] * u[f]))) + SLACK
            if u[f] >= -cut:  # else the cap around q holds the negative end of the axis, and no lower bound is right
                keep &= unit[:, f] >= u[f] * cut - reach  # a vector may be closer than the threshold: between it and q itself
            keep &= unit[:, f] <= u[f] + np.sqrt(max(0.0, 2 * (1 - cut))) + SLACK
            keep &= unit[:, f] >= u[f] - np.sqrt(max(0.0, 2 * (1 - cut))) - SLACK
        own = np.flatnonzero(keep)
        if len(own):
            best.offer(np.array([row]), dot(q[row : row + 1], p[own]), ids[own], ids[None, own] != best.ids[row])


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, block: int = 8192, bucket: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = materialize(quantized(small_batches(vectors), scale).repartitionByRange(F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc()), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**20)))  # of fixed files, so the same at every read
    total = queries.count()
    blocks = max(1, -(-total // block))
    path = f"{shared_dir(spark)}/table-found-{uuid.uuid4().hex}"
    for i in range(blocks):  # each block is of bounded size; its queries are broadcast and meet all rows in one pass
        own = queries.where((F.col("block") % blocks) == i).select("vec_id", "v").orderBy("vec_id", "v").collect()
        shared = spark.sparkContext.broadcast(([r["vec_id"] for r in own], [r["v"] for r in own]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q_vectors = shared.value
            by_dim: dict[int, list[int]] = {}
            for j, v in enumerate(q_vectors):
                by_dim.setdefault(len(v), []).append(j)
            state = {}
            for d, js in by_dim.items():
                q = np.array([q_vectors[j] for j in js], float).reshape(-1, d)
                state[d] = (np.array(js), q, np.linalg.norm(q, axis=1), Best(np.array([q_ids[j] for j in js], np.int64), k))
            for b in batches:
                ids, norms, lists = b.column("vec_id").to_numpy(), b.column("norm").to_numpy(), b.column("v")
                sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, int)
                flat = lists.values.to_numpy(zero_copy_only=False)
                begin = lists.offsets.to_numpy()[:-1]
                for d in np.unique(sizes).tolist():
                    if d not in state:
                        continue
                    own = np.flatnonzero(sizes == d)
                    own = own[np.argsort(-norms[own], kind="stable")]
                    for at in range(0, len(own), bucket):
                        some = own[at : at + bucket]
                        p = flat[begin[some][:, None] + np.arange(d)[None, :]].reshape(len(some), d)
                        _, q, q_norm, best = state[d]
                        search_bucket(best, q, q_norm, p, norms[some], ids[some])
            out: list[tuple] = []
            for js, _, _, best in state.values():
                for j, s, w in zip(js.tolist(), best.score.tolist(), best.who.tolist(), strict=True):
                    out += [(j, q_ids[j], b, a) for a, b in zip(s, w, strict=True) if b != np.iinfo(np.int64).max]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

        found = rows.select("vec_id", "norm", "v").mapInArrow(run, "query long, query_id long, vec_id long, score long")
        found.write.parquet(f"{path}/block={i}")
        shared.destroy()
    drop_materialized(rows)
    joined = spark.read.schema("query long, query_id long, vec_id long, score long, block int").parquet(path)
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    joined = joined.withColumn("rank", F.row_number().over(order).cast("int"))
    return joined.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
