"""Quality classifier: a byte-level convolutional network in numpy.

Filters of `width` bytes slide over the whole text at steps of `step`; a filter's weights are a table (position, byte), which is a
convolution over one-hot bytes.  Rectified outputs are max-pooled over overlapping chunks (two neighbouring blocks each), chunk
vectors are combined as their mean and their maximum, and a logistic layer makes one probability.  It learns from at most
`most_labelled` labelled rows, of `most_bytes` of text, whose crc32(doc_id as text) mod 5 isn't 0, with Adam; only bytes of the text
enter a score.

Null and empty texts are scored as one chunk of zero bytes.  Very long texts are scored whole.  A score that ties with the cut is
predicted 1.  An empty table gives no rows; other columns take no part, whatever their names.  Without labelled rows of both classes the score is the share of label 1
(0.5 with none).  Null ids count as held out.  Repeated rows get the same score; a row labelled twice takes its lowest label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, slices
from .rules import labelled_sample


class ByteNet:
    def __init__(self, filters: int = 16, width: int = 8, step: int = 4, block: int = 64, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.filters, self.width, self.step, self.block = filters, width, step, block
        self.table = rng.normal(0, 0.1, (width, 256, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.out = rng.normal(0, 0.1, 2 * filters).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def _blocks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, each padded with zeros to whole blocks, and the blocks of each."""
        size = self.step * self.block
        counts = [max(1, -(-len(t) // size)) for t in texts]
        data = b"".join([t.ljust(n * size, b"\0") for t, n in zip(texts, counts, strict=True)]) + bytes(self.width)
        return np.frombuffer(data, np.uint8), np.array(counts)

    def _windows(self, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = (len(data) - self.width) // self.step
        out = np.zeros((n, self.filters), np.float32)
        for k in range(self.width):
            out += self.table[k].take(data[k : k + n * self.step : self.step], axis=0)
        ends = np.cumsum(counts) * self.block
        for j in range(1, -(-self.width // self.step)):  # windows that reach over the end of a text see zeros there
            for k in range(j * self.step, self.width):
                out[ends - j] += self.table[k, 0] - self.table[k].take(data[(ends - j) * self.step + k], axis=0)
        return out

    def _pool(self, data: np.ndarray, counts: np.ndarray):
        """Maxima by block and where they lie, by chunk, and the vector of each text."""
        conv = self._windows(data, counts).reshape(-1, self.block, self.filters)
        where = conv.argmax(1)
        blocks = np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + self.bias
        np.maximum(blocks, 0, out=blocks)
        ends = np.cumsum(counts)
        starts = ends - counts
        after = np.arange(len(blocks)) + 1
        after[ends - 1] = np.maximum(ends - 2, starts)  # the last block of a text pairs with the one before it
        chunks = np.maximum(blocks, blocks[after])
        mean = np.add.reduceat(chunks, starts, 0) / counts[:, None].astype(np.float32)
        top = np.maximum.reduceat(chunks, starts, 0)
        return where, blocks, after, chunks, starts, np.concatenate([mean, top], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        data, counts = self._blocks(texts)
        vectors = self._pool(data, counts)[-1]
        return 1 / (1 + np.exp(-(vectors @ self.out + self.out_bias).astype(np.float64)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> ByteNet:
        rng = np.random.default_rng(seed)
        params = [self.table, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        f, t = self.filters, 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                data, counts = self._blocks([texts[i] for i in own])
                where, blocks, after, chunks, starts, vectors = self._pool(data, counts)
                p = 1 / (1 + np.exp(-(vectors @ self.out + self.out_bias)))
                error = ((p - labels[own]) * np.where(labels[own] > 0, 1, 2) / len(own)).astype(np.float32)  # junk is the rarer class
                grads = [None, None, vectors.T @ error, error.sum(keepdims=True)]
                back = error[:, None] * self.out[None, :]
                of = np.repeat(np.arange(len(own)), counts)
                g = (back[:, :f] / counts[:, None])[of]
                g += back[:, f:][of] * (chunks == vectors[:, f:][of])
                to_own = blocks >= blocks[after]
                gb = g * to_own
                np.add.at(gb, after, g * ~to_own)
                gb *= blocks > 0
                grads[1] = gb.sum(0)
                place = (np.arange(len(blocks))[:, None] * self.block + where) * self.step
                end = np.repeat(np.cumsum(counts), counts)[:, None] * self.block * self.step
                table = np.zeros_like(self.table)
                cols = np.broadcast_to(np.arange(f), place.shape)
                for k in range(self.width):
                    flat = np.where(place + k < end, data[place + k], 0).astype(np.int64) * f + cols
                    table[k] = np.bincount(flat.ravel(), gb.ravel(), 256 * f).reshape(256, f)
                grads[0] = table + decay * self.table
                t += 1
                for p_, g_, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g_ - m)
                    v += 0.001 * (g_ * g_ - v)
                    p_ -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, most_bytes: int = 64 << 20, **settings) -> ByteNet | float:
    """A network fitted on the driver, or the share of label 1 where there aren't both classes. Texts come in the order of the
    sample's hashes until most_bytes are full."""
    allowed = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    order = Window.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "text")  # of most_labelled rows, or their repeats
    rows = labelled_sample(docs, allowed, most_labelled).withColumn("run", F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(order)).where(F.col("run") <= most_bytes).collect()
    rows = sorted(((r["doc_id"], (r["text"] or "").encode(), int(r["quality"])) for r in rows), key=lambda r: r)
    labels_ = np.array([r[2] for r in rows], np.float32)
    if len(set(labels_.tolist())) < 2:
        return float(labels_.mean()) if len(rows) else 0.5
    return ByteNet(**settings).fit([r[1] for r in rows], labels_)


def score_documents(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in slices(batches, most_bytes=1 << 20):
            score = net.score(binary(b.column("text"))) if isinstance(net, ByteNet) else np.full(b.num_rows, net)
            held = [zlib.crc32(b"" if x is None else str(x).encode()) % 5 == 0 for x in b.column("doc_id").to_pylist()]
            columns = [b.column("doc_id"), pa.array(held, pa.bool_()), pa.array(score.astype(float)), pa.array((score >= cut).astype(np.int32))]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
