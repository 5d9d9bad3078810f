"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Random indexing: every word (a counter of VOCABULARY, by hash) has a fixed sparse index vector of a few +1 and
-1; a word's vector is the sum of the index vectors of the words around it, over all documents.  A
document is the mean of its words' vectors with their spread and a few sizes.  The network has one hidden
layer, and a temperature fitted on labels kept apart calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards
from . import textkit as K

#: Words by hash, dimensions, non-zeros of an index vector, words on either side, parts of the vectors in a shuffle.
VOCABULARY, DIMENSIONS, NONZERO, REACH, _SLICES = 1 << 15, 48, 2, 2, 32
#: Space 0, letters and digits 1, punctuation 2.
_CLASS = np.where(K.SPACE, 0, np.where(K.MARKS, 2, 1)).astype(np.uint8)
_RANDOM = np.random.Generator(np.random.PCG64(7))
_DIMENSION = _RANDOM.integers(0, DIMENSIONS, (VOCABULARY, NONZERO))
_SIGN = _RANDOM.integers(0, 2, (VOCABULARY, NONZERO)) * 2.0 - 1


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter of each run of letters or of punctuation, and tokens before each text."""
    x = K.folded(buf)
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = np.zeros(n + 2, np.uint8)
    kind[1:-1] = _CLASS[x]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    here = kind[1:-1]
    starts = np.flatnonzero((here > 0) & ((here != kind[:-2]) | edge[:-1]))
    ends = np.flatnonzero((here > 0) & ((here != kind[2:]) | edge[1:])) + 1
    names = K.name(x, starts, ends)
    return (names & np.uint64(VOCABULARY - 1)).astype(np.int64), np.searchsorted(starts, off)


def contexts(buf: np.ndarray, off: np.ndarray, total: np.ndarray, seen: np.ndarray) -> None:
    """Adds the index vectors around each word to `total`, and counts words in `seen`."""
    for _, _, x, o in K.pieces(buf, off, 16 * K.PIECE):
        t, first = tokens(x, o)
        row = np.repeat(np.arange(len(o) - 1), np.diff(first))
        seen += np.bincount(t, minlength=VOCABULARY)
        at, weight = [], []
        for d in range(1, REACH + 1):
            ok = np.flatnonzero(row[d:] == row[:-d])
            for a, b in ((t[ok], t[ok + d]), (t[ok + d], t[ok])):
                for k in range(NONZERO):
                    at.append(a * DIMENSIONS + _DIMENSION[b, k])
                    weight.append(_SIGN[b, k])
        if at:
            total += np.bincount(np.concatenate(at), np.concatenate(weight), VOCABULARY * DIMENSIONS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """VOCABULARY x DIMENSIONS vectors from all texts.  Tasks add up their own; Spark adds the parts; the size is fixed."""
    rows = VOCABULARY // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(VOCABULARY * DIMENSIONS), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            contexts(*K.flat(batch.column(0)), total, seen)
        codec = pa.Codec("zstd", compression_level=1)
        both = np.concatenate([total.reshape(VOCABULARY, DIMENSIONS), seen[:, None]], 1).astype(np.int32)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([codec.compress(np.ascontiguousarray(both[k * rows : (k + 1) * rows].T).tobytes(), asbytes=True) for k in range(_SLICES)], pa.binary())], ["slice", "payload"])

    def summed(table: pa.Table, kind) -> pa.Table:
        codec, total = pa.Codec("zstd", compression_level=1), np.zeros((DIMENSIONS + 1) * rows, np.int64)
        for x in table["payload"]:
            total += np.frombuffer(codec.decompress(x.as_buffer(), np.dtype(kind).itemsize * len(total)), kind)
        return pa.table({"slice": table["slice"][:1], "payload": pa.array([codec.compress(total.tobytes(), asbytes=True)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        return summed(table, np.int32)

    def add_sums(table: pa.Table) -> pa.Table:
        return summed(table, np.int64)

    out = np.zeros((VOCABULARY, DIMENSIONS + 1))
    parts = docs.select("text").mapInArrow(run, "slice int, payload binary").groupBy("slice", F.pmod(F.spark_partition_id(), F.lit(shards.FAN))).applyInArrow(add, "slice int, payload binary")
    for r in parts.groupBy("slice").applyInArrow(add_sums, "slice int, payload binary").collect():
        out[r.slice * rows : (r.slice + 1) * rows] = np.frombuffer(pa.Codec("zstd").decompress(r.payload, 8 * (DIMENSIONS + 1) * rows), np.int64).reshape(-1, rows).T
    return finished(out[:, :-1], out[:, -1])


def finished(total: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Vectors of length 1, without what all words have in common."""
    mean = total.sum(0) / max(1, seen.sum())
    v = total - seen[:, None] * mean
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(buf: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its words' vectors, the mean's length, sizes."""
    out = np.zeros((len(off) - 1, 2 * DIMENSIONS + 3), np.float32)
    for a, b, x, o in K.pieces(buf, off, K.PIECE // 2):
        t, first = tokens(x, o)
        per = np.diff(first)
        some = np.flatnonzero(per > 0)
        if len(some):
            v = vectors[t]
            n = per[some, None].astype(np.float32)
            mean = np.add.reduceat(v, first[:-1][some], axis=0) / n
            v *= v
            square = np.add.reduceat(v, first[:-1][some], axis=0) / n
            block = out[a:b]
            block[some, :DIMENSIONS] = mean
            block[some, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
            block[some, -3] = np.linalg.norm(mean, axis=1)
            block[some, -2] = np.log1p(per[some])
            block[some, -1] = np.log1p((o[1:] - o[:-1])[some] / per[some])
    return out


@dataclass
class Network:
    """Two layers on standardised features, and the temperature of its logits."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, ridge: float = 1e-4) -> Network:
    """Adam on the log loss; a fifth of the rows is kept apart for the temperature."""
    rng = np.random.default_rng(0)
    x = x.astype(np.float64)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[own].mean(0), x[own].std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x[own] - net.mean) / net.scale
    t = y[own].astype(np.float64)
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.tanh(z[part] @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30)))
            d = (p - t[part]) / len(part)
            back = np.outer(d, weights[2]) * (1 - h * h)
            grads = [z[part].T @ back + ridge * weights[0], back.sum(0), h.T @ d + ridge * weights[2], d.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    net.temperature = temperature(net.logits(x[held]), y[held])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, sought by golden section on its logarithm."""
    if len(np.unique(y)) < 2:
        return 1.0
    loss = lambda s: float(np.logaddexp(0, np.where(y == 1, -1, 1) * logits / np.exp(s)).mean())
    lo, hi, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def scored(docs: DataFrame, labels: DataFrame, sample: int = 20000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document: the probability of label 1.

    labels: doc_id, label 0 or 1 (others are left out; of several for one id, or of several texts, the smallest counts); sample bounds
    the labelled rows that are fitted, those with the smallest hash of their id.  A null or empty text has
    features of zero; a null doc_id stays null; without both classes every score is the smoothed base rate.
    """
    spark = docs.sparkSession
    docs = shards.documents(docs, id_col, text_col)
    sent = spark.sparkContext.broadcast(word_vectors(docs))
    width = 2 * DIMENSIONS + 3

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(*K.flat(batch.column(1)), sent.value)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["doc_id", "x"])

    rows = shards.durable(docs.mapInArrow(pool, "doc_id long, x binary"))
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the broadcast has `sample` rows at most
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    y = np.array([r.label for r in got], np.int64)
    if len(np.unique(y)) < 2:
        return rows.select("doc_id", F.lit(float((y.sum() + 1) / (len(y) + 2))).alias("score"))
    net = fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]), y)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.flat(batch.column(1))
            x = np.frombuffer(data.tobytes(), np.float32).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(x))], ["doc_id", "score"])

    return rows.mapInArrow(rate, "doc_id long, score double")
