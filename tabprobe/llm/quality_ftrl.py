"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Words and runs of punctuation, and pairs of neighbours, are hashed into
``2**BITS`` features (a pair of equal words is one feature of its own); a
document is the square roots of its feature counts at unit length.  Weights are
learned with follow-the-regularised-leader-proximal updates, one document at a
time, over a bounded sample of labelled documents (``sample``, by hash of the
id); a score is the logistic function of a sparse dot product.

Edge cases: null and empty texts have no feature, their score is that of the
bias; documents without a label, or whose labels contradict each other, aren't
learned from; repeated rows get equal results; with no label at all every
score is 0.5; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import id_crc, written

BITS = 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CACHE_LIMIT = 200_000
_BIAS, _SAME = 0, 1


class Features:
    def __init__(self):
        self.cache: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace")) + 1
        self.cache[word] = h
        return h

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature numbers and their values."""
        tokens = _TOKEN.findall(text) if text else []
        if not tokens:
            return np.array([_BIAS], np.int32), np.ones(1, np.float32)
        if len(self.cache) > _CACHE_LIMIT:
            self.cache.clear()
        get, new = self.cache.get, self._hash
        h = np.fromiter((get(w) or new(w) for w in tokens), np.uint64, len(tokens))
        pairs = (h[:-1] * _P ^ h[1:]) * _Q
        shift = np.uint64(64 - BITS)
        pairs = pairs >> shift
        pairs[h[:-1] == h[1:]] = _SAME
        found, counts = np.unique(np.concatenate(((h * _Q * _P) >> shift, pairs)), return_counts=True)
        values = np.sqrt(counts)
        values /= np.sqrt(counts.sum())
        return (np.append(found, _BIAS).astype(np.int32), np.append(values, 1).astype(np.float32))


class FTRL:
    """Logistic regression by FTRL-proximal (per-coordinate rates)."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        cells = [features.of(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a.tobytes() for a, _ in cells], pa.binary()),
             pa.array([x.tobytes() for _, x in cells], pa.binary()), batch.column(2)],
            ["h", "at", "x", "y"])


def trained(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, sample: int = 6000,
            sample_bytes: int = 256 << 20, epochs: int = 3, seed: int = 1, **options) -> np.ndarray:
    """Weights learned from labelled documents where ``learn`` (on ``doc_id``) holds: the
    first ``sample`` by hash, as far as their features fit ``sample_bytes`` together."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality")
    known = known.where(learn) if learn is not None else known
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top")) \
        .where("y = top").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(known), "doc_id") \
        .select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("y").cast("int").alias("y")) \
        .mapInArrow(_feature_rows, "h bigint, at binary, x binary, y int")
    rows = written(rows.orderBy("h").limit(sample))
    sizes = rows.select("h", (F.length("at") + F.length("x")).alias("size")).orderBy("h").collect()
    fits = [h for (h, _), total in zip(sizes, accumulate(r["size"] for r in sizes)) if total <= sample_bytes]
    rows = rows.where(F.col("h") <= fits[-1]).orderBy("h").collect() if fits else []
    model = FTRL(**options)
    order = np.random.default_rng(seed)
    data = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), r["y"])
            for r in rows]
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            model.learn(*data[i])
    return model.weights().astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every document."""
    def run(batches):
        features = Features()
        w = weights.astype(np.float64)
        for batch in batches:
            out = []
            for cell in batch.column(1):
                at, x = features.of(cell.as_py())
                out.append(1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(out, np.float64))], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 4 == 2


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels
    that aren't held out."""
    weights = trained(docs, labels, learn=~held_out(), **options)
    return scored(docs, weights).select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
