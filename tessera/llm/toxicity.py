"""Toxicity by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-bigrams (one or two words
left out), each counted once per text. FTRL-proximal has a learning rate per
coordinate and an L1 term that leaves most weights at exactly zero, so the model
that goes to the executors is two short arrays.

Training takes a bounded sample of labelled rows (``train_rows`` in
expectation); scoring reads every text whole.

Defined results: a null text scores as an empty one, that is by the bias; rows
without a label teach nothing; a null doc_id is neither learned from nor held
out; repeated rows are scored each; an empty table gives an empty result; with
nothing to learn from every score is the prior 0.5 ** 10.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_WORDS = re.compile(r"\w+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def features(text: str | None, bits: int) -> np.ndarray:
    """Buckets of the n-grams and skip-grams of a text, with repetitions."""
    found = _WORDS.findall((text or "").lower())
    known = shared.keep("word hashes", shared.WordHashes)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    parts, down = [h * _MULTIPLIERS[0]], np.uint64(64 - bits)
    for gap in (1, 2, 3):
        if len(h) > gap:
            x = (h[:-gap] * _MULTIPLIERS[gap]) ^ (h[gap:] >> np.uint64(7)) ^ (h[gap:] << np.uint64(57))
            parts.append(x * _MULTIPLIERS[0])
    return (np.concatenate(parts) >> down).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss over binary features."""

    def __init__(self, bits: int = 20, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z, self.bias_n = 0.0, 0.0

    def _weights(self, z, n):
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha))

    def update(self, buckets: np.ndarray, label: int) -> float:
        z, n, b = self.z[buckets], self.n[buckets], self.bias()
        w = self._weights(z, n)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
        g = p - label
        self.z[buckets] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[buckets] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g
        return p

    def model(self) -> tuple[int, float, np.ndarray, np.ndarray]:
        """(bits, bias, buckets, weights) of the weights that are not zero."""
        w = self._weights(self.z, self.n)
        at = np.flatnonzero(w)
        return self.bits, self.bias(), at.astype(np.int32), w[at]


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary())])


def train(labelled: DataFrame, passes: int = 4, bits: int = 20, seed: int = 3, **rates) -> tuple[int, float, np.ndarray, np.ndarray]:
    """A model from the bounded sample ``labelled`` (doc_id, text, label 0 or 1),
    which becomes bucket lists on the executors. The driver goes over these
    ``passes`` times, in an order fixed by the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield shared.batch(_SAMPLE, [b.column(0), b.column(1), [np.unique(features(t.as_py(), bits)).astype("<i4").tobytes() for t in b.column(2)]])

    got = labelled.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, label int, buckets binary").toArrow()
    if not got.num_rows:
        return bits, -10 * float(np.log(2)), np.zeros(0, np.int32), np.zeros(0)
    ids, labels, buckets = got["doc_id"].to_pylist(), got["label"].to_pylist(), got["buckets"]
    order = sorted(range(len(ids)), key=lambda i: (xxhash.xxh64_intdigest(str(ids[i]), seed), labels[i], zlib.crc32(buckets[i].as_buffer())))
    learner = Ftrl(bits, **rates)
    for _ in range(passes):
        for i in order:
            learner.update(np.frombuffer(buckets[i].as_buffer(), dtype="<i4"), labels[i])
    return learner.model()


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int, seed: int = 11) -> DataFrame:
    """(doc_id, text, label) for a hash sample of about ``train_rows`` of the
    labelled rows outside the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rate = min(1.0, train_rows / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # about train_rows rows


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


class Scorer:
    def __init__(self, bits: int, bias: float, buckets: np.ndarray, weights: np.ndarray):
        self.bits, self.bias = bits, bias
        self.weights = np.zeros(1 << bits, dtype=np.float64)
        self.weights[buckets] = weights

    def score(self, text: str | None) -> float:
        at = features(text, self.bits)
        at = np.unique(at[self.weights[at] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum(), -30, 30))))


def score(docs: DataFrame, model: tuple[int, float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shipped.value)
        for b in batches:
            s = np.array([scorer.score(t.as_py()) for t in b.column(2)], dtype=np.float64)
            yield shared.batch(_SCORES, [b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str, train_rows: int = 16_000) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return score(docs, train(labelled_sample(docs, shared.table(spark, sf_dir, "labels"), train_rows)))
