"""Quality grades by ordinal regression: a cumulative link over hashed text.

One vector of weights over hashed byte n-grams is shared by all grades; ordered thresholds cut its
scale into grades: ``P(grade <= k) = sigmoid(threshold_k - w.x)``. The result is the expected grade and
the chance of at least a wanted grade, by which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays, fitting, ngrams

BITS = 11
#: Labelled documents learnt from at most.
SAMPLE = 6000
STEPS, RATE, RIDGE = 300, 0.05, 2e-3


@dataclass
class Model:
    """Grades in ascending order, centre and weights of the buckets, and the thresholds between grades."""

    grades: list[float]
    centre: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """Chance of more than each grade but the last, rows by thresholds."""
        # row by row, so that equal texts get equal results in any batch
        z = ((x - self.centre) * self.weights).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(self.thresholds - z[:, None], -30, 30)))


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: vectors of length one, or zero for a text without n-grams."""
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def fit_vectors(x: np.ndarray, grade: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by accelerated gradient steps.

    Thresholds are the first one and the logarithms of the gaps, so their order cannot break.
    """
    grades, rank = np.unique(grade, return_inverse=True)
    k = len(grades)
    centre = x.mean(axis=0) if len(x) else np.zeros(1 << BITS, np.float32)
    if k < 2:
        return Model(grades.tolist(), centre, np.zeros_like(centre), np.empty(0))
    share = np.clip(np.cumsum(np.bincount(rank))[:-1] / len(rank), 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    x = x - centre
    w = np.zeros(x.shape[1])
    cut = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    params = np.concatenate([w, cut])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(len(x))
    for step in range(1, STEPS + 1):
        w, cut = params[:-len(cut)], params[-len(cut):]
        theta = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        z = x @ w
        high = 1 / (1 + np.exp(-np.clip(edges[rank + 1] - z, -30, 30)))
        low = 1 / (1 + np.exp(-np.clip(edges[rank] - z, -30, 30)))
        mass = np.maximum(high - low, 1e-9)
        up, down = high * (1 - high) / mass, low * (1 - low) / mass
        grad_z = (up - down) / len(x)
        grad_theta = np.zeros(k + 1)
        np.add.at(grad_theta, rank + 1, -up / len(x))
        np.add.at(grad_theta, rank, down / len(x))
        grad_theta = grad_theta[1:k]
        back = np.cumsum(grad_theta[::-1])[::-1]
        grad_cut = np.concatenate([back[:1], back[1:] * np.exp(cut[1:])])
        grad = np.concatenate([x.T @ grad_z + RIDGE / np.sqrt(len(rows)) * w, grad_cut])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        params = params - RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-9)
    w, cut = params[:-len(cut)], params[-len(cut):]
    return Model(grades.tolist(), centre, w, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          bound: int = SAMPLE) -> Model:
    """Fit on at most ``bound`` rated documents; their vectors, not their texts, reach the driver."""
    sampled = fitting.sample(docs.select(key, text), labels.select(key, label), key, label, bound)

    def run(batch: pa.RecordBatch):
        for a, b, found in ngrams.batches(batch.column(0), BITS):
            x = features(found).astype("<f2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["grade", "x"])

    rows = arrays.map_batches(
        sampled.select(F.col(text).cast("string"), F.col("_label").cast("double")), run, "grade double, x binary"
    ).orderBy(F.xxhash64("x"), "grade").collect()
    x = np.frombuffer(b"".join(r.x for r in rows), "<f2").reshape(len(rows), 1 << BITS).astype(np.float32)
    return fit_vectors(x, np.array([r.grade for r in rows], float))


def grade(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", at_least: float | None = None) -> DataFrame:
    """``key``, ``expected`` grade and ``tail``, the chance of at least ``at_least`` (default: the highest grade).

    One narrow pass over whole texts. A null or empty text, or one too short for an n-gram, is graded
    from the thresholds alone; rows are independent of each other; without rated documents both
    results are null, with one grade the expected grade is that grade and the tail 0 or 1.
    """
    want = at_least if at_least is not None else (model.grades[-1] if model.grades else 0.0)
    sent = docs.sparkSession.sparkContext.broadcast((model.grades, model.centre, model.weights, model.thresholds))

    def run(batch: pa.RecordBatch):
        own = Model(*sent.value)
        for a, b, found in ngrams.batches(batch.column(1), BITS):
            n = b - a
            if not own.grades:
                expected = tail = pa.nulls(n, pa.float64())
            else:
                tails = own.tails(features(found))
                expected = pa.array(own.grades[0] + tails @ np.diff(own.grades))
                above = [i for i, g in enumerate(own.grades) if g >= want]
                first = above[0] if above else None
                tail = pa.array(np.zeros(n) if first is None else np.ones(n) if first == 0 else tails[:, first - 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), expected, tail], names=["key", "expected", "tail"])

    kind = docs.schema[key].dataType.simpleString()
    out = arrays.map_batches(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run,
                             f"key {kind}, expected double, tail double")
    return out.withColumnRenamed("key", key)
