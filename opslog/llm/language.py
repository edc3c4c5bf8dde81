"""Language by nearest centroid: TF-IDF vectors of byte n-grams against several centroids a language.

Document frequencies come from all documents to learn from. The centroids of a language are clusters
of a bounded sample of its documents on the unit sphere, so scripts, genres or layouts of one
language need not share a mean. A text takes the language of the centroid with the greatest cosine;
one that is farther from it than the sample's own documents were is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays, fitting, ngrams
from opslog.llm.toxicity import lowered

BITS = 12
#: Documents of a language that its centroids are learnt from at most, and centroids of a language.
SAMPLE, CENTROIDS, ROUNDS = 500, 4, 12
#: Share of a language's sample that lies beyond its distance of rejection.
BEYOND = 0.002
UNKNOWN = "und"


def plain(data: np.ndarray) -> np.ndarray:
    """Lower case, with everything but letters as a space."""
    return np.where(arrays.IS_BREAK[data], np.uint8(32), lowered(data))


@dataclass
class Model:
    """Inverse document frequencies, unit centroids, their languages and least cosines."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts).astype(np.float32) * self.idf)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` unit centroids: farthest documents first, then rounds of nearest means."""
    centres = unit(x.mean(axis=0, keepdims=True))
    near = x @ centres[0]
    while len(centres) < min(k, len(x)) and near.min() < 1 - 1e-6:
        centres = np.vstack([centres, x[np.argmin(near)]])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres = unit(sums[filled])
    return centres


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", bound: int = SAMPLE) -> Model:
    """Learn from all documents with a text and a language; centroids from ``bound`` a language."""
    known = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        key, F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))

    def frequencies(batch: pa.RecordBatch):
        held = np.zeros(1 << BITS, np.int64)
        rows = 0
        for a, b, found in ngrams.batches(batch.column(0), BITS, plain):
            held += (found > 0).sum(axis=0)
            rows += b - a
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([held.tolist()])], names=["n", "held"])

    parts = arrays.map_batches(known.select("text"), frequencies, "n long, held array<bigint>")
    total = parts.select(F.posexplode("held").alias("i", "held")).groupBy("i").agg(F.sum("held").alias("held"))
    held = np.zeros(1 << BITS)
    for r in total.collect():
        held[r.i] = r.held
    languages = known.groupBy("label").agg(F.count("*").alias("n")).collect()
    n = sum(r.n for r in languages)
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + np.float32(0.1)
    model = Model(idf, np.zeros((0, 1 << BITS), np.float32), [], np.zeros(0))

    def vectors(batch: pa.RecordBatch):
        for a, b, found in ngrams.batches(batch.column(0), BITS, plain):
            x = model.vectors(found).astype("<f2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    chosen = fitting.sample_each(known, key, "label", bound, len(languages))
    rows = arrays.map_batches(chosen.select("text", "label"), vectors, "label string, x binary").orderBy(
        "label", F.xxhash64("x")).collect()
    centres, names, least = [], [], []
    for name in sorted({r.label for r in rows}):
        x = np.stack([np.frombuffer(r.x, "<f2") for r in rows if r.label == name]).astype(np.float32)
        x = x[np.abs(x).sum(axis=1) > 0]
        if len(x):
            own = cluster(unit(x), CENTROIDS)
            centres.append(own)
            names += [name] * len(own)
            least += [float(np.quantile((unit(x) @ own.T).max(axis=1), BEYOND))] * len(own)
    return Model(idf, np.concatenate(centres) if centres else model.centroids, names, np.array(least))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (greatest cosine, 0 to 1) and ``rejected``.

    One narrow pass over whole texts. A null text or one without a letter is ``und`` with a score of 0
    and rejected. A text too short for an n-gram takes the first centroid with a score of 0 and is
    rejected. Without anything learnt every text is ``und``. Rows are independent of each other.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.languages, model.least))

    def run(batch: pa.RecordBatch):
        own = Model(*sent.value)
        lettered = batch.column(2)
        for a, b, found in ngrams.batches(batch.column(1), BITS, plain):
            some = lettered.slice(a, b - a).to_numpy(zero_copy_only=False)
            if not own.languages:
                best, cosine, far = np.full(b - a, UNKNOWN, object), np.zeros(b - a), np.ones(b - a, bool)
            else:
                x = own.vectors(found)
                at = np.argmax(x @ own.centroids.T, axis=1)
                # row by row, so that equal texts get equal scores in any batch
                cosine = np.clip((x * own.centroids[at]).sum(axis=1, dtype=np.float64), 0, 1)
                far = cosine < own.least[at]
                best = np.array(own.languages, object)[at]
            best, cosine = np.where(some, best, UNKNOWN), np.where(some, cosine, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(best, pa.string()), pa.array(cosine), pa.array(far | ~some)],
                names=["key", "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn(
        "lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return arrays.map_batches(source, run, f"key {kind}, lang_pred string, score double, rejected boolean"
                              ).withColumnRenamed("key", key)
