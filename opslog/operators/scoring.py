"""Score logs with a trained model: templates, history, features, forest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from opslog.functions import sequence as seq
from opslog.operators import features as feat
from opslog.operators.iforest import Forest, dense
from opslog.operators.ocsvm import Machine
from opslog.operators.sequences import block_history
from opslog.operators.skew import SPLIT_ROWS, skew_join
from opslog.operators.templates import enrich_logs
from opslog.session import stage
from opslog.sources.models import Model

#: A vocabulary of more terms is joined instead of being sent to the tasks.
SHARED_TERMS = 200_000
MATRIX_CELLS = 4_000_000
#: Template ids and cells of the matrix that a task works on at a time.
PART_CELLS = 500_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _next_code(code: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Codes of terms with one more template id: 64-bit fingerprints, for ids of any size."""
    x = (code ^ ids.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Detector:
    """A forest or a one-class SVM with its offset: a lower score is an anomaly."""

    scorer: Forest | Machine
    offset: float

    @staticmethod
    def load(model: Model) -> Detector:
        if model.machine is not None:
            machine = Machine.load(model.machine)
            return Detector(machine, machine.offset)
        return Detector(Forest.load(model.forest), model.forest.agg(F.max("offset")).first()[0])


@dataclass(frozen=True)
class SequenceScorer:
    """Vocabulary, scaler and detector as arrays; scores batches of id sequences.

    A term of any number of template ids is coded as one fingerprint, so whole
    batches are counted with array operations.
    """

    codes: np.ndarray
    idx: np.ndarray
    idf: np.ndarray
    n_max: int
    meta: np.ndarray
    detector: Detector

    @staticmethod
    def load(model: Model) -> SequenceScorer:
        """For a vocabulary of checked size: it is read by the driver and sent to the tasks."""
        vocab = model.vocabulary.select("term", "idx", "idf").toPandas()
        ids = [[int(t[1:]) for t in term.split(" ")] for term in vocab["term"]]
        n_max = max((len(i) for i in ids), default=1)
        codes = np.array([_code(i) for i in ids], dtype=np.uint64)
        order = np.argsort(codes)
        scaler = model.scaler.first()
        meta = np.array([[scaler[f"{c}_mean"], scaler[f"{c}_scale"]] for c in feat.META])
        return SequenceScorer(
            codes[order], vocab["idx"].to_numpy()[order], vocab["idf"].to_numpy()[order],
            n_max, meta, Detector.load(model),
        )

    def matrix(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Feature columns the detector uses, one row per sequence, and the squared length of all features."""
        lengths = np.array([len(s) for s in sequences])
        raw = np.concatenate(sequences)
        row = np.repeat(np.arange(len(sequences)), lengths)
        out = np.zeros((len(sequences), len(self.detector.scorer.columns)))
        squares = np.zeros(len(sequences))
        rows, terms = [], []
        code = np.zeros(len(raw), dtype=np.uint64)
        for n in range(1, self.n_max + 1):
            size = len(raw) - n + 1
            if size <= 0:
                break
            code = _next_code(code[:size], raw[n - 1:])
            whole = row[:size] == row[n - 1:]
            rows.append(row[:size][whole])
            terms.append(code[whole])
        rows, terms = np.concatenate(rows), np.concatenate(terms)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, terms), len(self.codes) - 1)
            known = self.codes[at] == terms
            cell, tf = np.unique(rows[known] * len(self.codes) + at[known], return_counts=True)
            rows, at = cell // len(self.codes), cell % len(self.codes)
            weight = (1.0 + np.log(tf)) * self.idf[at]
            norm = np.sqrt(np.bincount(rows, weights=weight * weight, minlength=len(sequences)))
            self._put(out, rows, self.idx[at], weight / norm[rows])
            squares[np.unique(rows)] = 1.0
        ids, place = np.unique(raw, return_inverse=True)
        pair = np.unique(row * len(ids) + place)
        counts = [lengths, np.bincount(pair // len(ids), minlength=len(sequences))]
        for i, (mean, scale) in enumerate(self.meta):
            here = np.full(len(sequences), len(self.codes) + i)
            z = (counts[i] - mean) / scale
            self._put(out, np.arange(len(sequences)), here, z)
            squares += z * z
        return out, squares

    def _put(self, out: np.ndarray, rows: np.ndarray, features: np.ndarray, values: np.ndarray) -> None:
        columns = self.detector.scorer.columns
        if len(columns):
            at = np.minimum(np.searchsorted(columns, features), len(columns) - 1)
            hit = columns[at] == features
            out[rows[hit], at[hit]] = values[hit]

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """In parts of bounded size; sequences of equal features are judged once."""
        held = np.cumsum([len(s) + len(self.detector.scorer.columns) for s in sequences]) // PART_CELLS
        bounds = [*np.flatnonzero(np.diff(held, prepend=-1)), len(sequences)]
        return np.concatenate([np.empty(0), *(self._score(sequences[a:b]) for a, b in zip(bounds[:-1], bounds[1:]))])

    def _score(self, sequences: list[np.ndarray]) -> np.ndarray:
        matrix, squares = self.matrix(sequences)
        rows = np.column_stack([matrix, squares])
        codes, keys = pd.factorize(pd.Series([r.tobytes() for r in rows], dtype=object))
        first = np.full(len(keys), len(codes))
        np.minimum.at(first, codes, np.arange(len(codes)))
        return self.detector.scorer.score_matrix(matrix[first], squares[first])[codes]


def _code(ids: list[int]) -> int:
    code = np.zeros(1, dtype=np.uint64)
    for i in ids:
        code = _next_code(code, np.array([i]))
    return code[0]


def _score_shared(df: DataFrame, scorer: SequenceScorer) -> DataFrame:
    """Features and score in one narrow pass; equal sequences of a batch are scored once."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(ids: pd.Series) -> pd.Series:
        arrays = [np.asarray(i, dtype=np.int64) for i in ids]
        codes, keys = pd.factorize(pd.Series([a.tobytes() for a in arrays], dtype=object))
        distinct = [np.frombuffer(k, dtype=np.int64) for k in keys]
        return pd.Series(shared.value.score(distinct)[codes] if len(codes) else np.empty(0))

    ids = F.when(F.size("templates") > 0, F.col("templates")).otherwise(F.array(F.lit(0).cast("long")))
    return df.withColumn("score_sample", score(ids))


def _score_joined(df: DataFrame, model: Model, detector: Detector) -> DataFrame:
    """Features through joins with the vocabulary, whatever its size; each different sequence is scored once.

    Norms come from all terms; only the features that the detector looks at are gathered, for a forest
    at most as many as it has nodes. The weights of a linear machine, one a feature, are joined as well.
    """
    key = F.sha2(F.array_join("templates", " "), 256)
    keyed = df.withColumn("_sequence", key)
    tokens = seq.clean_tokens(F.transform("templates", seq.template_token))
    sequences = stage(keyed.select(F.col("_sequence").alias("block_id"), tokens.alias("tokens")).dropDuplicates(["block_id"]),
                      "sequences")
    n_max = model.vocabulary.agg(F.coalesce(F.max(F.size(F.split("term", " "))), F.lit(1))).first()[0]
    n_terms = model.vocabulary.count()
    terms = sequences.select("block_id", F.explode(seq.ngrams(F.col("tokens"), n_max)).alias("term")).groupBy(
        "block_id", "term").agg(F.count("*").alias("tf"))
    scaled = feat.scaler_transform(sequences.select(
        "block_id", F.size("tokens").alias("seq_len"), F.size(F.array_distinct("tokens")).alias("unique_templates")), model.scaler)
    weights = feat.tfidf_transform(terms, model.vocabulary)
    if isinstance(detector, Detector):
        shared = df.sparkSession.sparkContext.broadcast(detector.scorer)
        wanted = df.sparkSession.createDataFrame([(int(c),) for c in detector.scorer.columns], "idx int")
        whole = weights.groupBy("block_id").agg(F.lit(1.0).alias("_known"))
        vectors = feat.assemble_features(weights.join(wanted, "idx", "left_semi"), scaled, n_terms).join(
            whole, "block_id", "left").join(scaled.select("block_id", *(f"{c}_z" for c in feat.META)), "block_id")
        squares = F.coalesce("_known", F.lit(0.0)) + sum(F.col(f"{c}_z") * F.col(f"{c}_z") for c in feat.META)

        @F.pandas_udf("double")
        def score(indices: pd.Series, values: pd.Series, squares: pd.Series) -> pd.Series:
            columns = shared.value.columns
            step = max(1, MATRIX_CELLS // max(len(columns), 1))
            parts = [shared.value.score_matrix(dense(indices[i:i + step], values[i:i + step], columns),
                                               squares[i:i + step].to_numpy()) for i in range(0, len(indices), step)]
            return pd.Series(np.concatenate([np.empty(0), *parts]))

        scores = vectors.select("block_id", score("indices", "values", squares).alias("score_sample"))
    else:
        linear = model.machine.where("idx >= 0").select("idx", F.col("value").alias("_w"))
        meta = sum(F.coalesce(F.col(f"_w{i}"), F.lit(0.0)) * F.col(f"{c}_z") for i, c in enumerate(feat.META))
        for i in range(len(feat.META)):
            scaled = scaled.withColumn(f"_w{i}", linear.where(F.col("idx") == n_terms + i).select("_w").scalar())
        sums = weights.join(linear, "idx").groupBy("block_id").agg(F.sum(F.col("weight") * F.col("_w")).alias("_sum"))
        scores = scaled.join(sums, "block_id", "left").select(
            "block_id", (F.coalesce("_sum", F.lit(0.0)) + meta).alias("score_sample"))
    scores = stage(scores.withColumnRenamed("block_id", "_sequence"), "sequence_scores")
    return skew_join(keyed, scores, "_sequence", "id", "inner").drop("_sequence")


@dataclass(frozen=True)
class JoinedScorer:
    """A model whose vocabulary is too large to be sent; ``detector`` is None for a linear machine."""

    model: Model
    detector: Detector | None
    offset: float


def load_scorer(model: Model, shared_terms: int = SHARED_TERMS) -> SequenceScorer | JoinedScorer:
    """A model made ready for scoring. Up to ``shared_terms`` terms the vocabulary is sent to the tasks, else joined."""
    if model.vocabulary.count() <= shared_terms:
        return SequenceScorer.load(model)
    if model.machine is not None:
        head = model.machine.select("kernel", (F.col("rho") - F.col("slack")).alias("offset")).first()
        if head["kernel"] == "linear":
            return JoinedScorer(model, None, head["offset"])
    detector = Detector.load(model)
    return JoinedScorer(model, detector, detector.offset)


def score_histories(df: DataFrame, model: Model | SequenceScorer | JoinedScorer) -> DataFrame:
    """Score rows that carry their history: sequence, its counts, score and flag.

    ``model`` may be what ``load_scorer`` has made ready, so that a stream does so once. A history without
    a template counts as the one empty token.
    """
    scorer = load_scorer(model) if isinstance(model, Model) else model
    if isinstance(scorer, SequenceScorer):
        offset, scored = scorer.detector.offset, _score_shared(df, scorer)
    else:
        offset, scored = scorer.offset, _score_joined(df, scorer.model, scorer.detector)
    empty = F.size("tokens") == 0
    return scored.select(
        *[c for c in df.columns if c not in ("tokens", "templates")],
        F.when(empty, seq.EMPTY_TOKEN).otherwise(F.array_join("tokens", " ")).alias("sequence"),
        F.greatest(F.size("tokens"), F.lit(1)).alias("seq_len"),
        F.greatest(F.size(F.array_distinct("templates")), F.lit(1)).alias("unique_templates"),
        (F.col("score_sample") - F.lit(offset)).alias("score"),
        (F.col("score_sample") < F.lit(offset)).alias("is_anomaly"),
    )


def score_logs(logs: DataFrame, model: Model, split_rows: int = SPLIT_ROWS, shared_terms: int = SHARED_TERMS) -> DataFrame:
    """Parse, look back, build features and score every log."""
    enriched = stage(enrich_logs(logs, model.templates, split_rows), "enriched")
    return score_histories(block_history(enriched, split_rows=split_rows), load_scorer(model, shared_terms))


def flag_logs(logs: DataFrame, model: Model, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The anomalous logs with their scores.

    Few logs are flagged, so only what scoring needs is shuffled by block; the
    messages are attached to the flagged logs afterwards.
    """
    enriched = stage(enrich_logs(logs, model.templates, split_rows), "enriched")
    narrow = enriched.select("id", "timestamp", "template_id", "block_id", "blocks")
    scored = score_histories(block_history(narrow, split_rows=split_rows), model)
    flagged = scored.where("is_anomaly").select(
        "id", "sequence", "seq_len", "unique_templates", "score", "is_anomaly"
    )
    return enriched.join(flagged, "id")


def incident_gate(scored: DataFrame, model: Model | None = None) -> DataFrame:
    """Logs that open an incident; logs without a score are scored first."""
    if "is_anomaly" in scored.columns:
        return scored.where("is_anomaly")
    if model is None:
        raise ValueError("logs without a score need a model")
    return flag_logs(scored, model)
