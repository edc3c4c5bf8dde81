"""Train the detector and compare settings on labelled blocks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, functions as F

from opslog.operators import evaluate, features as feat, iforest, ocsvm, sequences as sq
from opslog.operators.templates import enrich_logs, mine_templates
from opslog.session import stage
from opslog.sources.models import Model

# The grid and the names in its results.
VECTORIZERS = (("TFIDF-Unigram", 1), ("TFIDF-Bigram", 2), ("TFIDF-Trigram", 3))
CONTAMINATIONS = (0.015, 0.02, 0.025, 0.03, 0.035)
FOREST, MACHINE = "IsolationForest", "OC-SVM ({})"
FOREST_SETTING, MACHINE_SETTING = "cont={}", "nu={}"


@dataclass
class Fitted:
    """Features of one vectorizer with what it takes to make them again."""

    vocabulary: DataFrame
    scaler: DataFrame
    features: DataFrame
    n_features: int


def fit_features(terms: DataFrame, stats: DataFrame, ngram_max: int = 1) -> Fitted:
    """Vocabulary, scaler and feature vectors of the blocks that ``terms`` counts.

    ``terms`` may hold longer n-grams than wanted, so that several vectorizers
    share one pass over the logs.
    """
    terms = terms.where(F.size(F.split("term", " ")) <= ngram_max)
    vocabulary = stage(feat.tfidf_fit(terms, stats), "vocabulary")
    scaler = stage(feat.scaler_fit(stats), "scaler")
    n_terms = vocabulary.count()
    vectors = feat.assemble_features(
        feat.tfidf_transform(terms, vocabulary), feat.scaler_transform(stats, scaler), n_terms
    )
    return Fitted(vocabulary, scaler, stage(vectors, "features"), n_terms + len(feat.META))


def count_terms(tokens: DataFrame, ngram_max: int = 1) -> tuple[DataFrame, DataFrame]:
    """Terms per block, stored, and the block statistics that follow from them."""
    terms = stage(sq.block_terms(tokens, ngram_max), "terms")
    return terms, stage(sq.stats_of(terms), "stats")


def fit_forest(fitted: Fitted, seed: int = iforest.SEED) -> tuple[DataFrame, DataFrame]:
    """Forest nodes and the scores of the training rows."""
    nodes = stage(iforest.iforest_fit(fitted.features, fitted.n_features, seed=seed), "forest")
    return nodes, stage(iforest.iforest_score(fitted.features, nodes).select("block_id", "score_sample"), "scores")


def train_model(logs: DataFrame, contamination: float = iforest.CONTAMINATION, ngram_max: int = 1,
                catalog: DataFrame | None = None, seed: int = iforest.SEED) -> Model:
    """Mine templates, build block features and fit the forest. No labels are used."""
    catalog = stage(mine_templates(logs), "catalog") if catalog is None else catalog
    tokens = sq.block_tokens(enrich_logs(logs, catalog))
    fitted = fit_features(*count_terms(tokens, ngram_max), ngram_max)
    nodes, scores = fit_forest(fitted, seed)
    offset = iforest.iforest_offsets(scores, [contamination])[0]
    return Model(catalog, fitted.vocabulary, fitted.scaler, nodes.withColumn("offset", F.lit(offset)))


@dataclass
class GridResult:
    """One row per setting, and the fitted models behind them."""

    results: DataFrame
    models: dict = field(default_factory=dict)

    def leaderboard(self, top: int | None = None) -> DataFrame:
        return evaluate.leaderboard(self.results, top)

    def best(self) -> tuple[Row, Model]:
        """The winning row, by unrounded values, and its model of either kind, ready to be saved.

        A grid that was given no catalogue yields a model without one.
        """
        row = self.leaderboard(1).first()
        return row, self.models[row["config"]]


def grid_search(tokens: DataFrame, labels: DataFrame, catalog: DataFrame | None = None,
                vectorizers=VECTORIZERS, contaminations=CONTAMINATIONS, nus=ocsvm.NUS,
                kernels=ocsvm.KERNELS) -> GridResult:
    """Fit every setting on the labelled blocks and score it on the same blocks.

    The contamination only moves the threshold, so there is one forest per
    vectorizer; all one-class models of a vectorizer share their passes. The
    vectorizers share one count of terms and run side by side, so that the
    small steps of one fill the gaps of another. All predictions are scored by
    one aggregation.
    """
    spark = tokens.sparkSession
    population = tokens.join(labels.select("block_id").distinct(), "block_id", "left_semi")
    terms, stats = count_terms(population, max(n for _, n in vectorizers))
    per_vectorizer = len(contaminations) + len(nus) * len(kernels)

    def fit(place: int):
        vectorizer, ngram_max = vectorizers[place]
        config = place * per_vectorizer
        fitted = fit_features(terms, stats, ngram_max)
        names, fits, thresholds, machines, made = [], {}, [], [], []
        if contaminations:
            nodes, scores = fit_forest(fitted)
            for contamination, offset in zip(contaminations, iforest.iforest_offsets(scores, list(contaminations))):
                names.append((config, FOREST, vectorizer, FOREST_SETTING.format(contamination)))
                fits[config] = Model(catalog, fitted.vocabulary, fitted.scaler, nodes.withColumn("offset", F.lit(offset)))
                thresholds.append(F.struct(F.lit(config).alias("config"), F.lit(offset).alias("offset")))
                config += 1
            made.append(scores.select("block_id", "score_sample", F.inline(F.array(*thresholds))).select(
                "config", "block_id", (F.col("score_sample") < F.col("offset")).cast("int").alias("pred")))
        if nus and kernels:
            machine = ocsvm.ocsvm_fit(fitted.features, fitted.n_features, nus, kernels)
            for nu in nus:
                for kernel in kernels:
                    names.append((config, MACHINE.format(kernel), vectorizer, MACHINE_SETTING.format(nu)))
                    fits[config] = Model(catalog, fitted.vocabulary, fitted.scaler,
                                         machine=ocsvm.machine_table(spark, machine[kernel, nu]))
                    machines.append(F.when((F.col("kernel") == kernel) & (F.col("nu") == nu), config))
                    config += 1
            predicted = ocsvm.ocsvm_predict(fitted.features, machine)
            made.append(predicted.select(F.coalesce(*machines).alias("config"), "block_id", "pred"))
        return names, fits, made

    with ThreadPool(len(vectorizers)) as pool:
        parts = pool.map(inheritable_thread_target(spark)(fit), range(len(vectorizers)))
    predictions = reduce(DataFrame.unionByName, [df for _, _, made in parts for df in made])
    judged = sq.label_blocks(predictions, labels.select("block_id", "true_label"))
    metrics = stage(evaluate.classification_metrics(judged, ["config"]), "metrics")
    settings = spark.createDataFrame(
        [name for names, _, _ in parts for name in names], "config int, model string, vectorizer string, param string"
    )
    return GridResult(settings.join(metrics, "config"), {c: m for _, fits, _ in parts for c, m in fits.items()})


def train_best(logs: DataFrame, labels: DataFrame, catalog: DataFrame | None = None, **grid) -> tuple[Row, Model]:
    """From logs and block labels to the best model of the grid: mine, enrich, search. The row names its setting."""
    catalog = stage(mine_templates(logs), "catalog") if catalog is None else catalog
    tokens = stage(sq.block_tokens(enrich_logs(logs, catalog)), "tokens")
    return grid_search(tokens, labels, catalog, **grid).best()
