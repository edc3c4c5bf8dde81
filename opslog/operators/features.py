"""TF-IDF terms, scaled counts and the feature vectors of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslog.operators.ranking import ranked
from opslog.operators.skew import SPLIT_ROWS, skew_join

META = ("seq_len", "unique_templates")


def tfidf_fit(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Vocabulary with index and idf = ln((1 + n) / (1 + df)) + 1.

    ``terms`` has one row per block and term, so df is a plain count. ``n`` is
    the number of blocks, also of those without any term.
    """
    n = blocks.agg(F.count("*")).scalar()
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    counted = terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf)
    return ranked(counted, [], ["term"], "_pos").select(
        "term", (F.col("_pos") - 1).cast("int").alias("idx"), "df", "idf"
    )


def tfidf_transform(terms: DataFrame, vocabulary: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Weights (1 + ln tf) * idf, scaled to unit length per block; one row per block and term.

    Terms outside the vocabulary are ignored. A term that most blocks share is
    a hot join key and is split.
    """
    vocab = vocabulary.select("term", "idx", "idf")
    raw = skew_join(terms, vocab, "term", "block_id", "inner", split_rows).select(
        "block_id", "term", "idx", ((1.0 + F.log("tf")) * F.col("idf")).alias("raw")
    )
    norms = raw.groupBy("block_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "block_id").select(
        "block_id", "term", "idx", (F.col("raw") / F.col("norm")).alias("weight")
    )


def scaler_fit(stats: DataFrame) -> DataFrame:
    """Mean and population deviation of the two counts; a zero deviation divides by 1."""
    def scale(col):
        dev = F.stddev_pop(col)
        return F.when(dev > 0, dev).otherwise(F.lit(1.0))

    return stats.agg(*[
        f for c in META for f in (F.avg(c).alias(f"{c}_mean"), scale(c).alias(f"{c}_scale"))
    ])


def scaler_transform(stats: DataFrame, scaler: DataFrame) -> DataFrame:
    """Add the z-scores. ``scaler`` is one row; its fields come in as scalars."""
    for c in META:
        mean = scaler.select(f"{c}_mean").scalar()
        scale = scaler.select(f"{c}_scale").scalar()
        stats = stats.withColumn(f"{c}_z", (F.col(c) - mean) / scale)
    return stats


def assemble_features(weights: DataFrame, scaled: DataFrame, vocabulary_size: int) -> DataFrame:
    """Sparse vector per block as two arrays: TF-IDF weights, then the two z-scores.

    A block collects its different terms only, at most one per vocabulary entry.
    """
    vectors = weights.groupBy("block_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("entries")
    )
    empty = F.array().cast("array<struct<idx:int,weight:double>>")
    meta = F.array(*[
        F.struct(F.lit(vocabulary_size + i).alias("idx"), F.col(f"{c}_z").alias("weight"))
        for i, c in enumerate(META)
    ])
    entries = F.concat(F.coalesce("entries", empty), meta)
    return scaled.join(vectors, "block_id", "left").select(
        "block_id",
        F.transform(entries, lambda e: e["idx"]).alias("indices"),
        F.transform(entries, lambda e: e["weight"]).alias("values"),
    )
