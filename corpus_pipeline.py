"""The corpus pipeline: five filtering and encoding stages over ``documents``.

Every stage takes all rows its predecessor kept and returns the columns of ``documents``, the last one
the digests of the encoded texts. ``run`` writes each stage's rows to the shared folder and reads
them back, so a lost executor never goes back more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslog.llm import decontaminate, neardup, queries, substrings, toxicity
from opslog.session import stage


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the keys in ``gone``. They are written first, so that Spark knows their size."""
    return docs.join(stage(gone.select("doc_id").distinct(), name), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go; a null or empty text stays."""
    labels = queries.table(spark, sf_dir, "labels").where(~queries.held_out(4, 2))
    scored = toxicity.score(docs, toxicity.learn(docs, labels), carry=tuple(docs.columns))
    return scored.where(F.col("score") < queries.TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Shingles have five words, the similarity is 0.8 or more. Rows without an id stay.
    """
    found = neardup.near_duplicates(docs)
    return without(docs, found.where(~F.col("kept")), "duplicates")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 that also starts earlier go; every document stays.

    Words are then one space apart and ``n_chars`` is that of the new text; a null text stays null.
    """
    cut = substrings.remove_repeats(docs, carry=tuple(docs.columns))
    kept = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return cut.select(*(
        kept.alias(c) if c == "text" else F.char_length(kept).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.{c}") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go."""
    return without(docs, decontaminate.find_leaks(docs, queries.table(spark, sf_dir, "benchmark")), "leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    return queries.digest_tokens(docs, staged=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the trained field nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, name)
    return docs
