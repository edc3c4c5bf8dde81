"""Template sequences per block: history of each log, whole sequences, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslog.functions import sequence as seq
from opslog.operators.explore import known_blocks, mentions, with_block
from opslog.operators.ranking import first_per_key, ranked
from opslog.operators.skew import SPLIT_ROWS, skew_join
from opslog.schema import HISTORY_CAP

PART_TOKENS = 1000


def first_templates(logs: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """Per block, its earliest ``cap`` templated mentions as one sorted array."""
    seen = mentions(logs.where(F.col("template_id").isNotNull())).select(
        "block_id", "timestamp", "id", "template_id", seq.template_token(F.col("template_id")).alias("token")
    )
    return (
        first_per_key(seen, ["block_id"], ["timestamp", "id"], cap)
        .groupBy("block_id")
        .agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", "template_id", "token"))).alias("first"))
    )


def with_history(rows: DataFrame) -> DataFrame:
    """Turn ``first``, the sorted earliest mentions of a row's block, into its history.

    Adds ``templates`` and ``tokens``: the entries earlier than the row, then
    its own. Nearly every row is one of the entries or later than all of them,
    so its history is a slice; only a latecomer or a row without a template is
    compared entry by entry.
    """
    first, own = F.col("first"), F.struct("timestamp", "id")
    size = F.coalesce(F.size(first), F.lit(0))
    last = F.element_at(first, -1)
    place = F.array_position(first["id"], F.col("id"))
    count = (
        F.when(first.isNull() | (size == 0), 0)
        .when(F.struct(last["timestamp"].alias("timestamp"), last["id"].alias("id")) < own, size)
        .when(place > 0, place - 1)
        .otherwise(F.size(F.filter(
            first, lambda x: F.struct(x["timestamp"].alias("timestamp"), x["id"].alias("id")) < own
        )))
    ).cast("int")
    counted = rows.withColumn("_count", count)

    def upto(field: str, kind: str, mine):
        none = F.array().cast(f"array<{kind}>")
        before = F.coalesce(F.slice(first[field], F.lit(1), F.col("_count")), none)
        return F.concat(before, F.when(F.col("template_id").isNotNull(), F.array(mine)).otherwise(none))

    return (
        counted.withColumn("templates", upto("template_id", "bigint", F.col("template_id")))
        .withColumn("tokens", upto("token", "string", seq.template_token(F.col("template_id"))))
        .drop("first", "_count")
    )


def block_history(logs: DataFrame, cap: int = HISTORY_CAP, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add to each log the templates its block had shown before, and its own.

    Only the earliest ``cap`` mentions of a block can ever be part of a history,
    so a block is reduced to one short array, and every log picks from it the
    entries that are earlier than itself. No group is larger than the cap and
    logs of a hot block are split over tasks.
    """
    owned = with_block(logs)
    return with_history(
        skew_join(owned, first_templates(logs, cap), "block_id", "id", "left", split_rows)
    )


def block_tokens(logs: DataFrame) -> DataFrame:
    """One row per log with a known block: block, time, id and template token."""
    return known_blocks(with_block(logs)).select(
        "block_id", "timestamp", "id", seq.template_token(F.col("template_id")).alias("token")
    )


def token_counts(tokens: DataFrame) -> DataFrame:
    """How often each block shows each token; counted on the map side first."""
    return tokens.where(F.col("token").isNotNull()).groupBy("block_id", "token").agg(F.count("*").alias("tf"))


def stats_of(terms: DataFrame) -> DataFrame:
    """Length and number of different templates of each block, from its term counts."""
    return terms.where(~F.col("term").contains(" ")).groupBy("block_id").agg(
        F.sum("tf").alias("seq_len"), F.count("*").alias("unique_templates")
    )


def block_stats(tokens: DataFrame) -> DataFrame:
    """Length and number of different templates of each block's sequence."""
    return stats_of(block_terms(tokens))


def _parts(tokens: DataFrame, length: int, overlap: int) -> DataFrame:
    """Consecutive parts of each block's sequence, as sorted arrays of tokens.

    A part also sees the first ``overlap`` tokens of the next one.
    """
    at = ranked(tokens.where(F.col("token").isNotNull()), ["block_id"], ["timestamp", "id"])
    part = F.floor((F.col("pos") - 1) / length)
    shared = (F.pmod(F.col("pos") - 1, F.lit(length)) < overlap) & (part > 0)
    at = at.withColumn("part", F.explode(F.when(shared, F.array(part, part - 1)).otherwise(F.array(part))))
    return at.groupBy("block_id", "part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens")
    )


def block_sequences(tokens: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """The whole sequence of each block, in parts of at most ``part_tokens``.

    Joining a block's parts in order gives its sequence. One row per block would
    gather a hot block in one task, so long sequences stay in parts.
    """
    return _parts(tokens, part_tokens, 0).select(
        "block_id", "part", F.array_join("tokens", " ").alias("sequence"), F.size("tokens").alias("n_tokens")
    )


def block_terms(tokens: DataFrame, ngram_max: int = 1, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Count of each n-gram term per block.

    Single tokens need no order, so they are counted straight away. Longer
    terms are read from overlapping parts; each part counts only the terms that
    start in it.
    """
    if ngram_max == 1:
        return token_counts(tokens).select("block_id", F.col("token").alias("term"), "tf")
    parts = _parts(tokens, part_tokens, ngram_max - 1)
    starts = F.sequence(F.lit(1), F.least(F.size("tokens"), F.lit(part_tokens)))
    sizes = F.array(*[F.lit(n) for n in range(1, ngram_max + 1)])
    terms = F.flatten(F.transform(
        starts,
        lambda i: F.transform(
            F.filter(sizes, lambda n: i + n - 1 <= F.size("tokens")),
            lambda n: F.array_join(F.slice("tokens", i, n), " "),
        ),
    ))
    return parts.select("block_id", F.explode(terms).alias("term")).groupBy("block_id", "term").agg(
        F.count("*").alias("tf")
    )


def label_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Keep labelled blocks; several labels of a block multiply its rows."""
    return blocks.join(labels, "block_id", "inner")


def eval_population(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum("true_label"), F.lit(0)).cast("long").alias("anomalies")
    )
