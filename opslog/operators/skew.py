"""Equi-joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SPLIT_ROWS = 1_000_000
MAX_HOT = 10_000
NULL_SPREAD = 1024


def hot_of(counts: DataFrame, key: str, n: str, split_rows: int = SPLIT_ROWS,
           max_hot: int = MAX_HOT) -> DataFrame:
    """Keys counted at more than ``split_rows`` rows and into how many parts to split them.

    At most ``max_hot`` rows, the largest keys first, so the table may be broadcast.
    """
    return (
        counts.where(F.col(n) > split_rows).orderBy(F.desc(n), key).limit(max_hot)
        .select(key, F.ceil(F.col(n) / split_rows).cast("int").alias("_splits"))
    )


def hot_keys(df: DataFrame, key: str, split_rows: int = SPLIT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """The hot keys of ``df``; counting combines on the map side."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return hot_of(counts, key, "_n", split_rows, max_hot)


def skew_join(big: DataFrame, small: DataFrame, key: str, row_id: str, how: str = "left",
              split_rows: int = SPLIT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to ``small``, which holds few rows per key.

    Hot keys of ``big`` are split by a hash of ``row_id`` and only their rows in
    ``small`` are repeated per part. Rows without a key are spread too, since a
    left join would send them all to one task. The hash makes a repeated task
    give the same rows. Whether a side is small enough to broadcast is left to
    Spark's own size check.
    """
    hot = F.broadcast(hot_keys(big, key, split_rows) if hot is None else hot)
    spread = F.pmod(F.xxhash64(row_id, F.lit(17)), F.coalesce("_splits", F.lit(1)))
    left = big.join(hot, key, "left").withColumn(
        "_part",
        F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(NULL_SPREAD))).otherwise(spread).cast("int"),
    ).drop("_splits")
    right = small.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
    ).drop("_splits")
    return left.join(right, [key, "_part"], how).drop("_part")
