"""Positions and quantiles in sorted data without one task per key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opslog.session import stage

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "pos",
           partitions: int | None = None) -> DataFrame:
    """Add the 1-based position of each row within ``keys``, sorted by ``order``.

    ``order`` must make rows of a key unique. Rows are split by range over keys
    *and* order, so a key with a third of all rows spreads over many tasks. Each
    task numbers its own rows; a small table of how many rows of a key came in
    earlier ranges turns that into positions. The sorted rows are staged because
    the range bounds come from a sample and must not be drawn twice.
    """
    cols = [*keys, *order]
    spread = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    numbered = stage(
        spread.sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_range", F.shiftright("_at", ROW_BITS))
    ranges = numbered.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        *keys, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    if not keys:
        ranges = F.broadcast(ranges)  # one row per range partition
    out = numbered.join(ranges, [*keys, "_range"])
    position = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return out.select(*df.columns, position.alias(name))


def quantiles(df: DataFrame, value: str, key: str, probs: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation, one per probability.

    The values are ranked by range; only the two neighbours of each quantile
    reach the driver.
    """
    rows = ranked(df.select(key, value), [], [value, key])
    total = rows.count()
    if total == 0:
        raise ValueError("no rows to take a quantile of")
    spots = [q * (total - 1) for q in probs]
    wanted = sorted({math.floor(s) + 1 for s in spots} | {math.ceil(s) + 1 for s in spots})
    found = {r["pos"]: r[value] for r in rows.where(F.col("pos").isin(wanted)).collect()}
    out = []
    for spot in spots:
        low, high = found[math.floor(spot) + 1], found[math.ceil(spot) + 1]
        out.append(low + (high - low) * (spot - math.floor(spot)))
    return out


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column], n: int,
                  groups: int = 64) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark limits each key inside every map task before the shuffle. Merging in
    two steps keeps a hot key's last task at ``n * groups`` rows, however many
    map tasks held it.
    """
    salted = df.withColumn("_group", F.spark_partition_id() % groups)
    near = W.partitionBy(*keys, "_group").orderBy(*order)
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= n).drop("_group")
        .withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= n).drop("_rn")
    )


def top_k_per_query(df: DataFrame, query: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows of each query with their rank."""
    window = W.partitionBy(query).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
