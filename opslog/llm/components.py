"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslog.session import stage

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a vertex is linked to the smallest vertex around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``vertex``, ``component`` for every vertex of ``links`` (columns ``a``, ``b``).

    The component is its smallest vertex. Minima combine before the shuffle and the joins may be
    split, so a vertex with very many links is no single task. Nothing but a count and a checksum
    reaches the driver; every round is written to the shared folder. Loops, repeated links and
    links with a null end are dropped; an empty table gives an empty table.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    before = _state(edges)
    for _ in range(ROUNDS):
        edges = stage(_small(_large(edges)).distinct(), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    leaf = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return leaf.union(edges.select("b", "b").distinct())
