"""Folds, bounded samples of labelled rows and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null without a key."""
    return F.crc32(F.col(key).cast("string")) % parts


def one_row(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of each key: that of the smallest hash of its other columns. Equal rows are one anyway."""
    others = [F.col(c) for c in rows.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*others), F.xxhash64(F.lit(1), *others))
    return rows.withColumn("_row", F.row_number().over(order)).where(F.col("_row") == 1).drop("_row")


def sample(docs: DataFrame, labels: DataFrame, key: str, label: str, bound: int) -> DataFrame:
    """At most ``bound`` documents with their label, the same ones at every run.

    Keys are taken in the order of their hash, so the sample is spread evenly. A key with several
    labels takes the greatest, a key on several rows gives one of them. The chosen keys are at most ``bound``
    rows and may be broadcast.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(
        F.max(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(bound)
    return one_row(docs.join(F.broadcast(chosen), key), key)


def sample_each(docs: DataFrame, key: str, label: str, bound: int, labels: int) -> DataFrame:
    """At most ``bound`` documents of each of the ``labels`` labels, by the order of the keys' hash.

    A key on several rows of a label gives one of them. The chosen keys are broadcast up to a million, and
    joined by a shuffle beyond.
    """
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    chosen = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        key, label, F.row_number().over(order).alias("_row")).where(F.col("_row") <= bound).select(key, label).distinct()
    return one_row(docs.join(F.broadcast(chosen) if bound * labels <= 1_000_000 else chosen, [key, label]), key, label)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
