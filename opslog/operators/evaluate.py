"""Quality of predictions and the comparison of model settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

METRICS = ("precision", "recall", "f1", "accuracy")


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def classification_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and accuracy of ``pred`` against ``true_label``.

    Grouping by the configuration scores all of them in one pass; a ratio
    without any case is 0.
    """
    hit, said = F.col("true_label") == 1, F.col("pred") == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"), F.count_if(~hit & ~said).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *(by or []),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def leaderboard(results: DataFrame, top: int | None = None) -> DataFrame:
    """Settings by F1, then precision, then order of the grid; shown to four digits."""
    ordered = results.orderBy(F.desc("f1"), F.desc("precision"), "config")
    if top is not None:
        ordered = ordered.limit(top)
    return ordered.select(*[
        F.round(c, 4).alias(c) if c in METRICS else F.col(c) for c in results.columns
    ])
