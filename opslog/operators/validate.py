"""Checks on records before they are stored, and on page bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslog.schema import (
    LOG_LEVELS, MAX_CATEGORY, MAX_HOST, MAX_INCIDENT_PAGE, MAX_LOG_PAGE, MAX_TITLE,
)


def _length_between(col: str, low: int, high: int | None = None) -> Column:
    size = F.length(col)
    ok = size >= low
    if high is not None:
        ok = ok & (size <= high)
    return F.coalesce(ok, F.lit(False))


def _split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    names = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    checked = df.withColumn("reason", F.concat_ws(",", *names))
    return checked.where(F.col("reason") == "").drop("reason"), checked.where(F.col("reason") != "")


def validate_logs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected log records; rejected ones name the failing fields."""
    return _split(df, {
        "source_host": _length_between("source_host", 1, MAX_HOST),
        "log_level": F.coalesce(F.col("log_level").isin(*LOG_LEVELS), F.lit(False)),
        "raw_message": _length_between("raw_message", 1),
    })


def validate_runbooks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, {
        "title": _length_between("title", 1, MAX_TITLE),
        "category": _length_between("category", 1, MAX_CATEGORY),
        "content": _length_between("content", 1),
    })


def check_page(limit: int, offset: int = 0, max_limit: int = MAX_LOG_PAGE) -> None:
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def check_incident_page(limit: int) -> None:
    check_page(limit, 0, MAX_INCIDENT_PAGE)
