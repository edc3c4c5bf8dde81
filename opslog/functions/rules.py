"""Rules that classify a message: level, block, severity, title."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Words and patterns the rules look for, and the texts they yield.
BLOCK_PATTERN = "(blk_-?[0-9]+)"
STRICT_ERROR_WORDS = ("ERROR", "FATAL")
STRICT_WARN_WORDS = ("WARN",)
LOOSE_ERROR_WORDS = ("ERROR", "FAIL", "EXCEPTION")
LOOSE_WARN_WORDS = ("WARN", "SLOW")
CRITICAL_WORDS = ("fatal", "connection")
HIGH_WORDS = ("error",)
POOL_WORDS = ("connection", "slot")
POOL_TITLE = "PostgreSQL Connection Pool Exhaustion"
ANOMALY_LABEL = "Anomaly"
PLACEHOLDER_MARK = "FAISS-backed RAG retrieval"


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def _level(upper: Column, errors: tuple[str, ...], warns: tuple[str, ...]) -> Column:
    return (
        F.when(contains_any(upper, errors), "ERROR")
        .when(contains_any(upper, warns), "WARN")
        .otherwise("INFO")
    )


def level_strict(message: Column) -> Column:
    """Level of a replayed line."""
    return _level(F.upper(message), STRICT_ERROR_WORDS, STRICT_WARN_WORDS)


def level_loose(message: Column) -> Column:
    """Level of a tailed line: also reads failures and slowness; NULL is INFO."""
    return _level(F.upper(F.coalesce(message, F.lit(""))), LOOSE_ERROR_WORDS, LOOSE_WARN_WORDS)


def extract_block_id(message: Column) -> Column:
    """First block id in the message, or NULL."""
    return F.nullif(F.regexp_extract(message, BLOCK_PATTERN, 1), F.lit(""))


def block_mentions(message: Column) -> Column:
    """Every different block id in the message, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(message, F.lit(BLOCK_PATTERN), F.lit(1)))


def classify_severity(message: Column) -> Column:
    lower = F.lower(message)
    return (
        F.when(contains_any(lower, CRITICAL_WORDS), "CRITICAL")
        .when(contains_any(lower, HIGH_WORDS), "HIGH")
        .otherwise("MEDIUM")
    )


def incident_title(level: Column, host: Column, message: Column) -> Column:
    return F.when(contains_any(F.lower(message), POOL_WORDS), POOL_TITLE).otherwise(
        F.concat(level, F.lit(" anomaly from "), host)
    )


def label_to_int(label: Column) -> Column:
    return F.when(label == ANOMALY_LABEL, 1).otherwise(0)


def needs_rca(report: Column) -> Column:
    """True where a report is still missing or is the placeholder."""
    return report.isNull() | (report == "") | report.contains(PLACEHOLDER_MARK)
