"""Time expressions: chart windows, bucket labels, ISO text."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# How far each chart looks back and the size of its buckets.
WINDOWS = {
    "1h": (timedelta(hours=1), "hour"),
    "24h": (timedelta(hours=24), "hour"),
    "7d": (timedelta(days=7), "day"),
}


def window_start(timeframe: str, now: datetime) -> tuple[datetime, str]:
    """Start of a chart's window and its grain; the start is not truncated."""
    if timeframe not in WINDOWS:
        raise ValueError(f"timeframe must be one of {', '.join(WINDOWS)}")
    back, grain = WINDOWS[timeframe]
    return now - back, grain


def bucket_label(bucket: Column) -> Column:
    return F.coalesce(F.date_format(bucket, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))


def iso_format(ts: Column) -> Column:
    """ISO text; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(full)
