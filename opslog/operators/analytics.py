"""Volume charts and the health summary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from opslog.functions.times import bucket_label, window_start


def since(df: DataFrame, column: str, start: datetime) -> DataFrame:
    """Rows from ``start`` on; a table stored by date reads only the dates it needs."""
    if "dt" in df.columns:
        df = df.where(F.col("dt") >= F.lit(start.date()))
    return df.where(F.col(column) >= F.lit(start))


def _volume(df: DataFrame, column: str, start: datetime, grain: str) -> DataFrame:
    return (
        since(df, column, start)
        .groupBy(F.date_trunc(grain, column).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def log_volume(logs: DataFrame, start: datetime, grain: str) -> DataFrame:
    """Logs per bucket from ``start`` on, with no upper bound and no filled gaps."""
    return _volume(logs, "timestamp", start, grain).orderBy("bucket")


def incident_volume(incidents: DataFrame, start: datetime, grain: str) -> DataFrame:
    return _volume(incidents, "created_at", start, grain).orderBy("bucket")


def volume_chart(logs: DataFrame, incidents: DataFrame, timeframe: str, now: datetime) -> DataFrame:
    """Normal logs and anomalies per bucket.

    Both sides are reduced to buckets before the join. Buckets with incidents
    but no logs are left out; the number of normal logs never falls below 0.
    """
    start, grain = window_start(timeframe, now)
    seen = _volume(logs, "timestamp", start, grain)
    flagged = _volume(incidents, "created_at", start, grain).withColumnRenamed("n", "anomalies")
    anomalies = F.coalesce("anomalies", F.lit(0))
    return (
        seen.join(flagged, "bucket", "left").orderBy("bucket")
        .select(
            bucket_label(F.col("bucket")).alias("timestamp"),
            F.greatest(F.col("n") - anomalies, F.lit(0)).alias("normal_logs"),
            anomalies.alias("anomalies"),
        )
    )


def open_critical_count(incidents: DataFrame) -> DataFrame:
    return incidents.agg(_open_critical().alias("open_critical_incidents"))


def anomaly_count(incidents: DataFrame, start: datetime) -> DataFrame:
    return since(incidents, "created_at", start).agg(F.count("*").alias("total_anomalies"))


def log_count(logs: DataFrame, start: datetime) -> DataFrame:
    return since(logs, "timestamp", start).agg(F.count("*").alias("total_logs"))


def _open_critical():
    return F.count_if((F.col("status") == "OPEN") & (F.col("severity") == "CRITICAL"))


def summary(logs: DataFrame, incidents: DataFrame, now: datetime, rate_divisor: int = 3600,
            critical_weight: float = 0.8, anomaly_weight: float = 0.2) -> DataFrame:
    """One row of health figures over the last 24 hours.

    Incidents are read once for both of their counts; the log count is a scalar
    subquery beside them. The rate rounds half to even.
    """
    start = now - timedelta(days=1)
    counts = incidents.agg(
        _open_critical().alias("critical"),
        F.count_if(F.col("created_at") >= F.lit(start)).alias("anomalies"),
    ).withColumn("logs", log_count(logs, start).scalar())
    health = F.greatest(
        F.lit(0.0), 100.0 - F.col("critical") * critical_weight - F.col("anomalies") * anomaly_weight
    )
    return counts.select(
        F.greatest(F.lit(0), F.bround(F.col("logs") / rate_divisor, 0).cast("long")).alias("ingestion_rate_per_sec"),
        F.round(health, 1).alias("system_health_percentage"),
        F.col("anomalies").alias("total_anomalies_today"),
        F.col("critical").alias("open_critical_incidents"),
    )
