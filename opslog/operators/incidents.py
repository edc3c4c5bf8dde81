"""Incidents: detail view, status changes, missing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslog.functions import rules
from opslog.operators.explore import by_ids


def trigger_logs(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """The logs that opened an incident.

    A left join would shuffle the whole log table with its messages. The
    semi-join keeps the few needed rows first: Spark sends the ids to the scan
    when they are small and filters by them at run time when they are not.
    """
    ids = incidents.where(F.col("trigger_log_id").isNotNull()).select(F.col("trigger_log_id").alias("id"))
    return by_ids(logs, ids)


def join_triggers(incidents: DataFrame, trigger: DataFrame) -> DataFrame:
    """Left join on ``trigger_log_id``; incidents without one bypass it, or one task would get them all."""
    has = F.col("trigger_log_id").isNotNull()
    joined = incidents.where(has).join(trigger, "trigger_log_id", "left")
    return joined.unionByName(incidents.where(~has), allowMissingColumns=True)


def incident_detail(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """Each incident with its trigger log as a struct, NULL where there is none."""
    trigger = trigger_logs(incidents, logs).select(
        F.col("id").alias("trigger_log_id"),
        F.struct("id", "raw_message", "source_host").alias("trigger_log"),
    )
    return join_triggers(incidents, trigger)


def needs_rca(incidents: DataFrame) -> DataFrame:
    return incidents.where(rules.needs_rca(F.col("rca_markdown")))


def latest_status(updates: DataFrame) -> DataFrame:
    """Last write per incident; equal times are decided by the status text.

    ``max`` of a struct combines on the map side, so an incident with very many
    updates sends one row per task.
    """
    return (
        updates.groupBy("incident_id").agg(F.max(F.struct("ts", "status")).alias("last"))
        .select("incident_id", F.col("last.status").alias("status"), F.col("last.ts").alias("ts"))
    )


def update_status(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """The incidents table after the updates."""
    last = latest_status(updates).select(
        F.col("incident_id").alias("id"), F.col("status").alias("_status"), F.col("ts").alias("_ts")
    )
    return incidents.join(last, "id", "left").select(*[
        F.coalesce("_status", "status").alias("status") if c == "status"
        else F.coalesce("_ts", "updated_at").alias("updated_at") if c == "updated_at"
        else F.col(c)
        for c in incidents.columns
    ])


def unknown_updates(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose incident does not exist."""
    ids = incidents.select(F.col("id").alias("incident_id"))
    return updates.join(ids, "incident_id", "left_anti")


def replace_reports(incidents: DataFrame, reports: DataFrame) -> DataFrame:
    """Put new reports in place; incidents without a new one keep theirs."""
    fresh = reports.select("id", F.col("rca_markdown").alias("_new"))
    return incidents.join(fresh, "id", "left").select(*[
        F.coalesce("_new", c).alias(c) if c == "rca_markdown" else F.col(c) for c in incidents.columns
    ])
