"""Log explorer, incident and runbook lists, lookups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from opslog.functions import rules
from opslog.operators.validate import check_incident_page, check_page


def log_entry(logs: DataFrame) -> DataFrame:
    return logs.select(
        "id", "timestamp", "source_host", "log_level", "raw_message", "template_id", "parsed_template"
    )


def incident_summary(incidents: DataFrame) -> DataFrame:
    return incidents.select("id", "created_at", "severity", "title", "status", "trigger_log_id")


def runbook_record(runbooks: DataFrame) -> DataFrame:
    return runbooks.select("id", "title", "category", "content", "created_at")


def runbook_summary(runbooks: DataFrame) -> DataFrame:
    return runbooks.select("id", "title", "category", "created_at")


def matching_logs(logs: DataFrame, level: str | None = None, source: str | None = None,
                  search: str | None = None) -> DataFrame:
    """Logs that pass the filters. An empty filter is no filter; equality filters reach the file scan."""
    if level:
        logs = logs.where(F.col("log_level") == level)
    if source:
        logs = logs.where(F.col("source_host") == source)
    if search:
        pattern = f"%{search}%"
        logs = logs.where(F.col("raw_message").ilike(pattern) | F.col("parsed_template").ilike(pattern))
    return logs


def explore_logs(logs: DataFrame, level: str | None = None, source: str | None = None,
                 search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of logs, newest first. An empty filter is no filter.

    ``%`` and ``_`` in ``search`` keep their wildcard meaning. The filters come
    before the limit, so equality filters reach the file scan.
    """
    check_page(limit, offset)
    logs = matching_logs(logs, level, source, search)
    return log_entry(logs).orderBy(F.desc("timestamp"), F.desc("id")).offset(offset).limit(limit)


def explore_stored(logs: DataFrame, dates: list[date], level: str | None = None, source: str | None = None,
                   search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The same page of logs stored by date (``dt``), from the newest dates that fill it.

    ``dates`` are those of the table (``tables.stored_dates``). Matches are counted in the newest date,
    then in the two before it, the four before those and so on, until the page is full; the page is then
    read from these folders alone. A page that is never full reads the whole table.
    """
    check_page(limit, offset)
    newest, done, some, found = sorted(dates, reverse=True), 0, 1, 0
    pages = matching_logs(logs, level, source, search)
    while done + some < len(newest):
        days = F.col("dt") >= F.lit(newest[done + some - 1])
        if done:
            days = days & (F.col("dt") < F.lit(newest[done - 1]))
        found += pages.where(days).count()
        done, some = done + some, some * 2
        if found >= offset + limit:
            logs = logs.where(F.col("dt") >= F.lit(newest[done - 1]))
            break
    return explore_logs(logs, level, source, search, limit, offset)


def list_incidents(incidents: DataFrame, status: str | None = None, severity: str | None = None,
                   limit: int = 20) -> DataFrame:
    check_incident_page(limit)
    if status:
        incidents = incidents.where(F.col("status") == status)
    if severity:
        incidents = incidents.where(F.col("severity") == severity)
    return incident_summary(incidents).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def list_runbooks(runbooks: DataFrame, category: str | None = None) -> DataFrame:
    """All runbooks of a category, newest first, without their content."""
    if category:
        runbooks = runbooks.where(F.col("category") == category)
    return runbook_summary(runbooks).orderBy(F.desc("created_at"), F.desc("id"))


def known_blocks(df: DataFrame, block: str = "block_id") -> DataFrame:
    return df.where(F.col(block).isNotNull())


def by_id(df: DataFrame, record_id: int) -> DataFrame:
    """The record with this id; an empty frame means it was not found."""
    return df.where(F.col("id") == record_id)


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Batch lookup: the records whose id occurs in ``ids.id``."""
    return df.join(ids.select("id"), "id", "left_semi")


def with_block(logs: DataFrame) -> DataFrame:
    """Add the first block a log mentions, unless the table already stores it."""
    if "block_id" in logs.columns:
        return logs
    return logs.withColumn("block_id", rules.extract_block_id(F.col("raw_message")))


def with_blocks(logs: DataFrame) -> DataFrame:
    """Add all blocks a log mentions, unless the table already stores them."""
    if "blocks" in logs.columns:
        return logs
    return logs.withColumn("blocks", rules.block_mentions(F.col("raw_message")))


def mentions(logs: DataFrame) -> DataFrame:
    """One row per log and block it mentions."""
    return with_blocks(logs).drop("block_id").withColumn("block_id", F.explode("blocks")).drop("blocks")
