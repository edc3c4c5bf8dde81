"""Stored tables: logs by date, incidents, runbooks and vectors."""

from __future__ import annotations

import re
import uuid
from datetime import date
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from opslog.operators.vectors import hashed_bag, index_runbooks
from opslog.schema import INCIDENTS, LOGS, RUNBOOKS, VECTORS


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; an absent one is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs with their date ``dt``; a filter on it prunes the folders."""
    parts = [T.StructField("dt", T.DateType()), T.StructField("batch_id", T.LongType())]
    return load_table(spark, path, T.StructType([*LOGS.fields, *parts])).drop("batch_id")


def load_incidents(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, INCIDENTS)


def load_runbooks(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, RUNBOOKS)


def stored_dates(logs: DataFrame) -> list[date]:
    """The dates of logs as loaded, from the names of their folders; no file is opened."""
    found = {re.search(r"/dt=(\d{4}-\d\d-\d\d)/", f) for f in logs.inputFiles()}
    return sorted({date.fromisoformat(m[1]) for m in found if m})


VERSIONED = T.StructType([*VECTORS.fields, T.StructField("version", T.LongType())])
# Folders below the table; Spark passes over them when it reads the table.
COMPACTED, CURRENT = "_compacted", "_compacted/current"


def _latest(stored: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("embedding", "version"), "version").alias("last")
    return stored.groupBy("runbook_id").agg(last).select("runbook_id", "last.embedding", "last.version")


def _compaction(spark: SparkSession, path: str) -> tuple[DataFrame, set[str]]:
    """The rows of the latest compaction and the files it covers; none and no files without one."""
    pointers = load_table(spark, f"{path}/{CURRENT}", T.StructType(
        [T.StructField("number", T.LongType()), T.StructField("folder", T.StringType())]))
    last = pointers.orderBy(F.desc("number"), "folder").first()
    if last is None:
        return spark.createDataFrame([], VERSIONED), set()
    base = f"{path}/{COMPACTED}/{last.folder}"
    covered = {r.file for r in spark.read.schema("file string").parquet(f"{base}/files").collect()}
    return spark.read.schema(VERSIONED).parquet(f"{base}/vectors"), covered


def _versions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Compacted rows, the rows stored since (``None`` without any), and all files of the table."""
    compacted, covered = _compaction(spark, path)
    files = load_table(spark, path, VERSIONED).inputFiles()
    fresh = [unquote(f) for f in files if f not in covered]
    return compacted, spark.read.schema(VERSIONED).parquet(*fresh) if fresh else None, files


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The latest vector of each runbook; an absent table is empty.

    Right after ``compact_vectors`` this is a plain scan; only vectors stored since then are grouped
    with the compacted ones.
    """
    compacted, fresh, _ = _versions(spark, path)
    return (compacted if fresh is None else _latest(compacted.unionByName(fresh))).select("runbook_id", "embedding")


def compact_vectors(spark: SparkSession, path: str) -> None:
    """Keep one row a runbook beside the table, so that reading needs no grouping.

    It covers the files there are when it begins; vectors stored meanwhile stay fresh. Rows and the list of covered files are
    written to a new folder first; a pointer of one row, the last write, makes them current, so a reader
    sees the state before or after. Without new files nothing is written.
    """
    compacted, fresh, files = _versions(spark, path)
    if fresh is None:
        return
    folder = uuid.uuid4().hex
    base = f"{path}/{COMPACTED}/{folder}"
    _latest(compacted.unionByName(fresh)).write.parquet(f"{base}/vectors")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{base}/files")
    number = load_table(spark, f"{path}/{CURRENT}", T.StructType([T.StructField("number", T.LongType())])).count() + 1
    spark.createDataFrame([(number, folder)], "number long, folder string").coalesce(1).write.mode("append").parquet(
        f"{path}/{CURRENT}")


def append_logs(valid: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Store validated logs without a template yet, by date.

    Rebalancing gives each date files of a useful size and splits a heavy date;
    sorting by host within them lets the scan skip row groups. Logs of a
    micro-batch lie under its number, so a repeated batch replaces its own files
    and no others.
    """
    rows = valid.select(
        "id", "timestamp", "source_host", "log_level", "raw_message",
        F.lit(None).cast("long").alias("template_id"), F.lit(None).cast("string").alias("parsed_template"),
        F.to_date("timestamp").alias("dt"), F.lit(-1 if batch_id is None else batch_id).cast("long").alias("batch_id"),
    )
    writer = rows.hint("rebalance", "dt").sortWithinPartitions("dt", "source_host", "timestamp").write
    writer = writer.mode("append") if batch_id is None else writer.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic")
    writer.partitionBy("dt", "batch_id").parquet(path)


def new_incidents(scored: DataFrame, severity, title, report, created_at) -> DataFrame:
    """Incident rows of anomalous logs, status OPEN; one log opens at most one."""
    return scored.select(
        "id", created_at.alias("created_at"), created_at.alias("updated_at"),
        severity.alias("severity"), title.alias("title"), F.lit("OPEN").alias("status"),
        F.col("id").alias("trigger_log_id"), report.alias("rca_markdown"),
    )


def append_incidents(incidents: DataFrame, path: str) -> None:
    incidents.select(*INCIDENTS.fieldNames()).write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store a micro-batch under its own number; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def save_vectors(vectors: DataFrame, path: str, version: int) -> None:
    """Append vectors under a version; reading keeps the latest one per runbook."""
    rows = vectors.select(*VECTORS.fieldNames()).withColumn("version", F.lit(version).cast("long"))
    rows.write.mode("append").parquet(path)


def append_runbooks(runbooks: DataFrame, path: str, vector_path: str, version: int, encoder=hashed_bag) -> None:
    """Store runbooks and index their vectors. Nothing stored before is rewritten."""
    names = set(runbooks.columns)
    rows = runbooks.select(*[
        F.col(f.name) if f.name in names else
        # a new runbook counts as updated when it was made
        F.col("created_at").alias(f.name) if f.name == "updated_at" and "created_at" in names else
        F.lit(None).cast(f.dataType).alias(f.name) for f in RUNBOOKS.fields
    ])
    rows.write.mode("append").parquet(path)
    save_vectors(index_runbooks(runbooks, encoder), vector_path, version)
