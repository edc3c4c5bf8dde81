"""Test tables: logs, incidents, runbooks and others made from the given tables.

Each has a DataFrame form, built with the operators, and a SQL form for the check.
The larger ones are written once per session, as the stored tables they stand for.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslog.functions import rules
from opslog.operators import templates as tpl
from opslog.session import stage

NOW = datetime(2024, 1, 30, 12, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(make):
    """Keep what ``make`` returns as a table in the shared folder, once per session.

    The given files may hold a single row group; a table that came from fewer
    partitions than there are cores is spread over them.
    """
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _stored:
            df = make(spark, sf_dir)
            cores = spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < cores:
                df = df.repartition(cores, df.columns[0])
            _stored[key] = stage(df, make.__name__)
        return _stored[key]

    return load


@stored
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per event. Users divisible by 5 share block 0, which makes it hot."""
    e = table(spark, sf_dir, "events")
    user, kind, third = F.col("user_id"), F.col("event_type"), F.col("event_id") % 3
    blk = F.concat(
        F.lit("blk_"), F.when((user % 7 == 3) & (user % 5 != 0), "-").otherwise(""),
        F.when(user % 5 == 0, 0).otherwise(user).cast("string"),
    )

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], "props")

    message = (
        F.when((kind == "error") & (third == 0),
               say("ERROR: Unable to replicate block ", blk, " connection reset by peer "))
        .when((kind == "error") & (third == 1), say("ERROR: Disk full while writing block ", blk, " "))
        .when(kind == "error", say("FATAL: no free slot for block ", blk, " "))
        .when(kind == "signup", say("WARN: Temporary response delay for block ", blk, " "))
        .when(kind == "click", say("INFO: Replication from block ", blk, " to block blk_",
                                   ((user + 1) % 150).cast("string"), " "))
        .when(kind == "purchase", say("INFO: Lease renewed after failed retry for block ", blk, " "))
        .otherwise(say("INFO: Heartbeat received slow "))
    )
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("host-"), (user % 20).cast("string")).alias("source_host"),
        message.alias("raw_message"),
    ).select(
        "id", "timestamp", "source_host", rules.level_strict(F.col("raw_message")).alias("log_level"), "raw_message",
        F.lit(None).cast("long").alias("template_id"), F.lit(None).cast("string").alias("parsed_template"),
    )


LOGS_SQL = """
b AS (SELECT event_id, ts, user_id, event_type, props,
  concat('blk_', CASE WHEN user_id % 7 = 3 AND user_id % 5 <> 0 THEN '-' ELSE '' END,
    cast(CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id END AS varchar)) AS blk FROM events),
m AS (SELECT event_id AS id, ts AS timestamp, concat('host-', cast(user_id % 20 AS varchar)) AS source_host,
  CASE WHEN event_type='error' AND event_id % 3 = 0 THEN concat('ERROR: Unable to replicate block ', blk, ' connection reset by peer ', props)
    WHEN event_type='error' AND event_id % 3 = 1 THEN concat('ERROR: Disk full while writing block ', blk, ' ', props)
    WHEN event_type='error' THEN concat('FATAL: no free slot for block ', blk, ' ', props)
    WHEN event_type='signup' THEN concat('WARN: Temporary response delay for block ', blk, ' ', props)
    WHEN event_type='click' THEN concat('INFO: Replication from block ', blk, ' to block blk_', cast((user_id + 1) % 150 AS varchar), ' ', props)
    WHEN event_type='purchase' THEN concat('INFO: Lease renewed after failed retry for block ', blk, ' ', props)
    ELSE concat('INFO: Heartbeat received slow ', props) END AS raw_message FROM b),
logs AS (SELECT id, timestamp, source_host,
  CASE WHEN upper(raw_message) LIKE '%ERROR%' OR upper(raw_message) LIKE '%FATAL%' THEN 'ERROR'
    WHEN upper(raw_message) LIKE '%WARN%' THEN 'WARN' ELSE 'INFO' END AS log_level, raw_message FROM m)"""


@stored
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per error and per seventh warning, five seconds after its log."""
    raised = logs(spark, sf_dir).where(
        (F.col("log_level") == "ERROR") | ((F.col("log_level") == "WARN") & (F.col("id") % 7 == 0))
    )
    made, msg, n = F.col("timestamp") + F.expr("INTERVAL 5 SECONDS"), F.col("raw_message"), F.col("id")
    return raised.select(
        "id", made.alias("created_at"), made.alias("updated_at"),
        rules.classify_severity(msg).alias("severity"),
        rules.incident_title(F.col("log_level"), F.col("source_host"), msg).alias("title"),
        F.when(n % 3 == 0, "OPEN").when(n % 3 == 1, "INVESTIGATING").otherwise("RESOLVED").alias("status"),
        F.when(n % 11 != 0, n).alias("trigger_log_id"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "once FAISS-backed RAG retrieval is enabled")
        .otherwise("reviewed").alias("rca_markdown"),
    )


INCIDENTS_SQL = LOGS_SQL + """,
incidents AS (SELECT id, timestamp + INTERVAL '5' SECOND AS created_at, timestamp + INTERVAL '5' SECOND AS updated_at,
  CASE WHEN lower(raw_message) LIKE '%fatal%' OR lower(raw_message) LIKE '%connection%' THEN 'CRITICAL'
    WHEN lower(raw_message) LIKE '%error%' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN lower(raw_message) LIKE '%connection%' OR lower(raw_message) LIKE '%slot%'
    THEN 'PostgreSQL Connection Pool Exhaustion' ELSE concat(log_level, ' anomaly from ', source_host) END AS title,
  CASE id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'INVESTIGATING' ELSE 'RESOLVED' END AS status,
  CASE WHEN id % 11 = 0 THEN cast(NULL AS bigint) ELSE id END AS trigger_log_id,
  CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'once FAISS-backed RAG retrieval is enabled' ELSE 'reviewed' END AS rca_markdown
  FROM logs WHERE log_level='ERROR' OR (log_level='WARN' AND id % 7 = 0))"""


@stored
def runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"),
        F.col("lang").alias("category"), F.col("text").alias("content"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id AS int), 0)")
        .alias("created_at"),
    )


RUNBOOKS_SQL = """
runbooks AS (SELECT doc_id AS id, substr(text, 1, 60) AS title, lang AS category, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("runbook_id"), "embedding")


def block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by block number, which is the digits of a block id."""
    raw = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("number"),
        F.when(F.col("toxic") == 1, rules.ANOMALY_LABEL).otherwise("Normal").alias("label"),
    )
    return raw.withColumn("true_label", rules.label_to_int(F.col("label")))


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs as requests, some of them invalid."""
    n = F.col("id")
    return logs(spark, sf_dir).select(
        "id", "timestamp",
        F.when(n % 97 == 0, "").otherwise(F.col("source_host")).alias("source_host"),
        F.when(n % 89 == 0, "DEBUG").otherwise(F.col("log_level")).alias("log_level"),
        F.when(n % 83 == 0, "").otherwise(F.col("raw_message")).alias("raw_message"),
    )


REQUESTS_SQL = LOGS_SQL + """,
requests AS (SELECT id, timestamp, CASE WHEN id % 97 = 0 THEN '' ELSE source_host END AS source_host,
  CASE WHEN id % 89 = 0 THEN 'DEBUG' ELSE log_level END AS log_level,
  CASE WHEN id % 83 = 0 THEN '' ELSE raw_message END AS raw_message FROM logs)"""


@stored
def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every incident is taken up after a minute; open ones are resolved after two. One is unknown."""
    inc = incidents(spark, sf_dir)
    taken = inc.select(
        F.col("id").alias("incident_id"), F.lit("INVESTIGATING").alias("status"),
        (F.col("created_at") + F.expr("INTERVAL 1 MINUTE")).alias("ts"),
    )
    done = inc.where(F.col("status") == "OPEN").select(
        F.col("id").alias("incident_id"), F.lit("RESOLVED").alias("status"),
        (F.col("created_at") + F.expr("INTERVAL 2 MINUTES")).alias("ts"),
    )
    stray = inc.agg(F.max("created_at").alias("ts")).select(
        F.lit(-1).cast("long").alias("incident_id"), F.lit("RESOLVED").alias("status"), "ts"
    )
    return taken.unionByName(done).unionByName(stray)


UPDATES_SQL = INCIDENTS_SQL + """,
updates AS (SELECT id AS incident_id, 'INVESTIGATING' AS status, created_at + INTERVAL '1' MINUTE AS ts FROM incidents
  UNION ALL SELECT id, 'RESOLVED', created_at + INTERVAL '2' MINUTE FROM incidents WHERE status = 'OPEN'
  UNION ALL SELECT cast(-1 AS bigint), 'RESOLVED', max(created_at) FROM incidents)"""


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: file, block_start (the document), line_no and value."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("file"), F.col("doc_id").alias("block_start"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "value"),
    )


log_lines = stored(split_lines)


def lines_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as the documents' files give them, without a copy on disk if the files have a part for every core."""
    lines = split_lines(spark, sf_dir)
    return lines if lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else log_lines(spark, sf_dir)


LINES_SQL = """
lines AS (SELECT source AS file, doc_id AS block_start, unnest(range(len(parts))) AS line_no, unnest(parts) AS value
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


@stored
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpl.template_catalog(logs(spark, sf_dir))


@stored
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs with their templates and blocks."""
    return tpl.enrich_logs(logs(spark, sf_dir), catalog(spark, sf_dir))
