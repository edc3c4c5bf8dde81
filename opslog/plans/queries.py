"""Registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslog.functions import report, rules, sequence as seq, text, times
from opslog.operators import (
    analytics, evaluate, explore, features as feat, iforest, incidents as inc, ocsvm, rca, retrieve,
    scoring, sequences as sq, templates as tpl, training, validate, vectors as vec,
)
from opslog.operators.ranking import ranked
from opslog.plans import fixtures as fx, forest_sql
from opslog.session import new_path, stage
from opslog.sources import lines as ln, models, tables
from opslog.streaming import chain, history, jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW_SQL = "TIMESTAMP '2024-01-30 12:30:00'"
DAY_SQL = f"({NOW_SQL} - INTERVAL '24' HOUR)"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def ts(col: str):
    """Timestamps leave as text, so that no engine's time zone takes part."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(col)


def ts_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f') AS {col}"


def big(col, name: str):
    return (F.col(col) if isinstance(col, str) else col).cast("long").alias(name)


# --- scans, sources, sinks ------------------------------------------------

TRIM_SQL = f"trim(value, '{text.WHITESPACE}')"
CLEAN_SQL = fx.LINES_SQL + f", clean AS (SELECT file, block_start, line_no, {TRIM_SQL} AS value FROM lines)"


@query(f"WITH {CLEAN_SQL} SELECT file, block_start, cast(line_no AS bigint) AS line_no, value FROM clean WHERE length(value) > 0")
def log_lines(spark, d):
    out = ln.clean_lines(fx.log_lines(spark, d))
    return out.select("file", "block_start", big("line_no", "line_no"), "value")


@query(f"WITH {CLEAN_SQL} SELECT file, block_start, cast(line_no AS bigint) AS line_no, value FROM clean")
def log_lines_keep_blank(spark, d):
    out = ln.clean_lines(fx.log_lines(spark, d), keep_blank=True)
    return out.select("file", "block_start", big("line_no", "line_no"), "value")


@query(f"""WITH {CLEAN_SQL} SELECT file, block_start, cast(line_no AS bigint) AS line_no, value,
  row_number() OVER (ORDER BY file, block_start, line_no) AS pos FROM clean
  QUALIFY pos <= 5000""")
def head_lines(spark, d):
    lines = ln.clean_lines(fx.log_lines(spark, d), keep_blank=True)
    return ln.head_lines(lines, 5000).select("file", "block_start", big("line_no", "line_no"), "value", "pos")


@query(f"""WITH {CLEAN_SQL} SELECT row_number() OVER (ORDER BY file, block_start, line_no) AS id, 'hdfs-datanode-01' AS source_host,
  CASE WHEN upper(value) LIKE '%ERROR%' OR upper(value) LIKE '%FATAL%' THEN 'ERROR'
    WHEN upper(value) LIKE '%WARN%' THEN 'WARN' ELSE 'INFO' END AS log_level, value AS raw_message FROM clean""")
def lines_as_logs(spark, d):
    lines = ln.clean_lines(fx.log_lines(spark, d), keep_blank=True)
    return ln.lines_as_logs(lines, fx.NOW).select("id", "source_host", "log_level", "raw_message")


def line_files(spark, d):
    """The lines as text files whose names follow their order."""
    path, order = new_path(spark, "line_files"), ["file", "block_start", "line_no"]
    fx.log_lines(spark, d).withColumn("value", F.translate("value", "\r", " ")).repartitionByRange(
        16, *order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


PLAIN_SQL = CLEAN_SQL.replace("trim(value,", "trim(translate(value, chr(13), ' '),") + """,
plain AS (SELECT row_number() OVER (ORDER BY file, block_start, line_no) AS pos, value FROM clean WHERE length(value) > 0)"""


@query(f"WITH {PLAIN_SQL} SELECT pos, value FROM plain WHERE pos <= 3000")
def read_head(spark, d):
    return ln.read_head(spark, line_files(spark, d), 3000).select("pos", "value")


@query(f"""WITH {PLAIN_SQL} SELECT pos AS id, 'hdfs-datanode-01' AS source_host,
  CASE WHEN upper(value) LIKE '%ERROR%' OR upper(value) LIKE '%FATAL%' THEN 'ERROR'
    WHEN upper(value) LIKE '%WARN%' THEN 'WARN' ELSE 'INFO' END AS log_level, value AS raw_message FROM plain""")
def files_as_logs(spark, d):
    lines = ln.number_lines(ln.read_log_lines(spark, line_files(spark, d)))
    return ln.lines_as_logs(lines, fx.NOW).select("id", "source_host", "log_level", "raw_message")


@query(f"""WITH {CLEAN_SQL} SELECT 'app-server-01' AS source_host, 'app' AS service,
  CASE WHEN upper(value) LIKE '%ERROR%' OR upper(value) LIKE '%FAIL%' OR upper(value) LIKE '%EXCEPTION%' THEN 'ERROR'
    WHEN upper(value) LIKE '%WARN%' OR upper(value) LIKE '%SLOW%' THEN 'WARN' ELSE 'INFO' END AS log_level,
  value AS raw_message FROM clean WHERE length(value) > 0""")
def tail_lines(spark, d):
    return ln.tag_lines(ln.clean_lines(fx.log_lines(spark, d)))


@query("""SELECT cast(doc_id AS varchar) AS block_id, CASE WHEN toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS label,
  cast(toxic AS bigint) AS true_label FROM labels""")
def read_labels(spark, d):
    path = new_path(spark, "labels")
    fx.block_labels(spark, d).select(
        F.col("number").alias("BlockId"), F.col("label").alias("Label")
    ).write.option("header", True).csv(path)
    return ln.read_labels(spark, path).select("block_id", "label", big("true_label", "true_label"))


@query(f"""WITH {fx.REQUESTS_SQL}, ok AS (SELECT * FROM requests WHERE length(source_host) BETWEEN 1 AND 100
  AND log_level IN ('ERROR','WARN','INFO') AND length(raw_message) >= 1)
  SELECT id, {ts_sql('timestamp')}, source_host, log_level, raw_message, cast(NULL AS bigint) AS template_id,
  cast(NULL AS varchar) AS parsed_template FROM ok""")
def append_logs(spark, d):
    path = new_path(spark, "logs")
    valid, _ = validate.validate_logs(fx.ingest_requests(spark, d))
    tables.append_logs(valid, path)
    return explore.log_entry(tables.load_logs(spark, path)).withColumn("timestamp", ts("timestamp"))


@query(f"WITH {fx.INCIDENTS_SQL} SELECT id, {ts_sql('created_at')}, severity, title, status, trigger_log_id, rca_markdown FROM incidents")
def append_incidents(spark, d):
    path = new_path(spark, "incidents")
    tables.append_incidents(fx.incidents(spark, d), path)
    return tables.load_incidents(spark, path).select(
        "id", ts("created_at"), "severity", "title", "status", "trigger_log_id", "rca_markdown"
    )


@query(f"WITH {fx.RUNBOOKS_SQL} SELECT id, title, category, content, {ts_sql('created_at')}, true AS indexed FROM runbooks")
def append_runbooks(spark, d):
    path, vector_path = new_path(spark, "runbooks"), new_path(spark, "vectors")
    books = fx.runbooks(spark, d)
    tables.append_runbooks(books, path, vector_path, version=1)
    indexed = tables.load_vectors(spark, vector_path).select(
        F.col("runbook_id").alias("id"), (F.size("embedding") == 384).alias("indexed")
    )
    return tables.load_runbooks(spark, path).join(indexed, "id", "left").select(
        "id", "title", "category", "content", ts("created_at"), "indexed"
    )


@query("""SELECT vec_id AS runbook_id, cast(len(embedding) AS bigint) AS dim,
  round(cast(embedding[1] AS double), 6) + 0.0 AS first_value FROM embeddings""")
def save_vectors(spark, d):
    """Indexing twice leaves one vector per runbook, the later one."""
    path = new_path(spark, "vectors")
    fresh = fx.vectors(spark, d)
    tables.save_vectors(fresh.withColumn("embedding", F.transform("embedding", lambda x: -x)), path, 1)
    tables.save_vectors(fresh, path, 2)
    return tables.load_vectors(spark, path).select(
        "runbook_id", big(F.size("embedding"), "dim"),
        (F.round(F.element_at("embedding", 1).cast("double"), 6) + 0.0).alias("first_value"),
    )


@query("""SELECT vec_id AS runbook_id, cast(len(embedding) AS bigint) AS dim,
  round(cast(embedding[1] AS double), 6) + 0.0 AS first_value FROM embeddings""")
def compact_vectors(spark, d):
    """Later vectors win before, between and after compactions."""
    path = new_path(spark, "vectors")
    fresh = fx.vectors(spark, d)
    old = fresh.withColumn("embedding", F.transform("embedding", lambda x: -x))
    tables.save_vectors(old, path, 1)
    tables.compact_vectors(spark, path)
    tables.save_vectors(fresh.where("runbook_id % 2 = 0"), path, 2)
    tables.save_vectors(fresh.where("runbook_id % 2 <> 0"), path, 3)
    tables.compact_vectors(spark, path)
    tables.save_vectors(old.where("runbook_id % 3 = 0"), path, 1)
    return tables.load_vectors(spark, path).select(
        "runbook_id", big(F.size("embedding"), "dim"),
        (F.round(F.element_at("embedding", 1).cast("double"), 6) + 0.0).alias("first_value"),
    )


# --- projections, filters, predicates ------------------------------------

@query(f"""WITH {fx.REQUESTS_SQL} SELECT id, source_host, log_level, raw_message FROM requests
  WHERE length(source_host) BETWEEN 1 AND 100 AND log_level IN ('ERROR','WARN','INFO') AND length(raw_message) >= 1""")
def validate_logs(spark, d):
    return validate.validate_logs(fx.ingest_requests(spark, d))[0].drop("timestamp")


@query(f"""WITH {fx.REQUESTS_SQL}, checked AS (SELECT id, concat_ws(',',
  CASE WHEN length(source_host) NOT BETWEEN 1 AND 100 THEN 'source_host' END,
  CASE WHEN log_level NOT IN ('ERROR','WARN','INFO') THEN 'log_level' END,
  CASE WHEN length(raw_message) < 1 THEN 'raw_message' END) AS reason FROM requests)
  SELECT id, reason FROM checked WHERE reason <> ''""")
def rejected_logs(spark, d):
    return validate.validate_logs(fx.ingest_requests(spark, d))[1].select("id", "reason")


@query(f"""WITH {fx.RUNBOOKS_SQL} SELECT id, title, category FROM runbooks WHERE length(title) BETWEEN 1 AND 255
  AND length(category) BETWEEN 1 AND 100 AND length(content) >= 1""")
def validate_runbooks(spark, d):
    return validate.validate_runbooks(fx.runbooks(spark, d))[0].select("id", "title", "category")


@query(f"""WITH {fx.LOGS_SQL} SELECT id, log_level AS level FROM logs""")
def level_strict(spark, d):
    return fx.logs(spark, d).select("id", rules.level_strict(F.col("raw_message")).alias("level"))


@query(f"""WITH {fx.LOGS_SQL} SELECT id,
  CASE WHEN upper(raw_message) LIKE '%ERROR%' OR upper(raw_message) LIKE '%FAIL%' OR upper(raw_message) LIKE '%EXCEPTION%' THEN 'ERROR'
    WHEN upper(raw_message) LIKE '%WARN%' OR upper(raw_message) LIKE '%SLOW%' THEN 'WARN' ELSE 'INFO' END AS level FROM logs""")
def level_loose(spark, d):
    return fx.logs(spark, d).select("id", rules.level_loose(F.col("raw_message")).alias("level"))


BLOCK_SQL = "nullif(regexp_extract(raw_message, '(blk_-?[0-9]+)', 1), '')"
MENTIONS_SQL = "unnest(list_distinct(regexp_extract_all(raw_message, '(blk_-?[0-9]+)', 1)))"


@query(f"WITH {fx.LOGS_SQL} SELECT id, {BLOCK_SQL} AS block_id FROM logs")
def extract_block_id(spark, d):
    return explore.with_block(fx.logs(spark, d)).select("id", "block_id")


@query(f"WITH {fx.LOGS_SQL} SELECT id, {MENTIONS_SQL} AS block_id FROM logs")
def block_mentions(spark, d):
    return explore.mentions(fx.logs(spark, d)).select("id", "block_id")


@query(f"""WITH {fx.LOGS_SQL} SELECT id, {ts_sql('timestamp')}, source_host, log_level, raw_message,
  cast(NULL AS bigint) AS template_id, cast(NULL AS varchar) AS parsed_template FROM logs""")
def log_entry(spark, d):
    return explore.log_entry(fx.logs(spark, d)).withColumn("timestamp", ts("timestamp"))


@query(f"WITH {fx.INCIDENTS_SQL} SELECT id, {ts_sql('created_at')}, severity, title, status, trigger_log_id FROM incidents")
def incident_summary(spark, d):
    return explore.incident_summary(fx.incidents(spark, d)).withColumn("created_at", ts("created_at"))


@query(f"WITH {fx.RUNBOOKS_SQL} SELECT id, title, category, content, {ts_sql('created_at')} FROM runbooks")
def runbook_record(spark, d):
    return explore.runbook_record(fx.runbooks(spark, d)).withColumn("created_at", ts("created_at"))


PAGE_SQL = f"SELECT id, {ts_sql('timestamp')}, source_host, log_level, raw_message, template_id, parsed_template FROM page"
MASK_SQL = ("regexp_replace(regexp_replace(regexp_replace(raw_message, 'blk_-?[0-9]+', '<*>', 'g'), "
            "'/?[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+(:[0-9]+)?', '<*>', 'g'), '[0-9]+([.][0-9]+)?', '<*>', 'g')")
CATALOG_SQL = fx.LOGS_SQL + f""",
masked AS (SELECT id, timestamp, source_host, log_level, raw_message, {MASK_SQL} AS masked FROM logs),
firsts AS (SELECT masked, timestamp AS first_ts, id AS first_id, count(*) OVER (PARTITION BY masked) AS n FROM masked
  QUALIFY row_number() OVER (PARTITION BY masked ORDER BY timestamp, id) = 1),
catalog AS (SELECT masked, first_ts, first_id, n, row_number() OVER (ORDER BY first_ts, first_id) AS template_id FROM firsts),
tlogs AS (SELECT m.*, c.template_id, c.masked AS parsed_template FROM masked m JOIN catalog c USING (masked))"""


@query(f"""WITH {CATALOG_SQL}, page AS (SELECT * FROM tlogs WHERE log_level = 'ERROR' AND source_host = 'host-3'
  AND (raw_message ILIKE '%disk full%' OR parsed_template ILIKE '%disk full%')
  ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 5) {PAGE_SQL}""")
def explore_logs(spark, d):
    return explore.explore_logs(
        fx.enriched(spark, d), level="ERROR", source="host-3", search="disk full", limit=50, offset=5
    ).withColumn("timestamp", ts("timestamp"))


@query(f"""WITH {CATALOG_SQL}, page AS (SELECT * FROM tlogs WHERE raw_message ILIKE '%block <_>%' OR parsed_template ILIKE '%block <_>%'
  ORDER BY timestamp DESC, id DESC LIMIT 500) {PAGE_SQL}""")
def explore_logs_wildcard(spark, d):
    """A wildcard in the search text that only the template can match."""
    return explore.explore_logs(fx.enriched(spark, d), search="block <_>", limit=500).withColumn(
        "timestamp", ts("timestamp")
    )


@query(f"""WITH {fx.LOGS_SQL}, page AS (SELECT *, cast(NULL AS bigint) AS template_id, cast(NULL AS varchar) AS parsed_template
  FROM logs WHERE log_level = 'ERROR' AND raw_message ILIKE '%disk full%' ORDER BY timestamp DESC, id DESC LIMIT 40 OFFSET 30) {PAGE_SQL}""")
def explore_stored(spark, d):
    path = new_path(spark, "logs")
    tables.append_logs(fx.logs(spark, d), path)
    logs = tables.load_logs(spark, path)
    return explore.explore_stored(
        logs, tables.stored_dates(logs), level="ERROR", search="disk full", limit=40, offset=30
    ).withColumn("timestamp", ts("timestamp"))


@query(f"""WITH {fx.LOGS_SQL}, page AS (SELECT *, cast(NULL AS bigint) AS template_id, cast(NULL AS varchar) AS parsed_template
  FROM logs ORDER BY timestamp DESC, id DESC LIMIT 50) {PAGE_SQL}""")
def log_page(spark, d):
    return explore.explore_logs(fx.logs(spark, d)).withColumn("timestamp", ts("timestamp"))


@query(f"""WITH {fx.INCIDENTS_SQL}, page AS (SELECT * FROM incidents WHERE status = 'OPEN' AND severity = 'CRITICAL'
  ORDER BY created_at DESC, id DESC LIMIT 20)
  SELECT id, {ts_sql('created_at')}, severity, title, status, trigger_log_id FROM page""")
def list_incidents(spark, d):
    return explore.list_incidents(fx.incidents(spark, d), "OPEN", "CRITICAL").withColumn(
        "created_at", ts("created_at")
    )


@query(f"WITH {fx.RUNBOOKS_SQL} SELECT id, title, category, {ts_sql('created_at')} FROM runbooks WHERE category = 'de' ORDER BY runbooks.created_at DESC, id DESC")
def list_runbooks(spark, d):
    return explore.list_runbooks(fx.runbooks(spark, d), "de").withColumn("created_at", ts("created_at"))


@query(f"WITH {fx.LOGS_SQL} SELECT id, {BLOCK_SQL} AS block_id FROM logs WHERE {BLOCK_SQL} IS NOT NULL")
def known_blocks(spark, d):
    return explore.known_blocks(explore.with_block(fx.logs(spark, d))).select("id", "block_id")


@query(f"""WITH {fx.LOGS_SQL} SELECT id, CASE WHEN lower(raw_message) LIKE '%fatal%' OR lower(raw_message) LIKE '%connection%'
  THEN 'CRITICAL' WHEN lower(raw_message) LIKE '%error%' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN lower(raw_message) LIKE '%connection%' OR lower(raw_message) LIKE '%slot%'
    THEN 'PostgreSQL Connection Pool Exhaustion' ELSE log_level || ' anomaly from ' || source_host END AS title FROM logs""")
def classify_incident(spark, d):
    msg = F.col("raw_message")
    return fx.logs(spark, d).select(
        "id", rules.classify_severity(msg).alias("severity"),
        rules.incident_title(F.col("log_level"), F.col("source_host"), msg).alias("title"),
    )


@query("SELECT doc_id AS id, cast(toxic AS bigint) AS true_label FROM labels")
def label_to_int(spark, d):
    return fx.block_labels(spark, d).select(
        F.col("number").cast("long").alias("id"), big("true_label", "true_label")
    )


@query(f"""WITH {fx.INCIDENTS_SQL} SELECT id, raw_message FROM logs
  WHERE id IN (SELECT trigger_log_id FROM incidents WHERE trigger_log_id IS NOT NULL)""")
def logs_by_ids(spark, d):
    ids = fx.incidents(spark, d).select(F.col("trigger_log_id").alias("id"))
    return explore.by_ids(fx.logs(spark, d), ids).select("id", "raw_message")


@query(f"WITH {fx.RUNBOOKS_SQL} SELECT id, title, content FROM runbooks WHERE id = 42")
def runbook_by_id(spark, d):
    return explore.by_id(fx.runbooks(spark, d), 42).select("id", "title", "content")


@query(f"WITH {fx.INCIDENTS_SQL} SELECT id, rca_markdown FROM incidents WHERE rca_markdown = '' OR rca_markdown LIKE '%FAISS-backed RAG retrieval%'")
def needs_rca(spark, d):
    return inc.needs_rca(fx.incidents(spark, d)).select("id", "rca_markdown")


# --- joins ----------------------------------------------------------------

@query(f"""WITH {fx.INCIDENTS_SQL} SELECT i.id, i.severity, i.trigger_log_id, l.id AS log_id, l.raw_message, l.source_host
  FROM incidents i LEFT JOIN logs l ON i.trigger_log_id = l.id""")
def incident_detail(spark, d):
    return inc.incident_detail(fx.incidents(spark, d), fx.logs(spark, d)).select(
        "id", "severity", "trigger_log_id", F.col("trigger_log.id").alias("log_id"),
        F.col("trigger_log.raw_message").alias("raw_message"), F.col("trigger_log.source_host").alias("source_host"),
    )


STATS_SQL = CATALOG_SQL + f""",
owned AS (SELECT {BLOCK_SQL} AS block_id, timestamp, id, 'E' || template_id AS token FROM tlogs WHERE {BLOCK_SQL} IS NOT NULL),
stats AS (SELECT block_id, count(token) AS seq_len, count(DISTINCT token) AS unique_templates FROM owned GROUP BY block_id),
labelled AS (SELECT s.block_id, seq_len, unique_templates, cast(toxic AS bigint) AS true_label
  FROM stats s JOIN labels l ON regexp_extract(s.block_id, '([0-9]+)', 1) = cast(l.doc_id AS varchar))"""


def tokens_of(spark, d):
    return sq.block_tokens(fx.enriched(spark, d))


def labels_for(blocks, spark, d):
    """Labels with the id of the block they belong to."""
    numbered = blocks.select("block_id").distinct().withColumn(
        "number", F.regexp_extract("block_id", "([0-9]+)", 1)
    )
    return numbered.join(fx.block_labels(spark, d), "number").select("block_id", "label", "true_label")


@query(f"WITH {STATS_SQL} SELECT block_id, seq_len, unique_templates, true_label FROM labelled")
def label_blocks(spark, d):
    stats = stage(sq.block_stats(tokens_of(spark, d)), "stats")
    return sq.label_blocks(stats, labels_for(stats, spark, d)).select(
        "block_id", big("seq_len", "seq_len"), big("unique_templates", "unique_templates"),
        big("true_label", "true_label"),
    )


KNN_SQL = """
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS runbook_id, round(greatest(list_sum(list_transform(
    list_zip(q.embedding, v.embedding), lambda p: (cast(p[1] AS double) - cast(p[2] AS double)) * (cast(p[1] AS double) - cast(p[2] AS double)))), 0), 6) AS distance
  FROM embeddings q, embeddings v),
near AS (SELECT query_id, runbook_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, runbook_id) AS rank
  FROM pairs QUALIFY rank <= 15)"""


@query(f"WITH {KNN_SQL} SELECT query_id, runbook_id, distance, rank FROM near")
def knn_l2(spark, d):
    v = fx.vectors(spark, d)
    return vec.knn_l2(v.withColumnRenamed("runbook_id", "query_id"), v, 15).select(
        "query_id", "runbook_id", "distance", big("rank", "rank")
    )


@query(f"""WITH {KNN_SQL}, {fx.RUNBOOKS_SQL} SELECT query_id, runbook_id, title, category FROM near
  JOIN runbooks ON runbooks.id = near.runbook_id""")
def attach_runbooks(spark, d):
    v = fx.vectors(spark, d)
    near = stage(vec.knn_l2(v.withColumnRenamed("runbook_id", "query_id"), v, 15), "near")
    books = fx.runbooks(spark, d).select("id", "title", "category")
    return retrieve.attach_runbooks(near, books).select("query_id", "runbook_id", "title", "category")


# --- aggregations -----------------------------------------------------------

@query(f"WITH {fx.LOGS_SQL} SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S.%f') AS bucket, count(*) AS n FROM logs WHERE timestamp >= {DAY_SQL} GROUP BY 1")
def log_volume(spark, d):
    return analytics.log_volume(fx.logs(spark, d), *times.window_start("24h", fx.NOW)).withColumn("bucket", ts("bucket"))


@query(f"WITH {fx.INCIDENTS_SQL} SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S.%f') AS bucket, count(*) AS n FROM incidents WHERE created_at >= {NOW_SQL} - INTERVAL '7' DAY GROUP BY 1")
def incident_volume(spark, d):
    return analytics.incident_volume(
        fx.incidents(spark, d), *times.window_start("7d", fx.NOW)
    ).withColumn("bucket", ts("bucket"))


def _chart_sql(back: str, grain: str) -> str:
    return f"""WITH {fx.INCIDENTS_SQL},
l AS (SELECT date_trunc('{grain}', timestamp) AS bucket, count(*) AS n FROM logs WHERE timestamp >= {NOW_SQL} - INTERVAL {back} GROUP BY 1),
a AS (SELECT date_trunc('{grain}', created_at) AS bucket, count(*) AS n FROM incidents WHERE created_at >= {NOW_SQL} - INTERVAL {back} GROUP BY 1)
SELECT strftime(l.bucket, '%Y-%m-%dT%H:%M:%S') AS timestamp, greatest(l.n - coalesce(a.n, 0), 0) AS normal_logs,
  coalesce(a.n, 0) AS anomalies FROM l LEFT JOIN a USING (bucket) ORDER BY l.bucket"""


def _chart(spark, d, timeframe):
    return analytics.volume_chart(fx.logs(spark, d), fx.incidents(spark, d), timeframe, fx.NOW)


@query(_chart_sql("'1' HOUR", "hour"))
def volume_chart_1h(spark, d):
    return _chart(spark, d, "1h")


@query(_chart_sql("'24' HOUR", "hour"))
def volume_chart_24h(spark, d):
    return _chart(spark, d, "24h")


@query(_chart_sql("'7' DAY", "day"))
def volume_chart_7d(spark, d):
    return _chart(spark, d, "7d")


@query(f"WITH {fx.INCIDENTS_SQL} SELECT count(*) AS open_critical_incidents FROM incidents WHERE status = 'OPEN' AND severity = 'CRITICAL'")
def open_critical_count(spark, d):
    return analytics.open_critical_count(fx.incidents(spark, d))


@query(f"WITH {fx.INCIDENTS_SQL} SELECT count(*) AS total_anomalies FROM incidents WHERE created_at >= {DAY_SQL}")
def anomaly_count(spark, d):
    return analytics.anomaly_count(fx.incidents(spark, d), fx.NOW - timedelta(days=1))


@query(f"WITH {fx.LOGS_SQL} SELECT count(*) AS total_logs FROM logs WHERE timestamp >= {DAY_SQL}")
def log_count(spark, d):
    return analytics.log_count(fx.logs(spark, d), fx.NOW - timedelta(days=1))


def _summary_sql(divisor: int, critical: float, anomaly: float) -> str:
    return f"""WITH {fx.INCIDENTS_SQL},
c AS (SELECT count(*) FILTER (WHERE status = 'OPEN' AND severity = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE created_at >= {DAY_SQL}) AS anomalies FROM incidents),
n AS (SELECT count(*) AS total FROM logs WHERE timestamp >= {DAY_SQL})
SELECT greatest(0, cast(round_even(total / {divisor}, 0) AS bigint)) AS ingestion_rate_per_sec,
  round(greatest(0.0, 100.0 - cast(critical AS double) * {critical} - cast(anomalies AS double) * {anomaly}), 1) AS system_health_percentage,
  anomalies AS total_anomalies_today, critical AS open_critical_incidents FROM c, n"""


@query(_summary_sql(3600, 0.8, 0.2))
def summary(spark, d):
    return analytics.summary(fx.logs(spark, d), fx.incidents(spark, d), fx.NOW)


@query(_summary_sql(100, 0.08, 0.02))
def summary_scaled(spark, d):
    """Smaller weights, so that the health is not cut off at 0."""
    return analytics.summary(
        fx.logs(spark, d), fx.incidents(spark, d), fx.NOW, 100, critical_weight=0.08, anomaly_weight=0.02
    )


@query(f"""WITH {CATALOG_SQL}, owned AS (SELECT {BLOCK_SQL} AS block_id, timestamp, id, 'E' || template_id AS token
  FROM tlogs WHERE {BLOCK_SQL} IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY timestamp, id) AS pos FROM owned)
SELECT block_id, (pos - 1) // 1000 AS part, string_agg(token, ' ' ORDER BY pos) AS sequence, count(*) AS n_tokens
FROM placed GROUP BY 1, 2""")
def block_sequences(spark, d):
    return sq.block_sequences(tokens_of(spark, d)).select(
        "block_id", big("part", "part"), "sequence", big("n_tokens", "n_tokens")
    )


@query(f"WITH {STATS_SQL} SELECT block_id, seq_len, unique_templates FROM stats")
def block_stats(spark, d):
    return sq.block_stats(tokens_of(spark, d)).select(
        "block_id", big("seq_len", "seq_len"), big("unique_templates", "unique_templates")
    )


@query(f"WITH {STATS_SQL} SELECT count(*) AS blocks, cast(coalesce(sum(true_label), 0) AS bigint) AS anomalies FROM labelled")
def eval_population(spark, d):
    stats = stage(sq.block_stats(tokens_of(spark, d)), "stats")
    return sq.eval_population(sq.label_blocks(stats, labels_for(stats, spark, d)))


JUDGED_SQL = STATS_SQL + """,
signs AS (SELECT b.block_id, max(CASE WHEN raw_message LIKE 'FATAL%' THEN 1 ELSE 0 END) AS fatal,
  CASE WHEN count(*) > 60 THEN 1 ELSE 0 END AS busy, 0 AS never
  FROM (SELECT nullif(regexp_extract(raw_message, '(blk_-?[0-9]+)', 1), '') AS block_id, raw_message FROM logs) b
  WHERE b.block_id IS NOT NULL GROUP BY 1),
judged AS (SELECT config, true_label, pred FROM labelled JOIN (
  SELECT 0 AS config, block_id, fatal AS pred FROM signs UNION ALL SELECT 1, block_id, busy FROM signs
  UNION ALL SELECT 2, block_id, never FROM signs) USING (block_id)),
counts AS (SELECT config, cast(count(*) FILTER (WHERE true_label = 1 AND pred = 1) AS double) AS tp,
  cast(count(*) FILTER (WHERE true_label = 0 AND pred = 1) AS double) AS fp, cast(count(*) FILTER (WHERE true_label = 1 AND pred = 0) AS double) AS fn,
  cast(count(*) FILTER (WHERE true_label = 0 AND pred = 0) AS double) AS tn FROM judged GROUP BY 1),
metrics AS (SELECT cast(config AS bigint) AS config, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM counts)"""


def judged(spark, d):
    """Three simple detectors: a fatal log in the block, a long sequence, nothing at all."""
    owned = explore.known_blocks(explore.with_block(fx.logs(spark, d)))
    signs = stage(owned.groupBy("block_id").agg(
        F.max(F.col("raw_message").startswith("FATAL").cast("int")).alias("fatal"),
        (F.count("*") > 60).cast("int").alias("busy"),
    ), "signs")
    preds = signs.select("block_id", F.posexplode(F.array("fatal", "busy", F.lit(0))).alias("config", "pred"))
    return sq.label_blocks(preds, labels_for(signs, spark, d))


@query(f"WITH {JUDGED_SQL} SELECT config, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM metrics")
def classification_metrics(spark, d):
    metrics = evaluate.classification_metrics(judged(spark, d), ["config"])
    return metrics.select(big("config", "config"), *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


BOARD_SQL = "SELECT config, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(accuracy, 4) AS accuracy FROM metrics ORDER BY metrics.f1 DESC, metrics.precision DESC, config"


@query(f"WITH {JUDGED_SQL} {BOARD_SQL}")
def leaderboard(spark, d):
    return evaluate.leaderboard(evaluate.classification_metrics(judged(spark, d), ["config"])).withColumn(
        "config", F.col("config").cast("long")
    )


@query(f"WITH {JUDGED_SQL} {BOARD_SQL} LIMIT 1")
def leaderboard_best(spark, d):
    return evaluate.leaderboard(evaluate.classification_metrics(judged(spark, d), ["config"]), 1).withColumn(
        "config", F.col("config").cast("long")
    )


# --- windows, updates -------------------------------------------------------

HISTORY_SQL = CATALOG_SQL + f""",
mentioned AS (SELECT {MENTIONS_SQL} AS block_id, timestamp, id, template_id FROM tlogs),
earliest AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY timestamp, id) AS rn FROM mentioned QUALIFY rn <= 250),
own AS (SELECT id, timestamp, template_id, {BLOCK_SQL} AS block_id FROM tlogs),
history AS (SELECT o.id, o.block_id, concat_ws(' ', string_agg('E' || e.template_id, ' ' ORDER BY e.timestamp, e.id), 'E' || any_value(o.template_id)) AS sequence,
  count(e.id) + 1 AS seq_len FROM own o LEFT JOIN earliest e ON o.block_id = e.block_id
  AND (e.timestamp < o.timestamp OR (e.timestamp = o.timestamp AND e.id < o.id)) GROUP BY o.id, o.block_id)"""


@query(f"WITH {HISTORY_SQL} SELECT id, block_id, sequence, seq_len FROM history")
def block_history(spark, d):
    return sq.block_history(fx.enriched(spark, d)).select(
        "id", "block_id", F.array_join("tokens", " ").alias("sequence"), big(F.size("tokens"), "seq_len")
    )


@query(f"""WITH {HISTORY_SQL} SELECT id, sequence, seq_len,
  cast(len(list_distinct(string_split(sequence, ' '))) AS bigint) AS unique_templates FROM history""")
def sequence_stats(spark, d):
    rows = sq.block_history(fx.enriched(spark, d))
    return rows.select("id", seq.sequence_stats(F.col("tokens")).alias("s")).select(
        "id", "s.sequence", big("s.seq_len", "seq_len"), big("s.unique_templates", "unique_templates")
    )


@query(f"""WITH {fx.UPDATES_SQL} SELECT incident_id, status, {ts_sql('ts')} FROM updates
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY updates.ts DESC, status DESC) = 1""")
def latest_status(spark, d):
    return inc.latest_status(fx.status_updates(spark, d)).withColumn("ts", ts("ts"))


LAST_SQL = fx.UPDATES_SQL + """,
last AS (SELECT incident_id, status AS new_status, ts AS new_ts FROM updates QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, status DESC) = 1),
changed AS (SELECT id, severity, coalesce(new_status, status) AS status, coalesce(new_ts, updated_at) AS updated_at
  FROM incidents LEFT JOIN last ON id = incident_id)"""
CHANGED_SQL = f"WITH {LAST_SQL} SELECT id, severity, status, {ts_sql('updated_at')} FROM changed"


@query(CHANGED_SQL)
def update_status(spark, d):
    out = inc.update_status(fx.incidents(spark, d), fx.status_updates(spark, d))
    return out.select("id", "severity", "status", ts("updated_at"))


@query(f"WITH {fx.UPDATES_SQL} SELECT incident_id, status FROM updates WHERE incident_id NOT IN (SELECT id FROM incidents)")
def unknown_updates(spark, d):
    return inc.unknown_updates(fx.incidents(spark, d), fx.status_updates(spark, d)).select("incident_id", "status")


# --- scalar functions ---------------------------------------------------------

TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({0}), '([a-z0-9]+)', 1), lambda w: length(w) > 2))"


@query(f"SELECT doc_id, array_to_string(list_sort({TOKENS_SQL.format('text')}), ' ') AS tokens, cast(len({TOKENS_SQL.format('text')}) AS bigint) AS n FROM documents")
def tokenize(spark, d):
    docs = fx.runbooks(spark, d).select(F.col("id").alias("doc_id"), text.tokenize(F.col("content")).alias("t"))
    return docs.select("doc_id", F.array_join(F.array_sort("t"), " ").alias("tokens"), big(F.size("t"), "n"))


@query(f"""WITH {fx.RUNBOOKS_SQL}, t AS (SELECT id, {TOKENS_SQL.format("concat_ws(' ', 'database connection', title)")} AS q,
  {TOKENS_SQL.format("concat_ws(' ', nullif(title, ''), nullif(category, ''), nullif(content, ''))")} AS w FROM runbooks)
  SELECT id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE cast(len(list_intersect(q, w)) AS double) / len(q) END, 6) AS lexical,
  round(1.0 / (1.0 + id), 6) AS semantic FROM t""")
def lexical_score(spark, d):
    parts = [F.col(c) for c in ("title", "category", "content")]
    q = text.tokenize(F.concat_ws(" ", F.lit("database connection"), "title"))
    return fx.runbooks(spark, d).select(
        "id", F.round(text.lexical_score(q, text.tokenize(text.runbook_text(*parts))), 6).alias("lexical"),
        F.round(text.semantic_score(F.col("id").cast("double")), 6).alias("semantic"),
    )


@query(f"""WITH {fx.RUNBOOKS_SQL} SELECT id, concat_ws(' ', nullif(title, ''), nullif(category, ''), nullif(content, '')) AS lexical_text,
  'Title: ' || title || chr(10) || 'Category: ' || category || chr(10) || content AS search_text FROM runbooks""")
def runbook_texts(spark, d):
    parts = [F.col(c) for c in ("title", "category", "content")]
    return fx.runbooks(spark, d).select(
        "id", text.runbook_text(*parts).alias("lexical_text"), text.runbook_search_text(*parts).alias("search_text")
    )


@query(f"""WITH {CATALOG_SQL} SELECT id, 'E' || template_id AS token,
  'Template sequence: E' || template_id || chr(10) || 'Problem message: ' || raw_message AS query FROM tlogs""")
def query_text(spark, d):
    token = seq.template_token(F.col("template_id"))
    return fx.enriched(spark, d).select(
        "id", token.alias("token"), text.query_text(token, F.col("raw_message")).alias("query")
    )




def flat_sql(col: str) -> str:
    return f"trim(regexp_replace({col}, '{text.WHITESPACE_PATTERN}', ' ', 'g'), ' ')"


SNIPPET_SQL = "CASE WHEN length({0}) > 220 THEN substr({0}, 1, 220) || '...' ELSE {0} END"


@query(f"WITH f AS (SELECT doc_id, {flat_sql('text')} AS flat FROM documents) SELECT doc_id, {SNIPPET_SQL.format('flat')} AS snippet FROM f")
def snippet(spark, d):
    return fx.runbooks(spark, d).select(F.col("id").alias("doc_id"), text.snippet(F.col("content")).alias("snippet"))


@query("""SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS label,
  CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events""")
def time_labels(spark, d):
    at = F.col("ts").cast("timestamp")
    return fx.table(spark, d, "events").select(
        "event_id", times.bucket_label(F.date_trunc("hour", at)).alias("label"), times.iso_format(at).alias("iso")
    )


TERMS_SQL = STATS_SQL + """,
placed AS (SELECT *, lead(token, 1) OVER w AS t2, lead(token, 2) OVER w AS t3 FROM owned
  WINDOW w AS (PARTITION BY block_id ORDER BY timestamp, id)),
grams AS (SELECT block_id, token AS term FROM placed
  UNION ALL SELECT block_id, token || ' ' || t2 FROM placed WHERE t2 IS NOT NULL
  UNION ALL SELECT block_id, token || ' ' || t2 || ' ' || t3 FROM placed WHERE t3 IS NOT NULL),
terms AS (SELECT block_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
vocabulary AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM stats)) / (1 + count(*))) + 1 AS idf,
  row_number() OVER (ORDER BY term) - 1 AS idx FROM terms GROUP BY term),
raw AS (SELECT block_id, term, idx, (1 + ln(tf)) * idf AS raw FROM terms JOIN vocabulary USING (term)),
weights AS (SELECT block_id, term, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY block_id)) AS weight FROM raw)"""


@query(f"WITH {TERMS_SQL} SELECT block_id, term, tf FROM terms")
def block_terms_trigram(spark, d):
    return sq.block_terms(tokens_of(spark, d), 3)


@query(f"""WITH {CATALOG_SQL}, owned AS (SELECT {BLOCK_SQL} AS block_id, timestamp, id, 'E' || template_id AS token
  FROM tlogs WHERE {BLOCK_SQL} IS NOT NULL),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY block_id ORDER BY timestamp, id) - 1) // 50 AS part FROM owned),
placed AS (SELECT *, lead(token, 1) OVER w AS t2 FROM numbered WINDOW w AS (PARTITION BY block_id, part ORDER BY timestamp, id)),
grams AS (SELECT block_id, part, token AS term FROM placed UNION ALL
  SELECT block_id, part, token || ' ' || t2 FROM placed WHERE t2 IS NOT NULL)
SELECT block_id, part, term, count(*) AS n FROM grams GROUP BY ALL""")
def ngrams(spark, d):
    parts = sq.block_sequences(tokens_of(spark, d), 50)
    terms = F.explode(seq.ngrams(F.split("sequence", " "), 2)).alias("term")
    return parts.select("block_id", big("part", "part"), terms).groupBy("block_id", "part", "term").agg(
        F.count("*").alias("n")
    )


@query(f"""WITH {CATALOG_SQL} SELECT id, '### Root Cause Analysis' || chr(10) || chr(10) || 'Log analytics anomaly detection flagged a ' || log_level
  || ' log from `' || source_host || '` at `' || CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END || '`. The triggering message was:' || chr(10) || chr(10) || '`' || raw_message || '`'
  || chr(10) || chr(10) || 'Parsed template: `' || parsed_template || '`' || chr(10) || chr(10) || '### Recommended Actions' || chr(10)
  || '1. Inspect the emitting service and recent deploy activity.' || chr(10)
  || '2. Check resource pressure and dependency health for the affected host.' || chr(10)
  || '3. Attach the relevant runbook once FAISS-backed RAG retrieval is enabled.' || chr(10) || chr(10)
  || '_Generated placeholder RCA at 2024-01-30T12:30:00+00:00._' AS report FROM tlogs""")
def rca_signal_markdown(spark, d):
    return fx.enriched(spark, d).select("id", report.rca_signal_markdown(
        F.col("log_level"), F.col("source_host"), F.col("timestamp"), F.col("raw_message"),
        F.col("parsed_template"), F.lit(fx.NOW),
    ).alias("report"))


# --- model operators ------------------------------------------------------------

@query(f"WITH {fx.LOGS_SQL} SELECT id, {MASK_SQL} AS masked FROM logs")
def mask_template(spark, d):
    return fx.logs(spark, d).select("id", text.mask_template(F.col("raw_message")).alias("masked"))


@query(f"WITH {CATALOG_SQL} SELECT template_id, masked AS template, n, first_id FROM catalog")
def template_catalog(spark, d):
    return tpl.template_catalog(fx.logs(spark, d)).select("template_id", "template", "n", "first_id")


@query(f"""WITH {CLEAN_SQL}, l AS (SELECT {MASK_SQL.replace('raw_message', 'value')} AS masked, file, block_start, line_no FROM clean WHERE length(value) > 0),
f AS (SELECT masked, count(*) OVER (PARTITION BY masked) AS n, block_start, line_no FROM l
  QUALIFY row_number() OVER (PARTITION BY masked ORDER BY block_start, line_no) = 1)
SELECT masked AS template, n, row_number() OVER (ORDER BY block_start, line_no) AS template_id FROM f""")
def template_catalog_lines(spark, d):
    """The catalogue of free text, which has about as many templates as lines."""
    lines = ln.clean_lines(fx.log_lines(spark, d)).select(
        F.timestamp_seconds("block_start").alias("timestamp"), F.col("line_no").cast("long").alias("id"),
        F.col("value").alias("raw_message"),
    )
    return tpl.template_catalog(lines).select("template", "n", "template_id")


@query(f"WITH {CATALOG_SQL} SELECT id, template_id, parsed_template FROM tlogs")
def assign_templates(spark, d):
    made = tpl.assign_templates(fx.logs(spark, d), fx.catalog(spark, d))
    return made.select("id", "template_id", "parsed_template")


@query(f"""WITH {CATALOG_SQL} SELECT id, template_id, parsed_template, {BLOCK_SQL} AS block_id,
  array_to_string(list_sort(list_distinct(regexp_extract_all(raw_message, '(blk_-?[0-9]+)', 1))), ' ') AS blocks FROM tlogs""")
def enrich_logs(spark, d):
    made = tpl.enrich_logs(fx.logs(spark, d), fx.catalog(spark, d))
    return made.select(
        "id", "template_id", "parsed_template", "block_id", F.array_join(F.array_sort("blocks"), " ").alias("blocks")
    )


#: The leader rule over ``catalog`` (masked, n, template_id in first-seen order), one message of each leaf at a time.
LEADER_SQL = """
toks AS (SELECT masked, n, template_id AS place, regexp_split_to_array(masked, '[ \t]+') AS tokens FROM catalog),
keyed AS (SELECT *, concat_ws(' ', cast(len(tokens) AS varchar), array_to_string(list_transform(tokens[1:2], lambda t:
  CASE WHEN regexp_matches(t, '[0-9]') OR contains(t, '<*>') THEN '<*>' ELSE t END), ' ')) AS leaf FROM toks),
ordered AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY place) AS k FROM keyed),
led AS (
  SELECT leaf, k, place, [{'p': place, 't': tokens}] AS leaders, place AS leader FROM ordered WHERE k = 1
  UNION ALL
  SELECT leaf, k, place, CASE WHEN hit IS NULL THEN list_append(leaders, {'p': place, 't': tokens}) ELSE leaders END,
    coalesce(hit, place)
  FROM (SELECT o.*, l.leaders, list_filter(l.leaders, lambda x: len(list_filter(range(1, len(o.tokens) + 1),
      lambda i: x.t[i] = o.tokens[i] AND x.t[i] <> '<*>')) >= 0.4 * len(o.tokens))[1].p AS hit
    FROM led l JOIN ordered o ON o.leaf = l.leaf AND o.k = l.k + 1)),
pairs AS (SELECT o.masked, o.n, o.tokens, l.leader, h.tokens AS head, h.masked AS text
  FROM led l JOIN ordered o ON o.place = l.place JOIN ordered h ON h.place = l.leader),
spots AS (SELECT leader, list(DISTINCT i) AS spots FROM (SELECT leader, unnest(list_filter(range(1, len(head) + 1),
  lambda i: head[i] <> tokens[i])) AS i FROM pairs) GROUP BY leader),
mined AS (SELECT masked, n, text AS leader, dense_rank() OVER (ORDER BY leader) AS template_id,
  array_to_string(list_transform(range(1, len(head) + 1), lambda i:
    CASE WHEN list_contains(coalesce(spots, []), i) THEN '<*>' ELSE head[i] END), ' ') AS template
  FROM pairs LEFT JOIN spots USING (leader))"""


@query(f"WITH RECURSIVE {CATALOG_SQL}, {LEADER_SQL} SELECT masked, template_id, template, n, leader FROM mined")
def mine_templates(spark, d):
    return tpl.mine_templates(fx.logs(spark, d))


@query(f"""WITH RECURSIVE {CLEAN_SQL}, l AS (SELECT {MASK_SQL.replace('raw_message', 'value')} AS masked, file, block_start, line_no
  FROM clean WHERE length(value) > 0),
catalog AS (SELECT masked, n, row_number() OVER (ORDER BY block_start, line_no) AS template_id FROM (
  SELECT masked, count(*) OVER (PARTITION BY masked) AS n, block_start, line_no FROM l
  QUALIFY row_number() OVER (PARTITION BY masked ORDER BY block_start, line_no) = 1)), {LEADER_SQL}
SELECT masked, template_id, template, n, leader FROM mined""")
def mine_templates_lines(spark, d):
    """Mining free text, where leaves are many and wide."""
    lines = ln.clean_lines(fx.lines_in_place(spark, d)).select(
        F.timestamp_seconds("block_start").alias("timestamp"), F.col("line_no").cast("long").alias("id"),
        F.col("value").alias("raw_message"),
    )
    return tpl.mine_templates(lines)


def weighted(spark, d, ngram_max):
    tokens = tokens_of(spark, d)
    terms = stage(sq.block_terms(tokens, ngram_max), "terms")
    vocabulary = stage(feat.tfidf_fit(terms, sq.block_stats(tokens)), "vocabulary")
    return feat.tfidf_transform(terms, vocabulary), vocabulary


@query(f"WITH {TERMS_SQL} SELECT term, df, round(idf, 6) AS idf, idx FROM vocabulary")
def tfidf_fit(spark, d):
    return weighted(spark, d, 3)[1].select("term", "df", F.round("idf", 6).alias("idf"), big("idx", "idx"))


@query(f"WITH {TERMS_SQL} SELECT block_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_transform(spark, d):
    return weighted(spark, d, 3)[0].select("block_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {STATS_SQL}, s AS (SELECT avg(seq_len) AS lm, stddev_pop(seq_len) AS ls, avg(unique_templates) AS um,
  stddev_pop(unique_templates) AS us FROM stats)
  SELECT block_id, round((seq_len - lm) / CASE WHEN ls > 0 THEN ls ELSE 1 END, 6) + 0.0 AS seq_len_z,
  round((unique_templates - um) / CASE WHEN us > 0 THEN us ELSE 1 END, 6) + 0.0 AS unique_templates_z FROM stats, s""")
def scaler(spark, d):
    stats = stage(sq.block_stats(tokens_of(spark, d)), "stats")
    out = feat.scaler_transform(stats, feat.scaler_fit(stats))
    return out.select("block_id", *[(F.round(f"{c}_z", 6) + 0.0).alias(f"{c}_z") for c in feat.META])


FEATURES_SQL = f"""{STATS_SQL}, grams AS (SELECT block_id, token AS term, count(*) AS tf FROM owned GROUP BY 1, 2),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM stats)) / (1 + count(*))) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS idx FROM grams GROUP BY term),
r AS (SELECT block_id, idx, (1 + ln(tf)) * idf AS raw FROM grams JOIN v USING (term)),
w AS (SELECT block_id, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY block_id)) AS value FROM r),
s AS (SELECT avg(seq_len) AS lm, stddev_pop(seq_len) AS ls, avg(unique_templates) AS um, stddev_pop(unique_templates) AS us FROM stats),
f AS (SELECT block_id, idx, value FROM w
  UNION ALL SELECT block_id, (SELECT count(*) FROM v), (seq_len - lm) / CASE WHEN ls > 0 THEN ls ELSE 1 END FROM stats, s
  UNION ALL SELECT block_id, (SELECT count(*) FROM v) + 1, (unique_templates - um) / CASE WHEN us > 0 THEN us ELSE 1 END FROM stats, s)"""


@query(f"WITH {FEATURES_SQL} SELECT block_id, cast(idx AS bigint) AS idx, round(value, 6) + 0.0 AS value FROM f")
def assemble_features(spark, d):
    fitted = training.fit_features(*training.count_terms(tokens_of(spark, d)))
    return fitted.features.select("block_id", F.explode(F.arrays_zip("indices", "values")).alias("e")).select(
        "block_id", big("e.indices", "idx"), (F.round("e.values", 6) + 0.0).alias("value")
    )


FOREST_SQL = FEATURES_SQL + "," + forest_sql.grown() + f""",
cells_rows AS (SELECT block_id FROM stats),{forest_sql.scored("trained", "block_id", "cells")},{forest_sql.OFFSET}"""


@query(f"""WITH {FOREST_SQL} SELECT block_id, round(score_sample, 6) AS score_sample, round(score_sample - edge, 6) + 0.0 AS score,
  score_sample < edge AS is_anomaly FROM trained, threshold""")
def isolation_forest(spark, d):
    fitted = training.fit_features(*training.count_terms(tokens_of(spark, d)))
    _, scores = training.fit_forest(fitted)
    offset = iforest.iforest_offsets(scores, [iforest.CONTAMINATION])[0]
    return iforest.predict(scores, offset).select(
        "block_id", F.round("score_sample", 6).alias("score_sample"), (F.round("score", 6) + 0.0).alias("score"), "is_anomaly")


@query()
def one_class_svm(spark, d):
    fitted = training.fit_features(*training.count_terms(tokens_of(spark, d)))
    model = ocsvm.ocsvm_fit(fitted.features, fitted.n_features)
    return ocsvm.ocsvm_predict(fitted.features, model)


def trained(spark, d):
    base = fx.logs(spark, d)
    return base, training.train_model(base)


SCORED_SQL = FOREST_SQL + "," + HISTORY_SQL[len(CATALOG_SQL) + 1:] + f""",
seqs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sequence) AS sid, sequence, string_split(sequence, ' ') AS toks
  FROM (SELECT DISTINCT sequence FROM history)),
seq_terms AS (SELECT sid, term, count(*) AS tf FROM (SELECT sid, unnest(toks) AS term FROM seqs) GROUP BY 1, 2),
seq_raw AS (SELECT sid, idx, (1 + ln(tf)) * idf AS raw FROM seq_terms JOIN v USING (term)),
sc AS MATERIALIZED (SELECT sid, cast(idx AS bigint) AS idx, cast(cast(value AS float) AS double) AS x FROM (
  SELECT sid, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sid)) AS value FROM seq_raw
  UNION ALL SELECT sid, (SELECT count(*) FROM v), (len(toks) - lm) / CASE WHEN ls > 0 THEN ls ELSE 1 END FROM seqs, s
  UNION ALL SELECT sid, (SELECT count(*) FROM v) + 1, (len(list_distinct(toks)) - um) / CASE WHEN us > 0 THEN us ELSE 1 END FROM seqs, s)),
sc_rows AS (SELECT sid FROM seqs),{forest_sql.scored("judged", "sid", "sc")},
logs_scored AS (SELECT t.*, h.block_id, h.sequence, h.seq_len, len(list_distinct(q.toks)) AS unique_templates,
  j.score_sample - edge AS score, j.score_sample < edge AS is_anomaly
  FROM tlogs t JOIN history h USING (id) JOIN seqs q USING (sequence) JOIN judged j USING (sid), threshold)"""


@query(f"""WITH {SCORED_SQL} SELECT id, template_id, block_id, seq_len, unique_templates, round(score, 6) + 0.0 AS score, is_anomaly
  FROM logs_scored""")
def score_logs(spark, d):
    """Train, save, load and score with the loaded model."""
    base, model = trained(spark, d)
    path = new_path(spark, "model")
    models.save_model(model, path)
    scored = scoring.score_logs(base, models.load_model(spark, path))
    return scored.select("id", "template_id", "block_id", big("seq_len", "seq_len"), big("unique_templates", "unique_templates"),
                         (F.round("score", 6) + 0.0).alias("score"), "is_anomaly")


@query(f"WITH {SCORED_SQL} SELECT id, log_level, round(score, 6) + 0.0 AS score FROM logs_scored WHERE is_anomaly")
def incident_gate(spark, d):
    base, model = trained(spark, d)
    return scoring.incident_gate(base, model).select("id", "log_level", (F.round("score", 6) + 0.0).alias("score"))


@query()
def grid_search(spark, d):
    tokens = tokens_of(spark, d)
    return training.grid_search(tokens, labels_for(tokens, spark, d)).leaderboard()


def embed_sql(source: str, key: str, col: str, out: str = "unit") -> str:
    """Unit vectors of the default encoder in long form: key, place, value."""
    return f"""{out}_h AS (SELECT {key}, cast('0x' || substr(md5(w), 1, 15) AS bigint) AS h FROM
  (SELECT {key}, unnest({TOKENS_SQL.format(col)}) AS w FROM {source})),
{out}_bag AS (SELECT {key}, (h >> 1) % 384 AS place, sum(CASE WHEN h & 1 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM {out}_h GROUP BY ALL),
{out} AS (SELECT {key}, place, cast(cast(v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS float) AS double) AS value FROM {out}_bag QUALIFY v <> 0)"""


def long_vectors(df, key):
    return df.select(key, F.posexplode("embedding").alias("place", "value")).where(F.col("value") != 0).select(
        key, big("place", "place"), F.round(F.col("value").cast("double"), 4).alias("value")
    )


@query(f"WITH {embed_sql('documents', 'doc_id', 'text')} SELECT doc_id, place, round(value, 4) AS value FROM unit")
def embed_texts(spark, d):
    books = fx.runbooks(spark, d).select(F.col("id").alias("doc_id"), "content")
    return long_vectors(vec.embed_texts(books, "content"), "doc_id")


BOOK_TEXT_SQL = "concat('Title: ', title, chr(10), 'Category: ', category, chr(10), content)"


@query(f"""WITH {fx.RUNBOOKS_SQL}, {embed_sql('runbooks', 'id', BOOK_TEXT_SQL)}
  SELECT id AS runbook_id, place, round(value, 4) AS value FROM unit""")
def index_runbooks(spark, d):
    return long_vectors(vec.index_runbooks(fx.runbooks(spark, d)), "runbook_id")


def given_queries(spark, d, needed=False):
    """Incidents as queries, incident number i with the given vector i modulo their number."""
    found = fx.incidents(spark, d)
    numbered = ranked(found.select(F.col("id").alias("query_id")), [], ["query_id"], "number")
    given = fx.vectors(spark, d)
    numbered = numbered.withColumn("vec_id", (F.col("number") - 1) % given.agg(F.count("*")).scalar())
    chosen = inc.needs_rca(found) if needed else found
    return rca.incident_queries(chosen, fx.enriched(spark, d)).join(numbered, "query_id").join(
        given.withColumnRenamed("runbook_id", "vec_id"), "vec_id"
    ).select("query_id", "sequence", "raw_message", "embedding")


SEARCH_SQL = CATALOG_SQL + fx.INCIDENTS_SQL[len(fx.LOGS_SQL):] + "," + fx.RUNBOOKS_SQL + "," + KNN_SQL + f""",
numbered AS (SELECT id AS incident_id, trigger_log_id, (row_number() OVER (ORDER BY id) - 1) % (SELECT count(*) FROM embeddings) AS vec_id FROM incidents),
queries AS (SELECT incident_id, vec_id, coalesce(cast(t.template_id AS varchar), '') AS sequence, coalesce(t.raw_message, '') AS raw_message
  FROM numbered n LEFT JOIN tlogs t ON t.id = n.trigger_log_id),
asked AS (SELECT *, {TOKENS_SQL.format("'Template sequence: ' || sequence || chr(10) || 'Problem message: ' || raw_message")} AS q FROM queries),
books AS (SELECT id, {TOKENS_SQL.format("concat_ws(' ', nullif(title, ''), nullif(category, ''), nullif(content, ''))")} AS w FROM runbooks),
scored AS (SELECT a.incident_id, n.runbook_id, n.distance,
  round(5.0 * (cast(len(list_intersect(a.q, b.w)) AS double) / len(a.q)) + 1.0 / (1.0 + n.distance), 6) AS score
  FROM asked a JOIN near n ON n.query_id = a.vec_id JOIN books b ON b.id = n.runbook_id),
found AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, distance, runbook_id) AS rank FROM scored QUALIFY rank <= 3)"""


@query(f"WITH {SEARCH_SQL} SELECT incident_id, runbook_id, distance, score, rank FROM found")
def search_runbooks(spark, d):
    found = retrieve.search_runbooks(given_queries(spark, d), fx.runbooks(spark, d), fx.vectors(spark, d))
    return found.select(
        F.col("query_id").alias("incident_id"), "runbook_id", "distance", "score", big("rank", "rank")
    )


ENCODED_SQL = CATALOG_SQL + fx.INCIDENTS_SQL[len(fx.LOGS_SQL):] + "," + fx.RUNBOOKS_SQL + f""",
queries AS (SELECT i.id AS incident_id, 'Template sequence: ' || coalesce(cast(t.template_id AS varchar), '') || chr(10)
  || 'Problem message: ' || coalesce(t.raw_message, '') AS query FROM incidents i LEFT JOIN tlogs t ON t.id = i.trigger_log_id),
{embed_sql('queries', 'incident_id', 'query', 'qv')}, {embed_sql('runbooks', 'id', BOOK_TEXT_SQL, 'bv')},
qn AS (SELECT incident_id, sum(value * value) AS norm FROM qv GROUP BY 1), bn AS (SELECT id, sum(value * value) AS norm FROM bv GROUP BY 1),
dots AS (SELECT incident_id, id, sum(qv.value * bv.value) AS dot FROM qv JOIN bv USING (place) GROUP BY 1, 2),
far AS (SELECT a.incident_id, r.id, round(greatest(coalesce(qn.norm, 0) + coalesce(bn.norm, 0) - 2 * coalesce(dot, 0), 0), 6) AS distance
  FROM queries a CROSS JOIN runbooks r LEFT JOIN dots ON dots.incident_id = a.incident_id AND dots.id = r.id
  LEFT JOIN qn ON qn.incident_id = a.incident_id LEFT JOIN bn ON bn.id = r.id),
near AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY distance, id) <= 15),
asked AS (SELECT incident_id, {TOKENS_SQL.format('query')} AS w FROM queries),
books AS (SELECT id, {TOKENS_SQL.format("concat_ws(' ', nullif(title, ''), nullif(category, ''), nullif(content, ''))")} AS w FROM runbooks),
scored AS (SELECT n.incident_id, n.id AS runbook_id, n.distance,
  round(5.0 * (cast(len(list_intersect(a.w, k.w)) AS double) / len(a.w)) + 1.0 / (1.0 + n.distance), 6) AS score
  FROM near n JOIN asked a USING (incident_id) JOIN books k USING (id))
SELECT incident_id, runbook_id, distance, score, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, distance, runbook_id) AS rank
FROM scored QUALIFY rank <= 3"""


@query(f"WITH {ENCODED_SQL}")
def search_runbooks_encoded(spark, d):
    """Search with the default encoder on both sides."""
    books = fx.runbooks(spark, d)
    queries = rca.incident_queries(fx.incidents(spark, d), fx.enriched(spark, d))
    found = retrieve.search_runbooks(queries, books, stage(vec.index_runbooks(books), "vectors"))
    return found.select(
        F.col("query_id").alias("incident_id"), "runbook_id", "distance", "score", big("rank", "rank")
    )


REPORT_SQL = SEARCH_SQL + f""",
shown AS (SELECT f.incident_id, f.rank, r.title, r.category, r.content, {flat_sql('r.content')} AS flat
  FROM found f JOIN runbooks r ON r.id = f.runbook_id),
lists AS (SELECT incident_id,
  string_agg(rank || '. **' || title || '** (' || category || ')' || chr(10) || '   - ' || {SNIPPET_SQL.format('flat')}, chr(10) ORDER BY rank) AS lines,
  string_agg('Runbook ' || rank || ': ' || title || ' (' || category || ')' || chr(10) || substr(content, 1, 800), chr(10) || chr(10) ORDER BY rank) AS entries
  FROM shown GROUP BY incident_id),
reports AS (SELECT q.incident_id, '### Root Cause Analysis' || chr(10) || chr(10) || 'The triggering log pattern `'
  || coalesce(nullif(sequence, ''), 'unknown template sequence') || '` aligns with a likely operational issue in the application stack.'
  || chr(10) || chr(10) || 'Triggering log: `' || raw_message || '`' || chr(10) || chr(10)
  || coalesce('### Relevant runbook guidance' || chr(10) || lines || chr(10) || chr(10), '') || '### Recommended Actions' || chr(10)
  || '1. Validate the failing service and recent deploy activity.' || chr(10)
  || '2. Inspect resource saturation and dependency health for the affected host.' || chr(10)
  || '3. Apply the matching runbook steps and confirm the fix with targeted checks.' AS report,
  'You are the Log analytics incident RCA assistant. Analyze the triggering log and use the relevant runbooks to produce a concise Markdown incident report.'
  || chr(10) || chr(10) || 'Template sequence: ' || coalesce(nullif(sequence, ''), 'unknown') || chr(10) || 'Triggering log: ' || raw_message
  || chr(10) || chr(10) || 'Relevant runbooks:' || chr(10) || coalesce(entries, 'No runbook matches were found.') || chr(10) || chr(10)
  || 'Return only a polished Markdown document with sections ''### Root Cause Analysis'', ''### Recommended Actions'', and a brief summary.' AS prompt
  FROM queries q LEFT JOIN lists USING (incident_id))"""


@query(f"WITH {REPORT_SQL} SELECT incident_id, report FROM reports")
def incident_rca(spark, d):
    made = rca.incident_rca(given_queries(spark, d), fx.runbooks(spark, d), fx.vectors(spark, d))
    return made.select(F.col("query_id").alias("incident_id"), F.col("text").alias("report"))


@query(f"WITH {REPORT_SQL} SELECT incident_id, prompt FROM reports")
def rca_prompt(spark, d):
    queries, books = stage(given_queries(spark, d), "queries"), fx.runbooks(spark, d)
    found = stage(retrieve.search_runbooks(queries, books, fx.vectors(spark, d)), "found")
    return rca.prompts(queries, found, books).select(
        F.col("query_id").alias("incident_id"), F.col("text").alias("prompt")
    )


@query(f"""WITH {REPORT_SQL} SELECT i.id, i.status, CASE WHEN rca_markdown = '' OR rca_markdown LIKE '%FAISS-backed RAG retrieval%'
  THEN report ELSE rca_markdown END AS rca_markdown FROM incidents i LEFT JOIN reports r ON r.incident_id = i.id""")
def backfill_rca(spark, d):
    found = fx.incidents(spark, d)
    made = rca.incident_rca(given_queries(spark, d, needed=True), fx.runbooks(spark, d), fx.vectors(spark, d))
    return inc.replace_reports(
        found, made.select(F.col("query_id").alias("id"), F.col("text").alias("rca_markdown"))
    ).select("id", "status", "rca_markdown")


# --- streams ----------------------------------------------------------------------

def feed(df: DataFrame, folder: str, slices: int, start: Callable, fmt: str = "parquet", late: bool = False) -> None:
    """Write ``df`` in time slices and run the stream after each, as data would arrive; ``late``: the last slice first."""
    spark = df.sparkSession
    edges = df.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    step = (edges["b"] - edges["a"]) / slices
    for i in range(slices - 1, -1, -1) if late else range(slices):
        part = df
        if i > 0:
            part = part.where(F.col("timestamp") >= F.lit(edges["a"] + step * i))
        if i < slices - 1:
            part = part.where(F.col("timestamp") < F.lit(edges["a"] + step * (i + 1)))
        part = part.select("value") if fmt == "text" else part
        part.write.mode("append").format(fmt).save(folder)
        start(spark.readStream.schema(part.schema).format(fmt).load(folder)).awaitTermination()


def _paths(spark, name, *parts):
    root = new_path(spark, name)
    return [f"{root}/{part}" for part in parts]


def _ingested(spark, d):
    source, valid, rejected, checkpoint = _paths(spark, "ingest", "in", "valid", "rejected", "checkpoint")
    requests = fx.ingest_requests(spark, d)
    feed(requests, source, 2, lambda stream: jobs.ingest_stream(stream, valid, rejected, checkpoint))
    return tables.load_logs(spark, valid), spark.read.parquet(rejected)


@query(SQL["append_logs"])
def ingest_stream(spark, d):
    """Ingested logs, read as any stored logs are."""
    return explore.log_entry(_ingested(spark, d)[0]).withColumn("timestamp", ts("timestamp"))


@query(f"""WITH {fx.REQUESTS_SQL} SELECT id, source_host, log_level, raw_message FROM requests
  WHERE NOT (coalesce(length(source_host) BETWEEN 1 AND 100, false) AND coalesce(log_level IN ('ERROR','WARN','INFO'), false)
  AND coalesce(length(raw_message) >= 1, false))""")
def ingest_rejected(spark, d):
    return _ingested(spark, d)[1].select("id", "source_host", "log_level", "raw_message")


@query(f"""WITH {fx.REQUESTS_SQL}, ok AS (SELECT * FROM requests WHERE length(source_host) BETWEEN 1 AND 100
  AND log_level IN ('ERROR','WARN','INFO') AND length(raw_message) >= 1)
  SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S.%f') AS bucket, count(*) AS n FROM ok
  WHERE timestamp >= {DAY_SQL} GROUP BY 1""")
def ingested_volume(spark, d):
    """The chart of logs that a stream has stored."""
    return analytics.log_volume(_ingested(spark, d)[0], *times.window_start("24h", fx.NOW)).withColumn("bucket", ts("bucket"))


@query(f"""WITH {fx.LOGS_SQL} SELECT 'hdfs-datanode-01' AS source_host,
  log_level, raw_message, count(*) AS n FROM logs GROUP BY ALL""")
def replay(spark, d):
    source, out, checkpoint = _paths(spark, "replay", "in", "out", "checkpoint")
    lines = fx.logs(spark, d).select("timestamp", F.col("raw_message").alias("value"))

    def start(_):
        stream = ln.replay(spark, source, files_per_trigger=4)
        return stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start()

    feed(lines, source, 2, start, "text")
    return spark.read.parquet(out).groupBy("source_host", "log_level", "raw_message").agg(F.count("*").alias("n"))


@query(SQL["block_history"])
def stream_block_state(spark, d):
    source, out, state, checkpoint = _paths(spark, "history", "in", "out", "state", "checkpoint")
    logs = fx.enriched(spark, d)
    feed(logs, source, 2, lambda stream: history.stream_block_state(stream, out, state, checkpoint))
    return spark.read.parquet(out).select(
        "id", "block_id", F.array_join("tokens", " ").alias("sequence"), big(F.size("tokens"), "seq_len")
    )


CHAIN = ("valid", "rejected", "catalog", "scored", "incidents", "scratch")
CHAIN_SQL = "WITH " + CATALOG_SQL + fx.REQUESTS_SQL[len(fx.LOGS_SQL):] + f""",
ok AS (SELECT id FROM requests WHERE length(source_host) BETWEEN 1 AND 100 AND log_level IN ('ERROR','WARN','INFO') AND length(raw_message) >= 1),
middle AS (SELECT epoch_us(min(timestamp)) + (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 2 AS mid FROM logs),
halves AS (SELECT tlogs.*, list_distinct(regexp_extract_all(raw_message, '(blk_-?[0-9]+)', 1)) AS blocks, {BLOCK_SQL} AS block_id, epoch_us(timestamp) >= (SELECT mid FROM middle) AS half
  FROM tlogs SEMI JOIN ok ON ok.id = tlogs.id),
mentioned AS (SELECT half, unnest(blocks) AS block_id, timestamp, id, template_id FROM halves),
earliest AS (SELECT *, row_number() OVER (PARTITION BY half, block_id ORDER BY timestamp, id) AS rn FROM mentioned QUALIFY rn <= 250),
seen AS (SELECT o.id, o.template_id, o.block_id,
  concat_ws(' ', string_agg('E' || e.template_id, ' ' ORDER BY e.timestamp, e.id), 'E' || any_value(o.template_id)) AS sequence, count(e.id) + 1 AS seq_len
  FROM halves o LEFT JOIN earliest e ON o.block_id = e.block_id AND o.half = e.half
  AND (e.timestamp < o.timestamp OR (e.timestamp = o.timestamp AND e.id < o.id)) GROUP BY o.id, o.template_id, o.block_id)
SELECT id, template_id, block_id, sequence, seq_len, cast(len(list_distinct(string_split(sequence, ' '))) AS bigint) AS unique_templates FROM seen"""


@query(CHAIN_SQL)
def request_chain(spark, d):
    """Requests to scored logs in one stream, with the later half coming in first."""
    source, checkpoint, *names = _paths(spark, "chain", "in", "checkpoint", *CHAIN)
    requests = fx.ingest_requests(spark, d)
    where = dict(zip(CHAIN, names))
    model = trained(spark, d)[1]
    feed(requests, source, 2, lambda stream: chain.request_chain(stream, model, where, checkpoint), late=True)
    return spark.read.parquet(where["scored"]).select(
        "id", "template_id", "block_id", "sequence", big("seq_len", "seq_len"), big("unique_templates", "unique_templates"))


ISO_SQL = """CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END"""


@query(f"""WITH {SCORED_SQL} SELECT id, id AS trigger_log_id, 'OPEN' AS status,
  CASE WHEN lower(raw_message) LIKE '%fatal%' OR lower(raw_message) LIKE '%connection%' THEN 'CRITICAL'
    WHEN lower(raw_message) LIKE '%error%' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN lower(raw_message) LIKE '%connection%' OR lower(raw_message) LIKE '%slot%'
    THEN 'PostgreSQL Connection Pool Exhaustion' ELSE concat(log_level, ' anomaly from ', source_host) END AS title,
  '### Root Cause Analysis' || chr(10) || chr(10) || 'Log analytics anomaly detection flagged a ' || log_level || ' log from `' || source_host
  || '` at `' || {ISO_SQL} || '`. The triggering message was:' || chr(10) || chr(10) || '`' || raw_message || '`'
  || chr(10) || chr(10) || 'Parsed template: `' || parsed_template || '`' || chr(10) || chr(10) || '### Model Signal' || chr(10)
  || '- Isolation Forest decision score: `' || format('{{:.6f}}', score) || '`' || chr(10) || '- Template sequence length: `' || seq_len || '`' || chr(10)
  || '- Unique templates in sequence: `' || unique_templates || '`' || chr(10) || '- Template sequence: `' || sequence || '`' || chr(10)
  || chr(10) || chr(10) || '### Recommended Actions' || chr(10)
  || '1. Inspect the emitting service and recent deploy activity.' || chr(10)
  || '2. Check resource pressure and dependency health for the affected host.' || chr(10)
  || '3. Attach the relevant runbook once FAISS-backed RAG retrieval is enabled.' || chr(10) || chr(10)
  || '_Generated placeholder RCA at ' || {ISO_SQL} || '+00:00._' AS rca_markdown
  FROM logs_scored WHERE is_anomaly""")
def stream_incidents(spark, d):
    """Logs with the ids of the model's own catalogue, scored as they come."""
    source, out, state, checkpoint = _paths(spark, "raised", "in", "out", "state", "checkpoint")
    base, model = trained(spark, d)
    logs = stage(tpl.enrich_logs(base, model.templates), "own")
    feed(logs, source, 2, lambda stream: jobs.stream_incidents(stream, model, out, state, checkpoint))
    return spark.read.parquet(out).select("id", "severity", "title", "status", "trigger_log_id", "rca_markdown")


@query(f"""WITH {fx.LOGS_SQL} SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S.%f') AS bucket, count(*) AS n FROM logs
  GROUP BY date_trunc('hour', timestamp)""")
def stream_volume(spark, d):
    """Every hour, with the later slice of the logs coming in first."""
    source, out, checkpoint = _paths(spark, "volume", "in", "out", "checkpoint")
    logs = fx.logs(spark, d)
    feed(logs, source, 2, lambda stream: jobs.stream_volume(stream, "hour", out, checkpoint), late=True)
    return jobs.read_volume(spark, out).select(ts("bucket"), "n")


@query(SQL["assign_templates"])
def stream_templates(spark, d):
    source, catalog, out, checkpoint = _paths(spark, "learn", "in", "catalog", "out", "checkpoint")
    logs = fx.logs(spark, d)
    feed(logs, source, 2, lambda stream: jobs.stream_templates(stream, catalog, out, checkpoint))
    return spark.read.parquet(out).select("id", "template_id", "parsed_template")


@query(SQL["update_status"])
def stream_status(spark, d):
    source, out, checkpoint = _paths(spark, "status", "in", "out", "checkpoint")
    updates = fx.status_updates(spark, d)
    feed(
        updates.withColumn("timestamp", F.col("ts")), source, 2,
        lambda stream: jobs.stream_status(stream, out, checkpoint),
    )
    return jobs.current_incidents(fx.incidents(spark, d), out).select(
        "id", "severity", "status", ts("updated_at")
    )
