"""Table schemas and the limits on their fields."""

from pyspark.sql import types as T

# Enumerations and field limits of the log, incident and runbook records.
LOG_LEVELS = ("ERROR", "WARN", "INFO")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")
STATUSES = ("OPEN", "INVESTIGATING", "RESOLVED")
TIMEFRAMES = ("1h", "24h", "7d")
MAX_HOST = 100
MAX_TITLE = 255
MAX_CATEGORY = 100
MAX_LOG_PAGE = 500
MAX_INCIDENT_PAGE = 100
HISTORY_CAP = 250
EMBEDDING_DIM = 384

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("source_host", T.StringType(), False),
    T.StructField("log_level", T.StringType(), False),
    T.StructField("raw_message", T.StringType(), False),
    T.StructField("template_id", T.LongType(), True),
    T.StructField("parsed_template", T.StringType(), True),
])

INCIDENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("trigger_log_id", T.LongType(), True),
    T.StructField("rca_markdown", T.StringType(), False),
])

RUNBOOKS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), True),
])

VECTORS = T.StructType([
    T.StructField("runbook_id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
])

LABELS = T.StructType([
    T.StructField("BlockId", T.StringType(), True),
    T.StructField("Label", T.StringType(), True),
])

STATUS_UPDATES = T.StructType([
    T.StructField("incident_id", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
])
