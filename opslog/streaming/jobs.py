"""Streams over the log table: ingest, incidents, volume, templates, status.

Every sink stores a micro-batch under its own number, so a batch that is
repeated after a failure replaces itself. ``trigger`` takes the arguments of
Spark's trigger; by default a stream works off what is there and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from opslog.functions import report, rules
from opslog.functions.text import mask_template
from opslog.operators import incidents as inc
from opslog.operators.scoring import incident_gate, load_scorer, score_histories
from opslog.operators.templates import CATALOG, enrich_logs, masked_counts, match_templates, mine_templates
from opslog.operators.validate import validate_logs
from opslog.schema import STATUS_UPDATES
from opslog.sources.models import Model
from opslog.session import stage
from opslog.sources.tables import append_logs, load_table, new_incidents, write_batch
from opslog.streaming.history import AVAILABLE, history_batches

VOLUME = T.StructType([T.StructField("bucket", T.TimestampType()), T.StructField("n", T.LongType())])


def _start(stream: DataFrame, on_batch, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE)).start()
    )


def ingest_stream(source: DataFrame, valid_path: str, rejected_path: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Validate and store; logs have no template yet and lie by date, where charts look for them."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = validate_logs(batch)
        append_logs(valid, valid_path, batch_id)
        write_batch(rejected, rejected_path, batch_id)

    return _start(source, on_batch, checkpoint, trigger)


def incident_rows(scored: DataFrame, created_at) -> DataFrame:
    """Incident rows of the anomalous logs, with rule-based fields and the first report."""
    context = report.signal_context(
        F.col("score"), F.col("seq_len"), F.col("unique_templates"), F.col("sequence")
    )
    return new_incidents(
        incident_gate(scored),
        rules.classify_severity(F.col("raw_message")),
        rules.incident_title(F.col("log_level"), F.col("source_host"), F.col("raw_message")),
        report.rca_signal_markdown(
            F.col("log_level"), F.col("source_host"), F.col("timestamp"), F.col("raw_message"),
            F.col("parsed_template"), created_at, context,
        ),
        created_at,
    )


def stream_incidents(logs: DataFrame, model: Model, path: str, scratch: str, checkpoint: str,
                     trigger: dict | None = None) -> StreamingQuery:
    """Score enriched logs against their block's history and open incidents; the model is loaded once."""
    scorer = load_scorer(model)

    def on_history(rows: DataFrame, batch_id: int) -> None:
        write_batch(incident_rows(score_histories(rows, scorer), F.col("timestamp")), path, batch_id)

    return history_batches(logs, on_history, scratch, checkpoint, trigger=trigger)


def stream_volume(logs: DataFrame, grain: str, path: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Store each batch's logs per hour or day; ``read_volume`` sums them.

    Every row counts, however late, and open buckets are there at once.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.date_trunc(grain, "timestamp").alias("bucket")).agg(F.count("*").alias("n"))
        write_batch(counts, path, batch_id)

    return _start(logs, on_batch, checkpoint, trigger)


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """Logs per bucket over all batches so far."""
    return load_table(spark, path, VOLUME).groupBy("bucket").agg(F.sum("n").alias("n"))


def read_catalog(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The catalogue as stored by batches with a number below ``before``."""
    stored = load_table(spark, path, T.StructType([*CATALOG.fields, T.StructField("batch_id", T.IntegerType())]))
    return stored if before is None else stored.where(F.col("batch_id") < before)


def stream_templates(logs: DataFrame, catalog_path: str, enriched_path: str, checkpoint: str,
                     trigger: dict | None = None) -> StreamingQuery:
    """Assign templates and learn new ones.

    An unseen message takes the earliest similar leader known so far; what has
    none is mined, and its new ids follow the known ones in first-seen order.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        known = read_catalog(batch.sparkSession, catalog_path, batch_id)
        unseen = masked_counts(batch).join(known.select("masked"), "masked", "left_anti").select("masked", "n")
        matched = stage(match_templates(unseen, known).select(*CATALOG.fieldNames()), "matched")
        rest = unseen.join(matched, "masked", "left_anti").select("masked")
        fresh = batch.withColumn("masked", mask_template(F.col("raw_message"))).join(rest, "masked", "left_semi")
        top = known.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
        mined = mine_templates(fresh).withColumn("template_id", F.col("template_id") + top)
        write_batch(matched.unionByName(mined), catalog_path, batch_id)
        catalog = read_catalog(batch.sparkSession, catalog_path, batch_id + 1)
        write_batch(enrich_logs(batch, catalog), enriched_path, batch_id)

    return _start(logs, on_batch, checkpoint, trigger)


def stream_status(updates: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each batch's last write per incident to the status log."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(inc.latest_status(batch), path, batch_id)

    return _start(updates, on_batch, checkpoint, trigger)


def current_incidents(incidents: DataFrame, status_path: str) -> DataFrame:
    """The incidents with the status log applied."""
    return inc.update_status(incidents, load_table(incidents.sparkSession, status_path, STATUS_UPDATES))
