import random

from pyspark.sql import functions as F

from opslog.operators import scoring, sequences as sq, templates as tpl, training
from opslog.streaming import history, jobs
from opslog.sources import lines, tables


def feed(spark, df, folder, cuts, start):
    """Write rows up to each cut and let the stream catch up."""
    low = None
    for cut in [*cuts, None]:
        part = df if low is None else df.where(F.col("id") >= low)
        part = part if cut is None else part.where(F.col("id") < cut)
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(df.schema).parquet(folder)).awaitTermination()
        low = cut


def paths(tmp_path, *names):
    return [str(tmp_path / n) for n in names]


def test_ingest(spark, make_logs, tmp_path):
    logs = make_logs([("database connection pool exhausted" if i % 3 else "", None) for i in range(30)])
    requests = logs.select("id", "timestamp", "source_host", "log_level", "raw_message")
    source, valid, rejected, check = paths(tmp_path, "in", "valid", "rejected", "check")
    feed(spark, requests, source, [10], lambda s: jobs.ingest_stream(s, valid, rejected, check))
    assert spark.read.parquet(valid).count() == 20 and spark.read.parquet(rejected).count() == 10
    # a second run without new files changes nothing
    again = jobs.ingest_stream(spark.readStream.schema(requests.schema).parquet(source), valid, rejected, check)
    again.awaitTermination()
    assert spark.read.parquet(valid).count() == 20


def test_history_equals_batch(spark, make_logs, tmp_path):
    rng = random.Random(2)
    rows = [
        (" ".join(["m"] + [f"blk_{rng.choice([1, 1, 2, 3])}" for _ in range(rng.choice([0, 1, 2]))]), rng.choice([None, 1, 2, 3]))
        for _ in range(300)
    ]
    logs = make_logs(rows)
    source, out, state, check = paths(tmp_path, "in", "out", "state", "check")
    feed(spark, logs, source, [90, 200], lambda s: history.stream_block_state(s, out, state, check, cap=20))
    got = {r["id"]: r["tokens"] for r in spark.read.parquet(out).collect()}
    want = {r["id"]: r["tokens"] for r in sq.block_history(logs, 20).collect()}
    assert got == want


def test_incidents_equal_batch(spark, make_logs, tmp_path):
    rows = []
    for block in range(40):
        kinds = ["open", "write", "close"] if block % 20 else ["panic error", "reset", "panic error"] * 3
        rows += [(f"{k} blk_{block}", None) for k in kinds]
    logs = make_logs(rows)
    model = training.train_model(logs, contamination=0.1)
    enriched = tpl.assign_templates(logs, model.templates).cache()
    source, out, state, check = paths(tmp_path, "in", "out", "state", "check")
    feed(spark, enriched, source, [60], lambda s: jobs.stream_incidents(s, model, out, state, check))
    want = jobs.incident_rows(scoring.score_logs(logs, model), F.col("timestamp"))
    key = lambda df: sorted(tuple(r) for r in df.select("id", "severity", "title", "status", "rca_markdown").collect())
    got = key(spark.read.parquet(out))
    assert got == key(want) and got
    assert all("Model Signal" in r[4] and r[3] == "OPEN" for r in got)


def test_volume_counts_late_and_open_hours(spark, make_logs, tmp_path):
    logs = make_logs([("m", None, 600 * i) for i in range(60)])
    source, out, check = paths(tmp_path, "in", "out", "check")
    start = lambda s: jobs.stream_volume(s, "hour", out, check).awaitTermination()
    for part in (logs.where("id >= 20"), logs.where("id < 20")):
        part.write.mode("append").parquet(source)
        start(spark.readStream.schema(logs.schema).parquet(source))
    got = [r["n"] for r in jobs.read_volume(spark, out).orderBy("bucket").collect()]
    assert got == [6] * 10


def test_ingested_logs_are_in_the_charts(spark, make_logs, tmp_path):
    logs = make_logs([("m", None, 600 * i) for i in range(60)]).select("id", "timestamp", "source_host", "log_level", "raw_message")
    source, valid, bad, check = paths(tmp_path, "in", "valid", "bad", "check")
    tables.append_logs(logs.where("id < 5"), valid)
    feed(spark, logs.where("id >= 5"), source, [30], lambda s: jobs.ingest_stream(s, valid, bad, check))
    stored = tables.load_logs(spark, valid)
    assert stored.count() == 60 and stored.where("dt is null").count() == 0
    tables.append_logs(logs.where("id >= 50"), valid, 1)
    tables.append_logs(logs.where("id >= 50"), valid, 1)
    assert tables.load_logs(spark, valid).where("id >= 50").count() >= 10


def test_late_logs_enter_a_full_history(spark, make_logs, tmp_path):
    late = make_logs([("blk_1 x", 70 + i, i) for i in range(3)])
    early = make_logs([("blk_1 x", 1 + i, 10 + i) for i in range(6)]).withColumn("id", F.col("id") + 100)
    last = make_logs([("blk_1 x", 50, 99)]).withColumn("id", F.lit(999).cast("long"))
    source, out, state, check = paths(tmp_path, "in", "out", "state", "check")
    for part in (early, late, last):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(early.schema).parquet(source)
        history.stream_block_state(stream, out, state, check, cap=4).awaitTermination()
    got = {r["id"]: " ".join(r["tokens"]) for r in spark.read.parquet(out).collect()}
    assert got[999] == "E70 E71 E72 E1 E50" and got[2] == "E70 E71 E72" and got[105] == "E1 E2 E3 E4 E6"


def test_templates_equal_batch_on_union(spark, make_logs, tmp_path):
    logs = make_logs([(f"kind {'abcdef'[i // 10]} number {i}", None) for i in range(60)])
    source, catalog, out, check = paths(tmp_path, "in", "catalog", "out", "check")
    feed(spark, logs, source, [25, 26], lambda s: jobs.stream_templates(s, catalog, out, check))
    got = {(r["template_id"], r["template"]) for r in jobs.read_catalog(spark, catalog).collect()}
    want = {(r["template_id"], r["template"]) for r in tpl.template_catalog(logs).collect()}
    assert got == want and spark.read.parquet(out).where("template_id is null").count() == 0


def test_replay_and_tail(spark, tmp_path):
    source, out, check = paths(tmp_path, "in", "out", "check")
    spark.createDataFrame([("ERROR a",), (" ",), ("it failed",)], "value string").coalesce(1).write.text(source)

    def run(stream, name):
        stream.writeStream.format("parquet").option("path", f"{out}/{name}").option(
            "checkpointLocation", f"{check}/{name}").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["log_level"] for r in spark.read.parquet(f"{out}/{name}").collect())

    assert run(lines.replay(spark, source), "replay") == ["ERROR", "INFO"]
    assert run(lines.tail_logs(spark, source), "tail") == ["ERROR", "ERROR"]
