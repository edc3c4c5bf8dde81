import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslog.operators import analytics, explore, incidents as inc, sequences, templates, training, validate
from opslog.schema import INCIDENTS, LOGS, RUNBOOKS, STATUS_UPDATES, VECTORS
from opslog.sources import lines, models, tables

T0 = datetime(2024, 1, 1, 10)


def incident_rows(spark, rows):
    return spark.createDataFrame([
        (i, at, at, severity, "t", status, trigger, "r") for i, (at, severity, status, trigger) in enumerate(rows)
    ], INCIDENTS)


def log_rows(spark, rows):
    return spark.createDataFrame([(i, at, host, level, msg, None, None) for i, (at, host, level, msg) in enumerate(rows)], LOGS)


def test_volume_chart(spark):
    logs = log_rows(spark, [(T0, "h", "INFO", "m")] * 120 + [(T0 + timedelta(hours=1), "h", "INFO", "m")] * 80)
    raised = [(T0, "HIGH", "OPEN", None)] * 12 + [(T0 + timedelta(hours=1), "HIGH", "OPEN", None)] * 8
    raised += [(T0 + timedelta(hours=5), "HIGH", "OPEN", None)]
    got = analytics.volume_chart(logs, incident_rows(spark, raised), "24h", T0 + timedelta(hours=2)).collect()
    assert [tuple(r) for r in got] == [("2024-01-01T10:00:00", 108, 12), ("2024-01-01T11:00:00", 72, 8)]


def test_normal_logs_never_negative(spark):
    logs = log_rows(spark, [(T0, "h", "INFO", "m")])
    got = analytics.volume_chart(logs, incident_rows(spark, [(T0, "HIGH", "OPEN", None)] * 3), "24h", T0).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 3)]


def test_summary(spark):
    logs = spark.range(7200).select(*[
        (F.lit(T0) if f.name == "timestamp" else F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in LOGS.fields
    ])
    old = T0 - timedelta(days=3)
    raised = [(T0, "HIGH", "OPEN", None)] * 18 + [(old, "CRITICAL", "OPEN", None)] * 2 + [(old, "CRITICAL", "RESOLVED", None)]
    got = analytics.summary(logs, incident_rows(spark, raised), T0).first()
    assert tuple(got) == (2, 94.8, 18, 2)


def test_summary_rounds_half_to_even_and_stops_at_zero(spark):
    logs = log_rows(spark, [(T0, "h", "INFO", "m")] * 5)
    got = analytics.summary(logs, incident_rows(spark, [(T0, "CRITICAL", "OPEN", None)] * 200), T0, rate_divisor=2).first()
    assert got["ingestion_rate_per_sec"] == 2 and got["system_health_percentage"] == 0.0


def test_explore(spark):
    logs = log_rows(spark, [
        (T0 + timedelta(seconds=i), f"h{i % 2}", "ERROR" if i % 3 == 0 else "INFO", f"Message_{i}") for i in range(20)
    ])
    got = explore.explore_logs(logs, level="ERROR", source="", search="message_1", limit=2, offset=1).collect()
    assert [r["id"] for r in got] == [15, 12]
    assert explore.explore_logs(logs, search="e%9").count() == 2
    for limit, offset in [(0, 0), (501, 0), (1, -1)]:
        with pytest.raises(ValueError):
            explore.explore_logs(logs, limit=limit, offset=offset)


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    tables.append_logs(log_rows(spark, [(T0, "h", "ERROR", "m"), (T0, "h", "INFO", "m")]), path)
    plan = explore.explore_logs(tables.load_logs(spark, path), level="ERROR")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(log_level,ERROR)" in text and "TakeOrderedAndProject" in text


def test_incident_and_runbook_lists(spark):
    inc_df = incident_rows(spark, [(T0 + timedelta(minutes=i), "HIGH", "OPEN" if i % 2 else "RESOLVED", None) for i in range(6)])
    assert [r["id"] for r in explore.list_incidents(inc_df, status="OPEN", limit=2).collect()] == [5, 3]
    with pytest.raises(ValueError):
        explore.list_incidents(inc_df, limit=101)
    books = spark.createDataFrame([(1, "a", "db", "c", T0, None), (2, "b", "DB", "c", T0, None), (3, "c", "db", "c", T0, None)], RUNBOOKS)
    got = explore.list_runbooks(books, "db")
    assert [r["id"] for r in got.collect()] == [3, 1] and "content" not in got.columns
    assert explore.list_runbooks(books, "").count() == 3


def test_validation(spark):
    rows = [(1, "h", "ERROR", "m"), (2, "", "ERROR", "m"), (3, "h" * 101, "LOUD", ""), (4, None, "INFO", "m"), (5, "h" * 100, "WARN", "m")]
    df = spark.createDataFrame(rows, "id long, source_host string, log_level string, raw_message string")
    valid, rejected = validate.validate_logs(df)
    assert sorted(r["id"] for r in valid.collect()) == [1, 5]
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {
        2: "source_host", 3: "source_host,log_level,raw_message", 4: "source_host",
    }
    books = spark.createDataFrame([("t" * 255, "c", "x"), ("t" * 256, "c", "x"), ("t", "", "")], "title string, category string, content string")
    assert validate.validate_runbooks(books)[0].count() == 1


def test_incident_detail(spark):
    logs = log_rows(spark, [(T0, "h", "ERROR", "m")])
    got = inc.incident_detail(incident_rows(spark, [(T0, "HIGH", "OPEN", 0), (T0, "HIGH", "OPEN", None), (T0, "HIGH", "OPEN", 9)]), logs)
    found = {r["id"]: r["trigger_log"] for r in got.collect()}
    assert found[0]["raw_message"] == "m" and found[1] is None and found[2] is None


def test_status_updates(spark):
    raised = incident_rows(spark, [(T0, "HIGH", "OPEN", None)] * 3)
    late = T0 + timedelta(hours=1)
    updates = spark.createDataFrame([(0, "RESOLVED", late), (0, "INVESTIGATING", T0), (2, "OPEN", T0), (7, "RESOLVED", T0)], STATUS_UPDATES)
    got = {r["id"]: (r["status"], r["updated_at"]) for r in inc.update_status(raised, updates).collect()}
    assert got == {0: ("RESOLVED", late), 1: ("OPEN", T0), 2: ("OPEN", T0)}
    assert [r["incident_id"] for r in inc.unknown_updates(raised, updates).collect()] == [7]


def test_log_lines(spark, tmp_path):
    (tmp_path / "b.log").write_bytes(b"small\n")
    (tmp_path / "a.log").write_bytes(b"  one \n\n\xff two\nthree\n" + b"x\n" * 50)
    path = str(tmp_path)
    got = lines.head_lines(lines.read_log_lines(spark, path), 3)
    assert [r["value"] for r in got.orderBy("pos").collect()] == ["one", "� two", "three"]
    assert lines.read_log_lines(spark, path, keep_blank=True).count() == 55
    everything = lines.head_lines(lines.read_log_lines(spark, path), 1000).orderBy("pos").collect()
    assert len(everything) == 54 and everything[-1]["value"] == "small"


def moved_columns(df):
    """The columns that go through any exchange of rows; a broadcast is none."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return " ".join(re.findall(r"\) Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", text))


def test_lines_are_numbered_in_place(spark, tmp_path):
    """Many splits a file, several files a task, blank lines; with and without the broadcast."""
    want = []
    for f in range(6):
        rows = ["" if i % 7 == 3 else f"{f} {i} " + "x" * (i % 50) for i in range(300 if f % 2 else 5)]
        (tmp_path / f"{f} log.txt").write_text("\n".join(rows) + "\n")
        want += [r.strip() for r in rows if r]
    (tmp_path / "7 empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for sent in (1_000_000, 0):
            found = lines.number_lines(lines.read_log_lines(spark, str(tmp_path)), sent=sent)
            rows = found.orderBy("pos").collect()
            assert [r["value"] for r in rows] == want and [r["pos"] for r in rows] == list(range(1, len(want) + 1))
            assert len({(r["file"], r["block_start"]) for r in rows}) > 10
            if sent:
                assert "value#" not in moved_columns(found)
        logs = lines.lines_as_logs(found, T0).orderBy("id").collect()
        assert [r["raw_message"] for r in logs] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for n in (0, 1, 5, 6, 300, 700, 10**6):
        head = lines.read_head(spark, str(tmp_path), n).orderBy("pos").collect()
        assert [r["value"] for r in head] == want[:n]
    assert lines.last_file_of_head(spark, str(tmp_path), 3).endswith("0%20log.txt")
    assert lines.last_file_of_head(spark, str(tmp_path), 10**6) is None
    first = lines.read_log_lines(spark, str(tmp_path), last=lines.last_file_of_head(spark, str(tmp_path), 3))
    assert [r["file"].rsplit("/", 1)[1] for r in first.select("file").distinct().collect()] == ["0%20log.txt"]
    assert len(first.collect()) == 5 - 1 and first.rdd.getNumPartitions() == 1  # other files are not opened
    with pytest.raises(ValueError):
        lines.read_head(spark, str(tmp_path), -1)


def test_newest_dates_fill_a_page(spark, tmp_path):
    rows = [(i, T0 + timedelta(days=i // 4), "h", "ERROR" if i % 3 == 0 else "INFO", f"message {i}", None, None) for i in range(80)]
    logs = spark.createDataFrame(rows, LOGS)
    path = str(tmp_path / "logs")
    tables.append_logs(logs, path)
    stored = tables.load_logs(spark, path)
    dates = tables.stored_dates(stored)
    assert len(dates) == 20 and dates == sorted(dates)
    for case in ({"limit": 3}, {"limit": 5, "offset": 20}, {"limit": 10, "level": "ERROR"}, {"limit": 20, "search": "message 7"},
                 {"limit": 50, "offset": 70}, {"level": "WARN"}):
        want = explore.explore_logs(logs, **case).collect()
        assert explore.explore_stored(stored, dates, **case).collect() == want
    page = explore.explore_stored(stored, dates, limit=4)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ >= ", plan)
    assert explore.explore_stored(tables.load_logs(spark, str(tmp_path / "none")), []).count() == 0


def test_compacted_vectors_need_no_grouping(spark, tmp_path):
    path = str(tmp_path / "some vectors")
    tables.compact_vectors(spark, path)  # nothing stored yet
    one = spark.createDataFrame([(i, [float(i)]) for i in range(20)], VECTORS)
    tables.save_vectors(one, path, 1)
    assert moved_columns(tables.load_vectors(spark, path))
    tables.compact_vectors(spark, path)
    compact = tables.load_vectors(spark, path)
    assert moved_columns(compact) == "" and sorted(compact.collect()) == sorted(one.collect())
    # an older version that arrives late does not win, a newer one does
    tables.save_vectors(spark.createDataFrame([(3, [30.0]), (99, [9.0])], VECTORS), path, 2)
    tables.save_vectors(spark.createDataFrame([(4, [40.0])], VECTORS), path, 0)
    want = {**{i: [float(i)] for i in range(20)}, 3: [30.0], 99: [9.0]}
    assert {r[0]: r[1] for r in tables.load_vectors(spark, path).collect()} == want
    tables.compact_vectors(spark, path)
    tables.compact_vectors(spark, path)
    last = tables.load_vectors(spark, path)
    assert moved_columns(last) == "" and {r[0]: r[1] for r in last.collect()} == want


def test_training_from_stored_lines(spark, tmp_path):
    """File to model: lines, blocks, labels and the best of a small grid."""
    rows = [f"{verb} blk_{b}" for b in range(30) for verb in (["panic", "drop"] if b % 10 == 0 else ["open", "close"])]
    (tmp_path / "node.log").write_text("\n".join(rows) + "\n")
    (tmp_path / "labels.csv").write_text(
        "BlockId,Label\n" + "".join(f"blk_{b},{'Anomaly' if b % 10 == 0 else 'Normal'}\n" for b in range(30))
    )
    found = lines.head_lines(lines.read_log_lines(spark, str(tmp_path / "node.log")), 58).drop("pos")
    logs = lines.lines_as_logs(found, T0)
    assert [r["raw_message"] for r in logs.orderBy("timestamp", "id").collect()] == rows[:58]
    catalog = templates.mine_templates(logs)
    tokens = sequences.block_tokens(templates.enrich_logs(logs, catalog))
    result = training.grid_search(
        tokens, lines.read_labels(spark, str(tmp_path / "labels.csv")), catalog,
        vectorizers=training.VECTORIZERS[:1], contaminations=(0.1, 0.2), nus=(), kernels=(),
    )
    best, model = result.best()
    assert best["model"] == "IsolationForest"
    models.save_model(model, str(tmp_path / "model"))
    assert models.load_model(spark, str(tmp_path / "model")).forest.count() > 0


def test_labels(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("BlockId,Label\nblk_1,Anomaly\nblk_2,Normal\n")
    got = lines.read_labels(spark, str(tmp_path / "labels.csv")).orderBy("block_id").collect()
    assert [(r["block_id"], r["true_label"]) for r in got] == [("blk_1", 1), ("blk_2", 0)]


def test_missing_tables_are_empty(spark, tmp_path):
    for load in (tables.load_logs, tables.load_incidents, tables.load_runbooks, tables.load_vectors):
        assert load(spark, str(tmp_path / "nothing")).count() == 0


def test_indexing_twice_keeps_the_later_vector(spark, tmp_path):
    path, vectors = str(tmp_path / "books"), str(tmp_path / "vectors")
    book = spark.createDataFrame([(42, "pool", "db", "old words", T0, None)], RUNBOOKS)
    tables.append_runbooks(book, path, vectors, version=1)
    first = tables.load_vectors(spark, vectors).collect()
    assert [r["runbook_id"] for r in first] == [42]
    tables.append_runbooks(book.withColumn("content", F.lit("new text")), path, vectors, version=2)
    second = tables.load_vectors(spark, vectors).collect()
    assert [r["runbook_id"] for r in second] == [42] and second[0]["embedding"] != first[0]["embedding"]


def test_missing_model_parts_are_named(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "vocabulary"))
    with pytest.raises(FileNotFoundError, match="templates, scaler, forest"):
        models.load_model(spark, str(tmp_path))


def test_complete_model_loads(spark, tmp_path):
    parts = {name: spark.range(i + 1) for i, name in enumerate(models.PARTS)}
    models.save_model(models.Model(**parts), str(tmp_path))
    loaded = models.load_model(spark, str(tmp_path))
    assert [getattr(loaded, p).count() for p in models.PARTS] == [1, 2, 3, 4]
