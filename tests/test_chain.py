"""The stream from request to incident against the batch operators."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslog.operators import scoring, sequences as sq, templates as tpl, training
from opslog.streaming import chain, jobs
from opslog.sources import tables

COLUMNS = ["id", "timestamp", "source_host", "log_level", "raw_message"]


def run(spark, requests, model, folder, slices, **more):
    """Feed slices of requests, given as conditions; returns the paths."""
    where = {name: f"{folder}/{name}" for name in ("valid", "rejected", "catalog", "scored", "incidents", "scratch")}
    for part in slices:
        requests.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(requests.schema).parquet(f"{folder}/in")
        chain.request_chain(stream, model, where, f"{folder}/checkpoint", **more).awaitTermination()
    return where


@pytest.fixture(scope="module")
def logs(make_logs):
    rng, rows = random.Random(3), []
    for block in range(30):
        kinds = ["open", "write", "close"] if block % 15 else ["panic error", "reset", "panic error"] * 3
        rows += [f"{k} blk_{block}" + (f" after blk_{rng.randrange(30)}" if rng.random() < 0.2 else "") for k in kinds]
    rng.shuffle(rows)
    return make_logs([(r, None) for r in [*rows, "no block here"]])


@pytest.fixture(scope="module")
def model(logs):
    return training.train_model(logs, contamination=0.1)


def key(df, *columns):
    return sorted(map(tuple, df.select("id", *columns).collect()))


def test_chain_equals_batch_with_a_late_slice(spark, logs, model, tmp_path):
    bad = F.when(F.col("id") % 17 == 0, "").otherwise(F.col("source_host"))
    requests = logs.select(*COLUMNS).withColumn("source_host", bad)
    late = F.col("id").between(30, 60)
    where = run(spark, requests, model, str(tmp_path), [F.col("id") < 30, F.col("id") > 60, late])
    valid = logs.where("id % 17 <> 0")
    assert key(tables.load_logs(spark, where["valid"])) == key(valid)
    assert key(spark.read.parquet(where["rejected"])) == key(logs.where("id % 17 = 0"))
    want = []
    for arrived, these in (("id < 30", "id < 30"), ("id < 30 or id > 60", "id > 60"), ("true", "id between 30 and 60")):
        want.append(scoring.score_logs(valid.where(arrived), model).where(these))
    want = want[0].unionByName(want[1]).unionByName(want[2])
    columns = ("block_id", "template_id", "parsed_template", "sequence", "seq_len", "unique_templates", "score", "is_anomaly")
    got = spark.read.parquet(where["scored"])
    assert key(got, *columns[:-2]) == key(want, *columns[:-2])
    both = {r["id"]: (r["score"], r["is_anomaly"]) for r in want.collect()}
    for r in got.collect():
        assert abs(r["score"] - both[r["id"]][0]) < 1e-9 and r["is_anomaly"] == both[r["id"]][1]
    raised = jobs.incident_rows(want, F.col("timestamp"))
    names = ("severity", "title", "status", "rca_markdown")
    assert key(spark.read.parquet(where["incidents"]), *names) == key(raised, *names) and raised.count()


def test_chain_learns_templates(spark, make_logs, model, tmp_path):
    new = make_logs([(f"unheard of message {w} blk_{i % 2}", None) for i, w in enumerate("abcdabcd")] + [("open blk_0", None)])
    where = run(spark, new.select(*COLUMNS), model, str(tmp_path), [F.col("id") < 3, F.col("id") >= 3], cap=3)
    rows = {r["id"]: r for r in spark.read.parquet(where["scored"]).collect()}
    assert len({rows[i]["template_id"] for i in range(8)}) == 1
    learned = rows[0]["template_id"]
    assert learned == chain.learned_id("unheard of message a <*>") and rows[3]["parsed_template"] == "unheard of message a <*>"
    assert rows[8]["template_id"] in {r["template_id"] for r in model.templates.collect()}
    assert rows[8]["sequence"].split(" ")[:3] == [f"E{learned}"] * 3 and rows[8]["seq_len"] == 4
    stored = spark.read.parquet(where["catalog"])
    assert sorted(r["masked"][19] for r in stored.collect()) == list("abcd")


def test_a_hot_block_hands_few_rows_to_its_state():
    rows = pd.DataFrame({"block_id": ["hot"] * 5000 + [f"b{i}" for i in range(300)], "micros": range(5300), "id": range(5300), "mask": "m"})
    parts = [rows.iloc[i::7].iloc[j:j + 200] for i in range(7) for j in range(0, 800, 200)]
    out = pd.concat(chain.earliest(4)(iter(parts)))
    hot = out[out["block_id"] == "hot"]
    assert sorted(hot["id"]) == [0, 1, 2, 3] and len(out) == 304


def test_a_batch_appends_to_the_history():
    class Store:
        def __init__(self):
            self.value, self.appended, self.rewritten = None, 0, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value or []

        def update(self, value):
            self.value = value

        def put(self, rows):
            self.value, self.rewritten = list(rows), self.rewritten + 1

        def appendList(self, rows):
            self.value, self.appended = [*(self.value or []), *rows], self.appended + 1

    state = chain.Firsts(4, None)
    state.entries, state.last = Store(), Store()
    put = lambda *at: next(state.handleInputRows(("b",), iter([pd.DataFrame(
        {"micros": at, "id": at, "mask": [str(x) for x in at]})]), None)).iloc[0]["ids"]
    assert put(5, 3) == [3, 5] and put(9) == [3, 5, 9] and state.entries.rewritten == 0
    assert put(4) == [3, 4, 5, 9] and state.entries.rewritten == 1
    assert put(20, 30) == [3, 4, 5, 9] and state.entries.appended == 2 and state.entries.rewritten == 1
    assert put(1, 40) == [1, 3, 4, 5] and state.last.value == (4, 5, 5)


def test_chain_runs_in_a_session_without_rocksdb(spark, logs, model, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    before, plain = spark.conf.get(store), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(store, plain)
    try:
        where = run(spark, logs.select(*COLUMNS), model, str(tmp_path), [F.col("id") < 30, F.col("id") >= 30])
        assert spark.conf.get(store) == plain
    finally:
        spark.conf.set(store, before)
    assert spark.read.parquet(where["scored"]).count() == logs.count()
