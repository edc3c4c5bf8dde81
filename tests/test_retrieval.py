from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslog.operators import rca, retrieve, vectors as vec
from opslog.schema import INCIDENTS, RUNBOOKS

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(90, 8)).round(1)
    data[10] = data[11] = data[12]  # ties
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(data)]
    return data, spark.createDataFrame(rows, "runbook_id long, embedding array<float>")


@pytest.mark.parametrize("block,batch,k,shared", [(4096, 512, 5, 10 ** 6), (7, 9, 5, 10 ** 6), (7, 9, 200, 0), (7, 9, 5, 0)])
def test_knn_against_brute_force(spark, points, block, batch, k, shared):
    data, df = points
    got = vec.knn_l2(
        df.withColumnRenamed("runbook_id", "query_id"), df, k, block_vectors=block, query_batch=batch,
        shared_bytes=shared, batches_per_task=3,
    )
    rows = sorted((r["query_id"], r["rank"], r["runbook_id"]) for r in got.collect())
    small = data.astype(np.float32).astype(float)
    d = np.round(((small[:, None] - small[None]) ** 2).sum(axis=2), 6)
    want = []
    for q in range(90):
        order = sorted(range(90), key=lambda i: (d[q, i], i))[:k]
        want += [(q, rank, i) for rank, i in enumerate(order, 1)]
    assert rows == want


def test_huge_distances_rank_the_same():
    d = np.array([[3e18, 1e18, 3e18, 0.0]])
    assert vec.nearest_columns(d, 3).tolist() == [[3, 1, 0]]
    assert vec.nearest_columns(np.array([[2.0, 1.0, 1.0]]), 2).tolist() == [[1, 2]]


def test_no_pairs_are_formed(spark, points):
    _, df = points
    plan = vec.knn_l2(df.withColumnRenamed("runbook_id", "query_id"), df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_mixed_dimensions_are_rejected(spark):
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "runbook_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        vec.knn_l2(queries, mixed, 1).collect()


def test_no_vectors_no_rows(spark):
    none = spark.createDataFrame([], "runbook_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert vec.knn_l2(queries, none, 3).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(1, "pool pool disk"), (2, "disk POOL"), (3, ""), (4, None)], "id int, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in vec.embed_texts(df, "t").collect()}
    assert got[1].shape == (384,) and abs(np.linalg.norm(got[1]) - 1) < 1e-6
    assert (got[1] == got[2]).all() and not got[3].any() and not got[4].any()


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([
        (10, "Database connection pool issue", "database", "Restart the pool when the database is exhausted.", T0, None),
        (11, "Network packet loss", "network", "Check the switch.", T0, None),
        (12, "Disk full", "storage", "Free some space on the disk.", T0, None),
    ], RUNBOOKS)


def queries(spark):
    rows = [(1, "E1", "database connection pool exhausted"), (2, "", "disk is full"), (3, "", "disk is full")]
    return spark.createDataFrame(rows, "query_id long, sequence string, raw_message string")


@pytest.mark.parametrize("split_rows", [1, 10 ** 6])
def test_search_prefers_the_relevant_runbook(spark, books, split_rows):
    found = retrieve.search_runbooks(queries(spark), books, vec.index_runbooks(books), top_k=2, split_rows=split_rows)
    got = {(r["query_id"], r["rank"]): r["runbook_id"] for r in found.collect()}
    assert len(got) == 6
    assert (got[1, 1], got[2, 1], got[3, 1]) == (10, 12, 12)


def test_search_in_an_empty_index(spark, books):
    none = vec.index_runbooks(books).where(F.lit(False))
    assert retrieve.search_runbooks(queries(spark), books, none).count() == 0
    reports = rca.incident_rca(queries(spark), books, none).collect()
    assert len(reports) == 3 and all("guidance" not in r["text"] for r in reports)


def test_candidates_without_a_runbook_are_skipped(spark, books):
    index = vec.index_runbooks(books)
    found = retrieve.search_runbooks(queries(spark), books.where("id != 10"), index)
    assert {r["runbook_id"] for r in found.collect()} == {11, 12}


def test_backfill(spark, books, make_logs):
    logs = make_logs([("database connection pool exhausted", 512)])
    rows = [(1, 0, ""), (2, None, "once FAISS-backed RAG retrieval is enabled"), (3, 0, "reviewed")]
    raised = spark.createDataFrame([(i, T0, T0, "HIGH", "t", "OPEN", t, r) for i, t, r in rows], INCIDENTS)
    got = {r["id"]: r["rca_markdown"] for r in rca.backfill_rca(raised, logs, books, vec.index_runbooks(books)).collect()}
    assert "pattern `512` aligns" in got[1] and "1. **Database connection pool issue** (database)" in got[1]
    assert "unknown template sequence" in got[2] and got[3] == "reviewed"


def test_prompt_cuts_the_runbook(spark, books):
    long = books.withColumn("content", F.repeat(F.lit("pool "), 400))
    found = retrieve.search_runbooks(queries(spark), long, vec.index_runbooks(long), top_k=1)
    got = rca.prompts(queries(spark), found, long).collect()
    assert all(("pool " * 160) in r["text"] and ("pool " * 161) not in r["text"] for r in got)


def test_the_index_is_not_broadcast(spark, points):
    _, df = points
    plan = vec.knn_l2(df.withColumnRenamed("runbook_id", "query_id"), df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "collect_list" not in plan


def test_each_embedding_is_searched_once(spark, books, monkeypatch):
    asked, knn = [], retrieve.knn_l2
    monkeypatch.setattr(retrieve, "knn_l2", lambda q, *more: (asked.append(q.count()), knn(q, *more))[1])
    one = queries(spark).withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(0.5).cast("float")))
    index = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [5.0, 5.0])], "runbook_id long, embedding array<float>")
    got = {(r["query_id"], r["runbook_id"]): r["distance"] for r in retrieve.search_runbooks(one, books, index, top_k=3).collect()}
    assert asked == [1]  # two different questions, three incidents
    assert len(got) == 9 and got[1, 10] == got[2, 10] == 0.25


def test_the_block_order_does_not_matter():
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(40, 6)).round(1), rng.normal(size=(500, 6)).round(1)
    v[7:30] = v[0]
    v[99, 2] = np.nan
    ids, k = rng.permutation(500), 9
    best = vec._Nearest(q, k)
    for i in range(0, 500, 61):
        best.add(ids[i:i + 61], np.zeros(len(ids[i:i + 61]), dtype=bool), v[i:i + 61])
    d = np.round(((q[:, None] - v[None]) ** 2).sum(axis=2), 6)
    want = [ids[np.lexsort((ids, row))[:k]].tolist() for row in d]
    assert best.id.reshape(40, k).tolist() == want and best.filled.all()


def test_a_repeated_query_id_does_not_change_others(spark, books):
    rows = [(1, "alpha", [0.0, 0.0]), (1, "alpha", [5.0, 5.0]), (2, "beta", [5.0, 5.0])]
    asked = spark.createDataFrame([(i, "", t, e) for i, t, e in rows],
                                  "query_id long, sequence string, raw_message string, embedding array<float>")
    index = spark.createDataFrame([(10, [0.0, 0.0]), (11, [5.0, 5.0]), (12, [9.0, 9.0])], "runbook_id long, embedding array<float>")
    got = retrieve.search_runbooks(asked, books, index, top_k=3).where("query_id = 2").collect()
    assert {r["runbook_id"]: r["distance"] for r in got} == {10: 50.0, 11: 0.0, 12: 32.0} and len(got) == 3
