import numpy as np
import pytest

from opslog.llm import neighbours

ROWS = "vec_id long, embedding array<float>, rank int"


def brute(rows, asked, k):
    out = {}
    for q, x in asked:
        away = sorted((float(np.sqrt(((np.array(y, np.float32).astype(float) - np.array(x, np.float32)) ** 2).sum())), i)
                      for i, y in rows if i != q)
        out[q] = [i for _, i in away[:k]]
    return out


def data(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16))
    return [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(3 * n)[:n], x.astype(np.float32))]


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    rows = data(1, 1500) + [(10_000 + i, [0.5] * 16) for i in range(120)]
    frame = spark.createDataFrame([(i, x, 1) for i, x in rows], ROWS)
    found = neighbours.nearest(frame, 10, frame.where("vec_id % 20 = 0"), sample=600).collect()
    asked = [(i, x) for i, x in rows if i % 20 == 0]
    want, vectors = brute(rows, asked, 10), {i: np.array(x, np.float32).astype(float) for i, x in rows}
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())
        assert r.rank == len(got[r.query_id])
    assert all(len(v) == 10 for v in got.values()) and got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert got[10_000] == [10_000 + i for i in range(1, 11)]


def test_all_leaves_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RECALL", 1.0)
    monkeypatch.setattr(neighbours, "widen", lambda *a, **b: 10**9)
    rows = data(2, 300)
    frame = spark.createDataFrame([(i, x, 1) for i, x in rows], ROWS)
    got = {}
    for r in sorted(neighbours.nearest(frame, 7).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, rows, 7)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (2, [0.0, 2.0]), (9, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, x, 1) for i, x in rows], ROWS)
    found = sorted(map(tuple, neighbours.nearest(frame, 3, frame.where("vec_id in (0, 3, 5, 6)")).collect()))
    assert [r[:3] for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 2)]
    assert found[0][3] == 0.0 and found[1][3] == pytest.approx(2 ** 0.5)
    assert neighbours.nearest(frame.limit(0)).count() == 0
    assert neighbours.nearest(frame, 3, frame.limit(0)).count() == 0
    one = frame.where("vec_id = 0")
    assert neighbours.nearest(one).count() == 0
