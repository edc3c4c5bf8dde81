import random

import numpy as np
import pytest

from opslog.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string, distance string", "item_id long, text string, doc_id int"


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        kind, at = rng.random(), rng.randrange(len(words))
        if kind < 0.4:
            words[at] = f"z{rng.randrange(10**6)}"
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, f"z{rng.randrange(10**6)}")
    return words


def best(item, words):
    row = list(range(len(item) + 1))
    least = row[-1]
    for w in words:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != w)))
        row, least = new, min(least, new[-1])
    return least


def test_recall_and_distances(spark):
    rng = random.Random(3)
    items = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 60))] for _ in range(60)]
    rows, want, far = [], {}, 0
    for key in range(240):
        item = rng.randrange(60)
        n = rng.choice([0, 1, len(items[item]) // 10, len(items[item]) // 5])
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(body))
        text = body[:at] + edited(items[item], n, rng) + body[at:]
        rows.append((key, ", ".join(text).upper(), "x"))
        for i, words in enumerate(items):
            away = best(words, text)
            if away <= int(dc.EDITS * len(words)):
                want[key, i] = away
    found = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(
        spark.createDataFrame(rows, DOCS),
        spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate(items)], ITEMS)).collect()}
    assert found.keys() <= want.keys()
    assert len(found) >= 0.97 * len(want)
    assert sum(found[k] != want[k] for k in found) <= 0.02 * len(found)
    assert all(k in found for k, away in want.items() if away <= 1)


def test_walks_shared_by_an_unedited_passage_at_any_offset():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 2**63, 20).astype(np.uint64)
    index = dc.Index(item, np.array([0, 20]))
    for offset in range(7):
        text = np.concatenate([rng.integers(0, 2**63, offset).astype(np.uint64), item, rng.integers(0, 2**63, 30).astype(np.uint64)])
        first = np.array([0, len(text)])
        found = dc.confirm(index, text, first, *index.candidates(text, first))
        assert (0, 0, 0) in set(zip(*(x.tolist() for x in (found[0], found[1], found[3]))))


@pytest.mark.parametrize("sent", [2_000_000, 10])
def test_edge_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(dc, "SENT_WORDS", sent)
    line = " ".join(f"q{i}" for i in range(12))
    rows = [(1, None, ""), (2, "", ""), (3, line, ""), (3, line, ""), (None, line, ""), (4, "x " * 40_000 + line + " y" * 9, ""),
            (5, "Two, WORDS!", ""), (6, "two other words", ""), (7, line.replace(" ", "\n* "), "")]
    items = [(1, line, 0), (2, line, 0), (2, line, 0), (3, None, 0), (None, line, 0), (4, "", 0), (5, "two words", 0)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    found = sorted(tuple(r) for r in dc.find_leaks(docs, bench).collect())
    assert found == [(3, 1, 0), (3, 2, 0), (4, 1, 0), (4, 2, 0), (5, 5, 0), (7, 1, 0), (7, 2, 0)]
    assert dc.find_leaks(docs.limit(0), bench).count() == dc.find_leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [8, 10, 11, 12, 15, 20, 59])
def test_no_item_within_the_allowed_edits_is_missed(n):
    rng = np.random.default_rng(n)
    fresh = lambda k: rng.integers(0, 2**63, k).astype(np.uint64)
    index = dc.Index(fresh(n * 300), np.arange(301) * n)
    parts, k = [], int(dc.EDITS * n)
    for i in range(300):
        item = index.words[i * n:(i + 1) * n].copy()
        # half of them with edits far from each other, half anywhere
        at = ((np.arange(k) + 1) * (n + 1) // (k + 1) - 1) if i % 2 else rng.choice(n, k, replace=False)
        item[at] = fresh(k)
        parts.append(np.concatenate([fresh(i % 7), item, fresh(5)]))
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    words = np.concatenate(parts)
    text, item, _, away = dc.confirm(index, words, first, *index.candidates(words, first))
    assert sorted(set(zip(text.tolist(), item.tolist()))) == [(i, i) for i in range(300)]
    assert (away == k).all()


def test_no_rows_of_the_driver_start_other_python_workers(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'some words' AS text")
    items = spark.range(0).selectExpr("id AS item_id", "'x' AS text")
    found = dc.find_leaks(docs, items)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert found.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("distance", "int")] and found.isEmpty()
