import itertools
import random

import numpy as np
import pytest

from opslog.llm import toxicity

DOCS = "doc_id long, text string, score string"
BAD, PLAIN = ["snork", "blarg", "Vexed", "vexier"], [f"word{i}" for i in range(200)] + ["snor", "vext", "éa"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(PLAIN, k=rng.randint(1, 60))
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    labels += [(3, None), (None, 1), (9999, 1), (5, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    return toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_scores_and_offsets(spark, model):
    rows = [(1, "word1 SNORK, word2 blarg", "a"), (2, "word1 word2 éa", "a"), (3, None, "a"), (4, "", "a"),
            (5, "éa Snork snork", "a"), (5, "word5", "b"), (None, "blarg snork", "a"), (7, "word3 " * 30_000 + "vexed blarg", "a")]
    out = toxicity.score(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(out) == len(rows)
    for row, (key, text, _) in zip(out, rows):
        bad = [w for w in (text or "").lower().replace(",", " ").split() if w in {b.lower() for b in BAD}]
        assert row.doc_id == key and 0 <= row.score <= 1
        assert (row.score >= 0.3) == (len(bad) >= 2)
        raw = (text or "").encode()
        assert [raw[s.start:s.end].decode().lower() for s in row.spans] == bad
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_marginals_equal_those_of_all_paths():
    rng = np.random.default_rng(0)
    cues = np.array([5, 9], np.uint64)
    for _ in range(40):
        moves, bias = rng.normal(size=(2, 2)), rng.normal()
        model = toxicity.Model(cues, np.zeros(2), bias, moves, np.zeros(4))
        lengths = rng.integers(1, 9, 3)
        weight = [np.where(rng.random(n) < 0.4, rng.normal(size=n) * 2, 0) for n in lengths]
        fired = [np.flatnonzero(w) for w in weight]
        first = np.concatenate([[0], np.cumsum([len(f) for f in fired])])
        got = model.marginals(np.concatenate(fired), np.concatenate([w[f] for w, f in zip(weight, fired)]), first, lengths)
        want = []
        for w, f in zip(weight, fired):
            total, on = 0.0, np.zeros(len(w))
            for path in itertools.product((0, 1), repeat=len(w)):
                s = sum(p * (w[i] + bias) for i, p in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
                total += np.exp(s)
                on += np.exp(s) * np.array(path)
            want += (on / total)[f].tolist()
        assert np.allclose(got, want)


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], DOCS)
    for labels, low, high in (([], 0, 0.01), ([(1, 0)], 0, 0.01), ([(1, 1)], 0.99, 1)):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        scores = [r.score for r in toxicity.score(docs, toxicity.learn(docs, frame)).collect()]
        assert all(low <= s <= high for s in scores)


def test_fit_of_the_chain_lowers_the_loss():
    seen = np.full((60, 8, 1), 2)
    label, live = np.zeros((60, 8), np.int64), np.ones((60, 8), bool)
    seen[::2, 3, 0], label[::2, 3] = 0, 1
    seen[1::2, 5, 0] = 1
    weights, bias, moves = toxicity.chain_fit(seen, label, live, 2)
    assert weights[0] + bias > 2 > weights[1] + bias


def test_lower_case_keeps_places():
    text = "ÀÉÜ× ÑAbÿ"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert toxicity.lowered(raw).tobytes().decode() == "àéü× ñabÿ"
