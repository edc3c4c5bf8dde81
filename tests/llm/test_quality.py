import random

import numpy as np
import pytest

from opslog.llm import ngrams, quality

DOCS = "doc_id long, text string, expected string"


def text_of(grade, rng):
    """The higher the grade the fewer words are junk."""
    words = []
    for _ in range(rng.randint(20, 80)):
        word = rng.choice(["the", "quality", "of", "plain", "prose", "sentence", "reads", "well"])
        words.append(word + rng.choice(["$$$", "%%%", "###"]) if rng.random() < 0.6 - 0.2 * grade else word)
    return " ".join(words)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, i % 4) for i in range(800)]
    docs = spark.createDataFrame([(i, text_of(g, rng), "x") for i, g in rows], DOCS)
    labels = spark.createDataFrame([*rows, (1, None), (None, 2), (9999, 3)], "doc_id long, quality int")
    return quality.learn(docs, labels)


def test_held_out_grades(spark, model):
    rng = random.Random(2)
    rows = [(i, i % 4) for i in range(400)]
    docs = spark.createDataFrame([(i, text_of(g, rng), "x") for i, g in rows], DOCS)
    found = {r.doc_id: r for r in quality.grade(docs, model, at_least=2).collect()}
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    means = [np.mean([found[i].expected for i, g in rows if g == k]) for k in range(4)]
    assert all(b > a + 0.5 for a, b in zip(means, means[1:]))
    assert np.mean([abs(found[i].expected - g) for i, g in rows]) < 0.5
    right = [(found[i].tail >= 0.5) == (g >= 2) for i, g in rows]
    assert np.mean(right) > 0.9 and all(0 <= r.tail <= 1 for r in found.values())


def test_tails_are_ordered_and_expected_grade_follows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    z = x @ np.array([2, -1, 0, 0, 1.0])
    grade = np.digitize(z + rng.logistic(size=600), [-2, 0, 3]) * 2.0
    own = quality.fit_vectors(x, grade)
    tails = own.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(x @ own.weights, z)[0, 1] > 0.95


def test_edge_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "a", "a"), (3, "a", "b"), (None, "plain prose", "a"), (4, "the plain prose " * 40_000, "a")]
    out = quality.grade(spark.createDataFrame(rows, DOCS), model).collect()
    assert [r.doc_id for r in out] == [r[0] for r in rows]
    assert len({r.expected for r in out[:4]}) == 1 and all(0 <= r.expected <= 3 for r in out)
    assert quality.grade(spark.createDataFrame([], DOCS), model).count() == 0


def test_few_grades(spark):
    docs = spark.createDataFrame([(1, "some text", "x"), (2, None, "x")], DOCS)
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [(r.expected, r.tail) for r in quality.grade(docs, none).collect()] == [(None, None)] * 2
    one = quality.learn(docs, spark.createDataFrame([(1, 5)], "doc_id long, quality int"))
    assert [(r.expected, r.tail) for r in quality.grade(docs, one).collect()] == [(5.0, 1.0)] * 2
    assert [r.tail for r in quality.grade(docs, one, at_least=6).collect()] == [0.0] * 2


def test_counts_are_those_of_all_ngrams():
    texts = [b"", b"ab", b"abc", b"abcabc", bytes(range(200))]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = ngrams.counts(np.frombuffer(b"".join(texts), np.uint8), at, 11)
    for row, raw in zip(found, texts):
        want = np.zeros(1 << 11, int)
        for i in range(len(raw) - 2):
            want[ngrams.buckets_of(np.frombuffer(raw[i:i + 3], np.uint8), 11)[0]] += 1
        assert (row == want).all()
