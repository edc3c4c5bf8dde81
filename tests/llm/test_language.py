import random

import numpy as np
import pytest

from opslog.llm import language

DOCS = "doc_id long, text string, lang string, score int"
WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce".split(),
}
SHAPES = [str.lower, str.upper, lambda t: t.replace(" ", " | ")]


def rows_of(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, rng.choice(SHAPES)(" ".join(rng.choices(WORDS[lang], k=rng.randint(12, 60)))), lang, 0))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = rows_of(1, 600) + [(9000, None, "en", 0), (9001, "text", None, 0), (None, "der die", "de", 0)]
    return language.learn(spark.createDataFrame(rows, DOCS), bound=120)


def test_held_out_accuracy(spark, model):
    rows = rows_of(2, 300)
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang, _ in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    assert sorted(set(model.languages)) == ["de", "en", "fr"] and len(model.languages) > 3
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-3)


def test_edge_rows(spark, model):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "123 !!", "en", 0), (4, "世", "en", 0), (5, "der die und", None, 0),
            (5, "der die und", "x", 0), (None, "the of and", "en", 0), (6, "qqxz zzqx xqzq", "en", 0), (7, "les des en un " * 40_000, "en", 0)]
    out = language.identify(spark.createDataFrame(rows, DOCS), model).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in out[:3])
    assert out[3].lang_pred in WORDS and out[7].rejected
    assert [r.lang_pred for r in out[4:7]] == ["de", "de", "en"] and out[8].lang_pred == "fr"
    empty = spark.createDataFrame([], DOCS)
    assert language.identify(empty, model).count() == 0
    assert [r.lang_pred for r in language.identify(spark.createDataFrame(rows[4:5], DOCS), language.learn(empty)).collect()] == ["und"]


def test_clusters_of_one_language():
    rng = np.random.default_rng(1)
    axes = np.eye(3, 20, dtype=np.float32)
    x = language.unit(np.repeat(axes, 30, axis=0) + rng.normal(0, 0.02, (90, 20)).astype(np.float32))
    centres = language.cluster(x, 4)
    assert all((centres @ a).max() > 0.98 for a in axes)
    assert len(language.cluster(x[:1], 4)) == 1
