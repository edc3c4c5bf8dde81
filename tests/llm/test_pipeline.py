import base64
import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken

import corpus_pipeline
from opslog.llm import queries
from test_neardup import brute as classes
from test_substrings import brute as cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    texts, labels = [], []
    items = [" ".join(f"i{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(60))
    for i in range(260):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(30, 90))]
        kind = i % 13
        if kind < 3:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["snork", "blarg", "vex"]))
        if kind == 5:
            words[10:10] = items[i % 6].split()
        if kind == 7:
            words[5:5] = shared.split()
        labels.append((i, 1, int(kind < 3)))
        texts.append(" ".join(words))
    texts += [texts[4], texts[4] + " end", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, items


def test_stages_against_brute_force(spark, tables):
    root, rows, items = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    state = {r[0]: r[1] for r in rows}
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, root), "test")
        if name == "toxicity":
            state = {k: t for k, t in state.items() if not {"snork", "blarg", "vex"} & set((t or "").split())}
        elif name == "near_duplicates":
            root_of = classes([x for x in state.items() if x[0] is not None], 5, 80)
            state = {k: t for k, t in state.items() if root_of.get(k) == k}
        elif name == "substrings":
            new = {k: text for k, _, _, text in cut(list(state.items()), 20)}
            state = {k: None if t is None else new[k] for k, t in state.items()}
        elif name == "decontamination":
            state = {k: t for k, t in state.items() if not any(x in (t or "") for x in items)}
        if name == "byte_bpe":
            with open(queries.RANKS, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            code = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            for r in docs.collect():
                ids = np.array(code.encode_ordinary(state[r.doc_id] or ""), "<u4")
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
                assert r.decoded_sha256 == hashlib.sha256((state[r.doc_id] or "").encode()).hexdigest()
        else:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {r.doc_id: r.text for r in docs.collect()} == state, name
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.doc_id and r.text)


def test_run_and_empty_tables(spark, tables, tmp_path):
    root, _, _ = tables
    assert corpus_pipeline.run(spark, root).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_task_of_the_encoding_has_one_python_worker(spark, tables):
    root, _, _ = tables
    plan = corpus_pipeline.encode(spark, queries.table(spark, root, "documents"), root)._jdf.queryExecution().toString()
    assert plan.partition("Physical Plan")[2].count("MapInArrow") == 1
