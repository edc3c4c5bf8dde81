"""Ranked search against scoring every document; bounds against exact scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from opslog.llm import arrays, signatures as S


def terms(text):
    low = re.sub(b"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    held = [(key, Counter(terms(t)), len(terms(t))) for key, t in docs if terms(t)]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c, n in held:
            m = 75 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if t in c)
            if score > 0 and key is not None:
                scores.append((-score, key))
        out += [(item, rank, key, -score) for rank, (score, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "A1", "a1", "日本", "x" * 40]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda size: "".join(w + rng.choice([" ", ",", "-", "\n", "\x7f"]) for w in rng.choices(words, weights, k=size))
    docs = [(i, text(rng.choice([1, 5, 30, 30, 60, 400]))) for i in range(n)]
    docs += [(n + 9, "most " * 300), (n + 10, "most " * 255 + "w2 " * 254), (n, None), (n + 1, ""), (n + 2, " .\n"), (None, "w1 w2"), *((n + 3 + i, docs[0][1]) for i in range(5))]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)] + [(20, None), (21, "unknown"), (22, "w1 " * 50), (24, "most"), (23, "")]
    return docs, items


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("seed,block,group,sent", [(0, 1 << 14, 256, 1 << 25), (1, 1 << 23, 5, 1 << 25), (2, 1 << 12, 3, 400)])
def test_equals_scoring_all(spark, seed, block, group, sent, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    docs, items = made(seed, 400)
    index = S.stage(S.build(spark.createDataFrame(docs, DOCS).repartition(3)), "index")
    found = S.search(index, spark.createDataFrame(items, ITEMS), 7, group=group, sent_bytes=sent)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(docs, items, 7)


def test_text_keys_and_extra_columns(spark):
    docs = [(f"d{i}", "one two" if i % 2 else "two three", i, "x") for i in range(9)]
    items = [("q", "Three, one!", 1), (None, "one", 2), ("q", "zzz", 3)]
    found = S.ranked(spark.createDataFrame(docs, "doc_id string, text string, rank int, item string"),
                     spark.createDataFrame(items, "item_id string, text string, score int"), 20)
    assert sorted(map(tuple, found.collect())) == brute([d[:2] for d in docs], [items[0][:2]], 20)


def test_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert S.ranked(docs.limit(0), items, 5).collect() == []
    assert S.ranked(docs, items.limit(0), 5).collect() == []
    assert len(S.ranked(docs, items, 5).collect()) == 1


def blocks_of(spark, docs):
    rows = S.build(spark.createDataFrame(docs, DOCS).coalesce(1)).collect()
    return [S.Block(r.asDict()) for r in rows]


def test_bounds_are_not_below_scores_and_leave_documents_out(spark):
    docs, items = made(5, 3000)
    queries = S.Queries([S.lowered_terms(t) for _, t in items])
    blocks = blocks_of(spark, docs)
    total, length = sum(b.docs for b in blocks), int(sum(b.n.sum() for b in blocks))
    df = Counter(t for _, text in docs for t in set(terms(text)))
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in queries.terms])
    search = S.Search(queries, weights, total, length, 5, np.zeros(len(items)))
    for block in blocks:
        m = 75 + (25 * block.n * total) // length
        doc, number, tf = block.found(queries.vocabulary, np.arange(block.docs))
        values = np.zeros((len(queries.terms), block.docs), np.int64)
        values[number, doc] = S.impact(tf, m[doc])
        assert (search.bounds(block, m) >= queries.times * weights @ values).all()
        search.look(block)
    assert search.scored < search.met / 2


def test_terms_of_one_hash_stay_apart(monkeypatch):
    true = arrays.hashes
    monkeypatch.setattr(arrays, "hashes", lambda *a: true(*a) & np.uint64(1))
    own = [f"t{i}".encode() for i in range(20)]
    vocabulary = S.Vocabulary(own)
    raw = [b"t3", b"t19", b"t20", b"t1", b"q"]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    assert vocabulary.numbers(data, np.append(0, ends[:-1]), ends).tolist() == [3, 19, -1, 1, -1]
    row = np.array([0, 0, 0, 0, 1])
    example, count, first = arrays.distinct(data, np.append(0, ends[:-1]), ends, np.zeros(5, np.uint64), row)
    assert sorted(example.tolist()) == [0, 1, 2, 3, 4] and count.sum() == 5 and first.tolist() == [0, 1, 2, 3, 4]
