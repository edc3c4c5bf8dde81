import random

import pytest

from opslog.llm import neardup
from opslog.llm.components import components

DOCS = "doc_id long, text string, component_id int, n int"


def brute(rows, size, similar):
    """Sets, links between all pairs, and components, one document per key."""
    sets = {}
    for key, text in rows:
        words = (text or "").lower().split()
        own = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets.setdefault(key, []).append(own)
    best = {k: k for k in sets}

    def root(k):
        while best[k] != k:
            k = best[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if any(x and y and 100 * len(x & y) >= similar * len(x | y) for x in sets[a] for y in sets[b]):
                a_, b_ = sorted((root(a), root(b)))
                best[b_] = a_
    return {k: root(k) for k in keys}


def corpus(seed):
    rng = random.Random(seed)
    rows, key = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            rows.append((key, rng.choice([" ", "\n", " \t"]).join(own).capitalize()))
            key += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,similar,block", [(3, 85, 4096), (5, 80, 4)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, size, similar, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(size)
    want = brute(rows, size, similar)
    docs = spark.createDataFrame([(k, t, 1, 1) for k, t in rows], DOCS)
    found = {r.doc_id: r for r in neardup.near_duplicates(docs, size=size, similar=similar).collect()}
    assert {k: r.component_id for k, r in found.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in found.items())
    text = dict(rows)
    for k, r in found.items():
        words = text[k].lower().split()
        assert r.n_shingles == max(1, len({tuple(words[i:i + size]) for i in range(len(words) - size + 1)}))


def test_edge_rows(spark):
    long = " ".join(f"v{i % 977}x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " end"),
            (9, "a b c d e f"), (9, "q r s t u v"), (10, "Q r s t u v"), (11, "a b c d e f"), (None, "one"), (12, "\x0bone\x0c")]
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], DOCS)
    found = [tuple(r) for r in neardup.near_duplicates(docs).collect()]
    assert len(found) == len(rows)
    assert {(k, c) for k, _, c, _ in found} == {
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9), (10, 9), (11, 9), (None, None), (12, 4)}
    assert {k for k, n, _, _ in found if n == 0} == {1, 2, 3}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(300 + i, 299) for i in range(9)]
    rng.shuffle(links)
    frame = spark.createDataFrame([*links, links[0], (5, 5), (None, 4)], "a long, b long")
    found = {r.vertex: r.component for r in components(frame).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(200, 309)]}}
    assert components(frame.limit(0)).count() == 0


def test_estimate_is_close_for_similar_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.85, 0.95):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 2**63, 1000).astype(np.uint64)
            rest = round(1000 * (1 - share) / (2 * share))
            sets = [np.concatenate([both, rng.integers(0, 2**63, rest).astype(np.uint64)]) for _ in range(2)]
            low, _ = neardup.signatures(np.concatenate(sets), np.array([0, len(sets[0]), 2 * len(sets[0])]))
            a, b = neardup.odd_sketch(low).view(np.uint64)
            errors.append(float(neardup.estimate(neardup.apart(a, b))) - share)
            fine = neardup.fold(np.concatenate(sets), np.repeat([0, 1], len(sets[0])), 2, neardup.FINE).view(np.uint64)
            assert neardup.apart(*fine) <= neardup.farthest(2 * len(sets[0]), round(100 * share))
        assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < neardup.SLACK


def test_chains_inside_a_bucket(spark, monkeypatch):
    """Documents that drift away from the first one are linked through those between."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for key in range(150):
        rows.append((key, " ".join(words)))
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(300)] = f"y{rng.randrange(10**6)}"
    rng.shuffle(rows)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    docs = spark.createDataFrame([(k, t, 1, 1) for k, t in rows], DOCS)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, size=3, similar=85).collect()}
    assert found == brute(rows, 3, 85)


def test_words_that_a_polynomial_mixes_up(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one}"), (5, one)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, similar=85)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_sets_by_their_words():
    assert neardup.word_shingles("A b  c\td", 3) == {(b"a", b"b", b"c"), (b"b", b"c", b"d")}
    assert neardup.word_shingles("a b", 3) == {(b"a", b"b")} and neardup.word_shingles(None, 3) == set()
