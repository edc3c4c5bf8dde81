import random

import numpy as np

from opslog.llm import lm

DOCS = "doc_id long, text string, log_prob int"


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.start().items()}
    around, target = rng.integers(0, lm.SIZE + 1, (6, 4)), rng.integers(0, lm.SIZE, 6)
    loss, g = lm.gradient(w, around, target)
    for name in w:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            if name == "embed":
                at = (at[0], around[rng.integers(6), at[0]], at[2])
            old = w[name][at]
            w[name][at] = old + 1e-4
            up = lm.gradient(w, around, target)[0]
            w[name][at] = old - 1e-4
            down = lm.gradient(w, around, target)[0]
            w[name][at] = old
            assert abs((up - down) / 2e-4 - g[name][at]) < 1e-4


def test_chances_sum_to_one_and_look_to_both_sides():
    w = lm.start(3)
    ids, first = np.array([3, 70, 999, 5]), np.array([0, 4])
    total = sum(np.exp(lm.log_chances(w, np.array([3, 70, t, 5]), first)[2]) for t in range(lm.SIZE))
    assert abs(total - 1) < 1e-4
    base = lm.log_chances(w, ids, first)[1]
    for other in (0, 2, 3):
        changed = ids.copy()
        changed[other] += 1
        assert lm.log_chances(w, changed, first)[1] != base


def corpus(seed, n):
    rng = random.Random(seed)
    rule = {a: [f"b{a}", f"c{a}", f"d{a}"] for a in range(20)}
    return [(i, " ".join(w for _ in range(60) for w in rule[rng.randrange(20)])) for i in range(n)]


def test_training_tells_rule_from_noise(spark):
    rows = corpus(1, 300)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS).repartition(3)
    words, weights = lm.learn(docs, rounds=8)
    fresh = corpus(2, 20)
    rng = random.Random(3)
    mixed = [(100 + i, " ".join(rng.sample(t.split(), 180))) for i, t in fresh]
    out = lm.score(spark.createDataFrame([(i, t, 0) for i, t in fresh + mixed], DOCS), (words, weights)).collect()
    good, bad = ([r.mean_log_prob for r in out if (r.doc_id < 100) == side] for side in (True, False))
    assert min(good) > max(bad) + 1
    assert np.mean(good) > -2.5


def test_edge_rows(spark):
    model = (lm.Words(np.empty(0, np.uint64), np.empty(0, np.int64)), lm.flat(lm.start()))
    rows = [(1, None, 0), (2, "", 0), (3, " .. ", 0), (4, "One word", 0), (4, "one WORD!", 0), (None, "x", 0), (5, "a " * 100_000, 0)]
    out = lm.score(spark.createDataFrame(rows, DOCS), model).collect()
    assert [r.n_tokens for r in out] == [0, 0, 0, 2, 2, 1, 100_000]
    assert [r.mean_log_prob is None for r in out] == [True] * 3 + [False] * 4
    assert out[3].log_prob == out[4].log_prob < 0 and out[0].log_prob == 0
    empty = spark.createDataFrame([], DOCS)
    assert lm.score(empty, lm.learn(empty)).count() == 0


def test_spellings_have_chances_that_sum_to_one():
    rng = np.random.default_rng(4)
    spelled = lm.Spelling(rng.integers(0, 3, (lm.ROWS + lm.SYMBOLS) * lm.SYMBOLS) * (rng.random((lm.ROWS + lm.SYMBOLS) * lm.SYMBOLS) < 0.1))
    for before, row in ((lm.EDGE, 7), (65, 9000)):
        assert abs(spelled.chances(np.arange(lm.SYMBOLS), before, row).sum() - 1) < 1e-4
    low = np.frombuffer(b"ab", np.uint8)
    steps = spelled.chances(*lm.symbols(low, np.array([0]), np.array([2])))
    fellows = np.array([b for b in range(256) if b % lm.RARE == 97 % lm.RARE])
    _, before, row = lm.symbols(low, np.array([0]), np.array([2]))
    share = spelled.chances(fellows, before[0], row[0]).sum()
    assert abs(spelled.of(low, np.array([0]), np.array([2]))[0] - np.log(steps.prod() / share)) < 1e-6


def test_words_beyond_the_frequent_ones_have_chances_of_their_own(spark):
    parts = ["ba", "do", "ki", "lu", "me", "na", "po", "ri", "su", "te", "va", "zo"]
    known = [a + b + c for a in parts for b in parts for c in parts]
    rows = [(i, " ".join(known[i:] + known[:960] * 2), 0) for i in range(0, 1500, 50)]
    model = lm.learn(spark.createDataFrame(rows, DOCS).repartition(3))
    rare, rng = known[960:], random.Random(8)
    strange = ["".join(rng.sample("bdklmnprstvz", 6)) for _ in range(200)]
    out = lm.score(spark.createDataFrame([(i, w, 0) for i, w in enumerate(rare + strange)], DOCS), model).collect()
    chance = {(rare + strange)[r.doc_id]: r.log_prob for r in out}
    assert len(set(chance.values())) > 0.9 * len(chance)
    assert min(chance[w] for w in rare) > max(chance[w] for w in strange)


def test_every_token_is_a_target_once(spark):
    first = np.concatenate([[0], np.cumsum([1, 2, 0, 3, 1, 9, 40])])
    met = np.concatenate([lm.targets(first, turn) for turn in range(lm.ROUNDS)])
    assert sorted(met.tolist()) == list(range(first[-1]))
    docs = spark.createDataFrame([(i, "word", 0) for i in range(20)], DOCS)
    assert (lm.learn(docs)[1] != lm.flat(lm.start())).any()


def test_windows_against_brute_force_and_in_batches(monkeypatch):
    rng = np.random.default_rng(6)
    first = np.concatenate([[0], np.cumsum([0, 1, 2, 0, 0, 3, 7, 4000, 1, 0])])
    ids = rng.integers(0, lm.SIZE, first[-1])
    around = lm.windows(*lm.apart(ids, first))
    for a, b in zip(first, first[1:]):
        for i in range(a, min(b, a + 50)):
            assert around[i].tolist() == [ids[i + p] if a <= i + p < b else lm.SIZE for p in lm.PLACES]
    sizes, true = [], lm._forward
    monkeypatch.setattr(lm, "_forward", lambda w, around, target: sizes.append(len(target)) or true(w, around, target))
    lm.log_chances(lm.start(), ids, first)
    assert sum(sizes) == len(ids) and max(sizes) <= lm.BATCH


def test_words_that_share_the_first_bits_of_their_prints():
    rng = np.random.default_rng(7)
    near = (np.uint64(9) << np.uint64(60)) + rng.integers(0, 2000, 200).astype(np.uint64)
    prints = np.unique(np.concatenate([near, rng.integers(0, 2**64, 700, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    ids = rng.permutation(len(prints))
    found = np.concatenate([prints, prints + np.uint64(1), prints - np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64)])
    known = dict(zip(prints.tolist(), ids.tolist()))
    got = lm.Words(prints, ids).of(found, np.full(len(found), 97, np.uint8)).tolist()
    assert got == [known.get(x, lm.SIZE - lm.RARE + 97 % lm.RARE) for x in found.tolist()]


def test_softmax_adds_each_column_as_numpy_adds_a_row():
    z = np.random.default_rng(8).normal(0, 3, (lm.CLASSES, 500)).astype(np.float32)
    less, total = lm._log_softmax(z)
    rows = np.ascontiguousarray(less.T)
    assert (np.log(np.exp(rows).sum(axis=1)) == total).all()
