import random
import re

import numpy as np
import pyarrow as pa
import pytest

from opslog.llm import arrays, substrings

DOCS = "doc_id long, text string, n_words int"


def brute(rows, window):
    first, cover = {}, {}
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in enumerate(rows)}
    order = sorted((i for i in texts if rows[i][0] is not None), key=lambda i: rows[i][0])
    for i in order:
        for p in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][p:p + window]), (rows[i][0], p))
    out = []
    for i, words in texts.items():
        gone = set()
        for p in range(len(words) - window + 1):
            if rows[i][0] is not None and first[tuple(words[p:p + window])] < (rows[i][0], p):
                gone.update(range(p, p + window))
        out.append((rows[i][0], len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, words):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(words)}" for _ in range(rng.randint(5, 90))] for _ in range(12)]
    rows = []
    for key in rng.sample(range(1000), 60):
        text = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                text += rng.choice(passages)
            elif kind < 0.6:
                text += [rng.choice("ab")] * rng.randint(1, 70)
            elif kind < 0.7:
                text += [f"y{i}" for i in range(rng.randint(2, 9))] * rng.randint(1, 20)
            else:
                text += [f"w{rng.randrange(words)}" for _ in range(rng.randint(1, 50))]
        rows.append((key, rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(1000 + k, rows[3][1]) for k in range(20)]
    return rows


@pytest.mark.parametrize("window,words,buffer,many", [(20, 4000, 400_000, 8), (20, 3, 50, 1), (6, 30, 300, 2), (20, 200, 100, 8)])
def test_removed_words_are_those_of_all_windows(spark, monkeypatch, window, words, buffer, many):
    monkeypatch.setattr(substrings, "BUFFER", buffer)
    monkeypatch.setattr(substrings, "MANY", many)
    rows = corpus(window + words, words)
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], DOCS).repartition(5)
    found = substrings.remove_repeats(docs, window=window).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, window)


def test_equal_windows_have_equal_names():
    rng = np.random.default_rng(4)
    for words in (3, 50, 5000):
        passage = arrays.mix(rng.integers(0, words, 45).astype(np.uint64))
        seen = {}
        for _ in range(300):
            sides = [arrays.mix(rng.integers(0, words, rng.integers(0, 30)).astype(np.uint64)) for _ in range(2)]
            text = np.concatenate([sides[0], passage, sides[1]])
            starts, names, _, _ = substrings.anchors(text, np.array([0, len(text)]), 20)
            for p, name in zip(starts, names):
                assert seen.setdefault(text[p:p + 20].tobytes(), name) == name


def test_periods_inside_a_text(spark):
    rng = random.Random(6)
    rows = []
    for period in range(1, 30):
        part = [f"p{rng.randrange(10**6)}" for _ in range(period)]
        rows.append((period, " ".join(["lead"] * (period % 3) + part * (1 + 80 // period) + ["tail"])))
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], DOCS)
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == brute(rows, 20)


def test_edge_rows(spark):
    long = " ".join(f"v{i % 9000}" for i in range(40_000))
    line = " ".join(f"q{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, line), (6, line), (6, line), (None, line), (7, "\x0b" + line + "\x0c"),
            (8, long), (9, "ä " + line.upper())]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], DOCS)
    found = substrings.remove_repeats(docs).collect()
    want = [x for x in brute([r for r in rows if r[0] != 6], 20)] + [(6, 20, 20, "")] * 2
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_words_that_a_polynomial_mixes_up(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{rest} {one} x"), (4, f"y {rest} {one}")]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == brute(rows, 20)


def test_words_of_one_hash_do_not_make_windows_equal(monkeypatch):
    true = arrays.hashes
    monkeypatch.setattr(arrays, "hashes", lambda d, s, e, seed=0: true(d, s, e, seed) & np.uint64(2 ** 64 - 1 if seed else 0))
    text = b" ".join(f"w{i}".encode() for i in range(60))
    data = np.frombuffer(text, np.uint8)
    marks = substrings.segments(data, np.array([0, len(data)]), 20)[4]
    assert len(set(marks.tolist())) == len(marks) == 41


def test_batches_are_sent_on_in_bounded_parts(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_001))], names=["x"])
    parts = list(arrays.slices(batch))
    assert max(p.num_rows for p in parts) <= 8 * arrays.BATCH_ROWS
    assert pa.Table.from_batches(parts).column("x").to_pylist() == list(range(20_001))
