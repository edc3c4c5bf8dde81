"""Collocations against counting by hand; tries against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from opslog.llm import arrays, collocations as C


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute(rows, least, share, first):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in n:
        scored = []
        for (own, words), a in found.items():
            if own != lang:
                continue
            if any(o == lang and len(w) > len(words) and words in (w[:2], w[1:]) and 100 * b >= share * a
                   for (o, w), b in found.items()):
                continue
            cuts = [(10 ** 6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = ["new", "York", "NEW", "é", "ä", "of", "the", "a-b", "x" * 30, "x" * 29 + "y", "日本", " ", "'s"]
    weights = [1 / (i + 1) for i in range(len(words))]
    marks = [" ", "  ", "\t", " ", " ", " ", ". ", ",", "\n", " ! ", "\r\n", "\x0b", ";"]
    rows = []
    for i in range(docs):
        text = "".join(w + rng.choice(marks) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None])))
    return [*rows, (None, "en"), ("", None), (" \t\n", "xx"), ("one", "yy"), *rows[:3]]


SCHEMA = "text string, lang string"


@pytest.mark.parametrize("seed", range(3))
def test_equals_counting_by_hand(spark, seed):
    rows = made(seed)
    df = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=3, share=50, first=15, held=50)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, df.collect())) == brute(rows, 3, 50, 15)


def test_words_with_one_id_are_counted_anew(spark):
    rows = [("alpha beta gamma. alpha beta gamma delta", "en")] * 4
    for bits in (3, 4, 5):
        df = C.collocations(spark.createDataFrame(rows, SCHEMA), least=3, id_bits=bits)
        assert sorted(map(tuple, df.collect())) == brute(rows, 3, 50, 2000)


def test_no_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([("a b. a b", "en", 1, "x")] * 9, "text string, lang string, id int, word string")
    assert [tuple(r) for r in C.collocations(docs, least=3).collect()] == [("en", 1, "a b", 18, 18, 18, 36, 1_000_000)]
    assert C.collocations(docs.limit(0)).collect() == []


def test_a_long_text_is_counted_whole(spark):
    text = "some words, and then some. " * 60000
    rows = [(text, "en"), ("z" * 3000 + " y", "en")]
    df = C.collocations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, df.collect())) == brute(rows, 10, 50, 2000)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_trie_counts_and_spills_sorted_runs(width):
    rng = np.random.default_rng(width)
    trie, want, got = C.Trie(width, burst=40), Counter(), Counter()
    ids = arrays.mix(np.arange(12, dtype=np.uint64))
    for _ in range(200):
        rows = ids[rng.integers(0, 12, (rng.integers(0, 50), width))]
        want.update(map(tuple, rows.tolist()))
        trie.add(rows)
        if trie.size() > 300:
            for path, phrases, counts in trie.spill(100):
                assert (path[1:] >= path[:-1]).all() and (path == C.path_of(phrases)).all()
                for p, n in zip(map(tuple, phrases.tolist()), counts.tolist()):
                    got[p] += n
            assert trie.size() <= 300
    for path, phrases, counts in trie.spill(0):
        for p, n in zip(map(tuple, phrases.tolist()), counts.tolist()):
            got[p] += n
    assert got == want and trie.size() == 0


def test_phrases_with_one_path_stay_apart(monkeypatch):
    monkeypatch.setattr(C, "path_of", lambda phrases: phrases[:, 0] & np.uint64(1))
    trie, rows = C.Trie(2, burst=4), np.array([[1, 5], [3, 5], [1, 6], [1, 5]] * 9, np.uint64)
    trie.add(rows)
    got = Counter()
    for _, phrases, counts in trie.spill(0):
        for p, n in zip(map(tuple, phrases.tolist()), counts.tolist()):
            got[p] += n
    assert got == Counter(map(tuple, rows.tolist()))


def test_hashes_tell_slices_apart():
    raw = ["", "a", "aa", "a" * 8, "a" * 9, "\x80" * 8, "a" * 7 + "á", "b" * 2000, "b" * 2001, "b" * 1999 + "c", "b" * 1030 + "x", "b" * 1030 + "y"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in raw])
    starts = np.append(0, ends[:-1])
    one = arrays.hashes(data, starts, ends)
    assert len(set(one.tolist())) == len(raw)
    for i, x in enumerate(raw):
        own = np.frombuffer(x.encode(), np.uint8)
        assert arrays.hashes(own, np.array([0]), np.array([len(own)]))[0] == one[i]
