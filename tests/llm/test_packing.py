"""Packing: least cost against a quadratic programme, pieces against the tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opslog.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def least(at, penalty, length, each):
    """Cost of the best cuts by trying every start of every sequence."""
    spots, cost = [0, *at], [0.0]
    for j in range(1, len(spots)):
        tries = []
        for i in range(j):
            n = spots[j] - spots[i]
            if n <= length:
                tries.append(cost[i] + (0 if n & (n - 1) == 0 else length - n) + penalty[j - 1] + each)
        cost.append(min(tries))
    return cost[-1]


def paid(ends, at, penalty, length, each):
    charge, first, total = dict(zip(at, penalty)), 0, 0.0
    for end in ends:
        n = end - first
        assert 0 < n <= length
        total += (0 if n & (n - 1) == 0 else length - n) + charge[end] + each
        first = end
    return total


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_least(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(3, 40))
    at = np.cumsum(rng.integers(1, min(8, length) + 1, rng.integers(1, 120)))
    penalty = rng.choice([0.0, 1.0, 4.0], len(at))
    ends, cost = packing.cuts(at, penalty, length, 2.0)
    assert ends[-1] == at[-1]
    assert cost == pytest.approx(least(at.tolist(), penalty, length, 2.0))
    assert paid(ends, at.tolist(), penalty, length, 2.0) == pytest.approx(cost)


def test_places_prefer_ends_and_fill_gaps():
    at, kinds = packing.places(np.array([3, 9]), np.array([9, 30]), 30, gap=8)
    assert at.tolist() == [3, 9, 17, 25, 30]
    assert kinds.tolist() == [packing.SENTENCE_END, packing.TEXT_END, packing.OTHER, packing.OTHER, packing.TEXT_END]


def test_chunks_give_the_ids_of_whole_texts():
    with open(PATH, encoding="utf-8") as file:
        coder = packing.Coder(file.read())
    texts = ["Élan vital.  It's   the\ttest\n\nof many words!" * 9, "x" * 300, "", " ", "a\u0301 \u0301b <|endoftext|> c",
             "\x0b. .\r\n" * 30, "(a)b[c]d.e,f;g:h!i?j\"k'll don't 'sure a.'s", "a,\u0301b =\u0338 .\u0338x", "1.5 x2,y3",
             "<|startoftext|>word.<|endoftext|>", "\u00a0a\u2003b\u3000.c", "ΑΣ. ΑΣ ΣΑ", "İ. ǅ, ﬁ!", "日本語。テキスト"]
    for known in range(2):  # the second time all chunks are known
        for group in (texts, texts[::-1]):
            raw = [t.encode() for t in group]
            data = np.frombuffer(b"".join(raw), np.uint8)
            ids, counts = coder.encode(data, np.cumsum([0, *map(len, raw)]))
            ends = np.cumsum(counts)
            for i, text in enumerate(group):
                assert ids[ends[i] - counts[i]:ends[i]].tolist() == coder.tokenizer.encode(
                    text, add_special_tokens=False).ids, text


def test_chunks_of_one_fingerprint_stay_apart(monkeypatch):
    with open(PATH, encoding="utf-8") as file:
        coder = packing.Coder(file.read())

    true = packing.keys_of

    def blind(data, starts, ends):
        keys = true(data, starts, ends)
        keys[:, 3] %= np.uint64(3)
        return keys

    monkeypatch.setattr(packing, "keys_of", blind)
    text = "one two three four five six seven one two. three! averyveryverylongword1 averyveryveryrongword1 averyveryverylongword1"
    data = np.frombuffer(text.encode() * 2, np.uint8)
    ids, counts = coder.encode(data, np.array([0, len(text), 2 * len(text)]))
    own = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert counts.tolist() == [len(own)] * 2 and ids.tolist() == own * 2


def test_long_texts_are_parted_at_white_space(spark, monkeypatch):
    text = ("some words, and more. " * 90000)[:-1]
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = packing.arrays.parted(data, np.array([0, 0, len(data), len(data)]))
    assert len(bounds) > 5 and all(text[b] == " " for b in bounds[2:-2])
    docs = spark.createDataFrame([(1, ""), (2, text), (3, "")], "doc_id long, text string").coalesce(1)
    assert check(packing.pack(docs, PATH, 2).collect(), {1: "", 2: text, 3: ""}, 4096) < 4096


def check(rows, texts, length):
    """Pieces hold each id once, windows are gapless, crc32 and totals agree. Returns the padding."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            own = np.array(ids[at:at + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(own.tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for members in windows.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


TEXTS = {0: "One sentence. Another one, longer than that! And more", 1: None, 2: "", 3: "word " * 700, 4: "The end.",
         5: "same", 6: "same", 7: "x" * 4000}


@pytest.mark.parametrize("length,stretch", [(64, 64), (64, 5000), (4096, 4096), (1, 16)])
def test_every_id_is_in_one_piece(spark, length, stretch):
    docs = spark.createDataFrame([(k, t, k) for k, t in TEXTS.items()], "doc_id long, text string, start int").repartition(2)
    rows = packing.pack(docs, PATH, 2, length, stretch=stretch).collect()
    check(rows, TEXTS, length)


def test_texts_keep_their_order(spark):
    docs = spark.createDataFrame([(k, f"text {k}. it goes on.") for k in range(200)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, PATH, 2, 64).collect()
    at = sorted((r["sequence_id"], r["offset"], r["doc_id"], r["start"]) for r in rows)
    assert [x[2:] for x in at] == sorted(x[2:] for x in at)


def test_null_keys_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b."), (1, "c"), (1, "c")], "doc_id long, text string")
    rows = packing.pack(docs, PATH, 2).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in rows) == [(False, 2), (False, 2), (True, 4)]
    assert packing.pack(docs.limit(0), PATH, 2).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, 2, 64, stretch=10)


def test_query_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = queries.op13_ordered_packing(spark, "/root/testdata/sf0.001").collect()
    padding = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 4096)
    assert padding < 0.005 * sum(r["length"] for r in rows)
