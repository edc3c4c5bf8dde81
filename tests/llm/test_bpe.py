import base64
import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from opslog.llm import arrays, bpe, queries

ALPHABET = list("ab'sS tdrevlm  \n\t15!?é世　½🙂")
DOCS = "doc_id long, text string, ids int"


@pytest.fixture(scope="module")
def library():
    with open(queries.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(queries.RANKS))


def encode(encoder, texts):
    raw = [x.encode() for x in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), at)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(5)
    texts = ["", "it's we're 's'd  'll x\n\n y 'S don't' ''s \t a", "'re'ves'", " \n's 5's", "ab   ", "x  \ny"]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)]
    assert encode(encoder, texts) == [library.encode_ordinary(x) for x in texts]


def test_long_slices_and_a_full_store(encoder, library, monkeypatch):
    rng = random.Random(6)
    texts = ["a" * 5000, "=" * 3001, "".join(rng.choices("abcdeé", k=20_000)), " " * 999]
    assert encode(encoder, texts) == [library.encode_ordinary(x) for x in texts]
    monkeypatch.setattr(bpe, "KEPT", 5)
    assert encode(encoder, ["one two", "three four five"] * 3) == [
        library.encode_ordinary(x) for x in ["one two", "three four five"] * 3]


def test_a_text_of_many_different_slices(encoder, library):
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(540_000))
    assert len(text) > 5_000_000
    encoder.forget()
    assert encode(encoder, [text]) == [library.encode_ordinary(text)]


def test_classes_of_all_codepoints(encoder, library):
    texts = ["a" + chr(c) + "a1" + chr(c) + "1 " + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert encode(encoder, texts) == [library.encode_ordinary(x) for x in texts]


def test_round_trip_with_edge_rows(spark, library):
    long = "wörd's 12 " * 30_000
    rows = [(1, None, 5), (2, "", 5), (3, "déjà vu's 世界", 5), (3, "déjà vu's 世界", 6), (None, " x", 5), (9, long, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    coded = bpe.encode(docs, queries.RANKS)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "ends"]
    back = bpe.decode(coded, queries.RANKS).withColumn("ends", bpe.unpack("ends"))
    found = sorted(back.withColumn("ids", bpe.unpack("ids")).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    want = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] or 0, len(r[1])))
    for row, (key, text) in zip(found, want):
        assert (row.doc_id, list(row.ids), bytes(row.decoded)) == (key, library.encode_ordinary(text), text.encode())
        assert row.n_tokens == len(row.ids) == len(row.ends)
        if row.ends:
            cut = row.ends[len(row.ends) // 2]
            assert row.ends[-1] == len(text.encode())
            assert library.decode_bytes(list(row.ids)[: len(row.ends) // 2 + 1]) == text.encode()[:cut]


def test_digests(spark, library):
    docs = spark.createDataFrame([(1, "it's  é\n", 0), (2, None, 0)], DOCS)
    found = {r.doc_id: r for r in queries.digest_tokens(docs).collect()}
    ids = np.array(library.encode_ordinary("it's  é\n"), "<u4").tobytes()
    assert found[1].ids_sha256 == hashlib.sha256(ids).hexdigest()
    assert found[1].decoded_sha256 == hashlib.sha256("it's  é\n".encode()).hexdigest()
    assert (found[2].n_tokens, found[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert queries.digest_tokens(docs).count() == 0
    assert bpe.encode(docs.where(F.lit(False)), queries.RANKS).count() == 0


def paired(turns=11):
    """Two words of 2 ** turns letters whose polynomials agree modulo 2 ** 64 for every odd base."""
    word = "a"
    for _ in range(turns):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_slices_that_a_polynomial_mixes_up(encoder, library):
    one, two = paired()
    texts = [f"{one}\n{two}", two, f"{two} {one}"]
    assert encode(encoder, texts) == [library.encode_ordinary(x) for x in texts]


def test_slices_of_one_fingerprint_stay_apart(library, monkeypatch):
    true = bpe.arrays.hashes
    own = bpe.Encoder(bpe.Vocabulary.load(queries.RANKS))
    monkeypatch.setattr(bpe.arrays, "hashes", lambda *a: true(*a) & np.uint64(3))
    texts = ["these are some different words of one text", "and of another text, with words"] * 3
    assert encode(own, texts) == [library.encode_ordinary(x) for x in texts]


def test_a_worker_keeps_one_prepared_thing():
    made = []
    for key in ("one", "one", "other", "one"):
        assert arrays.kept(key, lambda: made.append(key) or key) == key
    assert made == ["one", "other", "one"] and len(arrays._KEPT) == 1
