from collections import Counter, defaultdict
import random
import re

import pytest
from pyspark.sql import functions as F

from opslog.operators import sequences as sq


def history_by_hand(rows, cap):
    """rows: (id, time, message, template), any order."""
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    seen, out = defaultdict(list), {}
    for i, at, message, template in ordered:
        blocks = re.findall(r"blk_-?\d+", message)
        before = seen[blocks[0]][:cap] if blocks else []
        out[i] = [f"E{t}" for t in before] + ([f"E{template}"] if template is not None else [])
        if template is not None:
            for block in set(blocks):
                seen[block].append(template)
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        blocks = " ".join(f"blk_{rng.choice([1, 1, 1, 12, -1, 2])}" for _ in range(rng.choice([0, 1, 1, 2])))
        rows.append((f"m {blocks}", rng.choice([None, 1, 2, 3, 4]), rng.randrange(n // 3)))
    return rows


@pytest.mark.parametrize("cap,split_rows", [(250, 10 ** 6), (5, 20)])
def test_block_history(spark, make_logs, cap, split_rows):
    logs = make_logs(random_rows(400, cap))
    rows = [(r["id"], r["timestamp"], r["raw_message"], r["template_id"]) for r in logs.collect()]
    got = {r["id"]: r["tokens"] for r in sq.block_history(logs, cap, split_rows).collect()}
    assert got == history_by_hand(rows, cap)


def test_history_freezes_after_the_cap(spark, make_logs):
    logs = make_logs([("blk_1", i % 7) for i in range(300)] + [("blk_12", 1)])
    got = {r["id"]: r for r in sq.block_history(logs).collect()}
    assert len(got[299]["tokens"]) == 251 and got[299]["tokens"][:250] == got[298]["tokens"][:250]
    assert got[300]["tokens"] == ["E1"]  # blk_1 is no part of blk_12
    assert got[299]["templates"] == [int(t[1:]) for t in got[299]["tokens"]]


@pytest.fixture(scope="module")
def tokens(spark, make_logs):
    rng = random.Random(3)
    logs = make_logs([(f"blk_{rng.choice([1, 1, 2, 3])}" if i % 9 else "none", rng.randrange(1, 5)) for i in range(300)])
    return sq.block_tokens(logs)


def by_hand(tokens):
    out = defaultdict(list)
    for r in sorted(tokens.collect(), key=lambda r: (r["timestamp"], r["id"])):
        out[r["block_id"]].append(r["token"])
    return out


def test_sequences_and_stats(tokens):
    want = by_hand(tokens)
    parts = defaultdict(list)
    for r in sorted(sq.block_sequences(tokens, 7).collect(), key=lambda r: r["part"]):
        assert r["n_tokens"] <= 7
        parts[r["block_id"]].extend(r["sequence"].split(" "))
    assert parts == want
    stats = {r["block_id"]: (r["seq_len"], r["unique_templates"]) for r in sq.block_stats(tokens).collect()}
    assert stats == {b: (len(s), len(set(s))) for b, s in want.items()}


@pytest.mark.parametrize("n_max", [1, 2, 3])
@pytest.mark.parametrize("part", [2, 7, 1000])
def test_terms(tokens, n_max, part):
    want = {}
    for block, s in by_hand(tokens).items():
        grams = Counter(" ".join(s[i:i + n]) for n in range(1, n_max + 1) for i in range(len(s) - n + 1))
        want.update({(block, term): n for term, n in grams.items()})
    got = {(r["block_id"], r["term"]): r["tf"] for r in sq.block_terms(tokens, n_max, part).collect()}
    assert got == want


def test_labels_multiply(spark, tokens):
    labels = spark.createDataFrame([("blk_1", 1), ("blk_1", 0), ("blk_9", 1)], "block_id string, true_label int")
    joined = sq.label_blocks(sq.block_stats(tokens), labels)
    assert joined.count() == 2
    assert tuple(sq.eval_population(joined).first()) == (2, 1)
    assert tuple(sq.eval_population(joined.where(F.lit(False))).first()) == (0, 0)
