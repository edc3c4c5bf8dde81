"""Toxic spans by a linear-chain conditional random field, aggregated to a score per document.

Labels are per document, so tokens are labelled first: a cue, a word or a beginning of a word, that
is clearly more frequent in documents marked toxic marks the tokens it occurs in. A chain of two
states is then trained on those labelled tokens by forward and backward sums. Cues are the only
observations that carry weights, so a run of other tokens is a power of one matrix: whole documents
are scored exactly while only tokens with cues are visited. Forward-backward marginals give the
offending offsets, and a small logistic fit turns them into a document's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays, fitting

#: Labelled documents learnt from, and cues kept, at most.
SAMPLE = 8000
CUES = 4096
#: Bytes of a word's beginnings that may be cues, besides the word itself.
BEGINNINGS = (4, 5, 6)
#: A cue is in at least so many toxic documents, stands out by so many deviations, and so large a
#: part of the documents that have it are toxic.
SEEN, DEVIATIONS, SHARE = 4, 3.5, 0.5
#: A cue marks tokens from this share of toxic documents on.
MARKS = 0.7
GAP, LENGTH, EPOCHS, RATE, DECAY = 4, 64, 120, 0.15, 0.02
POWERS = 64
SIEVE = 20


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the two-byte letters from U+00C0 to U+00DE; no byte moves."""
    out = arrays.LOWER[data]
    wide = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[wide] += 32
    return out


def tokens(data: np.ndarray, at: np.ndarray):
    """Starts, ends and first token of each text, and the fingerprints of a token's features."""
    low = lowered(data)
    starts, ends, first = arrays.word_slices(low, at, arrays.IS_BREAK)
    size = ends - starts
    columns = [arrays.hashes(low, starts, ends)]
    for k in BEGINNINGS:
        # a beginning is told from a word of the same letters; a shorter word has none
        columns.append(np.where(size > k, arrays.hashes(low, starts, np.minimum(starts + k, ends), k), 0))
    return starts, ends, first, np.stack(columns, axis=1) if len(starts) else np.empty((0, 4), np.uint64)


@dataclass
class Model:
    """Cues with their weights, the chain and the document's logistic fit."""

    cues: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.cues)
        self.cues, self.weights = self.cues[order], self.weights[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(self.cues >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
        # one token without cues: move, then its own weight; scaled so that powers stay in range
        step = np.exp(self.moves) * np.exp([0.0, self.bias])
        step = step / np.abs(np.linalg.eigvals(step)).max()
        self.powers = np.stack([np.linalg.matrix_power(step, k) for k in range(POWERS)])

    def fired(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that have cues, and the sum of their weights."""
        if not len(self.cues) or not len(features):
            return np.empty(0, np.int64), np.empty(0)
        maybe = np.flatnonzero(self.sieve[(features >> np.uint64(64 - SIEVE)).astype(np.int64)])
        flat = features.ravel()[maybe]
        at = np.minimum(np.searchsorted(self.cues, flat), len(self.cues) - 1)
        real = self.cues[at] == flat
        token = maybe[real] // features.shape[1]
        which, group = np.unique(token, return_inverse=True)
        return which, np.bincount(group, self.weights[at[real]], minlength=len(which))

    def marginals(self, place: np.ndarray, weight: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Chance of the toxic state for each token with cues.

        ``place`` is its position in its text, ``first`` bounds the texts' tokens with cues and
        ``length`` is the number of all tokens of each text.
        """
        count = np.diff(first)
        rank = np.arange(len(place)) - np.repeat(first[:-1], count)
        own = np.exp(np.clip(np.stack([np.zeros(len(place)), weight + self.bias], axis=1), -40, 40))
        before = np.where(rank > 0, place - np.append(0, place[:-1]) - 1, place)
        text = np.repeat(np.arange(len(count)), count)
        after = np.where(rank < count[text] - 1, np.append(place[1:], 0) - place - 1, length[text] - 1 - place)
        move = np.exp(self.moves)
        through = lambda gap: self.powers[np.minimum(gap, POWERS - 1)]
        ahead, back = np.empty_like(own), np.empty_like(own)
        order = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[order], np.arange(int(count.max(initial=0)) + 1))
        start = np.array([1.0, np.exp(np.clip(self.bias, -40, 40))])
        for k in range(len(cuts) - 1):
            now = order[cuts[k]:cuts[k + 1]]
            state = np.broadcast_to(start, (len(now), 2)) if k == 0 else ahead[now - 1]
            gap = before[now]
            # the first token of a text is not entered by a move
            skip = np.maximum(gap - (k == 0), 0)
            state = np.einsum("ni,nij->nj", state, through(skip))
            moved = state @ move
            state = np.where(((k == 0) & (gap == 0))[:, None], 1.0, moved) * own[now]
            ahead[now] = state / state.sum(axis=1, keepdims=True)
        for k in range(len(cuts) - 2, -1, -1):
            now = order[cuts[k]:cuts[k + 1]]
            last = rank[now] == count[text[now]] - 1
            end = np.ones((len(now), 2))
            inner = now[~last]
            end[~last] = (own[inner + 1] * back[inner + 1]) @ move.T
            state = np.einsum("nij,nj->ni", through(after[now]), end)
            back[now] = state / state.sum(axis=1, keepdims=True)
        joint = ahead * back
        return joint[:, 1] / joint.sum(axis=1)

    def score(self, chance: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores of texts from the marginals of their tokens."""
        z = summary(chance, first, length) @ self.scale[:-1] + self.scale[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summary(chance: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a text's marginals say: the greatest, and their sum, beside the number of tokens."""
    total = arrays.row_sums(chance, first)
    most = np.zeros(len(first) - 1)
    text = np.repeat(np.arange(len(most)), np.diff(first))
    np.maximum.at(most, text, chance)
    return np.stack([most, np.log1p(total), np.log1p(length) / 10], axis=1)


def chain_fit(seen: np.ndarray, label: np.ndarray, live: np.ndarray, cues: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of cues, bias of the toxic state and moves from labelled sequences.

    ``seen`` (sequences, tokens, features) holds cue numbers or ``cues`` for none, ``label`` the
    states and ``live`` which tokens exist. Plain gradient steps with momentum and per-weight scale.
    """
    n, size, _ = seen.shape
    theta = np.zeros(cues + 1 + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    total = live.sum()
    for epoch in range(1, EPOCHS + 1):
        weight, bias, moves = np.append(theta[:cues], 0.0), theta[cues], theta[cues + 1:].reshape(2, 2)
        emit = np.zeros((n, size, 2))
        emit[:, :, 1] = weight[seen].sum(axis=2) + bias
        own, move = np.exp(np.clip(emit, -30, 30)), np.exp(moves)
        ahead, back = np.ones((n, size, 2)), np.ones((n, size, 2))
        ahead[:, 0] = own[:, 0] / own[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, size):
            state = (ahead[:, t - 1] @ move) * own[:, t]
            state /= state.sum(axis=1, keepdims=True)
            ahead[:, t] = np.where(live[:, t, None], state, ahead[:, t - 1])
        for t in range(size - 2, -1, -1):
            state = (own[:, t + 1] * back[:, t + 1]) @ move.T
            state /= state.sum(axis=1, keepdims=True)
            back[:, t] = np.where(live[:, t + 1, None], state, 1.0)
        joint = ahead * back
        chance = joint[:, :, 1] / joint.sum(axis=2)
        over = (chance - label) * live
        pair = ahead[:, :-1, :, None] * move * (own[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        both = live[:, 1:]
        had = np.zeros((2, 2))
        np.add.at(had, (label[:, :-1][both], label[:, 1:][both]), 1.0)
        grad = np.concatenate([
            np.bincount(seen.ravel(), np.repeat(over, seen.shape[2], axis=None), minlength=cues + 1)[:cues],
            [over.sum()], (pair * both[:, :, None, None]).sum(axis=(0, 1)).ravel() - had.ravel(),
        ]) / total
        grad += DECAY * theta / total
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad ** 2
        theta -= RATE * (mean / (1 - 0.9 ** epoch)) / (np.sqrt(square / (1 - 0.99 ** epoch)) + 1e-6)
    return theta[:cues], float(theta[cues]), theta[cues + 1:].reshape(2, 2)


def _cues(sampled: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Cues, whether each marks a token, and the numbers of toxic and other documents."""
    def run(batch: pa.RecordBatch):
        data, at = arrays.buffers(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in arrays.pieces(at):
            _, _, first, features = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
            row = np.repeat(np.repeat(np.arange(a, b), np.diff(first)), features.shape[1])
            flat = features.ravel()
            order = np.lexsort((row, flat))
            flat, row = flat[order], row[order]
            once = np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))[:len(flat)] & (flat != 0)
            flat, toxic = flat[once], label[row[once]] > 0
            each, group = np.unique(flat, return_inverse=True)
            bad = np.bincount(group, toxic, minlength=len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(arrays.signed(each)), pa.array(bad), pa.array(np.bincount(group, minlength=len(each)) - bad)],
                names=["feature", "bad", "good"])

    sizes = sampled.agg(F.sum((F.col("_label") > 0).cast("long")), F.count("*")).first()
    bad, good = sizes[0] or 0, sizes[1] - (sizes[0] or 0)
    if not bad or not good:
        return np.empty(0, np.uint64), np.empty(0, bool), bad, good
    found = arrays.map_batches(
        sampled.select(F.col(text).cast("string"), F.col("_label").cast("int")), run, "feature long, bad long, good long"
    ).groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= SEEN)
    p, q = F.col("bad") / bad, F.col("good") / good
    spread = F.sqrt((F.col("bad") + 1) / bad / bad + (F.col("good") + 1) / good / good)
    rows = found.withColumn("z", (p - q) / spread).where(
        (F.col("z") >= DEVIATIONS) & (F.col("bad") >= SHARE * (F.col("bad") + F.col("good")))
    ).orderBy(F.desc("z"), "feature").limit(CUES).select("feature", "bad", "good").collect()
    cues = np.array([r.feature for r in rows], np.int64).view(np.uint64)
    return cues, np.array([r.bad >= MARKS * (r.bad + r.good) for r in rows], bool), bad, good


def fit(sampled: DataFrame, text: str = "text") -> Model:
    """Learn from a bounded sample with a ``_label`` column, 1 for toxic.

    Without documents of both kinds the score is the share of toxic ones, 0 if there are none.
    """
    cues, marking, bad, good = _cues(sampled, text)
    blank = Model(cues, np.zeros(len(cues)), 0.0, np.zeros((2, 2)), np.zeros(4))
    if not len(cues):
        share = bad / max(bad + good, 1)
        blank.scale[-1] = np.log(max(share, 1e-9) / max(1 - share, 1e-9)) if bad else -30.0
        return blank
    order = np.argsort(cues)
    cues, marking = cues[order], marking[order]

    def run(batch: pa.RecordBatch):
        finder = Model(cues, np.zeros(len(cues)), 0.0, np.zeros((2, 2)), np.zeros(4))
        data, at = arrays.buffers(batch.column(0))
        for a, b in arrays.pieces(at):
            _, _, first, features = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
            which, _ = finder.fired(features)
            spot = np.searchsorted(finder.cues, features[which])
            spot = np.where(finder.cues[np.minimum(spot, len(cues) - 1)] == features[which], spot, len(cues))
            cut = np.searchsorted(which, first)
            place = which - np.repeat(first[:-1], np.diff(cut))
            yield pa.RecordBatch.from_arrays([
                batch.column(1).slice(a, b - a), pa.array(np.diff(first)),
                pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(place.astype(np.int64))),
                pa.ListArray.from_arrays(pa.array((cut * features.shape[1]).astype(np.int32)), pa.array(spot.ravel().astype(np.int64))),
            ], names=["label", "length", "place", "cue"])

    rows = arrays.map_batches(
        sampled.select(F.col(text).cast("string"), F.col("_label").cast("int")), run,
        "label int, length long, place array<bigint>, cue array<bigint>",
    ).orderBy(F.xxhash64("label", "length", "place", "cue")).collect()
    wide = len(BEGINNINGS) + 1
    seen, label, live = _sequences(rows, marking, len(cues), wide)
    weights, bias, moves = chain_fit(seen, label, live, len(cues))
    model = Model(cues, weights, bias, moves, np.zeros(4))
    place = np.concatenate([np.array(r.place, np.int64) for r in rows])
    flat = np.concatenate([np.array(r.cue, np.int64) for r in rows]).reshape(-1, wide)
    first = np.concatenate([[0], np.cumsum([len(r.place) for r in rows])])
    length = np.array([r.length for r in rows])
    chance = model.marginals(place, np.append(weights, 0.0)[flat].sum(axis=1), first, length)
    model.scale = fitting.logistic(summary(chance, first, length), np.array([r.label > 0 for r in rows], float), 0.05)
    return model


def _sequences(rows, marking, cues: int, wide: int):
    """Labelled sequences of bounded length; longer stretches without cues are shortened."""
    marks = np.append(marking, False)
    made = []
    for r in rows:
        flat, states, last = [], [], -1
        cue = np.array(r.cue, np.int64).reshape(-1, wide)
        for p, own in zip(r.place, cue):
            gap = min(p - last - 1, GAP)
            flat += [[cues] * wide] * gap + [own]
            states += [0] * gap + [int(marks[own].any() and r.label > 0)]
            last = p
        gap = min(r.length - last - 1, GAP)
        flat += [[cues] * wide] * gap
        states += [0] * gap
        made += [(flat[i:i + LENGTH], states[i:i + LENGTH]) for i in range(0, len(flat), LENGTH)]
    seen = np.full((len(made), LENGTH, wide), cues)
    label = np.zeros((len(made), LENGTH), np.int64)
    live = np.zeros((len(made), LENGTH), bool)
    for i, (flat, states) in enumerate(made):
        seen[i, :len(flat)], label[i, :len(flat)], live[i, :len(flat)] = flat, states, True
    return seen, label, live


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
          carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``score`` and ``spans``: byte offsets and chance of every token found offending.

    One narrow pass over whole texts; the model has a fixed size and is sent once. A null or empty
    text has no spans and the score of a text without cues; rows are independent of each other.
    Columns named in ``carry`` are kept as the fields of a column ``row``, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.cues, model.weights, model.bias, model.moves, model.scale))

    def run(batch: pa.RecordBatch):
        own = Model(*sent.value)
        data, at = arrays.buffers(batch.column(1))
        for a, b in arrays.pieces(at):
            starts, ends, first, features = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
            which, weight = own.fired(features)
            cut = np.searchsorted(which, first)
            length = np.diff(first)
            row = np.repeat(np.arange(b - a), np.diff(cut))
            chance = own.marginals(which - first[row], weight, cut, length)
            found = np.flatnonzero(chance >= 0.5)
            span = pa.StructArray.from_arrays([
                pa.array((starts[which[found]] + at[a] - at[a + row[found]]).astype(np.int64)),
                pa.array((ends[which[found]] + at[a] - at[a + row[found]]).astype(np.int64)),
                pa.array(chance[found]),
            ], names=["start", "end", "chance"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(found, cut).astype(np.int32)), span)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(own.score(chance, cut, length)), spans,
                 *(c.slice(a, b - a) for c in batch.columns[2:])], names=["key", "score", "spans", "row"][:3 + bool(carry)])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                         *([F.struct(*carry).alias("row")] if carry else []))
    schema = f"key {docs.schema[key].dataType.simpleString()}, score double, spans array<struct<start: bigint, end: bigint, chance: double>>"
    if carry:
        schema += f", row {source.schema['row'].dataType.simpleString()}"
    return arrays.map_batches(source, run, schema).withColumnRenamed("key", key)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          bound: int = SAMPLE) -> Model:
    """Fit on at most ``bound`` labelled documents."""
    both = docs.select(key, text)
    sampled = fitting.sample(both, labels.select(key, label), key, label, bound)
    # copies of one text would make all of its words look telling
    return fit(sampled.groupBy(text).agg(F.max("_label").alias("_label")), text)
