"""Language model scores: masked pseudo-likelihood by a window network trained in numpy.

Every token is hidden in turn and predicted from the tokens on both sides of it; the sum of the
logarithms of these conditional chances scores a document. The most frequent words of the whole corpus are
predicted as such; all others, known or not, by the group of their first byte and then spelled byte by
byte, so each word has a chance of its own. The network adds one embedding per place of the window, bends
the sum, and predicts first the class of the hidden token, then the member of the class.

Training is spread: every task takes the present weights, makes its own steps over its documents and
gives back how far it came; these are averaged by the number of tokens they rest on. All
documents take part, and over the rounds every token is a target, so what is gathered grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays
from opslog.llm.toxicity import lowered

CLASSES, MEMBERS, RARE = 32, 32, 64
SIZE = CLASSES * MEMBERS
PLACES = (-2, -1, 1, 2)
WIDTH = 16
#: One of so many tokens of a document is a target in each round of training, and so many rounds take all of them.
EVERY = ROUNDS = 2
BATCH, RATE = 2048, 0.08
#: First bits of a fingerprint by which it is looked up.
LEAD = 16
PART = 1 << 16
#: Symbols of a spelling are the bytes and the end of the word, which also stands for what is before it.
SYMBOLS, EDGE = 257, 256
#: In a spelling the end is written as the byte 0, which stands in no word.
END = 0
#: A byte is spelled by the three before it, which fall into so many rows, as far as those were met, else by the one before it.
ROWS, BACK = 1 << 14, 4.0
SHAPES = {"embed": (len(PLACES), SIZE + 1, WIDTH), "bend": (WIDTH,), "klass": (WIDTH, CLASSES), "klass_bias": (CLASSES,),
          "gate": (CLASSES, WIDTH), "member": (WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS)}


def symbols(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of spelled words, the one before each, and the row that the three before each fall into."""
    size = ends - starts + 1
    close = np.cumsum(size)
    at = arrays.ragged(starts, size)
    symbol = low[np.minimum(at, len(low) - 1)].astype(np.int64)
    symbol[close - 1] = END
    # a place earlier is one further back in the row of all symbols, until the word before ends
    ahead = np.concatenate([np.full(3, END), symbol])[:len(at) + 2]
    before, *more = (ahead[3 - k:3 - k + len(at)].copy() for k in (1, 2, 3))
    begin = close - size
    for k, values in enumerate(more, 1):
        for i in range(k + 1):
            values[(begin + i)[size > i]] = END
    key = (before | (more[0] << 9) | (more[1] << 18)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return symbol, before, (key >> np.uint64(64 - ROWS.bit_length() + 1)).view(np.int64)


class Spelling:
    """Chances of spellings, from how often each symbol followed those before it."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(ROWS + SYMBOLS, SYMBOLS).astype(np.float32)
        self.far, near = counts[:ROWS], counts[ROWS:]
        self.met = self.far.sum(axis=1)
        self.near = (near + np.float32(BACK / SYMBOLS)) / (near.sum(axis=1, keepdims=True) + np.float32(BACK))
        _, before, row = symbols(np.zeros(1, np.uint8), np.array([0]), np.array([1]))
        lead = self.chances(np.arange(EDGE), before[0], row[0])
        self.groups = np.log(np.bincount(np.arange(EDGE) % RARE, lead, RARE))

    def chances(self, symbol, before, row) -> np.ndarray:
        return (self.far[row, symbol] + BACK * self.near[before, symbol].astype(np.float64)) / (self.met[row] + BACK)

    def of(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logarithm of the chance of each word among all of its group."""
        size = ends - starts + 1
        logs = np.log(self.chances(*symbols(low, starts, ends)))
        return arrays.row_sums(logs, np.concatenate([[0], np.cumsum(size)])) - self.groups[low[starts] % RARE]


@dataclass
class Words:
    """Fingerprints of the frequent words, sorted, and their ids; the spelling of all others."""

    prints: np.ndarray
    ids: np.ndarray
    spelling: Spelling | None = None

    def __post_init__(self):
        #: How many prints have smaller first bits; few prints share theirs, so from there it is rarely a step to a print's place.
        self.leads = np.searchsorted(self.prints, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD)).astype(np.int16)

    def of(self, found: np.ndarray, lead: np.ndarray) -> np.ndarray:
        rare = SIZE - RARE + lead.astype(np.int64) % RARE
        if not len(self.prints):
            return rare
        last = len(self.prints) - 1
        at = np.minimum(self.leads[found >> np.uint64(64 - LEAD)], last)
        left = np.flatnonzero(self.prints[at] < found)
        while len(left):
            left = left[at[left] < last]
            at[left] += 1
            left = left[self.prints[at[left]] < found[left]]
        return np.where(self.prints[at] == found, self.ids[at], rare)


def tokens(data: np.ndarray, at: np.ndarray):
    """Fingerprints of lower-case words, where each text's begin, the lower-case bytes and the words' slices."""
    low = lowered(data)
    starts, ends, first = arrays.word_slices(low, at, arrays.IS_BREAK)
    return arrays.hashes(low, starts, ends), first, low, starts, ends


def targets(first: np.ndarray, turn: int) -> np.ndarray:
    """Tokens that are targets in a round; the place of the first differs from text to text, by its length."""
    size = np.diff(first)
    place = np.arange(first[-1]) - np.repeat(first[:-1] - (size + turn) % EVERY, size)
    return np.flatnonzero(place % EVERY == 0)


def apart(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids with gaps as wide as a window around the texts, filled by an id of its own, and where each token stands there."""
    gap = max(PLACES)
    where = np.arange(len(ids)) + np.repeat(np.arange(1, len(first)) * gap, np.diff(first))
    out = np.full(len(ids) + len(first) * gap, SIZE)
    out[where] = ids
    return out, where


def windows(spread: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Ids around the tokens that stand at ``where`` among those of ``apart``, one column for each place."""
    out = np.empty((len(PLACES), len(where)), np.int64)
    for k, place in enumerate(PLACES):
        np.take(spread, where + place, out=out[k], mode="clip")
    return out.T


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {name: (rng.normal(0, 0.0 if name.endswith("bias") or name == "bend" else 0.1, shape)
                   + (1.0 if name == "gate" else 0.0)).astype(np.float32) for name, shape in SHAPES.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = np.asarray(values[at:at + n], np.float32).reshape(shape)
        at += n
    return out


def _log_softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column: the values less the largest, and the logarithm of the sum of their exponentials.

    A column is added as numpy adds a short row: eight sums side by side, then these by pairs.
    """
    z = z - np.maximum.reduce(z, axis=0)
    each = np.exp(z)
    total = each[:8]
    for i in range(8, len(each), 8):
        total = total + each[i:i + 8]
    while len(total) > 1:
        total = total[::2] + total[1::2]
    return z, np.log(total[0])


def _forward(w, around, target):
    """What a batch brings forth; values of classes and members have a column for each target."""
    total = w["bend"] + w["embed"][0].take(around[:, 0], axis=0)
    for k in range(1, len(PLACES)):
        total += w["embed"][k].take(around[:, k], axis=0)
    hidden = np.tanh(total)
    klass, member = target // MEMBERS, target % MEMBERS
    first = w["klass"].T @ hidden.T
    first += w["klass_bias"][:, None]
    gate = w["gate"].take(klass, axis=0)
    second = w["member"].T @ (hidden * gate).T
    second += w["member_bias"].T.take(klass, axis=1)
    return hidden, klass, member, gate, _log_softmax(first), _log_softmax(second)


def log_chances(w: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of every token given those around it."""
    out = np.empty(len(ids))
    spread, where = apart(ids, first)
    for a in range(0, len(ids), BATCH):
        now = slice(a, min(a + BATCH, len(ids)))
        _, klass, member, _, one, two = _forward(w, windows(spread, where[now]), ids[now])
        rows = np.arange(len(klass))
        out[now] = (one[0][klass, rows] - one[1]) + (two[0][member, rows] - two[1])
    return out


def gradient(w: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of a batch and its gradient."""
    hidden, klass, member, gate, one, two = _forward(w, around, target)
    n, rows = len(target), np.arange(len(target))
    first, second = (z - total for z, total in (one, two))
    loss = -(first[klass, rows] + second[member, rows]).mean()
    d1, d2 = np.exp(first), np.exp(second)
    d1[klass, rows] -= 1
    d2[member, rows] -= 1
    d1, d2 = (np.ascontiguousarray(d.T) / np.float32(n) for d in (d1, d2))
    back = d2 @ w["member"].T
    g = {"klass": hidden.T @ d1, "klass_bias": d1.sum(axis=0), "member": (hidden * gate).T @ d2}
    pick = np.zeros((n, CLASSES), np.float32)
    pick[rows, klass] = 1
    g["member_bias"], g["gate"] = pick.T @ d2, pick.T @ (back * hidden)
    inner = (d1 @ w["klass"].T + back * gate) * (1 - hidden * hidden)
    g["bend"] = inner.sum(axis=0)
    g["embed"] = np.zeros_like(w["embed"])
    for k in range(len(PLACES)):
        ids = around[:, k].astype(np.uint16)  # numpy sorts short integers by their digits
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        g["embed"][k][ids[heads]] = np.add.reduceat(inner.take(order, axis=0), heads, axis=0)
    return float(loss), g


class Steps:
    """Gradient steps whose size falls with what each weight has met."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in w.items()}
        self.met = {k: np.full_like(v, 1e-6) for k, v in w.items()}

    def take(self, around: np.ndarray, target: np.ndarray) -> float:
        loss, g = gradient(self.w, around, target)
        for name, value in g.items():
            self.met[name] += value * value
            self.w[name] -= np.float32(RATE) * value / np.sqrt(self.met[name])
        return loss


def vocabulary(docs: DataFrame, text: str = "text") -> Words:
    """The most frequent words of all documents; counts combine in each piece and before the shuffle."""
    def run(batch: pa.RecordBatch):
        data, at = arrays.buffers(batch.column(0))
        for a, b in arrays.pieces(at):
            found, *_ = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
            each, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(arrays.signed(each)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = arrays.map_batches(docs.select(F.col(text).cast("string")), run, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "word").limit(SIZE - RARE).collect()
    prints = np.array([r.word for r in rows], np.int64).view(np.uint64)
    order = np.argsort(prints)
    return Words(prints[order], order)


def spelling(docs: DataFrame, words: Words, text: str = "text") -> Spelling:
    """How all words that are not frequent are spelled, from all documents; the counts have a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrays.BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value, np.zeros((ROWS + SYMBOLS) * SYMBOLS, np.int64)
        for batch in batches:
            data, at = arrays.buffers(batch.column(0))
            for a, b in arrays.pieces(at):
                found, _, low, starts, ends = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
                if not len(found):
                    continue
                rare = known.of(found, low[starts]) >= SIZE - RARE
                symbol, before, row = symbols(low, starts[rare], ends[rare])
                np.add.at(counts, row * SYMBOLS + symbol, 1)
                np.add.at(counts, (before + ROWS) * SYMBOLS + symbol, 1)
        cell = np.flatnonzero(counts)
        for a in range(0, len(cell), PART):
            some = cell[a:a + PART]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["cell", "n"])

    sums = docs.select(F.col(text).cast("string")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros((ROWS + SYMBOLS) * SYMBOLS, np.float32)
    counts[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return Spelling(counts)


def improve(docs: DataFrame, words: Words, weights: np.ndarray, turn: int, text: str = "text") -> np.ndarray:
    """One round: weights averaged over all tasks by the number of their targets."""
    sent = docs.sparkSession.sparkContext.broadcast((Words(words.prints, words.ids), weights))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrays.BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begin = sent.value
        steps, seen = Steps(shaped(begin)), 0
        for batch in batches:
            data, at = arrays.buffers(batch.column(0))
            for a, b in arrays.pieces(at):
                found, first, low, starts, _ = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
                ids = known.of(found, low[starts])
                spread, where = apart(ids, first)
                target = np.random.default_rng(len(ids)).permutation(targets(first, turn))
                for i in range(0, len(target), BATCH):
                    now = target[i:i + BATCH]
                    steps.take(windows(spread, where[now]), ids[now])
                seen += len(target)
        if seen:
            moved = (flat(steps.w) - begin).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen]), pa.ListArray.from_arrays(pa.array([0, len(moved)], pa.int32()), pa.array(moved))],
                names=["n", "moved"])

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "n long, moved array<double>")
    sums = parts.select("n", F.posexplode("moved").alias("i", "x")).groupBy("i").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    out = weights.astype(np.float64).copy()
    at = sums.column("i").to_numpy()
    out[at] += sums.column("x").to_numpy() / sums.column("n").to_numpy()
    return out.astype(np.float32)


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Words, np.ndarray]:
    """Vocabulary and weights from all documents. The weights depend on how rows are dealt to tasks."""
    words, weights = vocabulary(docs, text), flat(start())
    words.spelling = spelling(docs, words, text)
    for turn in range(rounds):
        weights = improve(docs, words, weights, turn, text)
    return words, weights


def score(docs: DataFrame, model: tuple[Words, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``log_prob`` (sum of the log conditional chances) and ``mean_log_prob``.

    One narrow pass over whole texts; the model has a fixed size. A null text, or one without words, has
    no tokens, a sum of 0 and a null mean; rows are independent of each other; an empty table
    gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        known, values = sent.value
        w = shaped(values)
        spelled = known.spelling or Spelling(np.zeros((ROWS + SYMBOLS) * SYMBOLS))
        data, at = arrays.buffers(batch.column(1))
        for a, b in arrays.pieces(at):
            found, first, low, starts, ends = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
            ids = known.of(found, low[starts])
            chances = log_chances(w, ids, first)
            rare = np.flatnonzero(ids >= SIZE - RARE)
            if len(rare):
                chances[rare] += spelled.of(low, starts[rare], ends[rare])
            total, n = arrays.row_sums(chances, first), np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.where(n > 0, total, 0.0))],
                names=["key", "n_tokens", "log_prob"])

    kind = docs.schema[key].dataType.simpleString()
    out = arrays.map_batches(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run,
                             f"key {kind}, n_tokens long, log_prob double")
    return out.select(F.col("key").alias(key), "n_tokens", "log_prob",
                      (F.col("log_prob") / F.nullif("n_tokens", F.lit(0))).alias("mean_log_prob"))
