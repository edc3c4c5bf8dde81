"""Benchmark passages in documents, by a random walk that turns edits into differing places.

The walk reads words and at each step emits the word under its pointer; a bit of that word's hash,
another one at each step, says whether the pointer moves on. Two word sequences a few edits apart
walk in step again soon after each edit, so their outputs differ in few places. A repetition samples
some places of a walk as its key. Walks begin at every word of items and documents. Random repetitions
alone would miss some passages, above all short ones with many edits. So a last repetition moves on at
every step, for as many steps as a run of unedited words has that the allowed edits must leave somewhere
in an item of its length: ``k`` edits leave at most ``k + 1`` runs. With it the recall is 1. What shares a
key is confirmed by the edit distance of the whole item to the best stretch of the document around it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays
from opslog.llm.toxicity import lowered

#: Edits allowed, as a share of an item's words.
EDITS = 0.2
#: Sampled places of the walk in each random repetition.
PLACES = ((0, 3, 6, 9), (1, 4, 6, 10), (0, 2, 5, 8), (2, 3, 7, 10))
STEPS = max(max(p) for p in PLACES) + 1
#: Items with fewer words are too short for a walk and are looked for unedited.
SHORT = 8
#: Words of items that are sent to the tasks at once; a larger benchmark takes several passes.
SENT_WORDS = 2_000_000
SIEVE, OWN = 20, 22
CANDIDATES = 4096
#: Stretches whose words are compared with the item's at a time.
STRETCHES = 1 << 15


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of lower-case words of letters and digits, and where each text's begin."""
    low = lowered(data)
    starts, ends, first = arrays.word_slices(low, at, arrays.IS_BREAK)
    return arrays.hashes(low, starts, ends), first


def walks(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int, sieves=None):
    """Keys of the walks from ``starts`` that stay before ``ends``, and which walks they are.

    With ``sieves``, one per sampled place, walks that no item can share are dropped on the way.
    """
    pick = np.arange(len(starts))
    spot, key = starts.copy(), np.full(len(starts), turn, np.uint64)
    for step in range(PLACES[turn][-1] + 1):
        inside = spot < ends[pick]
        if not inside.all():
            pick, spot, key = pick[inside], spot[inside], key[inside]
        word = words[spot]
        if step in PLACES[turn]:
            key = arrays.mix(key + word)
            if sieves is not None:
                some = sieves[PLACES[turn].index(step)][(key >> np.uint64(64 - SIEVE)).astype(np.int64)]
                pick, spot, key, word = pick[some], spot[some], key[some], word[some]
        spot = spot + ((word >> np.uint64((turn * STEPS + step) % 64)) & np.uint64(1)).astype(np.int64)
    return key, pick


def allowed_edits(size: np.ndarray) -> np.ndarray:
    return np.floor(EDITS * size).astype(np.int64)


def unedited_run(size: np.ndarray) -> np.ndarray:
    """Words of the longest unedited run that items of ``size`` words keep at least."""
    allowed = allowed_edits(size)
    return -((allowed - size) // (allowed + 1))


def _own(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The place of a word of an item in the table of all such pairs."""
    return (arrays.mix(words + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - OWN)).astype(np.int64)


@dataclass
class Index:
    """Words of items and the keys of their walks."""

    words: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        size = np.diff(self.first)
        item = np.repeat(np.arange(len(size)), size)
        starts = np.arange(len(self.words))
        long = size[item] >= SHORT
        starts, ends, item = starts[long], self.first[1:][item[long]], item[long]
        self.keys, self.starts, self.sieves = [], [], []
        for turn in range(len(PLACES)):
            key, pick = walks(self.words, starts, ends, turn)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.starts.append(starts[pick][order])
            self.sieves.append(self._sieves(starts, ends, turn))
        self.item = np.repeat(np.arange(len(size)), size)
        self.runs = {}
        spans, run = arrays.Spans(self.words), unedited_run(size)[item]
        for n in np.unique(run).tolist():
            begin = starts[(run == n) & (starts + n <= ends)]
            prints = spans.of(begin, begin + n)
            order = np.argsort(prints)
            sieve = np.zeros(1 << OWN, bool)
            sieve[(prints >> np.uint64(64 - OWN)).astype(np.int64)] = True
            self.runs[n] = (prints[order], begin[order], sieve)
        self.belongs = np.zeros(1 << OWN, bool)
        self.belongs[_own(self.words, self.item)] = True
        self.short = {}
        for n in sorted(set(size[(size > 0) & (size < SHORT)].tolist())):
            which = np.flatnonzero(size == n)
            prints = spans.of(self.first[which], self.first[which] + n)
            order = np.argsort(prints)
            self.short[n] = (prints[order], which[order])

    def _sieves(self, starts, ends, turn):
        out = []
        for last in range(len(PLACES[turn])):
            spot, key, alive = starts.copy(), np.full(len(starts), turn, np.uint64), np.ones(len(starts), bool)
            for step in range(PLACES[turn][last] + 1):
                alive &= spot < ends
                word = self.words[np.minimum(spot, len(self.words) - 1)]
                if step in PLACES[turn]:
                    key = arrays.mix(key + word)
                spot = spot + ((word >> np.uint64((turn * STEPS + step) % 64)) & np.uint64(1)).astype(np.int64)
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[(key[alive] >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
            out.append(sieve)
        return out

    def candidates(self, words: np.ndarray, first: np.ndarray):
        """Text, item, and the word at which the item would begin, for everything that shares a key."""
        size = np.diff(first)
        starts = np.arange(len(words))
        text = np.repeat(np.arange(len(size)), size)
        ends = first[1:][text]
        found = []

        def shared(keys, places, key, pick):
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            some = high > low
            pick, low, each = pick[some], low[some], (high - low)[some]
            place = places[arrays.ragged(low, each)]
            walk = np.repeat(pick, each)
            item = self.item[place]
            found.append((text[walk], item, starts[walk] - (place - self.first[item])))

        for turn, (keys, places) in enumerate(zip(self.keys, self.starts)):
            if not len(keys) or not len(starts):
                continue
            shared(keys, places, *walks(words, starts, ends, turn, self.sieves[turn]))
        spans = arrays.Spans(words)
        for n, (keys, places, sieve) in self.runs.items():
            pick = np.flatnonzero(starts + n <= ends)
            key = spans.of(pick, pick + n)
            some = sieve[(key >> np.uint64(64 - OWN)).astype(np.int64)]
            shared(keys, places, key[some], pick[some])
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def unedited(self, words: np.ndarray, first: np.ndarray):
        """Text, item and first word of unedited short items."""
        spans = arrays.Spans(words)
        for n, (prints, which) in self.short.items():
            starts = arrays.ragged(first[:-1], np.maximum(np.diff(first) - n + 1, 0))
            if not len(starts):
                continue
            own = spans.of(starts, starts + n)
            low, high = np.searchsorted(prints, own, "left"), np.searchsorted(prints, own, "right")
            hit = high > low
            each = (high - low)[hit]
            begin = np.repeat(starts[hit], each)
            yield np.searchsorted(first, begin, "right") - 1, which[arrays.ragged(low[hit], each)], begin


def distances(words: np.ndarray, begin: np.ndarray, end: np.ndarray, pattern: np.ndarray, p_begin: np.ndarray,
              p_size: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to any stretch of ``words[begin:end]``."""
    n, wide = len(begin), int(p_size.max(initial=0))
    column = np.arange(wide + 1)
    own = pattern[np.minimum(p_begin[:, None] + column[:-1], len(pattern) - 1)]
    state = np.broadcast_to(column, (n, wide + 1)).astype(np.int32).copy()
    best = state[np.arange(n), p_size].copy()
    for step in range(int((end - begin).max(initial=0))):
        at = begin + step
        live = at < end
        word = words[np.minimum(at, len(words) - 1)]
        new = np.zeros_like(state)
        new[:, 1:] = np.minimum(state[:, 1:] + 1, state[:, :-1] + (own != word[:, None]))
        new = np.minimum.accumulate(new - column, axis=1) + column
        state = np.where(live[:, None], new, state).astype(np.int32)
        best = np.minimum(best, state[np.arange(n), p_size])
    return best


def confirm(index: Index, words: np.ndarray, first: np.ndarray, text, item, begin):
    """Text, item, first word and distance of the candidates within the allowed edits."""
    if not len(text):
        return (np.empty(0, np.int64),) * 4
    size = np.diff(index.first)[item]
    allowed = allowed_edits(size)
    order = np.lexsort((begin, item, text))
    text, item, begin, size, allowed = (x[order] for x in (text, item, begin, size, allowed))
    # candidates of one place are looked at together: a stretch that takes in both
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(text)) - 1
    low = np.maximum(begin[heads] - allowed[heads], first[text[heads]])
    high = np.minimum(begin[tails] + size[tails] + allowed[tails], first[text[heads] + 1])
    # a stretch within the allowed edits has all but so many of the item's words
    real = np.empty(len(heads), bool)
    for k in range(0, len(heads), STRETCHES):
        now = slice(k, k + STRETCHES)
        each = (high - low)[now]
        shared = index.belongs[_own(words[arrays.ragged(low[now], each)], np.repeat(item[heads[now]], each))]
        real[now] = arrays.row_sums(shared, np.concatenate([[0], np.cumsum(each)])) >= (size - allowed)[heads[now]]
    heads, low, high = heads[real], low[real], high[real]
    if not len(heads):
        return (np.empty(0, np.int64),) * 4
    out = []
    by_size = np.argsort(size[heads] * 100_000 + (high - low), kind="stable")
    for k in range(0, len(heads), CANDIDATES):
        now = by_size[k:k + CANDIDATES]
        own = item[heads[now]]
        away = distances(words, low[now], high[now], index.words, index.first[own], size[heads[now]])
        good = away <= allowed[heads[now]]
        out.append((text[heads[now]][good], own[good], begin[heads[now]][good], away[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _indexed(items: DataFrame, item_key: str, item_text: str) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """Items as word arrays, in blocks of a bounded number of words."""
    blocks, block, total = [], [], 0
    rows = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_key), F.col(item_text).cast("string")).distinct().orderBy(item_key, item_text).toLocalIterator()
    for key, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        words, _ = words_of(raw, np.array([0, len(raw)]))
        if not len(words):
            continue
        if block and total + len(words) > SENT_WORDS:
            blocks.append(block)
            block, total = [], 0
        block.append((key, words))
        total += len(words)
    if block:
        blocks.append(block)
    return [([k for k, _ in b], np.concatenate([w for _, w in b]), np.concatenate([[0], np.cumsum([len(w) for _, w in b])]))
            for b in blocks]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """``key``, ``item_key`` and ``distance`` in words of every item that a document holds with few edits.

    An item is held if some stretch of the document is within ``EDITS`` of its words in edits; items of
    fewer than ``SHORT`` words are looked for unedited. One row per document and item, with the least
    distance found. Whole texts are read once for each ``SENT_WORDS`` words of items.

    Edge cases: null texts, texts and items without words, and items without a key hold nothing;
    documents without a key are left out; repeated documents and items count once; items with equal
    words are all reported; an empty table on either side gives an empty table.
    """
    spark = docs.sparkSession
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kinds[1])
    schema = f"key {kinds[0]}, item {kinds[1]}, distance int"
    source = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # without items; of the JVM, as rows of this process would start further Python workers beside those of the operators
    found = spark.range(0).select(*(F.lit(None).cast(k).alias(c) for k, c in zip((*kinds, "int"), ("key", "item", "distance"))))
    for names, words, first in _indexed(items, item_key, item_text):
        sent = spark.sparkContext.broadcast((names, words, first))
        found = found.union(arrays.map_batches(source, _finder(sent, item_type, uuid.uuid4().hex), schema))
    return found.groupBy(F.col("key").alias(key), F.col("item").alias(item_key)).agg(F.min("distance").alias("distance"))


def _finder(sent, item_type, block: str):
    def run(batch: pa.RecordBatch):
        names, item_words, item_first = sent.value
        index = arrays.kept(block, lambda: Index(item_words, item_first))
        data, at = arrays.buffers(batch.column(1))
        for a, b in arrays.pieces(at):
            words, first = words_of(data[at[a]:at[b]], at[a:b + 1] - at[a])
            if not len(words):
                continue
            parts = [confirm(index, words, first, *index.candidates(words, first))]
            parts += [(t, i, s, np.zeros(len(t), np.int64)) for t, i, s in index.unedited(words, first)]
            text, item, _, away = (np.concatenate(x) for x in zip(*parts))
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text + a)), pa.array([names[i] for i in item], item_type),
                     pa.array(away.astype(np.int32))], names=["key", "item", "distance"])

    return run
