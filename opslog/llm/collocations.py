"""Phrase collocations, counted in HAT-tries whose subtrees are spilled as sorted runs.

A word is known by a 64-bit id made of its language and its bytes. Each task counts the phrases of its
texts in a trie over the digits of their ids: inner nodes lead to 16 children by the next digit, leaves
are hash containers, and a container with too many phrases bursts into a node. When a task's trie
holds too many phrases, the largest subtrees below its root are spilled, each as one sorted run.
The runs of a prefix meet in one partition and are merged there by summing. Ids are checked: the words of
all texts are grouped by id, and if two share one, everything is counted anew with other ids.

A phrase counts only if its parts count as often, so each length is counted among the phrases whose shorter
parts are frequent. Tasks know those parts from a bitmap of fixed size; a false hit costs a row and
changes nothing, since rarer phrases are dropped after the merge. If the frequent parts outgrow the bitmap, it lets more
phrases through, and the tries count them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opslog.llm import arrays
from opslog.operators.ranking import first_per_key
from opslog.session import stage

LEAST, SHARE, FIRST = 10, 50, 2000
UNKNOWN = "und"
#: Bytes that end a piece of text, and those that part its words.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
IS_END = np.isin(np.arange(256), list(ENDS))
IS_BREAK = IS_END | np.isin(np.arange(256), list(BLANKS))

DIGIT = 4
#: Digits of the first words' hash in a phrase's path; the following ones are those of its last word.
HEAD = 10
#: Phrases of a container before it bursts, and of a task's trie before it spills down to the half.
BURST, HELD = 1 << 14, 1 << 20
#: Digits of a path that name the partition its phrases are merged in.
PREFIX = 3
FILTER_BITS = 27
#: Different words that a task counts before it sends them on.
WORDS_HELD = 300_000


def path_of(phrases: np.ndarray) -> np.ndarray:
    """Where a phrase stands in the trie: digits of all but its last word, then of the last one."""
    last = arrays.mix(phrases[:, -1])
    if phrases.shape[1] == 1:
        return last
    head = arrays.mix(phrases[:, 0])
    for k in range(1, phrases.shape[1] - 1):
        head = arrays.mix(head + phrases[:, k])
    low = np.uint64(64 - HEAD * DIGIT)
    return ((head >> low) << low) | (last >> np.uint64(HEAD * DIGIT))


def prefix_of(path: np.ndarray) -> np.ndarray:
    """The number of the prefix partition."""
    head = (path >> np.uint64(64 - PREFIX * DIGIT)) << np.uint64(DIGIT)
    last = (path >> np.uint64(64 - (HEAD + 1) * DIGIT)) & np.uint64((1 << DIGIT) - 1)
    return (head | last).astype(np.int32)


def combined(path: np.ndarray, phrases: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases in the order of their paths, equal ones next to each other as one."""
    order = np.argsort(path, kind="stable")
    path, phrases, counts = path[order], phrases[order], counts[order]
    head = np.ones(len(path), bool)
    head[1:] = (phrases[1:] != phrases[:-1]).any(axis=1)
    heads = np.flatnonzero(head)
    return path[heads], phrases[heads], np.add.reduceat(counts, heads) if len(heads) else counts


class Container:
    """Phrases with equal first digits: a sorted part and what came since."""

    def __init__(self, width: int):
        self.path, self.phrases, self.counts = np.empty(0, np.uint64), np.empty((0, width), np.uint64), np.empty(0, np.int64)
        self.new: list[tuple] = []
        self.waiting = 0

    def __len__(self) -> int:
        return len(self.path) + self.waiting

    def add(self, rows: tuple) -> bool:
        """Whether the new rows were sorted in."""
        self.new.append(rows)
        self.waiting += len(rows[0])
        if self.waiting <= max(len(self.path), BURST // 4):
            return False
        self.settle()
        return True

    def settle(self) -> tuple:
        if self.new:
            held = [(self.path, self.phrases, self.counts), *self.new]
            self.path, self.phrases, self.counts = combined(*(np.concatenate(x) for x in zip(*held)))
            self.new, self.waiting = [], 0
        return self.path, self.phrases, self.counts


class Trie:
    """Counts of phrases of ``width`` ids."""

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.burst = width, burst
        self.children: dict[int, Container | dict] = {}

    def add(self, phrases: np.ndarray) -> None:
        if len(phrases):
            rows = combined(path_of(phrases), phrases, np.ones(len(phrases), np.int64))
            self._into(self.children, rows, 0)

    def _into(self, node: dict, rows: tuple, depth: int) -> None:
        """Hand sorted rows to the children of a node at ``depth``."""
        digit = (rows[0] << np.uint64(depth * DIGIT)) >> np.uint64(64 - DIGIT)
        bounds = np.searchsorted(digit, np.arange((1 << DIGIT) + 1, dtype=np.uint64))
        for d in np.flatnonzero(np.diff(bounds)).tolist():
            part = tuple(x[bounds[d]:bounds[d + 1]] for x in rows)
            child = node.setdefault(d, Container(self.width))
            if isinstance(child, dict):
                self._into(child, part, depth + 1)
                continue
            if child.add(part) and len(child) > self.burst and (depth + 2) * DIGIT <= 64:
                node[d] = {}
                self._into(node[d], child.settle(), depth + 1)

    def size(self, node=None) -> int:
        node = self.children if node is None else node
        return sum(self.size(x) for x in node.values()) if isinstance(node, dict) else len(node)

    def _runs(self, node) -> Iterator[tuple]:
        if isinstance(node, dict):
            for d in sorted(node):
                yield from self._runs(node[d])
        else:
            yield node.settle()

    def spill(self, least: int) -> Iterator[tuple]:
        """Sorted runs of the largest subtrees until at most ``least`` phrases are held."""
        sizes = {d: self.size(x) for d, x in self.children.items()}
        held = sum(sizes.values())
        for d in sorted(sizes, key=sizes.get, reverse=True):
            if held <= least:
                break
            held -= sizes[d]
            yield tuple(np.concatenate(x) for x in zip(*self._runs(self.children.pop(d))))


class Texts:
    """The words of some texts: ids, bounds in the lower-cased bytes, and which follow one another in a piece.

    ``lang`` is the number of each text's language, ``seeds`` the seeds of the languages.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray, seeds: np.ndarray, id_bits: int):
        self.data = arrays.LOWER[data]
        self.starts, self.ends, first = arrays.word_slices(self.data, at, IS_BREAK)
        row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.lang = lang[row]
        self.ids = arrays.hashes(self.data, self.starts, self.ends, seeds[self.lang]) >> np.uint64(64 - id_bits)
        ended = np.cumsum(IS_END[self.data])
        self.joined = np.zeros(len(self.ids), bool)  # with the next word
        if len(self.ids) > 1:
            apart = ended[self.starts[1:] - 1] - ended[self.ends[:-1] - 1]
            self.joined[:-1] = (apart == 0) & (row[1:] == row[:-1])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Different words, as the index of an example and a count; words that share an id come out apart."""
        return arrays.distinct(self.data, self.starts, self.ends, self.ids, self.lang)[:2]


def seeds_of(langs: list[str], seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed} {x}".encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _texts(batch: pa.RecordBatch, seed: int, id_bits: int) -> Iterator[tuple[Texts, list[str]]]:
    """Texts of a batch in parts of bounded size, and the names of their languages."""
    column = batch.column(1).dictionary_encode()
    names, lang = column.dictionary.to_pylist(), column.indices.to_numpy(zero_copy_only=False)
    seeds = seeds_of(names, seed)
    data, at = arrays.buffers(batch.column(0))
    bounds = arrays.parted(data, at, IS_END)
    row = np.searchsorted(at, bounds[:-1], "right") - 1
    for a, b in arrays.pieces(bounds):
        yield Texts(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], lang[row[a:b]], seeds, id_bits), names


def _sources(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))


def count_words(source: DataFrame, seed: int, id_bits: int = 64) -> DataFrame:
    """``id``, ``lang``, ``word``, ``f`` of all words; ``shared`` is true where another word has the id."""
    def run(batches):
        held: dict[tuple[str, int, bytes], int] = {}

        def rows():
            items = list(held.items())
            held.clear()
            for i in range(0, len(items), 1 << 16):
                own = items[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[1] for k, _ in own], pa.uint64()).view(pa.int64()), pa.array([k[0] for k, _ in own], pa.string()),
                    pa.array([k[2].decode("utf-8", "replace") for k, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64()),
                ], names=["id", "lang", "word", "n"])

        for batch in batches:
            for part, langs in _texts(batch, seed, id_bits):
                raw = part.data.tobytes()
                example, count = part.words()
                for x, i, a, b, n in zip(part.lang[example].tolist(), part.ids[example].tolist(), part.starts[example].tolist(),
                                         part.ends[example].tolist(), count.tolist()):
                    key = langs[x], i, raw[a:b]
                    held[key] = held.get(key, 0) + n
                if len(held) > WORDS_HELD:
                    yield from rows()
        yield from rows()

    counted = source.mapInArrow(run, "id long, lang string, word string, n long").repartition("id").groupBy(
        "id", "lang", "word").agg(F.sum("n").alias("f"))
    return counted.withColumn("shared", F.count("*").over(Window.partitionBy("id")) > 1)


def bitmap(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size for any number of words or pairs: the bits of their hashes.

    Its parts are made in tasks; the driver gets 32 of them, 2 ** FILTER_BITS bits together.
    """
    parts, width = 32, (1 << FILTER_BITS) // 32

    def place(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            spot = np.unique((columns[0] if len(columns) == 1 else pair_hash(*columns)) >> np.uint64(64 - FILTER_BITS))
            yield pa.RecordBatch.from_arrays([pa.array((spot // np.uint64(width)).astype(np.int32)),
                                              pa.array(arrays.signed(spot % np.uint64(width)))], names=["part", "bit"])

    def fold(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(width, bool))[bit[part == p]] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(
                [np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])

    rows = ids.mapInArrow(place, "part int, bit long").repartition(parts, "part").mapInArrow(fold, "part int, bits binary")
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, bits in rows.collect():
        out[part * (width // 8):(part + 1) * (width // 8)] = np.frombuffer(bits, np.uint8)
    return out


def within(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set: always for those that were put in."""
    spot = (hashed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return arrays.mix(arrays.mix(left) + right)


def count_phrases(source: DataFrame, width: int, sent, least: int, seed: int = 0, id_bits: int = 64, burst: int = BURST,
                  held: int = HELD) -> DataFrame:
    """Phrases of two or three words that occur ``least`` times: their ids ``w1``.. and ``a``.

    ``sent`` holds the bitmap of the shorter parts that a phrase needs. A run's rows go to the partition
    of their prefix, which has one digit of the last word beside those of the first ones.
    """
    names = [f"w{k + 1}" for k in range(width)]

    def run(batches):
        bits, trie = sent.value, Trie(width, burst)

        def rows(least_held):
            for path, phrases, counts in trie.spill(least_held):
                for i in range(0, len(path), 1 << 16):
                    own = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(prefix_of(path[own])),
                        *(pa.array(arrays.signed(phrases[own, k])) for k in range(width)), pa.array(counts[own]),
                    ], names=["prefix", *names, "n"])

        for batch in batches:
            for part, _ in _texts(batch, seed, id_bits):
                ids, joined = part.ids, part.joined[:-1]
                if width == 2:
                    known = within(bits, ids)
                    at = np.flatnonzero(joined & known[:-1] & known[1:])
                else:
                    pairs = np.zeros(len(ids), bool)
                    at = np.flatnonzero(joined)
                    pairs[at[within(bits, pair_hash(ids[at], ids[at + 1]))]] = True
                    at = np.flatnonzero(pairs[:-1] & pairs[1:])
                trie.add(np.column_stack([ids[at + k] for k in range(width)]))
            if trie.size() > held:
                yield from rows(held // 2)
        yield from rows(0)

    runs = source.mapInArrow(run, "prefix int, " + ", ".join(f"{n} long" for n in names) + ", n long")
    return runs.repartition("prefix").groupBy("prefix", *names).agg(F.sum("n").alias("a")).where(F.col("a") >= least).drop("prefix")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE,
                 first: int = FIRST, id_bits: int = 64, held: int = HELD) -> DataFrame:
    """The best phrases of two and three words of each language.

    Returns ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of the two parts of the
    cut that scores least), ``n`` (words of the language) and ``score``. Phrases occur ``least`` times or more;
    one that lies in a longer phrase with ``share`` percent of its occurrences is left out. At most ``first`` rows a language.
    A null text counts as empty, a null language as ``und``; repeated rows count each; equal scores are ordered by
    occurrences, then by the phrase; an empty table gives no rows; other columns are ignored. Texts of any length are
    counted whole.
    """
    source, send = _sources(docs, text, lang), docs.sparkSession.sparkContext.broadcast
    seed = 0
    while True:
        counted = stage(count_words(source, seed, id_bits), "words")
        if not counted.where("shared").limit(1).count():
            break
        seed += 1  # two words had one id
    words = stage(counted.where(F.col("f") >= least).select("id", "lang", "word", "f"), "frequent")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs = stage(count_phrases(source, 2, send(bitmap(words.select("id"))), least, seed, id_bits, held=held), "pairs")
    triples = stage(count_phrases(source, 3, send(bitmap(pairs.select("w1", "w2"))), least, seed, id_bits, held=held), "triples")
    return _ranked(words, pairs, triples, totals, share, first)


def _cut(a: str, left: str, right: str):
    """Score of a cut, exactly: the products may have 38 digits."""
    wide = "cast({} as decimal(16, 0))".format
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})")


def _ranked(words: DataFrame, pairs: DataFrame, triples: DataFrame, totals: DataFrame, share: int, first: int) -> DataFrame:
    def word(k: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"),
                            *([F.col("lang")] if k == 1 else []))

    longer = triples.select("w1", "w2", F.col("a").alias("b")).union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(
        F.max("b").alias("b"))
    two = pairs.join(longer, ["w1", "w2"], "left").where(F.col("b").isNull() | (100 * F.col("b") < share * F.col("a"))) \
        .join(word(1), "w1").join(word(2), "w2").withColumn("s1", _cut("a", "f1", "f2")) \
        .select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                F.col("s1").alias("score"))
    heads = pairs.select("w1", "w2", F.col("a").alias("f12"))
    tails = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = triples.join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"]).join(word(1), "w1").join(word(2).drop("f2"), "w2") \
        .join(word(3), "w3").withColumn("s1", _cut("a", "f1", "f23")).withColumn("s2", _cut("a", "f12", "f3"))
    low = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(low, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(low, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = first_per_key(two.union(three), ["lang"], order, first)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", place).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
