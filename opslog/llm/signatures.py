"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of like size form blocks. A block holds one bitmap per signature bit, with a bit for each of its
documents, and the terms of its documents for exact scores. A term sets bits for every class its frequency
reaches, so the bitmaps of a query term's bits, taken together, show a superset of the documents in
which it is that frequent. Summed with the weights of the classes they bound every document's score from above.
Documents whose bound is below the score of the k-th best so far are left out; all others are scored exactly
from their terms. The bounds of the first pass, over a part of the blocks, start the second one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opslog.llm import arrays
from opslog.session import stage

#: Frequencies at which a term sets further bits; between two of them the greater one bounds the frequency.
STEPS = (1, 2, 3, 5, 9, 17)
BITS, PLACES = 12, 4
#: Bits of a block's signatures together, and the most bits of a signature.
BLOCK, WIDEST = 1 << 19, 1 << 20
#: Queries that are searched together, and bytes of queries that are sent at once.
GROUP, SENT_BYTES = 256, 1 << 25
#: Frequencies from here on are kept beside the others, which have a byte each.
OFTEN, SPACE = 255, 0x20
#: Documents of a block that are looked at together, a multiple of 8.
COLUMNS = 256
#: One block of so many is looked at first.
FIRST_OF = 16

BLOCK_SCHEMA = "width int, docs int, n binary, terms binary, tf binary, often binary, each binary, slices binary"


def terms_of(data: np.ndarray, at: np.ndarray):
    """Lower-cased bytes, bounds of all terms, the first term of each text, and the terms' hashes."""
    low = arrays.LOWER[data]
    starts, ends, first = arrays.word_slices(low, at, arrays.IS_BREAK)
    return low, starts, ends, first, arrays.hashes(low, starts, ends, 11)


def places(hashed: np.ndarray, step: int, width: int) -> np.ndarray:
    """The bits, one row a hash function, that terms set when their frequency reaches ``STEPS[step]``."""
    out, h = [], hashed
    for k in range(PLACES):
        h = arrays.mix(h + np.uint64(1 + step * PLACES + k))
        out.append((h & np.uint64(width - 1)).astype(np.int64))
    return np.stack(out)


class Held:
    """Documents of one size that wait for their block to be full."""

    def __init__(self, width: int):
        self.width = width
        self.limit = max(8, BLOCK // width)
        self.clear()

    def clear(self) -> None:
        self.keys: list = []
        self.n: list[int] = []
        self.parts: list[tuple] = []  # a document's terms, a space after each, their frequencies and hashes

    def block(self) -> tuple:
        """The keys and the columns of the block."""
        bits = np.zeros((self.width, -(-len(self.n) // 8) * 8), np.uint8)
        each = np.array([len(p[1]) for p in self.parts], "<u4")
        doc = np.repeat(np.arange(len(each)), each)
        tf, hashed = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2))
        for step, least in enumerate(STEPS):
            on = tf >= least
            for spot in places(hashed[on], step, self.width):
                bits[spot, doc[on]] = 1
        out = (self.keys, self.width, len(self.n), np.array(self.n, "<i8").tobytes(), b"".join(p[0] for p in self.parts),
               np.minimum(tf, OFTEN).astype(np.uint8).tobytes(), tf[tf >= OFTEN].astype("<i8").tobytes(),
               each.tobytes(), np.packbits(bits, axis=1, bitorder="little").tobytes())
        self.clear()
        return out


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: blocks of documents with their signatures, one narrow pass without a shuffle.

    Documents without a term are not in it. Stage it before searching more than once.
    """
    names = ["keys", *(x.split()[0] for x in BLOCK_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Held] = {}
        kind = None

        def out(block: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block[0]], pa.list_(kind))] + [
                pa.array([x], t) for x, t in zip(block[1:], [pa.int32()] * 2 + [pa.binary()] * 6)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            data, at = arrays.buffers(batch.column(1))
            for a, b in arrays.pieces(at):
                low, starts, ends, first, hashed = terms_of(data[at[a]:at[b]], at[a:b + 1] - at[a])
                count = np.diff(first)
                row = np.repeat(np.arange(b - a), count)
                example, tf, _ = arrays.distinct(low, starts, ends, arrays.mix(hashed + arrays.mix(row.astype(np.uint64))), row)
                order = np.argsort(row[example], kind="stable")
                example, tf = example[order], tf[order]
                bounds = np.searchsorted(row[example], np.arange(b - a + 1))
                steps = np.searchsorted(STEPS, tf, "right")
                needed = BITS * arrays.row_sums(steps, bounds)
                sizes = ends[example] - starts[example] + 1
                pool = low[np.minimum(arrays.ragged(starts[example], sizes), len(low) - 1)]
                pool[np.cumsum(sizes) - 1] = SPACE
                pool_at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
                for i in np.flatnonzero(count).tolist():
                    width = min(1 << max(6, int(needed[i] - 1).bit_length()), WIDEST)
                    mine = held.setdefault(width, Held(width))
                    own = slice(bounds[i], bounds[i + 1])
                    mine.keys.append(keys[a + i])
                    mine.n.append(int(count[i]))
                    mine.parts.append((pool[pool_at[i]:pool_at[i + 1]].tobytes(), tf[own], hashed[example[own]]))
                    if len(mine.n) >= mine.limit:
                        yield out(mine.block())
        for mine in held.values():
            if mine.n:
                yield out(mine.block())

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"keys array<{kind}>, {BLOCK_SCHEMA}")


class Block:
    """A block as arrays."""

    def __init__(self, row: dict):
        self.keys, self.width, self.docs = row.get("keys"), row["width"], row["docs"]
        self.n = np.frombuffer(row["n"], "<i8")
        self.terms = np.frombuffer(row["terms"], np.uint8)
        self.tf = np.frombuffer(row["tf"], np.uint8).astype(np.int64)
        self.tf[self.tf == OFTEN] = np.frombuffer(row["often"], "<i8")
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(row["each"], "<u4").astype(np.int64))])
        self.ends = np.flatnonzero(self.terms == SPACE)  # no term holds one
        self.slices = np.frombuffer(row.get("slices", b""), np.uint8).reshape(self.width, -1)

    def found(self, vocabulary: Vocabulary, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query terms in ``docs``: the place of the document, the term's number and its frequency."""
        each = self.first[docs + 1] - self.first[docs]
        entry = arrays.ragged(self.first[docs], each)
        doc = np.repeat(np.arange(len(docs)), each)
        number = vocabulary.numbers(self.terms, np.append(0, self.ends + 1)[entry], self.ends[entry])
        hit = number >= 0
        return doc[hit], number[hit], self.tf[entry[hit]]


class Vocabulary:
    """The different terms of some queries, found by hash and told apart by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.pool = np.frombuffer(b"".join(terms), np.uint8)
        sizes = np.array([len(t) for t in terms], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.hashes = arrays.hashes(self.pool, self.starts, self.ends, 11)
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term that each slice is, -1 if none."""
        out = np.full(len(starts), -1, np.int64)
        hashed = arrays.hashes(data, starts, ends, 11)
        at = np.searchsorted(self.sorted, hashed)
        left = np.flatnonzero(at < len(self.sorted))
        left = left[self.sorted[at[left]] == hashed[left]]
        while len(left):  # further rounds only for terms that share a hash
            number = self.order[at[left]]
            sizes = ends[left] - starts[left]
            same = self.ends[number] - self.starts[number] == sizes
            same[same] = arrays.same_slices(data, starts[left[same]], self.pool, self.starts[number[same]], sizes[same])
            out[left[same]] = number[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(self.sorted)]
            left = left[self.sorted[at[left]] == hashed[left]]
        return out


def lowered_terms(text: str) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    low, starts, ends, _, _ = terms_of(data, np.array([0, len(data)]))
    return [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


class Queries:
    """A group of queries: their vocabulary, and how often each has each term."""

    def __init__(self, texts: list[list[bytes]]):
        self.terms = sorted({t for text in texts for t in text})
        number = {t: i for i, t in enumerate(self.terms)}
        self.vocabulary = Vocabulary(self.terms)
        self.times = np.zeros((len(texts), len(self.terms)), np.int64)
        for i, text in enumerate(texts):
            for t in text:
                self.times[i, number[t]] += 1


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that often in a document of that length adds, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Search:
    """The best documents of each query of a group among the blocks met so far.

    Sums below 2 ** 53 are those of doubles, which are exact; the queries of a group may need longer integers.
    """

    def __init__(self, queries: Queries, weights: np.ndarray, total: int, length: int, k: int, least: np.ndarray):
        self.queries, self.total, self.length, self.k = queries, total, length, k
        weighted = queries.times * weights
        short = weighted.sum(axis=1).max(initial=0) < (1 << 53) // 1_000_000
        self.kind = np.float64 if short else np.int64
        self.weighted = weighted.astype(self.kind)
        self.least = least.astype(np.int64)  # a document must score as much
        self.best: tuple[np.ndarray, np.ndarray, list] = (np.empty(0, np.int64), np.empty(0, np.int64), [])
        self.scored = self.met = 0

    def bounds(self, block: Block, m: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, a row a query."""
        hashed = self.queries.vocabulary.hashes
        spots = [places(hashed, step, block.width) for step in range(len(STEPS))]
        out = np.empty((len(self.weighted), block.docs), np.int64)
        for a in range(0, block.docs, COLUMNS):
            slices, length = block.slices[:, a // 8:(a + COLUMNS) // 8], m[a:a + COLUMNS]
            reach = np.zeros((len(hashed), len(length)), self.kind)
            live, present, before = np.arange(len(hashed)), None, np.zeros(len(length), np.int64)
            for step in range(len(STEPS)):
                own = slices[spots[step][0, live]]
                for spot in spots[step][1:]:
                    own = own & slices[spot[live]]
                present = own if present is None else present & own
                some = present.any(axis=1)
                live, present = live[some], present[some]
                top = impact(np.int64(STEPS[step + 1] - 1), length) if step + 1 < len(STEPS) else np.full(len(length), 1_000_000)
                on = np.unpackbits(present, axis=1, bitorder="little")[:, :len(length)]
                reach[live] += on * (top - before).astype(self.kind)
                before = top
            out[:, a:a + COLUMNS] = self.weighted @ reach
        return out

    def look(self, block: Block) -> None:
        m = 75 + (25 * block.n * self.total) // self.length
        bound = self.bounds(block, m)
        self.met += bound.size
        usable = np.array([x is not None for x in block.keys])
        bound[:, ~usable] = 0
        done = np.zeros(bound.shape, bool)
        if block.docs > self.k:  # the highest bounds first, so that they raise the limit for the others
            top = np.argpartition(bound, block.docs - self.k, axis=1)[:, -self.k:]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, top, True, axis=1)
            done = first & (bound >= self.least[:, None]) & (bound > 0)
            self.score(block, m, done)
        self.score(block, m, (bound >= self.least[:, None]) & (bound > 0) & ~done)

    def score(self, block: Block, m: np.ndarray, wanted: np.ndarray) -> None:
        """Exact scores of the wanted documents; the best stay."""
        docs = np.flatnonzero(wanted.any(axis=0))
        for i in range(0, len(docs), COLUMNS):
            self._score(block, m, wanted, docs[i:i + COLUMNS])

    def _score(self, block: Block, m: np.ndarray, wanted: np.ndarray, docs: np.ndarray) -> None:
        doc, number, tf = block.found(self.queries.vocabulary, docs)
        values = np.zeros((len(self.queries.terms), len(docs)), self.kind)
        values[number, doc] = impact(tf, m[docs[doc]])
        scores = (self.weighted @ values).astype(np.int64)
        query, at = np.nonzero(wanted[:, docs])
        self.scored += len(query)
        score = scores[query, at]
        good = (score > 0) & (score >= self.least[query])
        query, score, keys = query[good], score[good], [block.keys[i] for i in docs[at[good]].tolist()]
        query, score, keys = np.append(self.best[0], query), np.append(self.best[1], score), [*self.best[2], *keys]
        place = {x: i for i, x in enumerate(sorted(set(keys)))}
        order = np.lexsort((np.array([place[x] for x in keys], np.int64), -score, query))
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        self.best = query[keep], score[keep], [keys[i] for i in order[keep].tolist()]


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i] for n in batch.schema.names}
        yield Block({n: x.as_buffer() if isinstance(x, pa.BinaryScalar) else x.as_py() for n, x in row.items()})


def frequencies(index: DataFrame, sent) -> DataFrame:
    """In how many documents each query term occurs, by its group and number; and, as group -1, the
    number of documents and of their terms."""
    def run(batches):
        total = length = 0
        queries = [Queries(x) for x in sent.value]
        df = [np.zeros(len(q.terms), np.int64) for q in queries]
        for batch in batches:
            for block in _blocks(batch):
                total += block.docs
                length += int(block.n.sum())
                for q, counts in zip(queries, df):
                    _, number, _ = block.found(q.vocabulary, np.arange(block.docs))
                    counts += np.bincount(number, minlength=len(counts))
        group, number, n = [-1, -1], [0, 1], [total, length]
        for g, counts in enumerate(df):
            held = np.flatnonzero(counts)
            group.extend([g] * len(held))
            number.extend(held.tolist())
            n.extend(counts[held].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(number, pa.int32()), pa.array(n, pa.int64())],
                                         names=["group", "number", "n"])

    return index.drop("keys", "slices").mapInArrow(run, "group int, number int, n long").groupBy("group", "number").agg(
        F.sum("n").alias("n"))


def _search(index: DataFrame, sent, item_type: pa.DataType, item_name: str, key_name: str, k: int) -> DataFrame:
    def run(batches):
        groups, ids, weights, total, length, least = sent.value
        searches = [Search(Queries(x), w, total, length, k, f) for x, w, f in zip(groups, weights, least)]
        kind = None
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for block in _blocks(batch):
                for search in searches:
                    search.look(block)
        for own, search in zip(ids, searches):
            if len(search.best[0]):
                yield pa.RecordBatch.from_arrays([
                    pa.array([own[i] for i in search.best[0].tolist()], item_type), pa.array(search.best[2], kind),
                    pa.array(search.best[1])], names=["item", "doc", "score"])

    return index.mapInArrow(run, f"item {item_name}, doc {key_name}, score long")


def search(index: DataFrame, items: DataFrame, k: int, item: str = "item_id", text: str = "text", key: str = "doc_id",
           group: int = GROUP, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item, ``rank``, document, ``score``.

    Equal scores go by key. Items go out in parts of about ``sent_bytes``, each of which is one pass for frequencies and
    two for the search; the driver gets a part's term frequencies and scores, never documents. Items without
    an id are left out; of several rows with one id the least text counts; an item without terms has no rows.
    """
    spark = index.sparkSession
    asked = items.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(
        F.min(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, math.ceil(size / sent_bytes))
    item_kind, key_kind = items.schema[item].dataType, index.schema["keys"].dataType.elementType
    shape = item_kind.simpleString(), key_kind.simpleString()
    item_type = to_arrow_type(item_kind)
    out = spark.createDataFrame([], f"item {shape[0]}, doc {shape[1]}, score long")
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item").collect()
        texts = [lowered_terms(r["text"]) for r in rows]
        groups = [texts[i:i + group] for i in range(0, len(texts), group)]
        ids = [[r["item"] for r in rows[i:i + group]] for i in range(0, len(rows), group)]
        counts = {(g, n): x for g, n, x in frequencies(index, spark.sparkContext.broadcast(groups)).collect()}
        total, length = counts.get((-1, 0), 0), counts.get((-1, 1), 0)
        if not total or not groups:
            continue
        weights = [np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * counts.get((g, n), 0) + 1)))
                             for n in range(len(Queries(x).terms))], np.int64) for g, x in enumerate(groups)]
        least = [np.zeros(len(x), np.int64) for x in groups]
        for blocks in (index.where(F.pmod(F.xxhash64("n", "terms"), F.lit(FIRST_OF)) == 0), index):
            sent = spark.sparkContext.broadcast((groups, ids, weights, total, length, least))
            hits = _top(_search(blocks, sent, item_type, *shape, k), k)
            if blocks is not index:
                limit = {r["item"]: r["score"] for r in hits.where(F.col("rank") == k).select("item", "score").collect()}
                least = [np.array([limit.get(x, 0) for x in own], np.int64) for own in ids]
        out = out.union(_search(index, sent, item_type, *shape, k))
    return _top(out, k).select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Index ``docs`` and search them for every item.

    A null text has no terms; documents without a term or without a key are never results, though one without a
    key counts in the statistics; repeated rows are documents of their own; texts of any length are indexed
    whole; empty tables give no rows; other columns are ignored.
    """
    return search(stage(build(docs, key, text), "signatures"), items, k, item=item, key=key)
