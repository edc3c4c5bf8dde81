"""Near duplicates by MinHash, with odd sketches to check candidates and full sets to confirm them.

A document is the set of its distinct word shingles. Equal sets are one representative. The bands
of a MinHash signature put sets into buckets. The signature's samples are folded into a bitmap of
parities, and the population count of two bitmaps' XOR estimates their Jaccard similarity closely
where it is high; a second, larger bitmap takes in every shingle and bounds the difference of two
sets still more closely. Candidates that neither rules out are confirmed on the full sets.

Components are found without listing the pairs of a bucket. First every member of a bucket is
compared with the bucket's smallest member only. Then, in rounds, buckets that still hold more than
one component compare the bitmaps of members of different components, in blocks, and every member
proposes its best untested partner in each other component. The rounds end when no plausible pair
across two components is left untested, so no link that could join two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays
from opslog.llm.components import components
from opslog.session import stage

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 80
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
BITS, FINE = 512, 2048
#: A candidate may fall short of the threshold by so much in the estimate from samples: about six
#: deviations; and by so many deviations in the distance of the larger bitmaps.
SLACK, DEVIATIONS = 0.17, 7.0
BLOCK = 4096

_MULTIPLY = (arrays.seeded(HASHES, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TURN = (arrays.seeded(HASHES, 12) >> np.uint64(32)).astype(np.uint32)


def shingles(data: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of all texts, and where each text's begin; another seed gives unrelated ones.

    A text with fewer words than ``size`` has its whole sequence as one shingle, or none without words.
    """
    data = arrays.LOWER[data]
    starts, ends, first = arrays.word_slices(data, at)
    words = arrays.hashes(data, starts, ends, seed)
    count = np.diff(first)
    each = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = arrays.ragged(first[:-1], each)
    end = np.minimum(begin + size, np.repeat(first[1:], each))
    prints = arrays.Spans(words, 2 + seed).of(begin, end) if len(words) else np.empty(0, np.uint64)
    return prints, np.concatenate([[0], np.cumsum(each)])


def signatures(prints: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of non-empty sets: rows by hashes; and the band keys."""
    short = (prints >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(at) - 1, HASHES), np.uint32)
    for h in range(HASHES):
        low[:, h] = np.minimum.reduceat((short ^ _TURN[h]) * _MULTIPLY[h], at[:-1])
    keys = np.empty((len(low), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(low), band, np.uint64)
        for h in range(band * ROWS, (band + 1) * ROWS):
            key = arrays.mix(key + low[:, h])
        keys[:, band] = key
    return low, keys


def fold(values: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """A bitmap for each row: a bit is the parity of the values that fall on it."""
    spot = (arrays.mix(values) % np.uint64(bits)).astype(np.int64) + row * bits
    return np.packbits((np.bincount(spot, minlength=rows * bits) & 1).astype(bool).reshape(rows, bits), axis=1)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Fold the samples of every signature."""
    tagged = low + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))
    return fold(tagged.ravel(), np.repeat(np.arange(len(low)), HASHES), len(low), BITS)


def estimate(distance: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the Hamming distance of two odd sketches of samples."""
    rest = np.maximum(1 - 2 * np.asarray(distance) / BITS, 1e-9)
    return 1 + np.log(rest) * (BITS / (4 * HASHES))


def farthest(sizes: np.ndarray, similar: int) -> np.ndarray:
    """The greatest plausible distance of the larger bitmaps for two sets of ``sizes`` elements in all.

    At the threshold the sets differ in a known number of elements; the distance that so many random
    places give has this mean and variance.
    """
    differ = sizes * (100 - similar) / (100 + similar)
    one = (1 - 2 / FINE) ** differ
    two = (1 - 4 / FINE) ** differ
    variance = FINE / 4 * (1 - one ** 2) + FINE * (FINE - 1) / 4 * (two - one ** 2)
    return FINE / 2 * (1 - one) + DEVIATIONS * np.sqrt(np.maximum(variance, 0)) + 2


def bits_of(column) -> np.ndarray:
    """Bitmaps of a binary column without nulls, as rows of 64-bit values."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(len(column), -1)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def sketch(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Per row: the key, the size of its set, a fingerprint of the set, band keys and both bitmaps."""
    def run(batch: pa.RecordBatch):
        data, at = arrays.buffers(batch.column(1))
        for a, b in arrays.pieces(at):
            prints, spans = shingles(data[at[a]:at[b]], at[a:b + 1] - at[a], size)
            sets = [np.unique(prints[spans[i]:spans[i + 1]]) for i in range(b - a)]
            sizes = np.array([len(x) for x in sets], np.int64)
            prints = np.concatenate(sets)
            where = np.concatenate([[0], np.cumsum(sizes)])
            full = np.flatnonzero(sizes)
            keys = np.zeros((b - a, BANDS), np.uint64)
            samples = np.zeros((b - a, BITS // 8), np.uint8)
            if len(full):
                low, keys[full] = signatures(prints, np.append(where[full], len(prints)))
                samples[full] = odd_sketch(low)
            everything = fold(prints, np.repeat(np.arange(b - a), sizes), b - a, FINE)
            halves = [arrays.row_sums(arrays.signed(arrays.mix(prints ^ np.uint64(salt))), where) for salt in (3, 5)]
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(offsets, pa.array(arrays.signed(keys[full].ravel())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes), *map(pa.array, halves), bands,
                 pa.array([x.tobytes() for x in samples], pa.binary()),
                 pa.array([x.tobytes() for x in everything], pa.binary())],
                names=["key", "n", "lo", "hi", "bands", "samples", "fine"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return arrays.map_batches(
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run,
        f"key {kind}, n long, lo long, hi long, bands array<bigint>, samples binary, fine binary",
    )


def _plausible(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs ``a``, ``b`` that sizes and bitmaps do not rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), *(
            F.col(c).alias(f"{c}_{side}") for c in ("n", "samples", "fine"))), side)
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        n, samples, fine = ([batch.column(f"{c}_{side}") for side in ("a", "b")] for c in ("n", "samples", "fine"))
        total = n[0].to_numpy() + n[1].to_numpy()
        keep = estimate(apart(*map(bits_of, samples))) >= similar / 100 - SLACK
        keep &= apart(*map(bits_of, fine)) <= farthest(total, similar)
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    close = pairs.where(100 * F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b"))
    return arrays.map_batches(close, run, f"a {kind}, b {kind}")


def _fetch(texts: DataFrame, pairs: DataFrame, have: DataFrame | None) -> DataFrame:
    """Texts of all ends of ``pairs``; those already fetched are not read again."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if have is None:
        return stage(texts.join(ids, "id"), "texts")
    lack = stage(ids.join(have.select("id").distinct(), "id", "left_anti"), "lack")
    return have if lack.isEmpty() else have.union(stage(texts.join(lack, "id"), "texts"))


def word_shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The set of a text as tuples of words."""
    words = (text or "").encode().translate(bytes(arrays.LOWER)).split(None)
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, similar: int) -> DataFrame:
    """``a``, ``b`` and whether their full shingle sets are similar enough; ``texts`` has ``id`` and ``text``."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"t_{side}")), side)

    def sets_of(column, seed: int) -> list[np.ndarray]:
        data, at = arrays.buffers(column)
        own = []
        for a, b in arrays.pieces(at):
            prints, spans = shingles(data[at[a]:at[b]], at[a:b + 1] - at[a], size, seed)
            own += [np.unique(prints[spans[i]:spans[i + 1]]) for i in range(b - a)]
        return own

    def run(batch: pa.RecordBatch):
        counts = [[(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))
                   for x, y in zip(*(sets_of(c, seed) for c in batch.columns[2:]))] for seed in (0, 1)]
        good = []
        for i, (n, other) in enumerate(zip(*counts)):
            if n != other:  # two shingles share a fingerprint: go by their words
                x, y = (word_shingles(c[i].as_py(), size) for c in batch.columns[2:])
                n = len(x), len(y), len(x & y)
            good.append(100 * n[2] >= similar * (n[0] + n[1] - n[2]) and n[2] > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    kind = pairs.schema["a"].dataType.simpleString()
    return arrays.map_batches(pairs.select("a", "b", "t_a", "t_b"), run, f"a {kind}, b {kind}, good boolean")


def _settled(tested: DataFrame) -> DataFrame:
    """One row a pair, which was confirmed for each pair of the texts of its keys."""
    return tested.groupBy("a", "b").agg(F.max("good").alias("good"))


def _one_key(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the sets of a key that has more than one."""
    held = rows.join(sets.select("lo", "hi", "id"), ["lo", "hi"]).groupBy("key").agg(
        F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("c")).where("c > 1 and a < z")
    every = rows.join(held.select("key", "a"), "key").join(sets.select("lo", "hi", F.col("id").alias("b")), ["lo", "hi"])
    return every.select("a", "b").where("a <> b").distinct()


def _across(members: DataFrame, parts: DataFrame, sets: DataFrame, failed: DataFrame, similar: int) -> DataFrame:
    """For every member of a bucket, its most plausible untested partner in each other component there.

    The members of a large bucket are dealt into blocks and each pair of blocks is a task of its own;
    what leaves a task is a pair per member and component, not the pairs that were compared.
    """
    placed = members.join(parts.withColumnRenamed("vertex", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_ = placed.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")
    ).where("x < y").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(open_, "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    not_again = failed.groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("failed"))
    known = sets.select("id", "n", "fine").join(not_again, "id", "left")
    dealt = rows.join(known, "id").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("bucket", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
             "mine", "id", "component", "n", "fine", "failed")
    kind = members.schema["id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("id", "ascending")])
        group = group.take(order).combine_chunks()
        ids = group.column("id").combine_chunks()
        part = group.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        n, mine = group.column("n").to_numpy(), group.column("mine").to_numpy()
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        marks = bits_of(group.column("fine"))
        place = {x: i for i, x in enumerate(ids.to_pylist())}
        failed = group.column("failed").to_pylist()
        barred = [np.array([place[x] for x in own or () if x in place], np.int64) for own in failed]
        blocked = {(i, int(j)) for i, own in enumerate(barred) for j in own}
        best: dict[tuple[int, int], tuple[float, int]] = {}
        right = np.flatnonzero(mine == q)
        for i in np.flatnonzero(mine == p):
            js = right[part[right] != part[i]]
            if p == q:
                js = js[js > i]
            js = js[100 * np.minimum(n[js], n[i]) >= similar * np.maximum(n[js], n[i])]
            distance = apart(marks[js], marks[i])
            near = distance <= farthest(n[js] + n[i], similar)
            for j, d in zip(js[near].tolist(), (distance[near] / (n[js[near]] + n[i])).tolist()):
                if (max(i, j), min(i, j)) in blocked:
                    continue
                for x, y in ((i, j), (j, i)):
                    if best.get((x, part[y]), (np.inf, 0))[0] > d:
                        best[x, part[y]] = (d, y)
        pairs = sorted({(min(x, y), max(x, y)) for (x, _), (_, y) in best.items()})
        return pa.table({"a": ids.take(pa.array([x for x, _ in pairs], pa.int64())),
                         "b": ids.take(pa.array([y for _, y in pairs], pa.int64()))})

    return dealt.groupBy("bucket", "p", "q").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    similar: int = SIMILAR) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when ``100 * intersection >= similar * union`` of their shingle sets; the
    component is the smallest key that links reach. A-Z are lower-cased, words are what spaces and
    the controls 9 to 13 leave. With 30 bands of 5 a pair at a similarity of 0.8 misses every bucket
    with a chance of 7e-6, at 0.85 of 3e-8.

    Edge cases: a null text, or one without words, has an empty set and is linked with nothing; equal
    texts are always one component; rows that repeat a key are one document, linked by any of their
    texts, and are all returned; a row without a key keeps a null component and stays; other columns
    are ignored; an empty table gives an empty table.
    """
    rows = stage(sketch(docs, key, text, size), "sketches")
    real = rows.where("n > 0 and key is not null")
    sets = stage(real.groupBy("lo", "hi").agg(
        F.min("key").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("samples").alias("samples"), F.first("fine").alias("fine"),
    ), "sets")
    placed = sets.select("id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = stage(placed.join(shared.select("bucket", "head"), "bucket"), "members")
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    stars = members.where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stage(_plausible(stars, sets, similar), "pairs")
    fetched = _fetch(texts, pairs, None)
    tested = stage(_settled(_confirm(pairs, fetched, size, similar)), "tested")
    links = tested.where("good").select("a", "b").union(_one_key(real, sets))
    failed = tested.where("not good").select("a", "b")
    parts = components(links)
    while True:
        pairs = stage(_across(members, parts, sets, failed, similar), "pairs")
        if pairs.isEmpty():
            break
        fetched = _fetch(texts, pairs, fetched)
        tested = stage(_settled(_confirm(pairs, fetched, size, similar)), "tested")
        links = parts.where("vertex <> component").select(F.col("component").alias("a"), F.col("vertex").alias("b")).union(
            tested.where("good").select("a", "b"))
        failed = failed.union(tested.where("not good").select("a", "b"))
        parts = components(links)
    classes = sets.select("lo", "hi", "id").join(parts.withColumnRenamed("vertex", "id"), "id", "left").select(
        "lo", "hi", F.coalesce("component", "id").alias("component"))
    linked = real.join(classes, ["lo", "hi"]).select("key", "n", "component")
    alone = rows.where("n = 0 or key is null").select("key", "n", F.col("key").alias("component"))
    return linked.union(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"),
    )

