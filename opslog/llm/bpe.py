"""Byte-level BPE: encode whole texts by a rank file and decode them again.

Method: vectorised pre-tokenisation. Texts become arrays of codepoint classes; each codepoint
acts on the running state as a transition function that is either constant or the identity, so
composing them is associative and one prefix scan finds every run. Local rules on the runs give
the slices that the pre-tokenisation pattern gives, without a regular expression. Equal slices
are merged once per worker and kept; the byte offset at which each id ends is kept for decoding.

Edge cases: a null text is an empty text with no ids; ids of rows are independent of their order,
copies and other columns; null keys pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from opslog.llm import arrays

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: A slice of more bytes is merged by a heap instead of with all others at once.
LONG = 128
#: Bits of a byte's position beside its rank: so many bytes of slices are merged at once, more in parts.
PLACE = 22
#: Slices kept per worker; when there are more, the store starts anew.
KEPT = 400_000
NEVER = np.int64(1 << 40)

#: Letters that a contraction takes after its apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every codepoint, by the Unicode tables of the library whose ids are to be met.

    An encoding of single bytes with the class as its pattern gives back just the codepoints in it.
    """
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, special_tokens={},
                                  mergeable_ranks={bytes([b]): b for b in range(256)})
        found = bytes(probe.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return out


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codepoints of UTF-8 bytes and the byte at which each begins."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[begins]
    points = lead.astype(np.uint32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        at, first = begins[wide], points[wide]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        value = first & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            value[more] = (value[more] << 6) | (data[at[more] + k] & 0x3F)
        points[wide] = value
    return points, begins


def last_reset(resets: np.ndarray) -> np.ndarray:
    """Prefix scan of transition functions: where the state of each position was last set.

    A position either sets the state or leaves it. Composing two such functions gives the later
    one unless that is the identity, which is associative; over whole arrays it is a running maximum.
    """
    return np.maximum.accumulate(np.where(resets, np.arange(len(resets)), 0))


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a slice of the pattern begins; ``first`` marks the codepoints that begin a text."""
    n = len(points)
    kind = classes()[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    last = np.ones(n, bool)
    last[:-1] = run[1:]
    ends_text = np.ones(n, bool)
    ends_text[:-1] = first[1:]
    space = kind == SPACE
    blank = points == 0x20
    joined = np.zeros(n, bool)  # the blank before belongs to this run
    joined[1:] = blank[:-1] & ~space[1:] & ~first[1:]
    begins = (run & ~joined) | (space & last & ~ends_text)
    lone = (points == 0x27) & run & last & begins & ~ends_text
    at = np.flatnonzero(lone)
    if len(at):
        # a contraction takes one or two letters of the run that follows; the run's end comes from the scan
        run_at = last_reset(run)
        ahead = np.concatenate([points, np.zeros(3, points.dtype)])
        state = np.concatenate([run_at, np.full(3, -1)])
        for letters in CONTRACTIONS:
            hit = np.ones(len(at), bool)
            for k, letter in enumerate(letters, 1):
                hit &= (ahead[at + k] == ord(letter)) & (state[at + k] == at + 1)
            found = at[hit]
            begins[found + 1] = False
            rest = found + 1 + len(letters)
            rest = rest[rest < n]
            begins[rest[state[rest] == rest - len(letters)]] = True
    return begins


class Vocabulary:
    """Bytes of every rank, as one pool."""

    def __init__(self, pool: bytes, sizes: np.ndarray):
        self.pool = np.frombuffer(pool, np.uint8)
        self.sizes = sizes.astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a rank file: base64 bytes and rank on each line."""
        with open(path, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in lines if x.strip())}
        if sorted(ranks) != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        tokens = [ranks[i] for i in range(len(ranks))]
        return cls(b"".join(tokens), np.array([len(t) for t in tokens]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``ids`` and the end of each id in them."""
        sizes = self.sizes[ids]
        return self.pool[arrays.ragged(self.begins[ids], sizes)], np.cumsum(sizes)


class Encoder:
    """Pair merging with a store of the slices met so far."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        prints = arrays.hashes(v.pool, v.begins, v.begins + v.sizes)
        self.order = np.argsort(prints)
        self.prints = prints[self.order]
        single = np.flatnonzero(v.sizes == 1)
        self.of_byte = np.full(256, -1, np.int64)
        self.of_byte[v.pool[v.begins[single]]] = single
        # every split of every token into two tokens is a pair that merges into it
        whole = np.repeat(np.arange(len(v.sizes)), v.sizes - 1)
        cut = arrays.ragged(v.begins + 1, v.sizes - 1)
        left, right = (self.rank_of(arrays.hashes(v.pool, a, b), v.pool, a, b)
                       for a, b in ((v.begins[whole], cut), (cut, v.begins[whole] + v.sizes[whole])))
        real = (left >= 0) & (right >= 0)
        pairs = (left[real] << 20) | right[real]
        at = np.argsort(pairs)
        self.pairs, self.merged = np.append(pairs[at], np.iinfo(np.int64).max), np.append(whole[real][at], 0)
        self.forget()

    def forget(self) -> None:
        self.known, self.pool = np.empty(0, np.uint64), np.empty(0, np.uint8)
        self.where, self.count, self.ids, self.place, self.size = (np.empty(0, np.int32) for _ in range(5))

    def rank_of(self, prints: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each slice that is a token, else -1."""
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        rank, v = self.order[at], self.vocabulary
        same = (self.prints[at] == prints) & (v.sizes[rank] == ends - starts)
        same[same] = arrays.same_slices(data, starts[same], v.pool, v.begins[rank[same]], v.sizes[rank[same]])
        return np.where(same, rank, -1)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], NEVER)

    def merge_long(self, ids: list[int]) -> list[int]:
        """One long slice: the pairs wait in a heap, neighbours are linked."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        ranks = self.pair_rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    y = after[x]
                    r = int(self.pair_rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r < NEVER:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive) if ok]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices and how many each has; in every step each slice merges its best pair.

        Slices of up to ``LONG`` bytes may have ``2 ** PLACE`` bytes together.
        """
        sizes = ends - starts
        count = np.zeros(len(starts), np.int64)
        rows, parts = [], []
        for i in np.flatnonzero(sizes > LONG):
            ids = self.merge_long(self.of_byte[data[starts[i]:ends[i]]].tolist())
            rows.append(np.full(len(ids), i))
            parts.append(np.array(ids, np.int64))
        short = np.flatnonzero(sizes <= LONG)
        ids = self.of_byte[data[arrays.ragged(starts[short], sizes[short])]]
        self.merge_rows(ids, np.repeat(short, sizes[short]), rows, parts)
        row, ids = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*parts, np.empty(0, np.int64)])
        at = np.argsort(row, kind="stable")
        count += np.bincount(row, minlength=len(starts))
        return ids[at], count

    def merge_rows(self, ids: np.ndarray, row: np.ndarray, rows: list, parts: list) -> None:
        """Merge all slices of ``ids``, told apart by ``row``; adds finished slices to ``rows`` and ``parts``."""
        ranks = np.full(len(ids), NEVER)
        same = row[1:] == row[:-1]
        ranks[:-1][same] = self.pair_rank(ids[:-1][same], ids[1:][same])
        while len(ids):
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            best = np.minimum.reduceat((ranks << PLACE) | np.arange(len(ids)), heads)
            done = (best >> PLACE) >= NEVER
            if done.any():
                over = np.repeat(done, np.diff(np.append(heads, len(ids))))
                rows.append(row[over])
                parts.append(ids[over])
                shift = np.cumsum(over)
                keep = ~over
                at = (best[~done] & ((1 << PLACE) - 1))
                at -= shift[at]
                ids, row, ranks = ids[keep], row[keep], ranks[keep]
                best = best[~done]
            else:
                at = best & ((1 << PLACE) - 1)
            if not len(ids):
                break
            ids[at] = best >> PLACE
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one codeword is dropped per slice, slices stand in order
            ids, row, ranks = ids[keep], row[keep], ranks[keep]
            for x in (at, at - 1):
                ok = x[(x >= 0) & (x < len(ids))]
                joined = ok[ok + 1 < len(ids)]
                joined = joined[row[joined] == row[joined + 1]]
                ranks[ok] = np.where(row[ok] == row[np.minimum(ok + 1, len(ids) - 1)], ranks[ok], NEVER)
                ranks[joined] = self.pair_rank(ids[joined], ids[joined + 1])
                if len(ids) and len(ok) and ok[-1] == len(ids) - 1:
                    ranks[-1] = NEVER

    def learn(self, prints: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Store the ids of new slices; ``prints`` are sorted."""
        if len(self.known) + len(prints) > KEPT:
            self.forget()
        ids = self.rank_of(prints, data, starts, ends)
        count = np.ones(len(prints), np.int64)
        hard = np.flatnonzero(ids < 0)
        if len(hard):
            at = np.concatenate([[0], np.cumsum(ends[hard] - starts[hard])])
            parts = [self.merge(data, starts[hard[a:b]], ends[hard[a:b]]) for a, b in arrays.pieces(at, 1 << PLACE)]
            made, sizes = (np.concatenate(x) for x in zip(*parts))
            count[hard] = sizes
            where = np.cumsum(count) - count
            flat = np.empty(int(count.sum()), np.int64)
            easy = np.flatnonzero(ids >= 0)
            flat[where[easy]] = ids[easy]
            flat[arrays.ragged(where[hard], sizes)] = made
        else:
            where, flat = np.arange(len(prints)), ids
        where = where + len(self.ids)
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        at = np.searchsorted(self.known, prints)
        self.known = np.insert(self.known, at, prints)
        self.where = np.insert(self.where, at, where)
        self.count = np.insert(self.count, at, count)
        sizes = ends - starts
        self.place = np.insert(self.place, at, np.cumsum(sizes) - sizes + len(self.pool))
        self.size = np.insert(self.size, at, sizes)
        self.pool = np.concatenate([self.pool, data[arrays.ragged(starts, sizes)]])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts ``data[at[i]:at[i + 1]]`` and how many each text has."""
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(at) - 1, np.int64)
        points, begins = codepoints(data)
        filled = at[:-1][np.diff(at) > 0]
        first = np.zeros(len(points), bool)
        first[np.searchsorted(begins, filled)] = True
        starts = begins[boundaries(points, first)]
        del points, begins, first
        ends = np.append(starts[1:], len(data))
        prints = arrays.hashes(data, starts, ends)
        unique, example, which = np.unique(prints, return_index=True, return_inverse=True)
        if len(self.known):
            spot = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            new = np.flatnonzero(self.known[spot] != unique)
        else:
            new = np.arange(len(unique))
        if len(self.known) + len(new) > KEPT:
            self.forget()
            new = np.arange(len(unique))
        if len(new):
            self.learn(unique[new], data, starts[example[new]], ends[example[new]])
        spot = np.searchsorted(self.known, unique)[which]
        count = self.count[spot]
        sizes = ends - starts
        same = self.size[spot] == sizes
        same[same] = arrays.same_slices(data, starts[same], self.pool, self.place[spot[same]], sizes[same])
        other = np.flatnonzero(~same)
        if not len(other):
            ids = self.ids[arrays.ragged(self.where[spot], count)]
        else:  # slices that share a fingerprint with another one
            made, count[other] = self.merge(data, starts[other], ends[other])
            where = np.cumsum(count) - count
            ids = np.empty(int(count.sum()), np.int64)
            ids[arrays.ragged(where[same], count[same])] = self.ids[arrays.ragged(self.where[spot[same]], count[same])]
            ids[arrays.ragged(where[other], count[other])] = made
        return ids, arrays.row_sums(count, np.searchsorted(starts, at))


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder; one is kept."""
    return arrays.kept(hash((len(vocabulary.sizes), vocabulary.pool.tobytes())), lambda: Encoder(vocabulary))


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column from flat little-endian values and how many each row has."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts; one narrow pass without a shuffle.

    Returns the key, ``n_tokens`` and two packed columns of little-endian unsigned 32-bit values:
    ``ids`` and ``ends``, the byte offset in the text at which each id ends. ``unpack`` turns them
    into arrays. The rank file at ``path`` is read on the driver and sent once, it has a fixed size.
    """
    vocabulary = Vocabulary.load(path)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary.pool.tobytes(), vocabulary.sizes))

    def run(batch: pa.RecordBatch):
        code = _worker_encoder(sent)
        data, at = arrays.buffers(batch.column(1))
        for a, b in arrays.pieces(at):
            ids, counts = code.encode(data[at[a]:at[b]], at[a:b + 1] - at[a])
            ends = np.cumsum(code.vocabulary.sizes[ids])
            ends -= np.repeat(at[a:b] - at[a], counts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(counts),
                binary(ids.astype("<u4"), counts), binary(ends.astype("<u4"), counts),
            ], names=[key, "n_tokens", "ids", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return arrays.map_batches(
        docs.select(key, F.col(text).cast("string").alias("_text")), run,
        f"`{key}` {kind}, n_tokens long, ids binary, ends binary",
    )


def _worker_encoder(sent) -> Encoder:
    pool, sizes = sent.value
    return encoder(Vocabulary(pool, sizes))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Turn packed ids back into bytes: every column of ``encoded`` and ``decoded`` binary."""
    vocabulary = Vocabulary.load(path)
    sent = encoded.sparkSession.sparkContext.broadcast((vocabulary.pool.tobytes(), vocabulary.sizes))
    columns = [c for c in encoded.columns if c != "decoded"]
    source = columns.index(ids)

    def run(batch: pa.RecordBatch):
        pool, sizes = sent.value
        words = Vocabulary(pool, sizes)
        packed = batch.column(source)
        counts = pc.binary_length(packed).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(counts)])
        for a, b in arrays.pieces(at):
            flat = np.frombuffer(b"".join(x.as_py() or b"" for x in packed.slice(a, b - a)), "<u4").astype(np.int64)
            out, ends = words.decode(flat)
            last = np.append(0, ends)[(at[a:b + 1] - at[a]) // 4]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(a, b - a) for c in batch.columns), binary(out, np.diff(last))],
                names=[*columns, "decoded"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*columns).schema)
    return arrays.map_batches(encoded.select(*columns), run, f"{schema}, decoded binary")


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpack(packed: pd.Series) -> pd.Series:
    """Packed values as an array of longs."""
    return packed.map(lambda x: np.frombuffer(x or b"", "<u4").astype(np.int64))
