"""Packing of tokenised texts into sequences, in order, by dynamic programming.

The ids of a task's texts form one stream in the order of the rows. Places where a sequence may end are
the ends of texts, the ends of sentences and, where both are too far apart, single ids in between. The
programme chooses the cuts that make padding plus the penalties of the cuts least. A full window may
be reached from any place at most ``length`` ids before, so the best of them is kept in a queue whose
costs rise from front to back; the few lengths that need no padding are further transitions.
Stretches of the stream are settled one after another, so memory does not grow with a task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from opslog.llm import arrays, bpe

LENGTH = 4096
#: Ids of a stretch that is settled at once.
STRETCH = 1 << 19
#: Penalty of a cut after a sentence, and within one, in ids of padding; and of every sequence.
SENTENCE, WITHIN, EACH = 1.0, 4.0, 16.0
#: The most ids between two places where a sequence may end.
GAP = 32
#: Bytes handed to the tokenizer at a time.
PART = 1 << 17
#: Chunks and their bytes that a task remembers before it begins anew.
KEPT, KEPT_BYTES = 1 << 20, 1 << 25
#: Characters that end a sentence, and marks that are never in one token with a letter.
STOPS = ".!?"
MARKS = ',.;:!?"()[]'
IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
IS_MARK = np.array([chr(b) in MARKS for b in range(256)])
IS_SMALL = np.array([b < 128 and chr(b).islower() for b in range(256)])
#: Words of small Latin letters, which are one word in the tokenizer's pattern.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]{1,64}").fullmatch
SEQUENCE_BITS = 32

TEXT_END, SENTENCE_END, OTHER = 0, 1, 2


class Pairs(bpe.Encoder):
    """The merges of words of letters, all words at once; the last byte of a word has ids of its own."""

    def __init__(self, of_byte: np.ndarray, of_last: np.ndarray, pairs: np.ndarray, first: int):
        self.of_byte, self.of_last = of_byte, of_last
        at = np.argsort(pairs)
        self.pairs, self.merged = np.append(pairs[at], np.iinfo(np.int64).max), np.append(first + at, 0)

    @classmethod
    def of(cls, json_text: str) -> Pairs | None:
        """None for a vocabulary whose merges are not numbered in their order or that has other rules."""
        model = json.loads(json_text)["model"]
        suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
        alphabet = pre_tokenizers.ByteLevel.alphabet()
        if not suffix or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            return None
        letters = byte_letters()
        if sorted(letters) != sorted(alphabet) or any(c not in vocabulary or c + suffix not in vocabulary for c in letters):
            return None
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        made = np.array([vocabulary.get(a + b, -1) for a, b in pairs], np.int64)
        if len(made) == 0 or (np.diff(made) != 1).any() or made[0] < 0 or len(vocabulary) >= 1 << 20:
            return None
        sides = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], np.int64)
        return cls(np.array([vocabulary[c] for c in letters]), np.array([vocabulary[c + suffix] for c in letters]), sides, int(made[0]))

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = ends - starts
        rows, parts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in arrays.pieces(np.append(0, np.cumsum(sizes)), 1 << bpe.PLACE):
            raw = data[arrays.ragged(starts[a:b], sizes[a:b])]
            ids = self.of_byte[raw]
            last = np.cumsum(sizes[a:b]) - 1
            ids[last] = self.of_last[raw[last]]
            if b - a == 1 and len(ids) > bpe.LONG:
                ids = np.array(self.merge_long(ids.tolist()), np.int64)
                rows.append(np.full(len(ids), a))
                parts.append(ids)
            else:
                self.merge_rows(ids, np.repeat(np.arange(a, b), sizes[a:b]), rows, parts)
        row, ids = np.concatenate(rows), np.concatenate(parts)
        return ids[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(starts))


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Coder:
    """A tokenizer that encodes each different chunk of text once, and knows the ids that end a sentence.

    Chunks are the stretches between white space, parted again where an ASCII letter meets a mark of
    ``MARKS``: no token of the vocabulary reaches over such a place. Chunks are told apart by their bytes.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        letters = {c for c in pre_tokenizers.ByteLevel.alphabet() if c.isalnum() or ord(c) > 126}
        stops = []
        for piece, i in self.tokenizer.get_vocab().items():
            own = piece[:-len(suffix)] if suffix and piece.endswith(suffix) else ("" if suffix else piece)
            if own and any(c in STOPS for c in own) and not any(c in letters for c in own):
                stops.append(i)
        self.stops = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.stops[stops] = True
        self.known = Known()
        self.pairs = Pairs.of(vocabulary)

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks and how many each has."""
        sizes = ends - starts
        plain = arrays.row_sums(~IS_SMALL[data[arrays.ragged(starts, sizes)]], np.append(0, np.cumsum(sizes))) == 0
        parts = [self.pairs.merge(data, starts[plain], ends[plain])] if self.pairs else []
        order = [np.flatnonzero(plain)] if self.pairs else []
        rest = np.flatnonzero(~plain) if self.pairs else np.arange(len(sizes))
        texts = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(starts[rest].tolist(), ends[rest].tolist())]
        if self.pairs and texts:
            changed = self.tokenizer.normalizer.normalize_str("\n".join(texts)).split(" ")
            if len(changed) == len(texts):
                latin = np.array([bool(LATIN(x)) for x in changed])
                raw = [changed[i].encode() for i in np.flatnonzero(latin).tolist()]
                at = np.cumsum([0, *map(len, raw)])
                parts.append(self.pairs.merge(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]))
                order.append(rest[latin])
                rest, texts = rest[~latin], [texts[i] for i in np.flatnonzero(~latin).tolist()]
        made, count, first = [], [], 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size < PART:
                size += len(texts[last])
                last += 1
            for one in self.tokenizer.encode_batch_fast(texts[first:last], add_special_tokens=False):
                own = one.ids
                made.extend(own)
                count.append(len(own))
            first = last
        parts.append((np.array(made, np.int64), np.array(count, np.int64)))
        order.append(rest)
        ids, count = (np.concatenate(x) for x in zip(*parts))
        back = np.argsort(np.concatenate(order))
        return ids[arrays.ragged((np.cumsum(count) - count)[back], count[back])].astype(np.int32), count[back]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[at[i]:at[i + 1]]`` and how many each has."""
        if b"<|" not in data.tobytes():  # the tokenizer lowers all but its special tokens
            data = arrays.LOWER[data]
        starts, ends = chunks(data, at)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(at) - 1, np.int64)
        if self.known.full():
            self.known = Known()
        keys = keys_of(data, starts, ends)
        entry = self.known.find(keys, data, starts)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, example = np.unique(keys[missing, 3], return_index=True)
            while len(missing):
                own = missing[example]
                ids, count = self.merge(data, starts[own], ends[own])
                self.known.add(keys[own], data, starts[own], ids, count)
                entry[missing] = self.known.find(keys[missing], data, starts[missing])
                missing = missing[entry[missing] < 0]  # those with the hash of another new chunk
                example = np.arange(min(len(missing), 1))
        place, count = self.known.ids_of(entry)
        return self.known.ids[arrays.ragged(place, count)], arrays.row_sums(count, np.searchsorted(starts, at))


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First and last eight bytes, size and a hash of each chunk: all of its bytes if it has 16 or fewer."""
    sizes = (ends - starts).astype(np.uint64)
    wide = np.ndarray((len(data) + 8,), "<u8", np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]), strides=(1,))
    cut = (np.uint64(8) - np.minimum(sizes, np.uint64(8))) * np.uint64(8)
    first = (wide[starts + 8] << cut) >> cut
    last = (wide[ends] >> cut) << cut
    hashed = arrays.mix(first + arrays.mix(last + sizes))
    return np.column_stack([first, last, sizes, hashed])


class Known:
    """An open-addressing table from chunks to their ids, looked up for many chunks at once.

    Chunks are equal if their bytes are: up to 16 bytes stand in the key, longer ones are compared in the pool.
    """

    def __init__(self, slots: int = 1 << 16):
        self.slot = np.full(slots, -1, np.int32)
        self.n = 0
        self.key = np.empty((1 << 12, 4), np.uint64)
        self.place = np.empty((1 << 12, 3), np.int32)  # of the bytes of a long chunk, of its ids, and how many
        self.pool, self.ids = np.empty(0, np.uint8), np.empty(0, np.int32)

    def full(self) -> bool:
        return self.n > KEPT or len(self.pool) > KEPT_BYTES or len(self.ids) > 8 * KEPT

    def ids_of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.place[entry]
        return found[:, 1].astype(np.int64), found[:, 2].astype(np.int64)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 for an unknown one."""
        out = np.full(len(keys), -1, np.int64)
        open_, at = np.arange(len(keys)), (keys[:, 3] & np.uint64(len(self.slot) - 1)).astype(np.int64)
        while len(open_):
            entry = self.slot[at]
            taken = entry >= 0
            open_, at, entry = open_[taken], at[taken], entry[taken].astype(np.int64)
            same = (self.key[entry, :3] == keys[open_, :3]).all(axis=1)
            long = np.flatnonzero(same & (keys[open_, 2] > np.uint64(16)))
            if len(long):
                same[long] = arrays.same_slices(data, starts[open_[long]], self.pool, self.place[entry[long], 0].astype(np.int64),
                                                keys[open_[long], 2].astype(np.int64))
            out[open_[same]] = entry[same]
            open_, at = open_[~same], (at[~same] + 1) & (len(self.slot) - 1)
        return out

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Add chunks that are not known yet, each once."""
        n = len(keys)
        while self.n + n > len(self.key):
            self.key, self.place = (np.concatenate([x, np.empty_like(x)]) for x in (self.key, self.place))
        new = np.arange(self.n, self.n + n)
        self.key[new] = keys
        sizes = keys[:, 2].astype(np.int64)
        kept = np.where(sizes > 16, sizes, 0)
        self.place[new] = np.column_stack([np.cumsum(kept) - kept + len(self.pool), np.cumsum(count) - count + len(self.ids), count])
        self.pool = np.concatenate([self.pool, data[arrays.ragged(starts, kept)]])
        self.ids = np.concatenate([self.ids, ids])
        self.n += n
        if 2 * self.n > len(self.slot):
            self.slot = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            new = np.arange(self.n)
        at = (self.key[new, 3] & np.uint64(len(self.slot) - 1)).astype(np.int64)
        while len(new):
            free = self.slot[at] < 0
            self.slot[at[free]] = new[free]  # of several for one slot the last one stays
            lost = self.slot[at] != new
            new, at = new[lost], (at[lost] + 1) & (len(self.slot) - 1)


_CODERS: dict[int, Coder] = {}


def coder_of(vocabulary: str) -> Coder:
    """The worker's coder; one is kept, with the chunks it knows."""
    key = hash(vocabulary)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(vocabulary)
    return _CODERS[key]


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of the texts ``data[at[i]:at[i + 1]]``."""
    inside = ~arrays.IS_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    letter, mark = IS_LETTER[data], IS_MARK[data]
    begin[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    filled = at[:-1][np.diff(at) > 0]
    begin[filled] = inside[filled]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begin[1:]
    if len(filled):
        before = filled[1:] - 1
        last[before] = inside[before]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def places(stops: np.ndarray, text_ends: np.ndarray, total: int, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Where a sequence may end, as counts of ids before, and the kind of each place; 0 is not among them.

    ``stops`` are the counts of ids up to the end of each sentence. The last place is ``total``.
    """
    kinds = np.full(total + 1, 255, np.uint8)
    kinds[stops] = SENTENCE_END
    kinds[text_ends] = TEXT_END
    kinds[0] = 255
    if kinds[total] == 255:
        kinds[total] = OTHER
    at = np.flatnonzero(kinds != 255)
    before = np.concatenate([[0], at[:-1]])
    wide = np.flatnonzero(at - before > gap)
    if len(wide):
        kinds[np.concatenate([np.arange(before[i] + gap, at[i], gap) for i in wide])] = OTHER
        at = np.flatnonzero(kinds != 255)
    return at, kinds[at]


def unpadded(length: int) -> list[int]:
    """Shorter lengths of a sequence that need no padding: the powers of two."""
    return [1 << k for k in range(length.bit_length()) if 1 << k < length]


def cuts(at: np.ndarray, penalty: np.ndarray, length: int, each: float = EACH) -> tuple[list[int], float]:
    """The ends of the sequences that part ``[0, at[-1])`` at least cost, and that cost.

    ``at`` are the places in rising order, at most ``length`` apart, ``penalty`` what a cut costs there.
    A sequence of n ids costs its penalty, ``each`` and ``length - n``, or nothing for the length if n is a power of two.
    Of equal costs the earlier start wins, and a full window before a shorter one.
    """
    spots = np.concatenate([[0], at])
    n = len(spots)
    exact: list[list[int]] = [[] for _ in range(n)]
    for size in unpadded(length):
        found = np.searchsorted(spots, spots - size)
        for j in np.flatnonzero((spots >= size) & (spots[np.minimum(found, n - 1)] == spots - size)).tolist():
            exact[j].append(int(found[j]))
    x, charge = spots.tolist(), [0.0, *(np.asarray(penalty, float) + each).tolist()]
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque()
    for j in range(1, n):
        i = j - 1  # what a start costs in a padded window grows with cost + x
        own = cost[i] + x[i]
        while queue and cost[queue[-1]] + x[queue[-1]] > own:
            queue.pop()
        queue.append(i)
        while x[queue[0]] < x[j] - length:
            queue.popleft()
        i = queue[0]
        best, start = cost[i] + length - (x[j] - x[i]), i
        for i in exact[j]:
            if cost[i] < best:
                best, start = cost[i], i
        cost[j], back[j] = best + charge[j], start
    out, j = [], n - 1
    while j:
        out.append(x[j])
        j = back[j]
    return out[::-1], cost[-1]


class Packer:
    """Takes texts' ids in order and yields the pieces of settled stretches."""

    def __init__(self, first_sequence: int, length: int, stretch: int, penalties: tuple[float, float, float], stops):
        self.sequence, self.length, self.stretch, self.stops = first_sequence, length, stretch, stops
        self.penalty = np.array([0.0, *penalties[:2]])
        self.each = penalties[2]
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.owners: list[tuple[object, int, int, int]] = []  # key, ids of it before, ids here, ids of the text
        self.size = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """One text, its end mark included."""
        for start in range(0, len(ids), self.stretch):
            part = ids[start:start + self.stretch]
            self.parts.append(part)
            self.owners.append((key, start, len(part), len(ids)))
            self.size += len(part)
            if self.size >= self.stretch:
                yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Pieces of what is held: key, start, length, crc32, ids of the text, sequence, offset."""
        if not self.size:
            return
        ids = np.concatenate(self.parts)
        text_ends, at = [], 0
        for _, start, n, whole in self.owners:
            at += n
            if start + n == whole:
                text_ends.append(at)
        known = np.minimum(ids, len(self.stops) - 1)
        spots, kinds = places(np.flatnonzero(self.stops[known]) + 1, np.array(text_ends, np.int64), len(ids),
                              min(GAP, self.length))
        ends, _ = cuts(spots, self.penalty[kinds], self.length, self.each)
        packed = ids.astype("<u4")
        begin, cut, first = 0, 0, 0
        for key, start, n, whole in self.owners:
            begin, last = first, first + n
            while begin < last:
                end = min(last, ends[cut])
                window = ends[cut - 1] if cut else 0
                yield (key, start + begin - first, end - begin, zlib.crc32(packed[begin:end].tobytes()), whole,
                       self.sequence + cut, begin - window)
                begin = end
                if end == ends[cut]:
                    cut += 1
            first = last
        self.sequence += len(ends)
        self.clear()


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, key: str = "doc_id", text: str = "text",
         stretch: int = STRETCH, penalties: tuple[float, float, float] = (SENTENCE, WITHIN, EACH)) -> DataFrame:
    """Pack all texts, each followed by ``end_id``, into sequences of at most ``length`` ids.

    One row a piece: the key, ``start`` (the text's ids before the piece), ``length``, ``ids_crc32`` of its
    little-endian unsigned 32-bit ids, ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence. The
    rows of a partition keep their order; a sequence holds texts of one partition only and there is no
    shuffle. A null or empty text is ``end_id`` alone, repeated rows are packed each, a text of any length
    is cut where the programme finds it best, an empty table gives no rows, and a null key is kept. Other columns are ignored.
    ``penalties`` are those of a cut after a sentence, of one within a sentence, and of each sequence.
    """
    if length < 1 or stretch < length:
        raise ValueError("a stretch must hold a sequence")
    with open(path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value)
        packer = Packer(TaskContext.get().partitionId() << SEQUENCE_BITS, length, stretch, penalties, coder.stops)
        rows: list[tuple] = []
        end = np.array([end_id], np.int32)

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) >= least:
                columns = list(zip(*rows))
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind_of[0])] + [
                    pa.array(c, pa.int64()) for c in columns[1:]], names=names)

        kind_of = [pa.null()]
        for batch in batches:
            kind_of[0] = batch.schema.field(0).type
            data, at = arrays.buffers(batch.column(1))
            keys = batch.column(0).to_pylist()
            bounds = arrays.parted(data, at)
            row, held = 0, []
            for a, b in arrays.pieces(bounds):
                ids, counts = coder.encode(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                ends = np.cumsum(counts)
                for i in range(a, b):
                    held.append(ids[ends[i - a] - counts[i - a]:ends[i - a]])
                    if bounds[i + 1] == at[row + 1]:
                        rows.extend(packer.add(keys[row], np.concatenate([*held, end])))
                        row, held = row + 1, []
                yield from out(8192)
        rows.extend(packer.settle())
        yield from out(1)

    names = [key, *(x.split()[0] for x in PIECE.split(", "))]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, {PIECE}")
