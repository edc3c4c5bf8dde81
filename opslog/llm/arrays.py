"""Text columns as flat numpy arrays: bytes, word slices and their fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 19
BATCH_ROWS = 1000

#: The bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Words of letters and digits; every byte of a character beyond ASCII counts as a letter.
IS_BREAK = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = np.asarray(x, np.uint64) + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values that are the same in every process."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))


#: Fingerprints are taken in the field of this prime, so two different sequences of n values share one
#: with a chance of n / PRIME, whatever they hold.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_LOW31, _LOW30, _LOW29 = (np.uint64((1 << n) - 1) for n in (31, 30, 29))
_U29, _U30, _U31, _U32, _U61 = (np.uint64(n) for n in (29, 30, 31, 32, 61))
_LOW32 = np.uint64((1 << 32) - 1)
#: Bytes whose products with a part of a power add up below 2 ** 64.
_SUMMED = 1 << 23
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo ``PRIME``."""
    x = (x & _P) + (x >> _U61)
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of values below it, by halves of 32 bits."""
    ah, al, bh, bl = a >> _U32, a & _LOW32, b >> _U32, b & _LOW32
    middle = ah * bl + al * bh
    low = al * bl
    return reduced(ah * bh * np.uint64(8) + (middle >> _U29) + ((middle & _LOW29) << _U32)
                   + (low & _P) + (low >> _U61))


def _table(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    have = 1
    while have < size:
        more = min(have, size - have)
        out[have:have + more] = product(out[:more], np.uint64(pow(base, have, PRIME)))
        have += more
    return out


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's base and of its inverse; only those for the words of one piece are kept."""
    have = _POWERS.get(seed)
    if have and len(have[0]) >= n:
        return have
    base, size = int(seeded(1, seed)[0]) % (PRIME - 2) + 2, max(n, PIECE // 4)
    made = _table(base, size), _table(pow(base, -1, PRIME), size)
    if n <= PIECE:
        if len(_POWERS) > 2:
            _POWERS.clear()
        _POWERS[seed] = made
    return made


def _summed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sums modulo ``PRIME`` from the sums of the parts above and below 31 bits."""
    high = reduced(high)
    return reduced((high >> _U30) + ((high & _LOW30) << _U31) + reduced(low))


class Spans:
    """Fingerprints of arbitrary slices of a sequence from one pass of prefix sums.

    Slices of up to 2 ** 31 values; ``seed`` chooses the base of the polynomial. A byte counts as its value
    and one, so that leading zeros matter.
    """

    def __init__(self, values: np.ndarray, seed: int = 2):
        up, self.down = _powers(len(values) + 1, seed)
        up = up[:len(values)]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        if values.dtype == np.uint8:  # products with a byte stay short, so sums of many need no remainder
            carry = np.uint64(0)
            for i in range(0, len(values), _SUMMED):
                near = values[i:i + _SUMMED].astype(np.uint64) + np.uint64(1)
                part = up[i:i + len(near)]
                sums = _summed(np.cumsum((part >> _U31) * near), np.cumsum((part & _LOW31) * near))
                self.sums[i + 1:i + 1 + len(near)] = reduced(sums + carry)
                carry = self.sums[i + len(near)]
        else:
            terms = product(reduced(values), up)
            self.sums[1:] = _summed(np.cumsum(terms >> _U31), np.cumsum(terms & _LOW31))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of ``values[start:end]``."""
        raw = self.sums[ends] + (_P - self.sums[starts])
        return mix(product(reduced(raw), self.down[starts]))


def same_slices(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``x[x_at:x_at + size]`` equals ``y[y_at:y_at + size]``, byte by byte, for each pair of slices."""
    same = np.ones(len(sizes), bool)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in pieces(at):
        n = sizes[a:b]
        differ = x[ragged(x_at[a:b], n)] != y[ragged(y_at[a:b], n)]
        same[a:b] = row_sums(differ, at[a:b + 1] - at[a]) == 0
    return same


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most ``size`` bytes, or one longer row."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def parted(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = IS_SPACE) -> np.ndarray:
    """The bounds of the texts, and for long ones further bounds before a byte of ``breaks``, where there are any."""
    more = []
    for i in np.flatnonzero(np.diff(at) > 2 * PIECE):
        spots = at[i] + np.flatnonzero(breaks[data[at[i]:at[i + 1]]])
        found = np.searchsorted(spots, np.arange(at[i] + PIECE, at[i + 1], PIECE))
        more.append(np.unique(spots[found[found < len(spots)]]))
    return np.sort(np.concatenate([at, *more])) if more else at


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place as one number, zeros beyond the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hashes of slices, eight bytes at a time; ``seed`` may differ for each slice."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.asarray(seed, np.uint64))
    wide = lanes(data)
    left, k = np.arange(len(sizes)), 0
    while len(left):
        rest = np.minimum(sizes[left] - k, 8).astype(np.uint64)
        cut = (np.uint64(8) - rest) * np.uint64(8)
        out[left] = mix(out[left] + ((wide[starts[left] + k] << cut) >> cut) * _M2)
        k += 8
        left = left[sizes[left] > k]
        if len(left) and k >= 1024:  # very long ones in one pass
            spans = Spans(data[starts[left].min():ends[left].max()], 4)
            first = starts[left].min()
            out[left] = mix(out[left] + spans.of(starts[left] + k - first, ends[left] - first))
            break
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, group: np.ndarray):
    """Different slices of each group: the index of the first one, how many there are, and the first one's of every slice.

    ``keys`` are equal for equal slices of a group; slices that share a key are told apart by their bytes.
    """
    left, sizes = np.arange(len(keys)), ends - starts
    first_of = np.empty(len(keys), np.int64)
    examples, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left):
        unique, example, which = np.unique(keys[left], return_index=True, return_inverse=True)
        example = left[example]
        own = example[which]
        same = (sizes[own] == sizes[left]) & (group[own] == group[left])
        same[same] = same_slices(data, starts[left[same]], data, starts[own[same]], sizes[left[same]])
        first_of[left[same]] = own[same]
        examples.append(example)
        counts.append(np.bincount(which[same], minlength=len(unique)))
        left = left[~same]
    return np.concatenate(examples), np.concatenate(counts), first_of


def word_slices(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = IS_SPACE):
    """Starts and ends of all words, and the index of each row's first word.

    Words are maximal runs of bytes outside ``breaks`` within a row.
    """
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    begin = inside & (~after[:-1] | first[:-1])
    follows = np.zeros(len(data) + 1, bool)
    follows[:-1] = inside
    end = inside & (~follows[1:] | first[1:])
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of ``values`` in each row ``at[i]:at[i + 1]``; 0 for an empty row."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all slices ``starts[i]:starts[i] + sizes[i]``, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit fingerprints as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make`` gives, kept in the worker under ``key`` until something else is kept.

    Workers serve one operator after another, so what each of them once prepared would add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def slices(batch: pa.RecordBatch, rows: int = 8 * BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows: a batch is read whole into memory that the JVM holds on to."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of few rows, as texts may be long.

    ``fn`` takes a ``RecordBatch`` and yields record batches.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        pa.default_memory_pool().release_unused()  # the worker lives on beside others

    return df.mapInArrow(run, schema)
