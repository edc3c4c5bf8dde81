"""Counts of hashed byte n-grams of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from opslog.llm import arrays

SIZE = 3
_TURN = (arrays.seeded(8, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Counts held at a time.
CELLS = 1 << 22


def buckets_of(data: np.ndarray, bits: int, size: int = SIZE) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte."""
    wide = data.astype(np.uint32) + np.uint32(1)
    code = np.zeros(max(len(data) - size + 1, 0), np.uint32)
    for k in range(size):
        code += wide[k:k + len(code)] * _TURN[k]
    code ^= code >> np.uint32(15)
    return (code * _TURN[size]) >> np.uint32(32 - bits)


def counts(data: np.ndarray, at: np.ndarray, bits: int, size: int = SIZE) -> np.ndarray:
    """Rows by buckets. Texts shorter than ``size`` bytes have no n-grams."""
    code = buckets_of(data, bits, size).astype(np.int64)
    each = np.maximum(np.diff(at) - size + 1, 0)
    if each.sum() != len(code):
        code = code[arrays.ragged(at[:-1], each)]
    code += np.repeat(np.arange(len(each)) << bits, each)
    return np.bincount(code, minlength=len(each) << bits).reshape(len(each), -1)


def batches(column: pa.Array, bits: int, change=None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of rows of a text column with their counts; ``change`` maps the bytes first."""
    data, at = arrays.buffers(column)
    for a, b in arrays.pieces(at):
        for i in range(a, b, max(CELLS >> bits, 1)):
            j = min(b, i + max(CELLS >> bits, 1))
            own = data[at[i]:at[j]]
            yield i, j, counts(change(own) if change else own, at[i:j + 1] - at[i], bits)
