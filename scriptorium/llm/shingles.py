"""Vectorised word and shingle hashes over UTF-8 buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A document's set
holds the hashes of its distinct runs of ``k`` words; a document with fewer
words has its whole word sequence as only member; without words the set is
empty.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 18
_ODD = U64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(int(_ODD), -1, 1 << 64)
        for i, base in enumerate((int(_ODD), inverse)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=U64)
    return _powers[0], _powers[1]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column: first row, its bytes, and row offsets into them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order, and the number of words before each row (one more than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1] | first[1:n]
    ends = inside
    ends[:-1] &= space[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _power(n)
    sums = np.cumsum((low.astype(U64) + U64(1)) * power[:n], dtype=U64)
    before = np.where(start > 0, sums[start - 1], U64(0))
    hashed = mix((sums[end] - before) * inverse[start] + (end - start + 1).astype(U64))
    return hashed, np.searchsorted(start, offsets, "left")


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct shingle hashes of each following row, slice by slice."""
    factors = [U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
    multipliers = np.array(factors, U64)
    for row, data, offsets in text_slices(column):
        h, at = words(data, offsets)
        rolled = np.zeros(max(0, len(h) - k + 1), U64)
        for i in range(k):
            rolled = rolled + h[i : i + len(rolled)] * factors[i]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                short = np.sum(h[a:b] * multipliers[: b - a], dtype=U64, keepdims=True)
                sets.append(mix(short + U64(b - a)))
            else:
                sets.append(np.zeros(0, U64))
        yield row, sets
