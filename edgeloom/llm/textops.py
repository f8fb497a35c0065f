"""Vectorised UTF-8 helpers for Arrow batches: bytes, words and shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, a bijection on 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table() -> np.ndarray:
    """A random value per byte; A-Z share the values of a-z."""
    values = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    return values


BYTES = _byte_table()
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about `most` bytes; a longer text is a piece of its own."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased: hash, text's row, first byte and byte after the last."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(offsets, start, "right") - 1, start, end


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the k-word shingles; a text of fewer words has its whole sequence as the only one."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factors = [_U(mix(np.array([j + 11], np.uint64))[0] | _U(1)) for j in range(k)]
    head = max(0, n - k + 1)
    whole = np.flatnonzero(rows[:head] == rows[k - 1 :]) if head else np.zeros(0, np.int64)
    value = np.zeros(len(whole), np.uint64)
    for j in range(k):
        value += hashes[whole + j] * factors[j]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[starts, n])
    short = starts[counts < k]
    left = counts[counts < k]
    small = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = left > j
        small[has] += hashes[short[has] + j] * factors[j]
    return np.r_[rows[whole], rows[short]], mix(np.r_[value, small + left.astype(np.uint64)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (row offsets, hashes sorted within each row)."""
    hashes, rows, _, _ = words(data, offsets)
    row, value = shingles(hashes, rows, k)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    return np.searchsorted(row, np.arange(len(offsets))), value


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """An Arrow list<int64> column of row offsets and values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
