"""Words of many texts at once, as numpy arrays over one UTF-8 buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd base, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPACE = np.zeros(256, np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for i, base in enumerate((BASE, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a text column, about ``most`` bytes at a time.

    A null counts as an empty text. A text longer than ``most`` comes alone.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the longest runs of one non-zero kind of byte within a row."""
    if not len(kind):
        none = np.empty(0, np.int64)
        return none, none, none
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


class Stretches:
    """Hashes of stretches of one buffer; the sums over the buffer are taken once."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.total[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes; equal stretches have equal hashes wherever they stand."""
        value = (self.total[end] - self.total[start]) * self.inverse[start]
        return mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Stretches(data).hashes(start, end)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased, in the order of the text."""
    start, end, row = runs(1 - SPACE[data], offsets)
    return hashes(LOWER[data], start, end), row
