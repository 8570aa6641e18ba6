"""Vectorised 64-bit hashes of many short byte ranges at once.

A range's hash is a polynomial in its bytes (each mapped to a random odd
number) modulo 2**64, taken as a difference of prefix sums, divided by the
power at its start and mixed with its length. Whole batches are hashed with a
few array operations. Ranges with equal bytes get equal hashes anywhere.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: The bytes' values where A-Z count as a-z.
FOLDED, PLAIN = _BYTES[_LOWER], _BYTES
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        if size > 1 << 21:  # one very long text: not kept
            return tables[0], tables[1]
        _powers = tables[0], tables[1]
    return _powers


def drop_powers() -> None:
    """Gives up the tables, up to 32 MB, that long texts have left; they are made again when needed."""
    global _powers
    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = PLAIN) -> np.ndarray:
    """Hashes of ``data[starts[i]:ends[i]]``. Callers pass about a megabyte at a time; memory is 8 times that."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces_of(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of rows (first, last) of up to ``most`` bytes each, one row at least."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        out.append((first, last))
        first = last
    return out
