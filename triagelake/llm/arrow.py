"""Cutting Arrow batches by bytes, so that memory in a task does not depend on row counts."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from triagelake.llm import hashing


def release(*tables: Callable) -> None:
    """Drops what the cached functions ``tables`` and the hashes' powers hold and gives the worker's free memory back to the system."""
    for table in tables:
        table.cache_clear()
    hashing.drop_powers()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def tidy(run: Callable, *tables: Callable) -> Callable:
    """``run`` for a task; when its batches end, the worker, which Spark keeps for later tasks, is left without what only they needed."""
    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        release(*tables)

    return tidied


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose ``column`` holds up to ``most`` bytes (one row at least; a long text stays whole)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            limit = (ends[first - 1] if first else 0) + most
            last = max(first + 1, int(np.searchsorted(ends, limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and the row offsets into them (null: no bytes)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def varint(values: np.ndarray) -> bytes:
    """Unsigned LEB128 of each value (below 2**35), concatenated."""
    v = values.astype(np.uint64)
    n = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        has = n > k
        if not has.any():
            break
        more = (n[has] > k + 1).astype(np.uint64) << np.uint64(7)
        out[at[has] + k] = (v[has] >> np.uint64(7 * k)) & np.uint64(127) | more
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max()) + 1):
        has = first + k <= last
        out[has] |= (raw[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out
