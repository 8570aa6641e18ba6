"""Word shingle sets of whole texts, as sorted 64-bit hashes.

Words are what lies between white space (space, tab, line feed, vertical tab,
form feed, carriage return), with A-Z lower-cased. A text of fewer words than a
shingle has is one shingle as a whole; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from triagelake.llm.arrow import text_bytes
from triagelake.llm.hashing import FOLDED, hash_ranges, mix, pieces_of

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``raw[offsets[i]:offsets[i+1]]``, and each text's first word (with the end)."""
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return hash_ranges(raw, starts, ends, FOLDED), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted."""
    raw, offsets = text_bytes(column)
    for a, b in pieces_of(offsets, 1 << 18):
        base = offsets[a]
        words, first = word_hashes(raw[base : offsets[b]], offsets[a : b + 1] - base)
        n = len(words)
        acc = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]) if len(acc) else acc
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.unique(acc[lo : hi - k + 1])
            elif hi > lo:
                whole = np.zeros(1, np.uint64)
                for j in range(lo, hi):
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[j : j + 1])
                yield mix(whole + np.uint64(hi - lo))
            else:
                yield np.empty(0, np.uint64)
