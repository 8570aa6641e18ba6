"""A count sketch of document frequencies, for rare-first orders.

Every token is counted, in one of CELLS cells by hash. The
order "by cell count, then by hash" is a fixed total order of all tokens, so a
prefix filter that uses it is exact whatever the counts are; the counts only
decide how well rare tokens come first. A cell of common tokens stands out from
the even noise of the rest at any size of the corpus.

Tasks add up their cells and hand over one packed row for each slice of the
sketch; slices are summed in two steps, so that a sum takes about the root of
the number of tasks at once. What reaches the driver, and is broadcast, is the
sketch alone: 4 bytes a cell (8 MB), whatever the size of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrow import tidy

CELLS = 1 << 21
SLICES = 64
_WIDTH = CELLS // SLICES


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """Counts as small numbers of the same order: 16 classes for each doubling, below 1,024 (4 MB in all)."""
    return ((np.maximum(counts, 1).astype(np.float32).view(np.uint32) >> np.uint32(19)) - np.uint32(127 << 4)).astype(np.uint16)


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").reshape(-1, 8).view(np.uint8).reshape(len(counts), 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _sum(group: pa.Table) -> pa.Table:
    total = np.zeros(_WIDTH, np.uint64)
    for data in group["counts"]:
        total += _unpack(data.as_py())
    return pa.table({"slice": group["slice"][:1], "counts": pa.array([_pack(total)], pa.binary())})


def sketch(rows: DataFrame, tokens_of, columns: list[str]) -> np.ndarray:
    """Counts by cell over ``rows``; ``tokens_of(batch)`` yields arrays of hashes."""
    def run(batches):
        part, total, held, size = TaskContext.get().partitionId(), np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for hashes in tokens_of(batch):
                held.append(hashes)
                size += len(hashes)
                if size > 1 << 20:
                    total += np.bincount(cells_of(np.concatenate(held)), minlength=CELLS)
                    held, size = [], 0
        if held:
            total += np.bincount(cells_of(np.concatenate(held)), minlength=CELLS)
        used = [k for k in range(SLICES) if total[k * _WIDTH : (k + 1) * _WIDTH].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([part] * len(used), pa.int32()), pa.array([_pack(total[k * _WIDTH : (k + 1) * _WIDTH]) for k in used], pa.binary())],
            ["slice", "part", "counts"],
        )

    packed = rows.select(*columns).mapInArrow(tidy(run), "slice int, part int, counts binary")
    tasks = max(1, rows.rdd.getNumPartitions())
    steps = packed.withColumn("salt", F.col("part") % max(1, int(tasks**0.5)))
    halfway = steps.groupBy("slice", "salt").applyInArrow(_sum_salted, "slice int, counts binary")
    out = np.zeros(CELLS, np.uint64)
    for r in halfway.groupBy("slice").applyInArrow(_sum, "slice int, counts binary").collect():
        out[r["slice"] * _WIDTH : (r["slice"] + 1) * _WIDTH] = _unpack(bytes(r["counts"]))
    return np.minimum(out, np.uint64(2**32 - 1)).astype(np.uint32)


def _sum_salted(group: pa.Table) -> pa.Table:
    return _sum(group.select(["slice", "counts"]))
