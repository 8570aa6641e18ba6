"""What Python workers, which Spark keeps from task to task, hold."""

import pickle

import numpy as np

from triagelake.llm import arrow, decontaminate, hashing


def test_an_index_is_small_beside_its_bitmap_of_bits():
    index = decontaminate.Index([(k, f"item {k}: " + " ".join(str(k * j) for j in range(60))) for k in range(20)], parts=True)
    assert len(pickle.dumps(index, protocol=5)) < 4 << 20  # a byte for each of 2^24 places took 16 MB in each worker
    others = np.random.default_rng(3).integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2)
    h = np.concatenate((others, index.hash))
    cells = set((index.hash >> np.uint64(64 - index.BITS)).tolist())
    want = [k for k, c in enumerate((h >> np.uint64(64 - index.BITS)).tolist()) if c in cells]
    assert index._seen(h).tolist() == want and len(want) >= len(index.hash)


def test_released_workers_keep_no_powers_of_long_texts():
    before = hashing._power_tables(1 << 20)
    arrow.release()
    assert len(hashing._powers[0]) == 1
    assert all((a == b[: len(a)]).all() for a, b in zip(hashing._power_tables(1000), before, strict=True) for a, b in [(a[:1000], b)])
