"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are folded (lower case, white space to single
blanks). An item of m characters that stands in a text with at most k edits
shares at least ``(m - Q + 1) - k * Q`` of its character q-grams with it, all
on diagonals (text place less item place) that lie within k of each other. So
shared q-grams are counted in bands of diagonals that overlap by half, bands
that reach the bound are kept, and each is verified by an alignment restricted
to the band. Nothing that is within the budget is missed.

So that a long part of an item is found as well, the queries search each
item's segments too, each within its own budget: its lines of SEGMENT
characters or more and windows of SEGMENT characters, one every STEP.

The benchmark is cut into blocks of bounded size; each block's q-gram index is
broadcast to one scan of all texts. Texts are read whole and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, release, tidy
from triagelake.llm.hashing import _power_tables, mix
from triagelake.llm.shared import table

Q = 12
#: Share of the q-grams of an item that k edits may destroy: k is the largest number within it, about 6 % of the length.
LOSS = 0.8
#: Characters of benchmark text in a block; its index takes about 20 bytes for each and a bitmap of 2 MB.
BLOCK = 4 << 20
#: Characters of a window of an item and between two windows' begins: an unchanged part of SEGMENT + STEP - 1 characters holds a whole window.
SEGMENT, STEP = 64, 32
#: Neighbouring bands that are verified as one, at most.
MERGED = 64
#: Bytes of text that are taken out of an Arrow batch, and characters that are searched, at once.
SLICE = 1 << 19
PIECE = 1 << 16
#: Hits of the index that are spread out at once, and those of a piece from which its repeating stretches are looked for.
HITS_AT_ONCE = 1 << 18
DENSE = 1 << 18
#: The commonest distances of equal q-grams that are tried as periods; stretches of other periods are counted in full.
PERIODS = 16
HITS = "doc_id long, item_id long, edits int, shared int, begin long, end long"

_VALUES = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BLANK = np.zeros(0x110000, bool)
_BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True


def fold(texts: list[str]) -> np.ndarray:
    """Code points of the folded texts, a zero before, between and behind them."""
    joined = "\0".join(["", *(t.lower().replace("\0", " ") for t in texts), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    blank = _BLANK[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes = codes[keep]
    return np.where(blank[keep], np.uint32(32), codes).astype(np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """The hash of the q-gram at each place."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_VALUES[codes & np.uint32(0xFFFF)] * up[: len(codes)], out=sums[1:])
    return mix((sums[Q:] - sums[:-Q]) * down[:n])


def budget(m: int) -> tuple[int, int]:
    """Edits allowed for an item of m characters, and the q-grams that are then shared at least."""
    n = m - Q + 1
    k = int(n * LOSS) // Q
    return k, n - k * Q


def _trim(c: np.ndarray) -> np.ndarray:
    return c[1 if len(c) and c[0] == 32 else 0 : len(c) - 1 if len(c) > 1 and c[-1] == 32 else len(c)]


def segments(text: str, whole: np.ndarray) -> list[np.ndarray]:
    """An item's folded lines of SEGMENT characters or more, and its windows; none if it is no longer than a window."""
    if len(whole) <= SEGMENT:
        return []
    lines = [_trim(fold([t])[1:-1]) for t in text.split("\n")]
    starts = [*range(0, len(whole) - SEGMENT, STEP), len(whole) - SEGMENT]
    every = [c for c in lines if SEGMENT <= len(c) < len(whole)] + [whole[a : a + SEGMENT] for a in starts]
    return list({c.tobytes(): c for c in every}.values())  # equal ones once


def _spread(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``first[i] .. first[i] + sizes[i] - 1`` of all i, one after another, and the i of each."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return (first - (np.cumsum(sizes) - sizes))[which] + np.arange(len(which)), which


def _summed(item: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of equal (item, band) added up, by item and band."""
    if not len(item):
        return item, band, count
    order = np.lexsort((band, item))
    item, band, count = item[order], band[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
    return item[first], band[first], np.add.reduceat(count, first)


def _repeats(h: np.ndarray, codes: np.ndarray, reach: int) -> np.ndarray:
    """Places deep inside a stretch of a text that repeats itself.

    What stands there stands a few periods further left as well, and so on to the
    stretch's begin: the ``reach`` characters and the period next to its two ends stand for it.
    """
    order = np.argsort(h, kind="stable")
    gaps, often = np.unique((order[1:] - order[:-1])[h[order[1:]] == h[order[:-1]]], return_counts=True)
    border = np.cumsum(codes == 0)
    inner = border[Q - 1 :] - border[: len(h)] + (codes[: len(h)] == 0) == 0  # q-grams over a border of texts belong to none
    step = np.zeros(len(h) + 1, np.int64)
    for gap in gaps[np.argsort(-often, kind="stable")[:PERIODS]].tolist():
        same = np.concatenate((np.zeros(gap, bool), h[gap:] == h[:-gap])) & inner
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        first, last = edge[::2], edge[1::2] - 1
        deep = last - first > 2 * (reach + gap)
        np.add.at(step, first[deep] + reach + gap + 1, 1)
        np.add.at(step, last[deep] - reach - gap, -1)
    return np.cumsum(step)[:-1] > 0


class Index:
    """The q-grams of a block of items: hash, item and place, by hash; and a bitmap that most others fail.

    With ``parts`` the items' segments follow the items; ``owner`` is the item of each.
    """

    BITS = 24

    def __init__(self, items: list[tuple[int, str]], parts: bool = False):
        self.ids = [i for i, _ in items]
        self.items = [_trim(fold([t])[1:-1]) for _, t in items]
        self.owner = list(range(len(items)))
        if parts:
            for k, (_, text) in enumerate(items):
                found = segments(text, self.items[k])
                self.items += found
                self.owner += [k] * len(found)
        self.short = [k for k, c in enumerate(self.items) if 0 < len(c) < Q]
        hashes = [grams(c) for c in self.items]
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.item = np.repeat(np.arange(len(self.items)), [len(h) for h in hashes])
        self.place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        limits = np.array([budget(len(c)) for c in self.items], np.int64).reshape(-1, 2)
        self.edits, self.bound = limits[:, 0], limits[:, 1]
        self.width = 2 * self.edits + 1
        self.size = np.array([len(c) for c in self.items], np.int64)
        order = np.lexsort((self.place, self.item, self.hash))
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        # of a q-gram's places in a stretch as wide as a band, the first and the last name every band that any of them does
        cell = self.place // self.width[self.item]
        other = (self.hash[1:] != self.hash[:-1]) | (self.item[1:] != self.item[:-1]) | (cell[1:] != cell[:-1])
        keep = np.concatenate(([True], other)) | np.concatenate((other, [True])) if len(cell) else np.empty(0, bool)
        self.hash, self.item, self.place = self.hash[keep], self.item[keep], self.place[keep]
        self.item, self.place = self.item.astype(np.int32), self.place.astype(np.int32)  # widened where they are used
        seen = np.zeros(1 << self.BITS, bool)
        seen[(self.hash >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        self.map = np.packbits(seen, bitorder="little")

    def _seen(self, h: np.ndarray) -> np.ndarray:
        """Places of the q-grams that the bitmap lets pass."""
        bit = h >> np.uint64(64 - self.BITS)
        return np.flatnonzero(self.map[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)

    def _runs(self, h: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
        """First and last place of each run of one q-gram, in the order of the text, and its rows of the index."""
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (h[at[1:]] != h[at[:-1]])))) if len(at) else at
        begin, end = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
        # all stretches inside a long run are alike: those at its two ends stand for the rest
        long = end - begin > 2 * reach
        begin, end = np.concatenate((begin, end[long] - reach)), np.concatenate((np.where(long, begin + reach, end), end[long]))
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        return begin, end, np.searchsorted(self.hash, h[begin], "left"), np.searchsorted(self.hash, h[begin], "right")

    def _count(self, begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, band and shared q-grams of the bands that reach their item's bound, by item and band.

        Hits are spread out HITS_AT_ONCE at a time and summed up; as runs come in
        the order of the text, bands that they have passed are settled in between.
        """
        rows = np.cumsum(hi - lo)
        sums, first = (np.empty(0, np.int64),) * 3, 0
        while first < len(begin):
            last = max(first + 1, int(np.searchsorted(rows, (rows[first - 1] if first else 0) + HITS_AT_ONCE, "right")))
            part = self._hits(begin[first:last], end[first:last], lo[first:last], hi[first:last])
            sums = _summed(*(np.concatenate(x) for x in zip(sums, part, strict=True)))
            item, band, count = sums
            passed = (band + 2) * self.width[item] + self.size[item] < begin[last] if last < len(begin) else np.ones(len(item), bool)
            keep = ~passed | (count >= self.bound[item])
            sums, first = (item[keep], band[keep], count[keep]), last
        return sums

    def _hits(self, begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, band and shared q-grams that these runs give."""
        row, run = _spread(lo, hi - lo)
        item, place = self.item[row].astype(np.int64), self.place[row].astype(np.int64)
        width = self.width[item]
        low = (begin[run] - place) // width
        band, which = _spread(low, (end[run] - place) // width - low + 1)
        item, place, width, run = item[which], place[which], width[which], run[which]
        inside = np.minimum(end[run], place + (band + 1) * width - 1) - np.maximum(begin[run], place + band * width) + 1
        return _summed(np.concatenate((item, item)), np.concatenate((band, band - 1)), np.concatenate((inside, inside)))

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Item, first diagonal, width and shared q-grams of each band that reaches its item's bound.

        A run of one q-gram in the text (a ruled line) is counted as a range, and
        no further than the items reach from its ends; nor is a longer period,
        in a text with so many hits that it matters.
        """
        h = grams(codes)
        at = self._seen(h)
        if not len(at):
            return
        reach = 2 * (max(map(len, self.items)) + 2 * int(self.width.max()))
        begin, end, lo, hi = self._runs(h, at, reach)
        if int((hi - lo).sum()) > DENSE:
            at = at[~_repeats(h, codes, reach)[at]]
            begin, end, lo, hi = self._runs(h, at, reach)
        item, band, count = self._count(begin, end, lo, hi)
        if not len(item):
            return
        # neighbouring bands are verified as one, MERGED at most
        apart = np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1] + 1)))
        head = np.flatnonzero(apart)[np.cumsum(apart) - 1]
        first = np.flatnonzero((np.arange(len(item)) - head) % MERGED == 0)
        size, most = np.diff(np.append(first, len(item))), np.maximum.reduceat(count, first)
        for i, b, n, c in zip(item[first].tolist(), band[first].tolist(), size.tolist(), most.tolist(), strict=True):
            w = int(self.width[i])
            yield i, b * w, (n + 1) * w, c

    def lacks(self, i: int, region: np.ndarray) -> bool:
        """Whether the region lacks more of the item's characters than the edits allowed can put in."""
        seen = np.bincount(region & np.uint32(1023), minlength=1024)
        return int(np.maximum(np.bincount(self.items[i] & np.uint32(1023), minlength=1024) - seen, 0).sum()) > self.edits[i]


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> tuple[int, int, int] | None:
    """The fewest edits (at most ``most``) that turn the item into a stretch of the text on diagonals
    ``first - most .. first + width + most``, with the stretch's begin and end; None beyond that."""
    lo, hi = first - most, first + width + most  # diagonals: text place less item place
    span = hi - lo + 1
    far = len(item) + len(text) + 1
    offset = np.arange(span)
    places = lo + offset  # text places before which row 0 stands
    inside = (places >= 0) & (places <= len(text))
    cost = np.where(inside, 0, far)
    begin = np.where(inside, places, 0)
    for r, char in enumerate(item.tolist(), 1):
        places = lo + offset + r
        ok = (places >= 0) & (places <= len(text))
        here = np.where(places >= 1, text[np.clip(places - 1, 0, max(len(text) - 1, 0))] if len(text) else 0, 0)
        best, origin = cost + (here != char), begin  # the same diagonal: equal or replaced
        gone = np.append(cost[1:], far) + 1  # the item's character is missing: one diagonal up
        origin = np.where(gone < best, np.append(begin[1:], 0), origin)
        best = np.where(ok, np.minimum(best, gone), far)
        ahead = best - offset  # characters inserted in the text: along the row
        run = np.minimum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead == run, offset, 0))
        cost, begin = np.where(ok, run + offset, far), origin[source]
    k = int(np.argmin(cost))
    return (int(cost[k]), int(begin[k]), int(lo + k + len(item))) if cost[k] <= most else None


def _find(haystack: np.ndarray, needle: np.ndarray) -> int:
    """Where the needle first is, or -1."""
    data, part, at = haystack.astype("<u4").tobytes(), needle.astype("<u4").tobytes(), -1
    while (at := data.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def search(texts: list[str | None], index: Index, once: bool = False) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Text number, item number, edits, shared q-grams, begin and end (in the folded text) of the best place of each item:
    of the item as a whole, or where that does not stand, of the segment with the fewest edits. With ``once`` a text is
    searched only until anything stands in it."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= PIECE):
            size += len(texts[last] or "")
            last += 1
        codes = fold([t or "" for t in texts[first:last]])
        ends = np.flatnonzero(codes == 0)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        whole, done = set(), set()  # segments come after all items
        for i, diagonal, width, shared in index.bands(codes):
            m, k, o = len(index.items[i]), int(index.edits[i]), index.owner[i]
            # a band may reach over a border of texts: every text that it touches is tried
            a = max(0, int(np.searchsorted(ends, max(diagonal - k, 0), "right")) - 1)
            b = int(np.searchsorted(ends, min(diagonal + width + k + m, len(codes) - 1), "left"))
            for t in range(a, min(b, len(ends) - 1)):
                lo, hi = int(ends[t]) + 1, int(ends[t + 1])
                left, right = max(lo, diagonal - k), min(hi, diagonal + width + m + 2 * k)
                if t in done or right - left < m - k or best.get((t, o), (1,))[0] == 0 or (i != o and (t, o) in whole):
                    continue
                region = codes[left:right]
                if index.lacks(i, region):
                    continue
                exact = _find(region, index.items[i])
                got = (0, exact, exact + m) if exact >= 0 else align(index.items[i], region, diagonal - left, width, k)
                if got and i == o:
                    whole.add((t, o))
                if got and once:
                    done.add(t)
                if got and ((t, o) not in best or got[0] < best[t, o][0]):
                    best[t, o] = got[0], shared, got[1] + left - lo, got[2] + left - lo
        for i in index.short:
            for t in range(len(ends) - 1):
                at = _find(codes[ends[t] + 1 : ends[t + 1]], index.items[i])
                if at >= 0:
                    best[t, i] = 0, 0, at, at + len(index.items[i])
        for (t, i), (edits, shared, begin, end) in sorted(best.items()):
            yield first + t, i, edits, shared, begin, end
        first = last


def _blocks(benchmark: DataFrame, parts: bool = False) -> Iterator[Index]:
    """Indexes of the benchmark's blocks: items in order, cut where BLOCK characters, with those of segments, are full."""
    times = 2 + -(-SEGMENT // STEP) if parts else 1  # itself, its lines and its windows
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():  # one partition at a time; the driver holds one block
        if held and size + times * len(r["text"]) > BLOCK:
            yield Index(held, parts)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += times * len(r["text"])
    if held:
        yield Index(held, parts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, parts: bool = False) -> DataFrame:
    """A row for each document and benchmark item that stands in it within the edit budget: its best place.

    With ``parts`` an item also counts if one of its segments stands within the
    segment's budget; the row then is that of the segment.

    Reads doc_id and text; item_id and text. ``begin`` and ``end`` are places in
    the folded text, ``shared`` the q-grams counted in the band. Null and empty
    texts have no leaks, empty items are in no text, items shorter than a q-gram
    must stand as they are. Repeated rows repeat. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            for batch in by_bytes(batches, "text", SLICE):
                found = list(search(batch["text"].to_pylist(), shared.value))
                ids = batch["doc_id"].to_pylist()
                cols = list(zip(*((ids[t], shared.value.ids[i], *rest) for t, i, *rest in found), strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in HITS.split(", ")])

        return rows.mapInArrow(tidy(run), HITS)

    out = None
    for index in _blocks(benchmark, parts):
        part = scan(index)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], HITS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, parts: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no benchmark item (with ``parts``, no segment of one) stands within the budget.

    Null and empty texts stay; repeated rows stay or go alike; an empty table stays empty.
    """
    spark, out = docs.sparkSession, docs
    for index in _blocks(benchmark, parts):
        out = out.where(_clean(spark.sparkContext.broadcast(index))(F.col("text").cast("string")))
    return out


def _clean(shared):
    """Whether a text holds nothing of a broadcast index; only the text goes to Python."""
    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            out = []
            for part in by_bytes([pa.RecordBatch.from_arrays([array], ["text"])], "text", SLICE):
                hit = {t for t, *_ in search(part["text"].to_pylist(), shared.value, once=True)}
                out += [t not in hit for t in range(len(part))]
            yield pa.array(out, pa.bool_())
        release()

    return clean


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), parts=True)
