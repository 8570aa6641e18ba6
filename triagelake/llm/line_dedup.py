"""Exact line deduplication by a set-similarity join of line tokens.

A line goes if an earlier line (by doc_id, then by place) has a Jaccard
similarity of PERCENT or more to it, over their sets of words. A line without
words neither goes nor counts.

1. A count sketch orders all tokens rare-first. One pass over the texts then
   writes, for each line, its place and a 128-bit signature of its set, and for
   the first line of each set in a batch also the set's size, a 64-bit parity
   map of its tokens and its prefix. Lines of equal sets are one class from
   there on: an aggregation finds its first line, all others of it go. Lines so
   short that only equal sets are similar (fewer than ``posting_size`` words)
   need no more.
2. Classes post the tokens of their prefixes, but those that the sketch counts
   once. Postings of groups that are not too large travel in blocks, by buckets of
   whole groups, and a group's members meet in one task, in which length,
   positional and parity filters reject pairs. Which groups are too large is known
   from their counted postings, never guessed. Their members, and in groups with
   many such pairs those members that have many, are tried against
   the earliest of them first, as many candidates as members. One earlier match is
   enough for a line to go, so what is still open then is tried in rounds against
   more of the early lines, for as long as these say that all pairs would be too
   many candidates. What they leave is split, by size and, as often as it takes, by
   the next token that similar lines must share as well (the first k common tokens
   of similar sets of n words lie among their ``n - ceil(n * PERCENT / 100) + k``
   rarest), and each open line meets all earlier lines of its parts. Groups of which
   at most the earliest line is open are not looked at again.
3. Candidates of all groups are made distinct. The full token sets are read again
   from the lines of candidates and of split groups only (once, for all that
   follows), with a wide parity map of each, which rejects most pairs that are
   not similar before any set is moved; the others are verified once on the sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, text_bytes, tidy
from triagelake.llm.hashing import mix, pieces_of
from triagelake.llm.near_duplicates import BROADCAST_IDS, prefix_length
from triagelake.llm.rarity import cells_of, rarity_classes, sketch
from triagelake.llm.shared import Scratch, table
from triagelake.llm.shingles import word_hashes

PERCENT = 80
#: Members of a token's group that meet in one join; a larger group is split if that takes fewer rows than SPLIT comparisons each.
HOT, SPLIT = 2048, 100
#: Candidate pairs for each member of a group beyond which its members with more are split too; of a split group, open lines beyond which more pivots are tried, and comparisons a member that these make at first.
DENSE = 4
#: Tokens that a split group's lines share at most, in its key.
DEEPEST = 4
#: Places of lines to remove that are broadcast to the scan of the texts, at most (4 bytes each, and 30 for each text); beyond, the scan is joined by shuffle.
BROADCAST_LINES = 2_000_000
BATCH, PIECE = 2 << 20, 1 << 18
#: Bits kept of the first signature, by which candidates travel: all. (Fewer only to try what happens where unlike sets share one.)
FIRST = -1
LINES = "d long, l int, s1 long, s2 long, n int, copies int, bits long, once int, rare int, tokens array<long>"
#: Hashes, of which a dictionary in a file would hold each value once.
HASHED = {f"parquet.enable.dictionary#{c}": "false" for c in ("s1", "s2", "bits", "tokens.list.element")}
#: Postings of a batch that are dealt out to buckets at once, and words of the corpus for each bucket.
BLOCK, BUCKET = 1 << 18, 1 << 19
#: Words of 64 bits in the wide parity map of a candidate's set.
WIDE = [f"w{k}" for k in range(8)]
SETS = f"s1 long, s2 long, n int, {', '.join(f'{w} long' for w in WIDE)}, tokens binary"


def _sorted_tokens(line: np.ndarray, words: np.ndarray, ranks: np.ndarray | None) -> np.ndarray:
    """The order of words by line, then rarity class (if given), then hash."""
    rank = ranks[cells_of(words)].astype(np.uint64) if ranks is not None else np.zeros(len(words), np.uint64)
    if not len(line) or line[-1] < 1 << 20:
        # one sort of packed keys; where they tie, equal words must still stand together
        key = (line.astype(np.uint64) << np.uint64(44)) | (rank << np.uint64(34)) | (words >> np.uint64(30))
        order = np.argsort(key)
        key, sorted_words = key[order], words[order]
        if not ((key[1:] == key[:-1]) & (sorted_words[1:] != sorted_words[:-1])).any():
            return order
    return np.lexsort((words, rank, line))


class _Lines:
    """The lines with words of a batch's texts: row, place, size of the token set, two signatures, parity bits; all sets in ``flat``.

    ``wanted`` names (row, place) of lines to which this is limited; ``first`` the bits kept of the first signature.
    """

    def __init__(self, column: pa.Array, ranks: np.ndarray | None = None, wanted: tuple[np.ndarray, np.ndarray] | None = None, first: int = FIRST):
        rows, lines, sizes, flats = [], [], [], []
        raw, offsets = text_bytes(column)
        for a, b in pieces_of(offsets, PIECE):
            base = offsets[a]
            part, ends = raw[base : offsets[b]], offsets[a : b + 1] - base
            breaks = np.flatnonzero(part == 10) + 1
            # an empty text has no line; equal cuts (a break at a text's end) make an empty line, which has no words
            cuts = np.unique(np.concatenate((ends, breaks)))
            row = np.searchsorted(ends, cuts[:-1], "right") - 1
            place = np.searchsorted(breaks, cuts[:-1], "right") - np.searchsorted(breaks, ends[row], "right")
            if wanted is not None:
                keep = np.isin(((row + a) << 32) | place, (wanted[0] << 32) | wanted[1])
                row, place, length = row[keep], place[keep], np.diff(cuts)[keep]
                begin = np.cumsum(length) - length
                part = part[np.repeat(cuts[:-1][keep] - begin, length) + np.arange(int(length.sum()))]
                cuts = np.append(begin, len(part))
                if not len(row):
                    continue
            words, begins = word_hashes(part, cuts)
            line = np.repeat(np.arange(len(cuts) - 1), np.diff(begins))
            order = _sorted_tokens(line, words, ranks)
            words = words[order]  # lines stay where they are
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
            words, n = words[new], np.bincount(line[new], minlength=len(cuts) - 1)
            keep = n > 0
            rows.append((row + a)[keep])
            lines.append(place[keep])
            sizes.append(n[keep])
            flats.append(words)
        join = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)
        self.row, self.line, self.n, self.flat = join(rows, np.int64), join(lines, np.int64), join(sizes, np.int64), join(flats, np.uint64)
        self.starts = np.cumsum(self.n) - self.n
        total = lambda values: np.add.reduceat(values, self.starts).view(np.int64) if len(self.n) else np.empty(0, np.int64)
        self.s1, self.s2 = total(mix(self.flat ^ np.uint64(0x5851F42D4C957F2D))) & first, total(mix(self.flat ^ np.uint64(0x14057B7EF767814F)))

    def bits(self) -> np.ndarray:
        """Of 64 hash ranges the parity of their tokens: two sets differ by as many tokens at least as their maps by bits."""
        each = np.uint64(1) << ((self.flat >> np.uint64(24)) & np.uint64(63))
        return np.bitwise_xor.reduceat(each, self.starts).view(np.int64) if len(self.n) else np.empty(0, np.int64)

    def wide(self) -> list[np.ndarray]:
        """Like ``bits``, of as many times 64 hash ranges as WIDE has words, a column for each word."""
        cell = (self.flat >> np.uint64(24)) % np.uint64(64 * len(WIDE))
        each, word = np.uint64(1) << (cell & np.uint64(63)), cell >> np.uint64(6)
        if not len(self.n):
            return [np.empty(0, np.int64) for _ in WIDE]
        return [np.bitwise_xor.reduceat(np.where(word == k, each, np.uint64(0)), self.starts).view(np.int64) for k in range(len(WIDE))]

    def firsts(self, ids: np.ndarray) -> np.ndarray:
        """For the earliest line of each set in the batch the number of its lines, for others 0."""
        order = np.lexsort((self.line, ids[self.row], self.s2, self.s1))
        s1, s2 = self.s1[order], self.s2[order]
        new = np.flatnonzero(np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))) if len(order) else np.empty(0, np.int64)
        out = np.zeros(len(order), np.int64)
        out[order[new]] = np.diff(np.append(new, len(order)))
        return out


def posting_size(percent: int) -> int:
    """The fewest words of a line that a line of another set can match: one word more or less must leave ``percent``."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else 1 << 30


def deepest(percent: int) -> int:
    """Tokens that all similar lines of posting size share for certain, up to DEEPEST."""
    return min(DEEPEST, -(-posting_size(percent) * percent // 100))


def _word_hashes(batch):
    for part in by_bytes([batch], "text", BATCH):
        raw, offsets = text_bytes(part["text"])
        for a, b in pieces_of(offsets, PIECE):
            yield word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0]


def _every_line(ranks, percent: int, hot: int, bits: int = FIRST):
    often = rarity_classes(np.array([hot]))[0]

    def run(batches):
        for batch in by_bytes(batches, "text", BATCH):
            x, ids = _Lines(batch["text"], ranks.value, first=bits), batch["id"].to_numpy(zero_copy_only=False)
            copies = x.firsts(ids)
            first = copies > 0
            posted = np.minimum(np.where(first & (x.n >= posting_size(percent)), prefix_length(x.n, percent) + DEEPEST - 1, 0), x.n)
            ends = np.cumsum(posted)
            taken = np.repeat(x.starts - (ends - posted), posted) + np.arange(int(posted.sum()))
            # a token that the sketch counts less often than ``hot`` has no larger group, one that it counts once none; tokens stand rare-first
            rank = ranks.value[cells_of(x.flat[taken])]

            def head(which, posted=posted, ends=ends, x=x):
                seen = np.concatenate(([0], np.cumsum(which)))
                return pa.array(np.minimum(seen[ends] - seen[ends - posted], prefix_length(x.n, percent)).astype(np.int32))
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(x.flat[taken].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[x.row]), pa.array(x.line.astype(np.int32)), pa.array(x.s1), pa.array(x.s2), pa.array(x.n.astype(np.int32), mask=~first),
                    pa.array(copies.astype(np.int32)), pa.array(x.bits()), head(rank == 0), head(rank < often), tokens,
                ],
                [c.split()[0] for c in LINES.split(", ")],
            )
    return run


def _sets(bits: int = FIRST):
    """Token sets, by both signatures, of the lines that ``wanted`` names, each once in a task; a line of another set (under a repeated id) is passed over."""
    def run(batches):
        done: set[tuple[int, int]] = set()
        for batch in by_bytes(batches, "text", BATCH):
            wanted = batch["wanted"]
            row = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            place, s1, s2 = (wanted.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            x = _Lines(batch["text"], None, (row, place.astype(np.int64)), bits)
            asked = set(zip(row.tolist(), place.tolist(), s1.tolist(), s2.tolist(), strict=True))
            keep = []
            for k, (r, p, *s) in enumerate(zip(x.row.tolist(), x.line.tolist(), x.s1.tolist(), x.s2.tolist(), strict=True)):
                if (r, p, *s) in asked and tuple(s) not in done:
                    done.add(tuple(s))
                    keep.append(k)
            sets = [x.flat[x.starts[k] : x.starts[k] + x.n[k]].tobytes() for k in keep]
            known = [pa.array(c[keep]) for c in (x.s1, x.s2, x.n.astype(np.int32), *x.wide())]
            yield pa.RecordBatch.from_arrays([*known, pa.array(sets, pa.binary())], [c.split()[0] for c in SETS.split(", ")])
    return run


def _verify(percent: int):
    def run(batches):
        for batch in by_bytes(batches, "tx", BATCH):
            (a, x), (b, y) = (text_bytes(batch[c]) for c in ("tx", "ty"))
            n, m = np.diff(x) // 8, np.diff(y) // 8
            pair = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)))
            # a token of one pair gets one value, and meets only its like
            value = mix(np.concatenate((np.frombuffer(a.tobytes(), np.uint64), np.frombuffer(b.tobytes(), np.uint64))) ^ mix(pair.astype(np.uint64)))
            order = np.argsort(value)
            value, pair = value[order], pair[order]
            both = np.bincount(pair[1:][(value[1:] == value[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
            keep = 100 * both >= percent * (n + m - both)
            yield batch.select(["s1", "s2"]).filter(pa.array(keep, pa.bool_()))
    return run


def _close(key: np.ndarray, a: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, percent: int, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of members in groups by key: pairs (a, b) that pass the length, parity and positional filters, and key and a of crowded members.

    Those are the members with more than DENSE such pairs in a group of more than DENSE pairs a member. Pairs between two of them are not given.
    """
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    order = np.argsort(group << 32 | n)
    a, n, pos, bits = a[order], n[order], pos[order], bits[order].view(np.uint64)
    # the members of a group within reach of a member's size stand behind it, up to the one of the largest size
    count = np.searchsorted(group << 32 | n, group << 32 | (n * 100 // percent), "right") - np.arange(len(key)) - 1
    total, most = np.cumsum(count), DENSE * np.bincount(group)
    found, partners, first = np.zeros(len(most), np.int64), np.zeros(len(key), np.int64), 0
    xs, ys = [], []

    def given(x, y):
        return (found[group[x]] <= most[group[x]]) | (partners[x] <= DENSE) | (partners[y] <= DENSE)

    while first < len(key):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + chunk, "right")))
        here = count[first:last]
        x = np.repeat(np.arange(first, last), here)
        y = np.arange(len(x)) - np.repeat(np.cumsum(here) - here, here) + x + 1
        size = n[x] + n[y]
        keep = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) * (100 + percent) <= size * (100 - percent)
        x, y, size = x[keep], y[keep], size[keep]
        keep = (np.minimum(n[x] - pos[x], n[y] - pos[y]) * (100 + percent) >= size * percent) & (a[x] != a[y])
        x, y = x[keep], y[keep]
        found += np.bincount(group[x], minlength=len(found))
        partners += np.bincount(x, minlength=len(key)) + np.bincount(y, minlength=len(key))
        keep = given(x, y)  # counts only grow: what is not given now never is
        xs.append(x[keep])
        ys.append(y[keep])
        first = last
    x, y = np.concatenate(xs), np.concatenate(ys)
    keep = given(x, y)
    x, y = x[keep], y[keep]
    crowded = partners > np.bincount(x, minlength=len(key)) + np.bincount(y, minlength=len(key))
    x, y = a[x], a[y]
    return np.unique(np.column_stack((np.minimum(x, y), np.maximum(x, y))), axis=0), key[crowded], a[crowded]


def _dealt(cols: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Postings (key, a, at, bits) as one row for each bucket of keys: the bucket, and its columns one after another."""
    bucket = (mix(cols[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, counts = np.unique(bucket, return_counts=True)
    ends = np.cumsum(counts)
    at = np.repeat((len(cols) - 1) * (ends - counts), counts) + np.arange(len(bucket))
    out, step = np.empty(len(cols) * len(bucket), np.int64), np.repeat(counts, counts)
    for k, c in enumerate(cols):
        out[at + k * step] = c[order]
    offsets = pa.py_buffer((8 * len(cols) * np.append(0, ends)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(own), pa.Array.from_buffers(pa.binary(), len(own), [None, offsets, pa.py_buffer(out)])], ["bucket", "rows"])


def _blocks(flat, buckets: int):
    """Postings of several batches, about BLOCK at once, dealt to buckets; ``flat`` takes (key, a, at, bits) from a batch."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(flat(batch))
            size += len(held[-1][0])
            if size >= BLOCK:
                yield _dealt([np.concatenate(c) for c in zip(*held, strict=True)], buckets)
                held, size = [], 0
        if size:
            yield _dealt([np.concatenate(c) for c in zip(*held, strict=True)], buckets)
    return run


def _posted(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Postings of lines' tokens from place ``once`` to before ``rare``."""
    s1, n, bits, once, rare = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s1", "n", "bits", "once", "rare"))
    count = np.maximum(rare - once, 0)
    ends = np.cumsum(count)
    row, pos = np.repeat(np.arange(len(n)), count), np.arange(int(count.sum())) - np.repeat(ends - count - once, count)
    tokens, starts = batch["tokens"].values.to_numpy(), batch["tokens"].offsets.to_numpy()[:-1]
    return [tokens[starts[row] + pos], s1[row], n[row] << 32 | pos, bits[row]]


def _plain(batch: pa.RecordBatch) -> list[np.ndarray]:
    key, a, n, pos, bits = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "a", "n", "pos", "bits"))
    return [key, a, n << 32 | pos, bits]


def _meet(percent: int):
    """Candidate pairs of blocks that come sorted by bucket, and key and ``a``, without a ``b``, of crowded members; a bucket's blocks are held until its last has come."""
    def pairs(blocks):
        key, a, at, bits = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in blocks], axis=1)
        order = np.argsort(key)
        key = key[order]
        alike = np.concatenate(([False], key[1:] == key[:-1], [False]))
        many = alike[1:] | alike[:-1]  # a posting of its own meets nothing
        key, order = key[many], order[many]
        if not len(key):
            return
        found, keys, crowded = _close(key, a[order], at[order] >> 32, at[order] & 0xFFFFFFFF, bits[order], percent)
        first, pair = np.concatenate((found[:, 0], crowded)), np.arange(len(found) + len(crowded)) < len(found)
        second, key = np.concatenate((found[:, 1], crowded)), np.concatenate((found[:, 0], keys))
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second, mask=~pair), pa.array(key, mask=pair)], ["a", "b", "key"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for bucket, rows in zip(batch["bucket"].to_pylist(), batch["rows"], strict=True):
                if bucket != now and held:
                    yield from pairs(held)
                    held = []
                now = bucket
                held.append(rows)
        if held:
            yield from pairs(held)
    return run


def _prefix(n: Column, percent: int, tokens: int) -> Column:
    """Tokens of a set of n among which similar sets share ``tokens``."""
    return (n - F.floor((n.cast("long") * percent + 99) / 100).cast("int") + tokens).cast("int")


def _possible(x: str, y: str, percent: int, tokens: int) -> Column:
    """Length, parity and positional filters for two members of a group, whose key holds ``tokens`` tokens of which ``pos`` is the last one's place."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    size = n.cast("long") + m
    apart = F.bit_count(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits")))
    return (
        (apart * (100 + percent) <= size * (100 - percent)) & (F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * percent)
        & ((F.least(n - i, m - j) + tokens - 1) * (100 + percent) >= size * percent)
    )


def _earlier(x: str, y: str) -> Column:
    """Whether a line of ``x`` stands before one of ``y``; candidates of unlike sets only."""
    return (F.struct(f"{x}.d", f"{x}.l") < F.struct(f"{y}.d", f"{y}.l")) & (F.col(f"{x}.a") != F.col(f"{y}.a"))


def _near(x: str, y: str, percent: int) -> Column:
    """Whether the wide parity maps of two sets let them be similar."""
    apart = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in WIDE), F.lit(0))
    return apart * (100 + percent) <= (F.col(f"{x}.n").cast("long") + F.col(f"{y}.n")) * (100 - percent)


class _Groups:
    """Groups of classes by posted keys, from one split to the next.

    ``lines`` may hold a class's prefix several times, once for each batch that has it.
    """

    def __init__(self, rows: DataFrame, lines: DataFrame, classes: DataFrame, doubles: DataFrame | None, scratch: Scratch, percent: int, words: int):
        self.rows, self.lines, self.classes, self.doubles, self.scratch, self.percent, self.words = rows, lines, classes, doubles, scratch, percent, words
        self.held = None  # the members of groups that are split first
        self.details = self.sets = self.prefixes = None  # of the first candidates and of the classes in split groups

    def posted(self, *more: str, rare: bool = True) -> DataFrame:
        """key, a (a class by its first signature), n, pos, bits: the prefixes of all classes of posting size without tokens that occur once, or of them what is not ``rare``."""
        past, whole = F.col("once") if rare else F.greatest("once", "rare"), _prefix(F.col("n"), self.percent, 1)
        some = self.lines.where((F.col("n") >= posting_size(self.percent)) & (past < whole))
        head = F.slice("tokens", past + 1, whole - past)
        return some.select(F.col("s1").alias("a"), "n", "bits", past.alias("_past"), *more, F.posexplode(head).alias("_k", "key")).withColumn("pos", F.col("_past") + F.col("_k")).drop("_past", "_k")

    def room(self, depth: int) -> Column:
        """Rows that a member becomes when its group is split."""
        return F.lit(2) if depth == 0 else F.greatest(F.lit(0), _prefix(F.col("n"), self.percent, depth + 1) - F.col("pos") - 1)

    def keys(self, keys: DataFrame) -> DataFrame | None:
        """The keys, broadcast if they are few; None if there are none."""
        keys = self.scratch.save(keys)
        found = keys.limit(BROADCAST_IDS + 1).count()
        return None if not found else F.broadcast(keys) if found <= BROADCAST_IDS else keys

    def heavy(self, members: DataFrame, depth: int) -> DataFrame:
        """Keys of the groups that are better split; each open member, at first all, is compared with all others."""
        open_ = F.sum(F.col("open").cast("long")) if depth else F.count(F.lit(1))
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), open_.alias("o"), F.sum(self.room(depth).cast("long")).alias("r"))
        return sizes.where((F.col("c") > HOT) & (F.col("o") * F.col("c") > F.col("r") * SPLIT)).select("key")

    def reached(self, state: DataFrame) -> DataFrame:
        """``state``'s groups up to their last open line, without those in which no other line than the earliest is open."""
        place = F.struct("d", "l")
        ends = state.groupBy("key").agg(F.max(F.when(F.col("open"), place)).alias("_last"), F.min(place).alias("_first")).where("_last > _first")
        return state.join(ends, "key").where(place <= F.col("_last")).drop("_last", "_first")

    def split(self, state: DataFrame, depth: int) -> DataFrame:
        """The members of ``state`` that can still meet, under the keys of the next depth; only one that is its key's ``own`` meets others."""
        state = self.reached(state)
        if depth == 1:
            # sizes by steps of the least ratio: a line is at home at its own step and a guest at the next one
            step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / self.percent)))
            roles = F.explode(F.array(F.struct(step.alias("step"), F.lit(True).alias("own")), F.struct((step + 1).alias("step"), F.lit(False).alias("own"))))
            out = state.select("key", "a", "s2", "d", "l", "n", "pos", "bits", "m", "open", roles.alias("r"))
            return out.select(F.xxhash64("key", "r.step").alias("key"), "a", "s2", "d", "l", "n", "pos", "bits", "m", F.col("r.own").alias("own"), "open")
        more = F.slice("tokens", F.col("pos") + 2, F.greatest(F.lit(0), _prefix(F.col("n"), self.percent, depth) - F.col("pos") - 1))
        out = state.select("key", "a", "s2", "d", "l", "n", "bits", "m", "own", "open", "pos", F.posexplode(more).alias("_k", "_token"))
        return out.select(F.xxhash64("key", "_token").alias("key"), "a", "s2", "d", "l", "n", (F.col("pos") + 1 + F.col("_k")).alias("pos"), "bits", "m", "own", "open")

    def meet(self, members: DataFrame, depth: int) -> DataFrame:
        """Candidate pairs (a, b) of classes in one group; of a split one those of an open class and an earlier one."""
        if depth == 0:  # groups of HOT members at most: ``members``, and all of rare tokens; they travel by buckets of whole groups
            rare = self.lines.where((F.col("n") >= posting_size(self.percent)) & (F.col("once") < F.col("rare"))).select("s1", "n", "bits", "once", "rare", "tokens")
            buckets = max(1 << 6, self.words // BUCKET)
            blocks = [x.mapInArrow(tidy(_blocks(flat, buckets)), "bucket long, rows binary") for x, flat in ((rare, _posted), (members.select("key", "a", "n", "pos", "bits"), _plain))]
            return blocks[0].union(blocks[1]).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_meet(self.percent)), "a long, b long, key long")
        x, y = members.where("open").alias("x"), members.alias("y")
        fit = (F.col("x.own") | F.col("y.own")) & _earlier("y", "x") & _possible("x", "y", self.percent, max(1, depth)) & _near("x.m", "y.m", self.percent)
        return x.join(y, "key").where(fit).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))

    def read(self, about: DataFrame) -> DataFrame:
        """The sets of the classes ``about`` (a, s2, d, l), read from their first lines; a repeated id may give one in several tasks."""
        wanted = about.groupBy(F.col("d").alias("id")).agg(F.collect_list(F.struct("l", F.col("a").alias("s1"), "s2")).alias("wanted"))
        few = about.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        texts = self.rows.join(F.broadcast(wanted) if few else wanted, "id").select("id", "text", "wanted")
        return self.scratch.save(texts.mapInArrow(tidy(_sets(FIRST)), SETS), codec="uncompressed")

    def learn(self, pairs: DataFrame) -> None:
        """Reads the sets, sizes and wide parity maps of the classes in ``pairs``, and in the groups that are split for all that follows."""
        named = [pairs.select("a"), pairs.select("b")] + ([self.held.select("a")] if self.held is not None else [])
        ids = functools.reduce(DataFrame.union, named).distinct()
        about = self.scratch.save(self.classes.select(F.col("s1").alias("a"), "s2", "d", "l").join(ids, "a"))
        self.sets = self.read(about)
        sized = self.sets.select(F.col("s1").alias("a"), "s2", "n", *WIDE).dropDuplicates(["a", "s2"])
        self.details = self.scratch.save(about.join(sized, ["a", "s2"]))
        self.scratch.drop(about)

    def tokens(self) -> DataFrame:
        """a, s2, tokens: the prefixes of the classes that are known."""
        if self.prefixes is None:
            lines = self.lines.where(F.col("n") >= posting_size(self.percent)).select(F.col("s1").alias("a"), "s2", "d", "l", "tokens")
            self.prefixes = self.scratch.save(lines.join(self.details.select("a", "s2", "d", "l"), ["a", "s2", "d", "l"]).select("a", "s2", "tokens").dropDuplicates(["a", "s2"]))
        return self.prefixes

    def closed(self, state: DataFrame, found: DataFrame) -> DataFrame:
        """``state``, in which the classes ``found`` (s1, s2) are open no more."""
        done = found.select(F.col("s1").alias("a"), "s2", F.lit(True).alias("_done"))
        few = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return state.join(F.broadcast(done) if few else done, ["a", "s2"], "left").withColumn("open", F.col("open") & F.col("_done").isNull()).drop("_done")

    def thinned(self, state: DataFrame, depth: int, gone: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The saved ``state`` after rounds in which the open lines of crowded groups are tried against early lines; what goes is put to ``gone``.

        A group of c members, o of them open, names up to ``rows`` * c / o pivots: ``rows`` comparisons a member at most. Rounds
        end when what they have met lets all open lines with all members make DENSE candidates a member at most, or at SPLIT
        comparisons; one that settles less than half is followed by one of four times the comparisons. Given with it is the
        saved table that it is made from.
        """
        scratch, rows, before = self.scratch, DENSE, None
        while True:
            sizes = scratch.save(state.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("open").cast("long")).alias("o")).where(F.col("o") > DENSE))
            members, left = sizes.agg(F.sum("c"), F.sum("o")).first()
            if before and left and 2 * left > before:
                rows *= 4
            if not left or rows > SPLIT:
                scratch.drop(sizes)
                return state, state
            before, crowded = left, state.join(sizes.select("key", "o", F.ceil(F.col("c") * rows / F.col("o")).alias("k")), "key")
            pivots = crowded.groupBy("key", F.pmod(F.xxhash64("a", "s2"), F.col("k")).alias("_k")).agg(F.min(F.struct("d", "l", "a", "n", "pos", "bits", *[f"m.{w}" for w in WIDE], "o")).alias("p"))
            x, y = state.where("open").alias("x"), pivots.select("key", "p.*").alias("y")
            fit = _earlier("y", "x") & _possible("x", "y", self.percent, max(1, depth)) & _near("x.m", "y", self.percent)
            tried = scratch.save(x.join(y, "key").where(fit).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), "y.o"))
            expected = (tried.agg(F.sum("o")).first()[0] or 0) / rows
            gone.append(self.linked(tried))
            scratch.drop(sizes, tried)
            saved, state = state, self.closed(state, gone[-1])
            if expected <= DENSE * members:
                return state, saved
            state = scratch.save(state)
            scratch.drop(saved)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """s1, s2 of the later class of each similar pair: each class is tried with its earliest candidate, and only what that leaves with all others.

        Later pairs are of the classes that the first ones and the groups that are split have.
        """
        scratch, known = self.scratch, self.details is not None
        pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = pairs.limit(BROADCAST_IDS + 1).count()
        if not known and (found or self.held is not None):
            self.learn(pairs)
        if not found:
            return pairs.select(F.col("a").alias("s1"), F.col("b").alias("s2"))
        sized, sets = self.details, self.sets
        if known and 2 * found <= BROADCAST_IDS:
            sized = sized.join(F.broadcast(pairs.select("a").union(pairs.select("b"))), "a", "left_semi")
        place, size = F.struct("d", "l", F.col("a").alias("s1"), "s2"), F.struct("n", *WIDE)
        x, y = (sized.select(F.col("a").alias(side), place.alias(f"p{side}"), size.alias(f"m{side}")) for side in "ab")
        # two texts under one id may have unlike lines at one place: neither is the earlier one
        earlier = (F.col("pa.d") != F.col("pb.d")) | (F.col("pa.l") != F.col("pb.l"))
        near = pairs.join(x, "a").join(y, "b").where(earlier & _near("ma", "mb", self.percent))
        ordered = near.select(F.greatest("pa", "pb").alias("x"), F.least("pa", "pb").alias("y"))
        ordered = scratch.save(ordered.select(F.col("x.s1"), F.col("x.s2"), "y"))
        scratch.drop(pairs)
        first = ordered.groupBy("s1", "s2").agg(F.min("y").alias("y"))
        gone = scratch.save(self.verified(first, sets))
        rest = ordered.join(gone, ["s1", "s2"], "left_anti")
        rest = scratch.save(rest.join(first.withColumnRenamed("y", "tried"), ["s1", "s2"]).where("y <> tried").drop("tried"))
        out = scratch.save(gone.union(self.verified(rest, sets)))
        scratch.drop(ordered, gone, rest)
        return out

    def verified(self, ordered: DataFrame, sets: DataFrame) -> DataFrame:
        """s1, s2 of the classes that one at least of their ``y`` (d, l, s1, s2) is similar to."""
        asked = self.scratch.save(ordered.select("s1", "s2").union(ordered.select("y.s1", "y.s2")).distinct())
        few = asked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        sets = sets.select("s1", "s2", "tokens").join(F.broadcast(asked) if few else asked, ["s1", "s2"], "left_semi")
        dealt = sets.repartition("s1", "s2")  # one exchange for both sides
        x, y = dealt.withColumnRenamed("tokens", "tx"), dealt.select(F.col("s1").alias("y1"), F.col("s2").alias("y2"), F.col("tokens").alias("ty"))
        full = ordered.select("s1", "s2", F.col("y.s1").alias("y1"), F.col("y.s2").alias("y2")).join(y, ["y1", "y2"]).join(x, ["s1", "s2"])
        return full.select("s1", "s2", "tx", "ty").mapInArrow(tidy(_verify(self.percent)), "s1 long, s2 long").distinct()

    def later(self) -> DataFrame:
        """s1, s2 of every class that a line of an earlier class matches."""
        scratch, members, gone = self.scratch, self.posted(rare=False), []
        for depth in range(deepest(self.percent) + 1):
            heavy = self.keys(self.heavy(members, depth)) if depth < deepest(self.percent) else None
            pairs, held = self.meet(members.join(heavy, "key", "left_anti") if heavy is not None else members, depth), None
            if not depth:
                met = scratch.save(pairs)
                pairs, crowded = met.where("key is null").select("a", "b"), self.keys(met.where("key is not null").select("key", "a").distinct())
                if self.doubles is not None:  # no group can pair classes that go by one name
                    pairs = pairs.union(self.doubles.select(F.col("s1").alias("a"), F.col("s1").alias("b")))
                split = [] if heavy is None else [self.posted("s2", "d", "l").join(heavy, "key")]
                if crowded is not None:
                    split.append(self.posted("s2", "d", "l").join(self.keys(crowded.select("key").distinct()), "key", "left_semi").join(crowded, ["key", "a"]))
                if split:  # a class's first line, which posts what its others post, stands for it
                    held = functools.reduce(DataFrame.unionByName, split).groupBy("key", "a", "s2").agg(F.min(F.struct("d", "l", "n", "pos", "bits")).alias("f"))
                    self.held = held = scratch.save(held.select("key", "a", "s2", "f.*"))
                    pivots = held.groupBy("key").agg(F.min(F.struct("d", "l", "a", "n", "pos", "bits")).alias("p")).select("key", "p.*")
                    tried = held.alias("x").join(pivots.alias("y"), "key").where(_earlier("y", "x") & _possible("x", "y", self.percent, 1))
                    pairs = pairs.union(tried.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")))
            elif heavy is not None:
                held = scratch.save(members.join(heavy, "key").join(self.tokens(), ["a", "s2"]))
            gone.append(self.linked(pairs))
            if depth:
                scratch.drop(members)
            if held is None:
                return functools.reduce(DataFrame.union, gone).distinct()
            state = self.reached(self.closed(held if depth else held.withColumn("open", F.lit(True)), gone[-1]))
            state = scratch.save(state if depth else state.join(self.details.select("a", "s2", F.struct("n", *WIDE).alias("m")), ["a", "s2"]))
            scratch.drop(held)
            if not state.limit(1).count():
                return functools.reduce(DataFrame.union, gone).distinct()
            state, saved = self.thinned(state, depth, gone)
            members = scratch.save(self.split(state, depth + 1))
            scratch.drop(saved)
        raise AssertionError("the last depth holds no heavy groups")


def _classes(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Each set's signatures, first line (d, l) and copies; and the first signatures, if any, that several sets have."""
    lines = lines.where("n is not null")
    about = F.min(F.struct("d", "l")).alias("f"), F.sum("copies").alias("copies")
    named = scratch.save(lines.groupBy("s1").agg(*about, F.min("s2").alias("s2"), F.max("s2").alias("other")), codec="snappy")
    columns = "s1", "s2", "f.*", "copies"
    doubles = scratch.save(named.where("s2 <> other").select("s1"))
    found = doubles.limit(BROADCAST_IDS + 1).count()
    if not found:
        return named.select(*columns), None
    again = lines.join(F.broadcast(doubles) if found <= BROADCAST_IDS else doubles, "s1").groupBy("s1", "s2").agg(*about)
    return scratch.save(named.where("s2 = other").select(*columns).union(again.select(*columns)), codec="snappy"), doubles


def later_lines(rows: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(d, l) of every line of ``rows`` (id, text) that goes."""
    counts = sketch(rows, _word_hashes, ["text"])
    shared = rows.sparkSession.sparkContext.broadcast(rarity_classes(counts))
    lines = scratch.save(rows.mapInArrow(tidy(_every_line(shared, percent, HOT, FIRST)), LINES), codec="snappy", options=HASHED)
    classes, doubles = _classes(lines, scratch)
    gone = _Groups(rows, lines, classes, doubles, scratch, percent, int(counts.sum(dtype=np.uint64))).later().withColumn("gone", F.lit(True))
    touched = classes.select("s1", "s2", F.col("d").alias("fd"), F.col("l").alias("fl"), "copies").join(gone, ["s1", "s2"], "left").where("copies > 1 or gone")
    return lines.select("d", "l", "s1", "s2").join(touched, ["s1", "s2"]).where("gone or d <> fd or l <> fl").select("d", "l")


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with later matches taken out of ``text``, and ``lines_removed``; all other columns as they are.

    Every line that has a word takes part. A null text stays null, one without
    such lines stays as it is; lines keep their order. Rows without a doc_id
    have no place in the order: they stay as they are and remove nothing.
    Repeated rows of one doc_id share their lines' places, so they do not
    remove each other's but are treated alike. A column of ``docs`` named
    lines_removed is replaced. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    gone = scratch.save(later_lines(rows, scratch, percent).groupBy("d").agg(F.collect_set("l").alias("gone")))
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES
    names = [c for c in docs.columns if c != "lines_removed"]
    whole = docs.select(F.col("doc_id").cast("long").alias("d"), F.struct(*names).alias("row"))  # so that no column can clash
    joined = whole.join(F.broadcast(gone) if few else gone, "d", "left")

    def rest(lines: Column) -> Column:  # a lambda's argument is computed once
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda k: lines[k]), "\n")

    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.transform(F.array(F.split(F.col("row.text"), "\n", -1)), rest)[0])
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("lines_removed"))


def drop_emptied(deduped: DataFrame) -> DataFrame:
    """Rows of ``dedup_lines`` without those that lost lines and have nothing but white space left."""
    return deduped.where((F.col("lines_removed") == 0) | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")).drop("lines_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines_removed", "text")
