"""N-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

Two documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets
of word n-grams. The join finds the connected components of all links; it loses
no link between different texts, but never makes all pairs of a group.

1. Each text's set is hashed inside the scan; equal sets (all copies) become
   one class at once, by a partial aggregation on a 128-bit signature.
2. Sets are ordered rare-first by the count sketch, and only their prefixes are
   posted: similar sets share a posted n-gram.
3. Each posted n-gram names a pivot, the member with the fewest rarer n-grams
   before it. Members are tried against pivots only: as many candidates as
   postings. Length and positional filters apply in the join, the suffix filter
   (counts of the sets' n-grams by hash range, a bound of their difference) on
   the distinct pairs, and what is left is verified once per pair on full sets.
4. Only where an n-gram's members are still in different components are its
   members outside the pivot's component tried against the others, again
   filtered and once per pair. Further pivots go first as long as that saves work.

Texts are never shuffled unless the candidates' ids are too many to broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, tidy
from triagelake.llm.graph import components
from triagelake.llm.hashing import mix
from triagelake.llm.rarity import cells_of, sketch
from triagelake.llm.shared import Scratch, table
from triagelake.llm.shingles import shingle_sets
from triagelake.operators.ranking import numbered

RANGES = 16
BATCH = 2 << 20
#: Ids of candidates that are broadcast to the scan of the texts, at most (8 bytes each); beyond, the scan is joined by shuffle.
BROADCAST_IDS = 1_000_000


def prefix_length(n, percent: int):
    """N-grams of a set of n of which similar sets share one."""
    return n - -(-n * percent // 100) + 1


def _need(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of linked sets of n and m n-grams."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent))


def _profiles(k: int):
    def run(batches):
        for batch in by_bytes(batches, "text", BATCH):
            n, first, second, counts = [], [], [], []
            for s in shingle_sets(batch["text"], k):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    first.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    second.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                counts.append(np.diff(np.searchsorted(s >> np.uint64(60), np.arange(RANGES + 1, dtype=np.uint64))).astype(np.int32))
            flat = np.concatenate(counts) if counts else np.empty(0, np.int32)
            ranges = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * RANGES), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), ranges], ["id", "n", "s1", "s2", "ranges"])
    return run


def _postings(k: int, percent: int, counts):
    def run(batches):
        cells = counts.value
        for batch in by_bytes(batches, "text", BATCH):
            ids = batch["id"].to_numpy(zero_copy_only=False)
            tokens, size, place = [], [], []
            for s in shingle_sets(batch["text"], k):
                if not len(s):
                    size.append(0)
                    place.append(0)
                    continue
                p = prefix_length(len(s), percent)
                tokens.append(s[np.argsort(cells[cells_of(s)], kind="stable")[:p]])  # by count, then hash
                size.append(len(s))
                place.append(p)
            place = np.array(place, np.int64)
            total = int(place.sum())
            at = np.arange(total) - np.repeat(np.cumsum(place) - place, place)
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)), pa.array(np.repeat(ids, place)), pa.array(np.repeat(np.array(size, np.int32), place)), pa.array(at.astype(np.int32))],
                ["h", "id", "n", "pos"],
            )
    return run


def _sets(k: int):
    def run(batches):
        for batch in by_bytes(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([s.tobytes() for s in shingle_sets(batch["text"], k)], pa.binary())], ["id", "grams"])
    return run


def _verify(percent: int):
    def run(batches):
        for batch in by_bytes(batches, "ga", BATCH):
            keep, last, a = [], None, None
            for x, y in zip(batch["ga"], batch["gb"], strict=True):
                x, y = x.as_py(), y.as_py()
                if x is not last and x != last:
                    last, a = x, np.frombuffer(x, np.uint64)
                b = np.frombuffer(y, np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out
    return run


class _Join:
    def __init__(self, rows: DataFrame, k: int, percent: int, scratch: Scratch):
        self.rows, self.k, self.percent, self.scratch = rows, k, percent, scratch
        self.profiles = scratch.save(rows.mapInArrow(tidy(_profiles(k)), "id long, n long, s1 long, s2 long, ranges array<int>"))

    def copies(self) -> DataFrame:
        """(a, b): each document b of a set that a smaller id a has too."""
        full = self.profiles.where("n > 0")
        firsts = full.groupBy("n", "s1", "s2").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").drop("last")
        return full.select("n", "s1", "s2", F.col("id").alias("b")).join(firsts, ["n", "s1", "s2"]).where("a <> b").select("a", "b")

    def only_copies(self) -> DataFrame:
        """``id`` of the documents that have no text but what a smaller id has too: their links are those of that id."""
        keys = ["n", "s1", "s2"]
        firsts = self.profiles.where("n > 0").groupBy(*keys).agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").drop("last")
        own = self.profiles.where("n > 0").join(firsts, keys, "left")
        return self.scratch.save(own.groupBy("id").agg(F.min(F.coalesce(F.col("a") < F.col("id"), F.lit(False))).alias("copy")).where("copy").select("id"))

    def members(self, copies: DataFrame) -> DataFrame:
        """Postings (h, id, n, pos) of n-grams that several classes post, with the pivot (p_id, p_n, p_pos); copies post nothing."""
        k, percent, spark = self.k, self.percent, self.rows.sparkSession
        rows = self.rows.join(_small(copies), "id", "left_anti")
        # whole batches of distinct n-grams: each document counts once
        counts = spark.sparkContext.broadcast(sketch(rows, lambda b: (s for part in by_bytes([b], "text", BATCH) for s in shingle_sets(part["text"], k)), ["text"]))
        postings = rows.mapInArrow(tidy(_postings(k, percent, counts)), "h long, id long, n int, pos int")
        pivots = (
            postings.groupBy("h").agg(F.min(F.struct("pos", "n", "id")).alias("p"), F.min("id").alias("lo"), F.max("id").alias("hi"))
            .where("lo < hi").select("h", F.col("p.id").alias("p_id"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"))
        )
        return self.scratch.save(postings.join(pivots, "h"))

    def possible(self, n: Column, pos: Column, m: Column, other: Column) -> Column:
        """Length and positional filters for two members of a posted n-gram."""
        p = F.lit(self.percent)
        rest = F.least(n - pos, m - other)
        return (F.least(n, m) * 100 >= F.greatest(n, m) * p) & (rest >= _need(n, m, self.percent))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of candidate pairs (a, b): distinct, through the suffix filter, then verified on full sets."""
        spark = self.rows.sparkSession
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        prof = self.profiles
        x = prof.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("ranges").alias("ra"))
        y = prof.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("ranges").alias("rb"))
        apart = F.aggregate(F.zip_with("ra", "rb", lambda u, v: F.abs(u - v)), F.lit(0), lambda s, v: s + v)
        near = pairs.join(x, "a").join(y, "b").where(apart <= F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), self.percent))
        near = self.scratch.save(near.select("a", "b").distinct())
        ids = self.scratch.save(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct())
        wanted = self.rows.join(_small(ids), "id", "left_semi")
        sets = self.scratch.save(wanted.mapInArrow(tidy(_sets(self.k)), "id long, grams binary"), codec="uncompressed")
        # the side with many partners is the one that is not moved with each pair
        full = (
            near.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
            .select("a", "b", "ga", "gb")
        )
        linked = self.scratch.save(full.mapInArrow(tidy(_verify(self.percent)), "a long, b long").distinct())
        self.scratch.drop(near, ids, sets)
        return linked

    def pivot_pairs(self, members: DataFrame) -> DataFrame:
        fits = self.possible(F.col("n"), F.col("pos"), F.col("p_n"), F.col("p_pos"))
        return members.where((F.col("id") != F.col("p_id")) & fits).select(F.col("p_id").alias("a"), F.col("id").alias("b"))

    def split(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Members of the n-grams whose members are in several components, with ``comp`` and the pivot's ``p_comp``."""
        comp = self.scratch.save(components(found, self.scratch))
        seen = members.select("h", "id", "n", "pos", "p_id", "p_n", "p_pos").join(comp.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        apart = seen.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
        pivot = comp.select(F.col("id").alias("p_id"), F.col("component").alias("p_comp"))
        return self.scratch.save(seen.join(apart, "h", "left_semi").join(pivot, "p_id", "left").withColumn("p_comp", F.coalesce("p_comp", "p_id")))

    def all_links(self, copies: DataFrame, rounds: int = 4) -> DataFrame:
        """Links (a, b) with the components of all links; ``copies`` are ids that take no part."""
        members = self.members(copies)
        found = self.links(self.pivot_pairs(members))
        for k in range(rounds + 1):
            rest = self.split(members, found)
            sizes = rest.groupBy("h").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("comp") != F.col("p_comp")).alias("others"))
            work, held = sizes.agg(F.sum(F.col("all") * F.col("others")), F.sum("all")).first()
            if not work:
                break
            others = rest.where("comp <> p_comp")
            if work <= 20 * held or k == rounds:
                one = others.select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
                two = rest.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), "p_id", "p_comp")
                # pairs with the pivot were tried; of two outsiders only one order is needed
                apart = (F.col("ca") != F.col("cb")) & (F.col("b") != F.col("p_id")) & ((F.col("cb") == F.col("p_comp")) | (F.col("a") < F.col("b")))
                pairs = one.join(two, "h").where(apart & self.possible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"))).select("a", "b")
                found = self.scratch.save(found.union(self.links(pairs)))
                break
            best = others.groupBy("h").agg(F.min(F.struct("pos", "n", "id", "comp")).alias("q"))
            tried = rest.join(best, "h").where((F.col("comp") != F.col("q.comp")) & (F.col("id") != F.col("p_id")))
            tried = tried.where(self.possible(F.col("n"), F.col("pos"), F.col("q.n"), F.col("q.pos"))).select(F.col("q.id").alias("a"), F.col("id").alias("b"))
            found = self.scratch.save(found.union(self.links(tried)))
            members = rest
        return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Reads doc_id and text. A null or empty text, or one of white space, has no
    shingles and no links. Rows that repeat a doc_id are one document to the
    links: each keeps its own n_shingles, all get one component. A row without
    a doc_id takes no part and has no component. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    join = _Join(every.where("id is not null"), k, percent, scratch)
    copies = scratch.save(join.copies())
    links = join.all_links(join.only_copies())
    comp = scratch.save(components(links.union(copies), scratch))
    named = join.profiles.select("id", "n").join(comp, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    none = every.where("id is null").mapInArrow(tidy(_profiles(k)), "id long, n long, s1 long, s2 long, ranges array<int>")
    return named.union(none.select(F.col("id"), F.col("n"), F.lit(None).cast("long")))


def _rest(docs: DataFrame, others: DataFrame) -> DataFrame:
    """``docs`` without those whose doc_id is among ``others``."""
    return docs.join(_small(others), "doc_id", "left_anti").select(docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    """A saved table of distinct ids, to be broadcast if it is counted to be small."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns as they are, with one document of each component: the one of the smallest doc_id.

    Where doc_ids repeat, every different text of an id is a document of its own,
    so that one id never joins texts that are not alike: the first of a component
    by doc_id and the text's sha256 stays, as the row of the smallest hash over
    all columns. Rows without a doc_id, and documents without words, stay.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.where(F.col("doc_id").cast("long").isNotNull())
    if known.groupBy(F.col("doc_id").cast("long")).count().where("count > 1").limit(1).count():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        keyed = known.select(F.col("doc_id").cast("long").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), row.alias("row"))
        once = keyed.groupBy("id", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        rows = numbered(once, F.col("id"), F.col("digest").asc_nulls_first(), place="doc_id", scratch=scratch).rows
        kept = _rest(rows, _others(rows.select("doc_id", "row.text"), k, percent, scratch)).select("row.*")
        return kept.union(docs.where(F.col("doc_id").cast("long").isNull()))
    return _rest(docs, _others(docs, k, percent, scratch))


def _others(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """``doc_id`` of the documents that are not the first of their component."""
    return scratch.save(near_duplicates(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct())


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)
