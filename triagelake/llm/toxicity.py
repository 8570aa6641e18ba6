"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, turns homoglyphs and digit substitutions into the letters
they stand for (i, l and 1 into one), and everything else into single spaces,
in texts and lexicon alike. Lexicon entries are word beginnings and whole
words; one pass of the automaton finds them all. A hit inside an exception
phrase does not count. The hits' weights are summed, normalised by length and
turned into a probability.

Entries, weights, exception phrases and the calibration are learned from a
bounded sample of labelled rows (SAMPLE rows of each class at most, by hash of
the id); counting over it is a Spark aggregation. Calibration is cross-fitted:
each half of the sample is scored with the other half's lexicon. Scoring reads
every text whole.
"""

from __future__ import annotations

import functools
import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, release, tidy
from triagelake.llm.shared import Scratch, crc32_of, table

#: Labelled rows of each class that the lexicon is learned from, at most.
SAMPLE = 10_000
THRESHOLD = 0.3
#: Characters of a word beginning, from and to.
SHORTEST, LONGEST = 3, 8
#: Toxic sample documents that an entry needs, and its least log-odds.
SUPPORT, ODDS = 3, 1.2
#: Phrases that are harmless whatever they contain, besides those that are learned.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "pond scum")
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


@functools.lru_cache(1)
def _folding() -> np.ndarray:
    """What each code point becomes: a letter, or a space."""
    out = np.full(0x110000, ord(" "), np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        char = chr(c)
        if not char.isalpha() and char not in SUBSTITUTES:
            if unicodedata.category(char) != "Nd" or c < 128:
                continue
            char = str(unicodedata.digit(char))
        if 0xFF00 < c < 0xFF5F or 0x1D400 <= c < 0x1D800:  # full-width and mathematical forms
            char = unicodedata.normalize("NFKC", char)
        char = char.lower()[:1]
        char = HOMOGLYPHS.get(char, SUBSTITUTES.get(char, char))
        out[c] = ord("i" if char == "l" else char)
    return out


def fold(text: str) -> tuple[str, int]:
    """The folded text, with a space before and behind each word, and its number of words."""
    codes = np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), "<u4")
    codes = _folding()[codes]
    space = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    codes = codes[keep]
    return codes.astype("<u4").tobytes().decode("utf-32-le"), max(0, int((codes == 32).sum()) - 1)


@dataclass
class Model:
    """Entries with weights (" abc" a word beginning, " abcde " a word), harmless phrases, calibration."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    beta: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for e, w in self.entries.items():
                a.add_word(e, (len(e), w))
            for e in self.exceptions:
                a.add_word(f" {e} ", (len(e) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """Place and entry of each word that has one (the weightiest, if several fit), outside harmless phrases."""
        found: dict[int, tuple[float, str]] = {}
        harmless: list[tuple[int, int]] = []
        if self.entries or self.exceptions:
            for end, (n, w) in self.automaton().iter(folded):
                at = end - n + 1
                if w is None:
                    harmless.append((at, end))
                elif at not in found or w > found[at][0]:
                    found[at] = w, folded[at : end + 1]
        return [(at, e) for at, (_, e) in found.items() if not any(a <= at < b for a, b in harmless)]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Of the hits' weights: the sum by the root of the length, the sum by its logarithm, the largest.

        An entry that is repeated counts up to twice, so that one word over and over does not outweigh the rest.
        """
        folded, words = fold(text or "")
        uses = Counter(e for _, e in self.hits(folded))
        total = math.fsum(self.entries[e] * (2 - 2.0 ** (1 - n)) for e, n in uses.items())
        return total / math.sqrt(words + 1), total / math.log(words + 2), max((self.entries[e] for e in uses), default=0.0)

    def score(self, text: str | None) -> float:
        b = self.beta
        z = b[0] + sum(x * y for x, y in zip(b[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(folded: str) -> set[str]:
    """All word beginnings and words of a folded text, as entries."""
    out: set[str] = set()
    for w in set(folded.split()):
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
        out.add(f" {w} ")
    return out


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries from (entry, toxic and clean documents): the shortest that lose no odds to what they stand for."""
    odds = {}
    for e, t, c in counts:
        w = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        # a lower bound of the log-odds: few documents weigh little
        w -= 1.5 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= SUPPORT and w >= ODDS:
            odds[e] = w
    chosen: dict[str, float] = {}
    for e in sorted(odds, key=lambda e: (len(e.rstrip()), e[-1] == " ", e)):
        shorter = [chosen[e[:k]] for k in range(SHORTEST + 1, len(e)) if e[:k] in chosen]
        if not shorter or odds[e] > max(shorter) + 0.7:
            chosen[e] = odds[e]
    return chosen


def _half(doc_id: int) -> int:
    return zlib.crc32(b"half:%d" % doc_id) & 1


def _sample(docs: DataFrame, labels: DataFrame, train) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic of the sample; labelled training rows that have a document by class, in all."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(train(F.col("doc_id"))).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(SAMPLE).union(known.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    # 2 * SAMPLE ids at most, whatever the size of the tables; of rows that repeat an id the smallest text counts
    return rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), totals


def _count(batches):
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for doc_id, text, toxic in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
            k = 2 * _half(doc_id) + toxic
            for e in candidates(fold(text)[0]):
                seen.setdefault(e, [0, 0, 0, 0])[k] += 1
    names = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[e][k] for e in names], pa.int64()) for k in range(4))], ["entry", "c0", "t0", "c1", "t1"])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on scaled features, by Newton's method with halved steps."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack((np.ones(len(x)), x / scale))
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1.0] * (x.shape[1] - 1))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + b @ ridge @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        now, part = loss(beta), 1.0
        while part > 1e-6 and loss(beta + part * step) > now:
            part /= 2
        beta = beta + part * step
        if np.abs(part * step).max() < 1e-7:
            break
    return np.concatenate((beta[:1], beta[1:] / scale))


def fit(docs: DataFrame, labels: DataFrame, train=lambda doc_id: F.lit(True)) -> Model:
    """Learns a model from the labelled rows of ``docs`` that ``train`` (a condition on doc_id) admits.

    Without labelled rows of both classes there is no lexicon, and every text
    gets the toxic share of the labels, or a score below 0.05 if there are none.
    """
    scratch = Scratch(docs.sparkSession)
    sample, totals = _sample(docs, labels, train)
    sample = scratch.save(sample)
    counts = (
        sample.mapInArrow(tidy(_count), "entry string, c0 long, t0 long, c1 long, t1 long")
        .groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
        .where(F.col("t0") + F.col("t1") >= SUPPORT).where("4 * (t0 + t1) >= c0 + c1").collect()  # far above what ODDS admits
    )
    sizes = Counter((_half(r[0]), r[1]) for r in sample.select("doc_id", "toxic").collect())
    toxic, clean = sizes[0, 1] + sizes[1, 1], sizes[0, 0] + sizes[1, 0]
    if not toxic or not clean:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return Model({}, (), (math.log(max(share, 0.04) / (1 - min(share, 0.96))), 0.0, 0.0, 0.0))
    phrases = tuple(sorted({fold(e)[0].strip() for e in EXCEPTIONS}))
    entries = choose([(r["entry"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in counts], toxic, clean)
    other = [choose([(r["entry"], r[f"t{h}"], r[f"c{h}"]) for r in counts], sizes[h, 1], sizes[h, 0]) for h in (1, 0)]
    halves = [Model(o, phrases) for o in other]  # a half is scored with the other half's lexicon
    whole = Model(entries, phrases)

    def features(batches):
        for batch in batches:
            ids, texts, labels = (batch[c].to_pylist() for c in ("doc_id", "text", "toxic"))
            rows = [halves[_half(i)].features(t) for i, t in zip(ids, texts, strict=True)]
            around: list[list[str]] = []
            for text in texts:  # a hit's word with the word before it, and with the one behind it
                folded = fold(text)[0]
                near = set()
                for at, _ in whole.hits(folded):
                    end = folded.index(" ", at + 1)
                    if at:
                        near.add(folded[folded.rindex(" ", 0, at) + 1 : end])
                    if end + 1 < len(folded):
                        near.add(folded[at + 1 : folded.index(" ", end + 1)])
                around.append(sorted(near))
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in rows], pa.list_(pa.float64())), pa.array(labels, pa.int32()), pa.array(around, pa.list_(pa.string()))], ["x", "toxic", "near"])

    seen = scratch.save(sample.mapInArrow(tidy(features), "x array<double>, toxic int, near array<string>"))
    learned = seen.select("toxic", F.explode("near").alias("phrase")).groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("c >= 3 and t = 0").collect()
    rows = seen.select("x", "toxic").collect()  # 2 * SAMPLE rows at most
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    weight = np.where(y == 1, totals[1] / toxic, totals[0] / clean)
    beta = _logistic(x, y, weight)
    scratch.drop(sample, seen)
    return Model(entries, tuple(sorted({*phrases, *(r["phrase"] for r in learned)})), tuple(float(b) for b in beta))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id if not given; never text of another name) with ``score``, by ``text`` alone; a null text counts as empty."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_scored"))

    def run(batches):
        one = shared.value.score
        for batch in by_bytes(batches, "_scored", 4 << 20):
            scores = pa.array([one(t) for t in batch["_scored"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), scores], [*keep, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_scored")
    return rows.mapInArrow(tidy(run), f"{types}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below the threshold (a null text counts as empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:  # only the text goes to Python
        one = shared.value.score
        for array in texts:
            yield pa.array([one(t.as_py()) for t in array], pa.float64())
        release()

    return docs.where(scored(F.col("text").cast("string")) < threshold)


def held_out(doc_id):
    return F.coalesce(crc32_of(doc_id) % 4 == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), train=lambda d: ~held_out(d))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
