"""One JSON array of any size, read in many tasks.

Spark's text source cuts the file into byte ranges and deals out what lies
between commas, in order, from any store that Spark reads. What a comma means
depends on all that stands before it, so two passes are made. The first gives,
for each range, whether it turns the string state around and how it changes the
bracket depth, for either state at its start; from these few numbers the driver
knows the state at every range's start. The second cuts the ranges at the commas
between records. Records are numbered by counts of such commas in the ranges
before, and the few that lie across a range's border are put together by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.sources.scratch import Scratch

_ESCAPE = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"?|[\[\]{},]', re.S)
_REST = re.compile(r'(?:[^"\\]++|\\.)*+', re.S)
_KEY = re.compile(r'"([^"\\]*)"\s*:\s*$')
ROOT = "$"


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep=",").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """Range and text, in order; a range's text may come in several chunks. Each piece but a file's first has its comma before it."""
    now = None
    for batch in batches:
        for key, rows in batch.groupby(["file", "start"], sort=False):
            text = ",".join(rows["value"])
            first = key != now
            yield key, text if first and key[1] == 0 else "," + text
            now = key


def _depth(text: str) -> int:
    return text.count("[") + text.count("{") - text.count("]") - text.count("}")


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, out = None, []
    for key, text in _chunks(batches):
        if key != now:
            out.append([*key, False, 0, 0, text.lstrip()[:1]])
            now = key
        row = out[-1]
        parts = _ESCAPE.sub("", text).split('"')
        even, odd = _depth("".join(parts[::2])), _depth("".join(parts[1::2]))
        if row[2]:
            even, odd = odd, even
        row[3], row[4], row[2] = row[3] + even, row[4] + odd, row[2] ^ (len(parts) % 2 == 0)
    yield pd.DataFrame(out, columns=["file", "start", "turns", "outside", "inside", "first"])


class _Cutter:
    """Cuts one range into fragments of records: (key of the array, ``?`` for the one that the range begins in; commas so far; text; whole)."""

    def __init__(self, inside: bool, depth: int, level: int, wrappers: tuple[str, ...]):
        self.string, self.depth, self.level, self.wrappers = inside, depth, level, wrappers
        self.key = "?" if depth >= level else None
        self.no, self.text, self.begun, self.out, self.opened = 0, [], False, [], []

    def _end(self, whole: bool) -> None:
        text = "".join(self.text)
        if self.key is not None and (text.strip() or not whole):
            self.out.append((self.key, self.no, text, whole and self.begun))
        self.text, self.begun = [], True

    def feed(self, text: str) -> None:
        at = from_ = 0
        if self.string:
            at = _REST.match(text).end()
            if at == len(text):
                self.text.append(text)
                return
            self.string, at = False, at + 1
        for token in _TOKEN.finditer(text, at):
            found, place = token[0], token.start()
            char = found[0]
            if char == '"':
                self.string = len(found) == 1 or found[-1] != '"' or _ESCAPE.sub("", found).count('"') < 2
            elif char in "[{":
                self.depth += 1
                if self.depth == self.level:
                    name = ROOT if self.level == 1 else (m[1] if (m := _KEY.search(text[:place])) else None)
                    self.key = name if char == "[" and (self.level == 1 or name in self.wrappers) else None
                    if self.key is not None:
                        self.opened.append(self.key)
                    else:
                        self.opened.append("")
                    self.no, self.text, self.begun, from_ = 0, [], True, place + 1
            elif char in "]}":
                if self.depth == self.level and self.key is not None:
                    self.text.append(text[from_:place])
                    self._end(True)
                    self.key = None
                    self.opened.append("")
                    from_ = place + 1
                self.depth -= 1
            elif self.depth == self.level and self.key is not None:
                self.text.append(text[from_:place])
                self._end(True)
                self.no, from_ = self.no + 1, place + 1
        if self.key is not None:
            self.text.append(text[from_:])

    def close(self) -> None:
        if self.key is not None and self.text:
            self._end(False)


def _cut(starts: dict, level: int, wrappers: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cutter = None, None

        def frame(done: bool) -> pd.DataFrame:
            if done:
                cutter.close()
            rows = [(*now, key, no, text, whole, None) for key, no, text, whole in cutter.out]
            cutter.out = []
            if done:  # what the range hands to those behind it: the arrays it opened and left, in order, and its commas in the last
                rows.append((*now, None, cutter.no, ",".join(cutter.opened), False, cutter.key or ""))
            return pd.DataFrame(rows, columns=["file", "start", "key", "no", "text", "whole", "left"])

        for key, text in _chunks(batches):
            if key != now:
                if cutter:
                    yield frame(True)
                now, cutter = key, _Cutter(*starts[key], level, wrappers)
            cutter.feed(text)
            if cutter.out:
                yield frame(False)
        if cutter:
            yield frame(True)

    return run


def elements(spark: SparkSession, path: str, wrappers: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """``value`` (JSON text) and ``_ord`` of each element of the document at ``path``: of its root array, or of the first of ``wrappers``
    that is an array in its root object; no rows where there is neither. Runs when called.

    ``path`` may be several files whose contents, in the order of their names, are the document. The document must be well formed: in one
    that is not, what the elements are is not defined. An element has to fit in a row; nothing else does. The driver gets a row for each
    byte range (``spark.sql.files.maxPartitionBytes``).
    """
    scratch = scratch or Scratch(spark)
    raw = _ranges(spark, path)
    effects = sorted(raw.mapInPandas(_effects, "file string, start long, turns boolean, outside int, inside int, first string").collect(), key=lambda r: (r["file"], r["start"]))
    root = next((r["first"] for r in effects if r["first"]), "")
    none = spark.createDataFrame([], "value string, _ord long")
    if root not in ("[", "{") or (root == "{" and not wrappers):
        return none
    starts, inside, depth = {}, False, 0
    for r in effects:
        starts[r["file"], r["start"]] = inside, depth
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["turns"]
    cut = scratch.save(raw.mapInPandas(_cut(starts, 1 if root == "[" else 2, wrappers), "file string, start long, key string, no long, text string, whole boolean, left string"))
    ends = {(r["file"], r["start"]): r for r in cut.where("key is null").collect()}
    opened = [k for place in starts for k in ends[place]["text"].split(",") if k]
    chosen = next((k for k in ([ROOT] if root == "[" else wrappers) if k in opened), None)
    if chosen is None:
        return none
    # in which array each range begins, and how many of its commas lie ahead of the range
    within, ahead, begins = None, 0, []
    for number, place in enumerate(starts):
        begins.append((*place, number, ahead if within == chosen else None))
        end = ends[place]
        if end["left"] == "?":
            ahead += end["no"]
        elif end["text"]:
            within, ahead = (end["left"] or None), end["no"]
    known = spark.createDataFrame(begins, "file string, start long, number int, ahead long")
    rows = cut.where(F.col("key").isin("?", chosen)).join(F.broadcast(known), ["file", "start"])  # a row for each byte range
    rows = rows.where((F.col("key") != "?") | F.col("ahead").isNotNull()).select(
        "number", "text", "whole", (F.col("no") + F.when(F.col("key") == "?", F.col("ahead")).otherwise(0)).alias("_ord")
    )
    joined = rows.where(~F.col("whole")).groupBy("_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "").alias("value"))
    return rows.where("whole").select(F.col("text").alias("value"), "_ord").unionByName(joined.where(F.trim("value") != ""))
