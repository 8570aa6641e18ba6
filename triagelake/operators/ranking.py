"""Gapless places over tables of any size.

A ``row_number`` over a whole view sorts it in one task. Here the rows are
range-partitioned by the sort keys, sorted inside the partitions and written
once; a count for each partition (as many numbers as partitions) gives the
offset of every partition's first row, and a row's place is its offset plus its
number inside the partition. The place inside a category is the place among all
rows less the place at which the category begins, so a category that holds a
third of all rows is spread over tasks like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.sources.scratch import Scratch

#: monotonically_increasing_id: the partition's number above these bits, the row's number inside it below.
_ROW_BITS = 33
#: Offsets stand in the plan as one literal, so that many partitions at most.
_LITERAL = 20_000


@dataclass(frozen=True)
class Key:
    """A value that rows are sorted by, and which way; for anything but a plain column.

    A sort works out an expression again at each comparison of rows that tie before it. The
    value of a Key becomes a column first, so it is worked out once a row, and goes after the sort.
    """

    value: Column
    way: Callable[[Column], Column] = Column.asc


def keyed(df: DataFrame, *keys: Key | Column | str) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with a column for each Key among ``keys``, the order that they all say, and the names of those columns."""
    values = {f"_sort{k}": key.value for k, key in enumerate(keys) if isinstance(key, Key)}
    order = [key.way(F.col(f"_sort{k}")) if isinstance(key, Key) else F.col(key) if isinstance(key, str) else key for k, key in enumerate(keys)]
    return df.withColumns(values) if values else df, order, list(values)


@dataclass(frozen=True)
class Numbered:
    rows: DataFrame
    count: int


def _offset(counts: dict[int, int], parts: int) -> Column:
    if parts > _LITERAL:
        raise ValueError(f"more than {_LITERAL} shuffle partitions")
    ahead = [0, *accumulate(counts.get(p, 0) for p in range(parts))][:parts]
    return F.element_at(F.lit(ahead).cast("array<bigint>"), (F.shiftright("_at", _ROW_BITS) + 1).cast("int"))


def numbered(df: DataFrame, *keys: Key | Column | str, place: str = "place", collapse: bool = False, scratch: Scratch | None = None) -> Numbered:
    """``df`` with its gapless place (from 0) in the order of ``keys``, and the number of rows. Runs when called.

    Rows with equal keys lie in one partition and get places in no stated order
    among them, so end the keys with something unique. Where that is not at hand,
    ``collapse`` counts equal rows first and gives each of them its place after
    the sort: any number of equal rows is then one row of the shuffle, and since
    they are equal their order does not matter. Nulls sort as the keys say. An
    empty table has no places.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    names = df.columns
    if collapse:
        df = df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_same"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df, order, made = keyed(df, *keys)
    # the range cut is sampled; written once, the counts and the rows below see the same cut
    ranged = scratch.save(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop(*made))
    part = F.shiftright("_at", _ROW_BITS).cast("int").alias("part")
    inside = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    if not collapse:
        counts = {r["part"]: r["n"] for r in ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
        return Numbered(ranged.withColumn(place, _offset(counts, parts) + inside).drop("_at"), sum(counts.values()))
    counts = {r["part"]: r["n"] for r in ranged.groupBy(part).agg(F.sum("_same").alias("n")).collect()}
    # inside a partition, equal rows count as many times as they were there: a running sum, which reads a partition once
    before = Window.partitionBy(F.shiftright("_at", _ROW_BITS)).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    first = _offset(counts, parts) + F.coalesce(F.sum("_same").over(before), F.lit(0))
    rows = ranged.withColumn("_first", first).withColumn(place, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_same") - 1)))
    return Numbered(rows.select(*[F.col(f"`{c}`") for c in names], place), sum(counts.values()))


def placed(df: DataFrame, within: list[str], *keys: Key | Column | str, place: str = "place", start: str = "start", size: str = "size", collapse: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with each row's place (from 0) inside its group of equal ``within`` columns, in the order of ``keys``.

    ``start`` is the place among all rows at which the group begins (groups
    ascend, nulls first): a number for the group that is never null. ``size`` is
    its number of rows. A null in ``within`` is a group like any other.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = numbered(df, *[F.col(c).asc_nulls_first() for c in within], *keys, place="_all", collapse=collapse, scratch=scratch).rows
    rows = scratch.save(rows) if collapse else rows
    # one row for each group; a small file of them is broadcast by its size, a large one is joined by shuffle
    groups = scratch.save(rows.groupBy(*within).agg(F.min("_all").alias(start), F.count(F.lit(1)).alias(size)))
    names = {c: f"_g{k}" for k, c in enumerate(within)}
    groups = groups.select(*[F.col(c).alias(n) for c, n in names.items()], start, size)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(groups, same, "inner").withColumn(place, F.col("_all") - F.col(start)).drop("_all", *names.values())
