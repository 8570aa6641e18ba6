"""Lookups: first match by a normalised key, keyed state, and preferred order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.semantics import compact, truthy
from triagelake.operators.ranking import Key, keyed, numbered


_NO_KEY = hashlib.sha256(b"").digest()


def key_digest(key: Column) -> Column:
    """32 bytes that stand for a key's text (sha256: equal digests are taken for equal texts). It is never null, so that no
    filter on it is made, by which the key would be worked out a second time for each row."""
    return F.coalesce(F.unhex(F.sha2(key.cast("binary"), 256)), F.lit(bytearray(_NO_KEY)))


def first_by(df: DataFrame, key: Column, columns: list[str], order: str = "_ord") -> DataFrame:
    """``_key`` (digest) and ``columns`` of the first row, by ``order``, of each key that is not empty.

    ``order`` has to be unique, as a scan's ``_ord`` is. Only digests and orders go through the
    aggregation, which combines before the shuffle, so neither a long text nor a frequent key is
    heavy; the columns are fetched by order for the one row of each key.
    """
    firsts = df.select(key_digest(key).alias("_key"), F.col(order).alias("_at")).groupBy("_key").agg(F.min(F.when(F.col("_key") != F.lit(bytearray(_NO_KEY)), F.col("_at"))).alias("_at"))
    if set(columns) <= {order}:
        return firsts.select("_key", *[F.col("_at").alias(c) for c in columns])
    rows = df.select(F.col(order).alias("_at"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    return firsts.join(rows, "_at").select("_key", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def lookup_first(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, columns: dict[str, str]) -> DataFrame:
    """``left`` with columns of the first right row of an equal compacted key; nulls where there is none or the key is empty."""
    found = first_by(right, compact(right_key), list(columns))
    found = found.select("_key", *[F.col(c).alias(f"_f{i}") for i, c in enumerate(columns)])
    keyed = left.withColumn("_key", key_digest(compact(left_key)))
    return keyed.join(found, "_key", "left").select(*left.columns, *[F.col(f"_f{i}").alias(alias) for i, alias in enumerate(columns.values())])


def title_key(*names: str) -> Column:
    return truthy(*names)


def with_review(df: DataFrame, reviews: DataFrame, key: Column) -> DataFrame:
    """``review_key`` and ``review_status`` (``new`` where none is stored)."""
    kv = reviews.select(F.col("review_key"), F.col("status").alias("_status"))
    return df.withColumn("review_key", key).join(kv, "review_key", "left").withColumn("review_status", truthy("_status", default="new")).drop("_status")


def with_memo(df: DataFrame, memos: DataFrame, panel: str, title: Column) -> DataFrame:
    """``card_key`` (panel and title) and its memo, empty where there is none."""
    keyed = df.withColumn("card_key", F.concat(F.lit(panel + "-"), truthy(F.trim(title), default="untitled")))
    return keyed.join(memos.select("card_key", F.col("memo").alias("_memo")), "card_key", "left").withColumn("memo", F.coalesce("_memo", F.lit(""))).drop("_memo")


def with_registered(df: DataFrame, registered: DataFrame, key: Column) -> DataFrame:
    """``research_id`` with the stored state as a struct ``registered`` (null where there is none)."""
    kv = registered.select("research_id", F.struct(*[c for c in registered.columns if c != "research_id"]).alias("registered"))
    return df.withColumn("research_id", key).join(kv, "research_id", "left")


def _section(value: str, preferred: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(value))
    return (F.coalesce(F.nullif(at, F.lit(0)), F.lit(len(preferred) + 1)) - 1).cast("bigint")


def by_preference(df: DataFrame, value: str, preferred: list[str]) -> DataFrame:
    """Rows of preferred values in that order, the others behind them in their own."""
    rows, order, made = keyed(df, Key(_section(value, preferred)), "_ord")
    return rows.orderBy(*order).drop(*made)


def placed_by_preference(df: DataFrame, value: str, preferred: list[str]) -> DataFrame:
    """The same order as columns: ``section`` (which preferred value, from 0; the others' is last) and ``place`` among all rows, from 1."""
    rows = numbered(df.withColumn("section", _section(value, preferred)), F.col("section"), F.col("_ord")).rows
    return rows.withColumn("place", F.col("place") + 1)


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a window with a rank limit that Spark applies before the shuffle too."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
