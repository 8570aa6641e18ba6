"""Counts for summaries: each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scalars import digits_only
from triagelake.functions.semantics import eq_true, not_false, or_empty, truthy


def grade_counts(df: DataFrame, grade: str | Column = "grade") -> DataFrame:
    g = F.col(grade) if isinstance(grade, str) else grade
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(g == "S").alias("s"), F.count_if(g == "A").alias("a"), F.count_if(g.isin("B", "C")).alias("bc"))


def region_overlap(df: DataFrame, text: str | Column, first: str = "서울", second: str = "경기") -> DataFrame:
    """Rows, rows that contain either of two words (both count in both), and the rest, never below zero."""
    t = or_empty(text)
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(t.contains(first)).alias("first"), F.count_if(t.contains(second)).alias("second"))
    return out.withColumn("rest", F.greatest(F.col("total") - F.col("first") - F.col("second"), F.lit(0)))


def category_counts(df: DataFrame, category: Column, excluded: Column, categories: list[str]) -> DataFrame:
    """Shown rows of each category (zeros kept) and all excluded ones, in one pass."""
    shown = ~eq_true(excluded)
    return df.agg(*[F.count_if((category == c) & shown).alias(c) for c in categories], F.count_if(eq_true(excluded)).alias("excluded"))


def target_counts(df: DataFrame) -> DataFrame:
    on = df.where(not_false("enabled"))
    group = truthy("regionGroupLabel", "regionGroup", default="미분류")
    return on.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("priority") == str(k)).alias(f"priority_{k}") for k in (1, 2, 3)],
        F.countDistinct(group).alias("region_groups"),
    )


def facet_values(df: DataFrame, value: Column, fixed: list[tuple[str, str]], prefix: str) -> DataFrame:
    """Fixed facets first, then the distinct values by first appearance: label, value, place."""
    spark = df.sparkSession
    base = spark.createDataFrame([(0, i, label, v) for i, (label, v) in enumerate(fixed)], "section int, at long, label string, value string")
    seen = df.groupBy(value.alias("label")).agg(F.min("_ord").alias("at")).select(F.lit(1).alias("section"), "at", "label", F.concat(F.lit(prefix), "label").alias("value"))
    return base.unionByName(seen).orderBy("section", "at")


def histogram(df: DataFrame, value: Column, domain: list[str]) -> DataFrame:
    """Rows by value over a fixed domain; values without rows are zero, values beyond it are left out."""
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    full = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    return full.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def counter(meta: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """A declared counter, else the number of rows."""
    return meta.select(name).limit(1).unionByName(rows.sparkSession.createDataFrame([(None,)], f"{name} int")).agg(F.max(name).alias("declared")).join(
        rows.agg(F.count(F.lit(1)).alias("held")), how="inner", on=F.lit(True)
    ).select(F.coalesce("declared", "held").cast("long").alias(name))


def shown_count(text: str | Column) -> Column:
    """The number in a displayed count."""
    return digits_only(text)
