"""Connected components by contraction: each vertex takes its smallest
neighbour, pointers are followed a few steps, and the graph of the remaining
roots is solved in the same way. Every step is a join or a partial aggregation;
nothing is collected but the emptiness of the remaining edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every vertex of ``edges`` (a, b)."""
    left = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        up = scratch.save(up)
        for _ in range(2):
            further = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = scratch.save(up.join(further, "up").select("a", F.col("top").alias("up")))
            scratch.drop(up)
            up = jumped
        levels.append(up)
        rest = (
            left.join(up.select("a", F.col("up").alias("ua")), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )
        rest = scratch.save(rest)
        scratch.drop(left)
        left = rest
    if not levels:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = levels[0].select(F.col("a").alias("id"), F.col("up").alias("component"))
    for up in levels[1:]:
        out = out.join(up.select(F.col("a").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    return out
