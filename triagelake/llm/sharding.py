"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global number (its rank by id, then size, then checksum).
A keyed Feistel network over the mixed-radix square ``a * b >= n`` permutes
``0 .. n-1``; a value that falls beyond ``n`` walks on along its cycle until it
is inside again. Shard and slot are the remainder and the quotient of the
permuted number, so they can be computed for any row number without data:
counts differ by at most one and slots have no gaps.

Only built-in expressions are used. The text never moves: size and checksum
are computed at the scan. Equal rows are collapsed to a count before the sort,
so no key can be hot, and are numbered one after another again afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.shared import Scratch, table

ROUNDS = 6
#: Steps of a cycle walk. Fewer than sqrt(n) + 1 of a * b values lie beyond n, so
#: a walk of this length fails with a chance far below 1e-60; it then raises.
WALK = 64


def _round_value(half: Column, key: int, r: Column) -> Column:
    word = F.substring(F.md5(F.concat_ws(":", F.lit(str(key)), r.cast("string"), half.cast("string")).cast("binary")), 1, 12)
    return F.conv(word, 16, 10).cast("long")


def feistel_once(x: Column, a: int, b: int, key: int) -> Column:
    """One pass of the keyed permutation of ``0 .. a*b-1`` (left half below a, right half below b)."""
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])

    def step(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, s.l).otherwise((s.l + _round_value(s.r, key, r)) % F.lit(a)).alias("l"),
            F.when(odd, (s.r + _round_value(s.l, key, r)) % F.lit(b)).otherwise(s.r).alias("r"),
        )

    return F.aggregate(rounds, start, step, lambda s: s.l * F.lit(b) + s.r)


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def permuted(x: Column, n: int, key: int) -> Column:
    """The place of row number ``x`` (0 .. n-1) in the keyed shuffle of n rows."""
    a, b = sides(n)
    inside = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        feistel_once(x, a, b, key),
        lambda at, _: F.when(at < F.lit(n), at).otherwise(feistel_once(at, a, b, key)),
    )
    return F.when(inside < F.lit(n), inside).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(spark: SparkSession, df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``df`` collapsed to its distinct ``keys``, each equal row back again, with ``row_no`` 0 .. n-1
    in the order of the keys (nulls first), and n.

    Global without a single-partition window: a range sort, one count per
    partition (a table as small as the number of partitions), then offsets.
    """
    scratch = Scratch(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # repartitionByRange samples its input; written once, both readers below see the same cut
    ranged = scratch.save(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_same"))
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .select(*keys, "_same", F.spark_partition_id().alias("_part"))
    )
    sums = ranged.groupBy("_part").agg(F.sum("_same").alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    n = int(ranged.agg(F.coalesce(F.sum("_same"), F.lit(0))).first()[0])
    within = Window.partitionBy("_part").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        ranged.withColumn("_first", F.coalesce(F.sum("_same").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition: bounded by a setting, not by data
        .withColumn("_first", F.col("_first") + F.col("_before"))
        .withColumn("row_no", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_same") - 1)))
        .select(*keys, "row_no")
    )
    return numbered, n


#: Key of the shuffle, where none is given.
KEY = 20177


def feistel_shards(spark: SparkSession, docs: DataFrame, shards: int = 40, key: int = KEY) -> DataFrame:
    """Shard and slot of every document, by law ``rows``: shard counts differ by at most one.

    Reads ``doc_id`` and ``text`` only. A null text has 0 bytes and the checksum
    of no bytes; a null doc_id sorts first and is placed like any other; repeated
    rows each get a place of their own; an empty table gives an empty result.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    numbered, n = number_rows(spark, sized, ["doc_id", "size", "text_crc32"])
    placed = numbered.withColumn("_at", permuted(F.col("row_no"), n, key))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(spark, table(spark, sf_dir, "documents"))


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes: each step adds what the eight low bits carry over the polynomial."""
    carried = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        carried.append(c)
    low = "xor(a, b)"
    step = "(a >> 8)"
    for bit, c in enumerate(carried):
        step = f"xor({step}, {c} * (({low} >> {bit}) & 1))"
    spelled = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(0, octet_length(encode(c))), lambda i: ('0x' || substr(hex(encode(c)), 2 * i + 1, 2))::BIGINT)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {spelled}), lambda a, b: {step}))"


def _round_sql(half: str, r: str) -> str:
    return f"('0x' || substr(md5('{KEY}:' || {r} || ':' || {half}), 1, 12))::BIGINT"


#: The rows of ``op10_feistel_shards`` with its ``row_no``: one step of the walk is one round; a value beyond n starts anew.
OP10_SQL = f"""WITH RECURSIVE sized AS (SELECT doc_id::BIGINT AS doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
rows AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM sized),
side AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT count(*) AS n, greatest(floor(sqrt(count(*)))::BIGINT, 1) AS a FROM documents)),
walk AS (SELECT row_no, 0 AS r, row_no // b AS l, row_no % b AS h, n, a, b FROM rows, side
 UNION ALL
 SELECT row_no, CASE WHEN r = {ROUNDS} THEN 0 ELSE r + 1 END,
  CASE WHEN r < {ROUNDS} AND r % 2 = 0 THEN (l + {_round_sql("h", "r")}) % a ELSE l END,
  CASE WHEN r < {ROUNDS} AND r % 2 = 1 THEN (h + {_round_sql("l", "r")}) % b ELSE h END, n, a, b
 FROM walk WHERE r < {ROUNDS} OR l * b + h >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((l * b + h) % 40)::INT AS shard, ((l * b + h) // 40)::BIGINT AS slot, NULL::INT AS grown_shard, row_no
FROM rows JOIN walk USING (row_no) WHERE r = {ROUNDS} AND l * b + h < n"""
