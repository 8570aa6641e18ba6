"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, and a tree over the groups.

Each level is a window over runs of ``ARITY`` consecutive nodes of a group: the
ordered list of the whole run is the parent's preimage, and what stands in it
before and after a node are that node's siblings. The run's first row becomes
the parent, so a parent is there once. No window holds more than ``ARITY`` rows,
so a group that has a third of all rows is as evenly spread as the others; rows
get their number inside the group by a range sort, not by one task.

Proofs are put together from the top: a level's paths are joined to the level
below by (group, run), where each path meets ``ARITY`` children at most. Texts
are read once, at the scan, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.shared import Scratch, crc32_of, framed, table
from triagelake.operators.ranking import numbered, placed

ARITY = 16
# The fixed order of a document's fields in its leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _runs(nodes: DataFrame) -> DataFrame:
    """Each node of a group that has several, with its run and all digests of the run in order."""
    run = Window.partitionBy("gid", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.where("size > 1").withColumn("run", F.shiftright("idx", 4)).withColumn("all", F.collect_list("h").over(run))


def _parents(nodes: DataFrame) -> DataFrame:
    firsts = _runs(nodes).where(F.col("idx") % ARITY == 0)
    return firsts.select("gid", F.col("run").alias("idx"), F.ceil(F.col("size") / ARITY).cast("long").alias("size"), digest(F.array_join("all", "")).alias("h"))


def climb(nodes: DataFrame, largest: int, scratch: Scratch) -> list[DataFrame]:
    """The levels of every group's tree (gid, idx, size, h), the leaves first; a group ends at the level where its size is 1."""
    levels = [nodes]
    while largest > 1:
        levels.append(scratch.save(_parents(levels[-1])))
        largest = -(-largest // ARITY)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The one node of each group at which its tree ends."""
    out = None
    for level in levels:
        ended = level.where("size = 1").select("gid", "h")
        out = ended if out is None else out.unionByName(ended)
    return out


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves' columns with ``top`` (the digest at which the group ends) and ``path``: for each level upwards what stands before and
    after the node in its run, and then the group's own path of ``above`` (gid, path)."""
    paths = None
    for level in reversed(levels):
        here = level.where("size = 1").join(above, "gid").withColumn("top", F.col("h"))
        if paths is not None:
            at = (F.col("idx") % ARITY).cast("int")
            step = F.struct(F.array_join(F.slice("all", F.lit(1), at), "").alias("before"), F.array_join(F.slice("all", at + 2, F.lit(ARITY)), "").alias("after"))
            up = paths.select("gid", F.col("idx").alias("run"), F.col("top"), F.col("path").alias("_up"))
            several = _runs(level).withColumn("_step", step).drop("all").join(up, ["gid", "run"])
            here = here.unionByName(several.withColumn("path", F.concat(F.array("_step"), "_up")).drop("_step", "_up", "run"))
        paths = here
    return paths


def proof_digest(path: Column) -> Column:
    """Of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.concat(p["before"], h, p["after"])))


def manifest(spark: SparkSession, docs: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, leaf, subroot, root and path, and the columns ``also``, computed at the scan.

    Leaves of a group ascend by key (null first), equal keys by their leaf; repeated rows
    are leaves of their own. Null groups are one group, which comes first. A lone leaf is
    its group's subroot and a lone subroot the root, with an empty path. An empty table has
    no rows. Columns that are not named play no part.
    """
    scratch = Scratch(spark)
    also = also or {}
    leaves = docs.select(
        F.col(group).cast("string").alias("_group"), F.col(key).alias("_key"),
        digest(framed(*[F.col(f) for f in fields])).alias("h"), *[c.alias(n) for n, c in also.items()],
    )
    rows = placed(leaves, ["_group"], F.col("_key").asc_nulls_first(), F.col("h"), collapse=True, scratch=scratch)
    leaves = scratch.save(rows.select(F.col("start").alias("gid"), F.col("place").alias("idx"), "size", "h", F.col("_key").alias(key), *also))
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels = climb(leaves, largest, scratch)
    # the groups' tops are the leaves of one more tree, in the order of the groups
    ends = numbered(tops(levels), "gid", scratch=scratch)
    upper = ends.rows.select(F.lit(0).cast("long").alias("gid"), F.col("place").alias("idx"), F.lit(ends.count).cast("long").alias("size"), "h", F.col("gid").alias("group"))
    above = climb(upper, ends.count, scratch)
    root = above[-1].select("h").first()
    none = spark.range(1).select(F.col("id").alias("gid"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    roads = scratch.save(descend(above, none).select(F.col("group").alias("gid"), "path"))
    done = descend(levels, roads)
    return done.select(key, F.col("h").alias("leaf"), F.col("top").alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"), "path", *also)


def tampered_leaf() -> Column:
    """The leaf of a document whose text's A-Z are lower-cased, where 5 divides the crc32 of its id; otherwise null."""
    changed = F.translate(F.col("text"), UPPER, LOWER)
    return F.when(crc32_of(F.col("doc_id")) % 5 == 0, digest(framed(*[changed if f == "text" else F.col(f) for f in FIELDS])))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by source, and what each row's leaf, tampered where its id says so, folds to."""
    done = manifest(spark, table(spark, sf_dir, "documents"), also={"forged": tampered_leaf()})
    folded = fold(F.coalesce("forged", "leaf"), F.col("path"))
    rows = done.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


# ---- SQL -------------------------------------------------------------------

_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
 lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _framed_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


def _tree(name: str, depth: int) -> str:
    """Levels ``{name}0`` (gid, idx, h) to ``{name}{depth}``; ``{name}s{k}`` has each node's size of group, and what stands before and after it."""
    run = "PARTITION BY gid, idx // 16 ORDER BY idx ROWS BETWEEN"
    out = []
    for k in range(depth):
        out.append(f"""{name}s{k} AS (SELECT gid, idx, h, count(*) OVER (PARTITION BY gid) AS n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
 coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k}),
{name}{k + 1} AS (SELECT gid, idx // 16 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h FROM {name}s{k} GROUP BY gid, idx // 16)""")
    return ",\n".join(out)


def _climb_sql(name: str, depth: int, frm: str, gid: str, at: str) -> str:
    """``frm`` with proof and folded digest carried up through the tree ``name``."""
    out = []
    for k in range(depth):
        out.append(f"""{name}p{k} AS (SELECT d.* EXCLUDE (proof, f), d.proof || s.b || s.a AS proof, CASE WHEN s.n > 1 THEN sha256(s.b || d.f || s.a) ELSE d.f END AS f
 FROM {frm} d JOIN {name}s{k} s ON s.gid = d.{gid} AND s.idx = d.{at} // {16**k})""")
        frm = f"{name}p{k}"
    return ",\n".join(out)


_DOCS, _GROUPS = 6, 4  # enough for 16 million rows a source and 65,536 sources

OP12_SQL = f"""WITH leaves AS (SELECT doc_id, source, {_framed_sql(*FIELDS)} AS h,
 CASE WHEN {_CRC} % 5 = 0 THEN {_framed_sql("doc_id", "source", "lang", "n_chars", f"translate(text, '{UPPER}', '{LOWER}')")} END AS forged FROM documents),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS gid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM leaves),
t0 AS (SELECT gid, idx, h FROM placed),
{_tree("t", _DOCS)},
u0 AS (SELECT 0 AS gid, gid AS idx, h FROM t{_DOCS}),
{_tree("u", _GROUPS)},
start AS (SELECT *, 0 AS zero, '' AS proof, coalesce(forged, h) AS f FROM placed),
{_climb_sql("t", _DOCS, "start", "gid", "idx")},
{_climb_sql("u", _GROUPS, f"tp{_DOCS - 1}", "zero", "gid")}
SELECT d.doc_id, d.h AS leaf, s.h AS subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.f AS folded_root, d.f = r.h AS verified
FROM up{_GROUPS - 1} d JOIN t{_DOCS} s ON s.gid = d.gid, u{_GROUPS} r"""
