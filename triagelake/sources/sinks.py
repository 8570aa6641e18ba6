"""Writers: records as JSON lines or as one document, key-value maps, and the run's summary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.ranking import numbered
from triagelake.sources.scratch import Scratch

#: Records in a part of a document.
PART = 10_000
POINTER = "CURRENT"


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record a line, in parallel; for record sets of any size."""
    df.drop("_ord").write.mode("overwrite").json(path)


def document_lines(rows: DataFrame, count: int, wrapper: str | None = None) -> DataFrame:
    """``place`` and ``value``: the lines of one JSON document that holds all records, an array or an object with it, each record on its own line."""
    names = [c for c in rows.columns if c not in ("_ord", "place")]
    head, tail = ("[", "]") if wrapper is None else ('{"%s": [' % wrapper, "]}")
    if not count:
        return rows.sparkSession.createDataFrame([(0, head + tail)], "place long, value string")
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    before = F.when(F.col("place") == 0, F.lit(head + "\n")).otherwise("")
    after = F.when(F.col("place") == count - 1, F.lit("\n" + tail)).otherwise(",")
    return rows.select("place", F.concat(before, record, after).alias("value"))


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _move_over(spark: SparkSession, source: str, target: str) -> None:
    """Renames onto ``target`` in one step: a reader finds the old file or the new one."""
    fs, src = _fs(spark, source)
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(src), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target)), options)


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    aside = f"{path}.d/{POINTER}-{uuid.uuid4().hex[:8]}"
    fs, where = _fs(spark, aside)
    out = fs.create(where, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    _move_over(spark, aside, f"{path}.d/{POINTER}")


def current_parts(spark: SparkSession, path: str) -> str | None:
    """The parts of the document's committed version, if it is kept in versions."""
    pointer = f"{path}.d/{POINTER}"
    fs, where = _fs(spark, pointer)
    if not fs.exists(where):
        return None
    version = spark.read.text(pointer, wholetext=True).first()[0].strip()
    return f"{path}.d/{version}/part-*"


def publish(df: DataFrame, path: str, wrapper: str | None = None) -> DataFrame:
    """Replaces the document at ``path`` by the records of ``df``, in the order of ``_ord``, and returns the records as written.

    The records are written to the shared folder first, so ``df`` may read the very document
    that it replaces, and nothing of it is worked out twice. The new document is made in
    ordered parts, in parallel. One of a single part takes the file's place by one rename; one
    of several parts is a version under ``path.d`` to which a pointer is then moved by one
    rename, and from then on the pointer says what the document is. A run that stops at any
    moment leaves the old document or the new one. Older versions are left to be removed.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    done = numbered(df, F.col("_ord").asc_nulls_first(), scratch=scratch)
    lines = document_lines(done.rows, done.count, wrapper)
    parts = max(1, -(-done.count // PART))
    version = f"v-{uuid.uuid4().hex[:12]}"
    lines.repartitionByRange(parts, "place").sortWithinPartitions("place").select("value").write.text(f"{path}.d/{version}", lineSep="\n")
    fs, pointer = _fs(spark, f"{path}.d/{POINTER}")
    if parts == 1 and not fs.exists(pointer):
        made = [s.getPath().toString() for s in fs.listStatus(_fs(spark, f"{path}.d/{version}")[1]) if s.getPath().getName().startswith("part-") and s.getLen()]
        _move_over(spark, made[0], path)
        fs.delete(_fs(spark, f"{path}.d/{version}")[1], True)
    else:
        _point_to(spark, path, version)
    return done.rows.drop("place")


def wrapped_document(df: DataFrame, wrapper: str | None = None) -> DataFrame:
    """The whole (small) record set as one JSON document in a row, in the order of ``_ord``; for text that is shown or copied. ``publish`` is for files."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct("_ord", F.to_json(F.struct(*[c for c in df.columns if c != "_ord"]), {"ignoreNullFields": "false"}).alias("r")))).alias("rows"))
    body = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["r"]), ","), F.lit("]"))
    return rows.select((body if wrapper is None else F.concat(F.lit('{"%s":' % wrapper), body, F.lit("}"))).alias("value"))


def kv_document(entries: DataFrame) -> DataFrame:
    """Key-value rows as one JSON map."""
    return entries.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("value"))


def batch_summary(df: DataFrame) -> DataFrame:
    """Records and their confidence, one row a level; levels without records show zero, unknown ones do not show, none is LOW."""
    from triagelake.operators.summary import histogram

    return histogram(df, F.coalesce("dateConfidence", F.lit("LOW")), ["HIGH", "MEDIUM", "LOW"])
