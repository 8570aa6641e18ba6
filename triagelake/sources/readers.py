"""Typed scans: JSON arrays and wrapped arrays, Parquet, key-value maps and URL parameters.

Every record scan adds ``_ord``, the record's place in its array, by which all
later orders break their ties.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.scalars import query_param
from triagelake.sources import arrays, sinks

WRAPPERS = ("projects", "items", "data")
#: Bytes of a JSON document that one task reads.
SPLIT_BYTES = 32 << 20


def _with_ord(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_ord", T.LongType())])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], _with_ord(schema))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _with_names(schema: T.StructType, names: dict[str, str]) -> T.StructType:
    known = {f.name: f.dataType for f in schema.fields}
    return T.StructType([*schema.fields, *[T.StructField(theirs, known[ours]) for theirs, ours in names.items() if theirs not in known]])


def _own_names(df: DataFrame, schema: T.StructType, names: dict[str, str], *keep: str) -> DataFrame:
    """The schema's fields; one that is not there is taken from the first name in ``names`` that stands for it."""
    out = []
    for f in schema.fields:
        found = [f.name, *[theirs for theirs, ours in names.items() if ours == f.name]]
        there = [F.when(~F.is_variant_null(F.col(f"`{n}`")), F.col(f"`{n}`")) if isinstance(f.dataType, T.VariantType) else F.col(f"`{n}`") for n in found]
        out.append(F.coalesce(*there).alias(f.name))
    return df.select(*out, *keep)


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def parse_records(texts: DataFrame, schema: T.StructType, wrappers: tuple[str, ...] = WRAPPERS, strict: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """Records of JSON documents (column ``value``): the root array, or the first wrapper that is one; otherwise none, or an error if ``strict``.

    ``names`` says which fields of the documents stand for which of the schema's (theirs to ours); without it only the schema's own names count.
    """
    parsed = F.try_parse_json("value")
    arrays = [F.try_variant_get(parsed, p, "array<variant>") for p in ("$", *[f"$.{w}" for w in wrappers])]
    found = F.coalesce(*arrays)
    if strict:
        found = F.coalesce(found, F.raise_error(F.lit("no array of records in the document")).cast("array<variant>"))
    rows = texts.select(F.posexplode(found).alias("_ord", "_v"))
    return records_of(rows, schema, names)


def records_of(rows: DataFrame, schema: T.StructType, names: dict[str, str] | None = None) -> DataFrame:
    """Typed records of VARIANT values ``_v`` with their place ``_ord``; fields of mixed types stay VARIANT."""
    typed = rows.select(F.from_json(F.to_json("_v"), _with_names(schema, names or {})).alias("r"), F.col("_ord").cast("long").alias("_ord"))
    return _own_names(typed.select("r.*", "_ord"), schema, names or {}, "_ord")


def load_records(spark: SparkSession, path: str, schema: T.StructType, wrapped: bool = False, strict: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """A document's records; a missing one has none (an error if ``strict``). ``wrapped`` also accepts wrapper objects.

    A document of up to ``SPLIT_BYTES`` is one row of text; a longer one, or one in parts, is cut into byte ranges and read in many tasks.
    """
    wrappers = WRAPPERS if wrapped or strict else ()
    parts = sinks.current_parts(spark, path)
    if parts is None and not strict and not _exists(spark, path):
        return empty(spark, schema)
    if parts is None and _bytes(spark, path) <= SPLIT_BYTES:
        return parse_records(spark.read.text(path, wholetext=True), schema, wrappers, strict, names)
    found = arrays.elements(spark, parts or path, wrappers)
    return records_of(found.select(F.try_parse_json("value").alias("_v"), "_ord"), schema, names)


def load_lines(spark: SparkSession, path: str, schema: T.StructType, names: dict[str, str] | None = None) -> DataFrame:
    """Large record sets: one JSON record a line, split and pruned by Spark; ``_ord`` is increasing within the files' order. Values are read as in documents."""
    rows = spark.read.schema(_with_names(schema, names or {})).json(path)
    return _own_names(rows, schema, names or {}).withColumn("_ord", F.monotonically_increasing_id())


def load_object(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A one-row table from a JSON object; all nulls where the file is missing."""
    one = spark.range(1)
    if not _exists(spark, path):
        return one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select("r.*")


def load_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Columnar records; filters and columns reach the scan. A missing path with a schema has no rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def load_many(spark: SparkSession, base: str, tables: dict[str, tuple[str, T.StructType]]) -> dict[str, DataFrame]:
    """Several record sets at once; nothing is read before it is needed."""
    return {name: load_records(spark, f"{base}/{file}", schema, wrapped=True) for name, (file, schema) in tables.items()}


def fingerprint(spark: SparkSession, path: str) -> tuple | None:
    """What says whether a document is still the same: name, length and time of its file or of its pointer; None where there is neither."""
    found = []
    for one in (path, f"{path}.d/{sinks.POINTER}"):
        where = spark._jvm.org.apache.hadoop.fs.Path(one)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(where):
            found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where)]
    return tuple(found) or None


class Memo:
    """Keeps each record set as long as its document stays the same; one that failed to load is empty until its document changes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def get(self, path: str, schema: T.StructType, names: dict[str, str] | None = None) -> DataFrame:
        now = fingerprint(self.spark, path)
        before = self.held.get(path)
        if before and before[0] == now:
            return before[1]
        if before:
            before[1].unpersist()
        try:
            rows = load_records(self.spark, path, schema, wrapped=True, names=names).cache()
            rows.count()
        except (PySparkException, Py4JJavaError):
            rows = empty(self.spark, schema)
        self.held[path] = now, rows
        return rows


def kv_entries(texts: DataFrame, value_type: str = "string") -> DataFrame:
    """``key`` and ``value`` of JSON maps (column ``value``); what does not parse has none."""
    # from_json gives a map without entries, or null, for malformed text
    parsed = F.from_json("value", f"map<string,{value_type}>")
    return texts.select(F.explode(F.map_entries(F.coalesce(parsed, F.create_map().cast(f"map<string,{value_type}>")))).alias("e")).select("e.key", "e.value")


def callback_params(urls: DataFrame, names: list[str], url: str = "url") -> DataFrame:
    """``urls`` with the decoded query parameters as columns."""
    return urls.withColumns({n: query_param(url, n) for n in names})
