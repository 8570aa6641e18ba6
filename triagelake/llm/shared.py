"""Helpers shared by the training-data operators: written tables in the
cluster's shared folder, input guards, and small hashing pieces."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.sources import scratch


#: Bytes in a batch of rows that goes to Python, where the session sets no fewer: memory in a task must not hang on the length of texts.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 6 << 20


def bound_batches(spark: SparkSession) -> None:
    """Holds from here on in the session, since operators' results are computed later."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


class Scratch(scratch.Scratch):
    """Written tables whose readers hand bounded batches to Python."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        super().__init__(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra columns (whatever their names) play no part."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in types.items()])


def long_id(name: str = "doc_id") -> T.StructField:
    return T.StructField(name, T.LongType())


def framed(*columns) -> "F.Column":
    """The values as one text that no other values give: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def crc32_of(column) -> "F.Column":
    """Unsigned crc32 of a value's text form, as a long."""
    return F.crc32(column.cast("string").cast("binary"))


def crc32_text(value) -> int:
    return zlib.crc32(str(value).encode())
