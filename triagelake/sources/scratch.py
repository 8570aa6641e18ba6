"""Written tables in the cluster's shared folder: they cut lineage, and every later reader sees the same rows in the same cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that a query's shuffle files go when it ends, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one, and a cluster an error:
    its executors would not see a folder of the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='triagelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables; ``drop`` frees one as soon as nothing reads it. Frames that were not saved here are left alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/triagelake-{uuid.uuid4().hex}"
        self.held: list[tuple[DataFrame, str]] = []  # the frame itself, since a number of a frame that is gone is given again

    def save(self, df: DataFrame, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
        path, conf = f"{self.base}/{uuid.uuid4().hex[:12]}", self.spark.conf
        before = conf.get(FREE_SHUFFLES, None)
        conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.options(compression=codec, **(options or {})).parquet(path)
        finally:
            conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)
        # the written schema is known, so reading it back starts no inference job
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for path in [p for held, p in self.held if any(held is df for df in frames)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.held = [(h, p) for h, p in self.held if p != path]
