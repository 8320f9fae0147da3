"""Incremental ingest: a file stream keeps a scanned table up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatelake.operators.scan import patch, scan

_FILES = "path string, text string"


def _versions(spark: SparkSession, table: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest complete version of the scanned table."""
    got = _versions(spark, table)
    return spark.read.parquet(f"{table}/v={got[-1]}") if got else None


def apply_batch(batch: DataFrame, version: int, table: str, defines: dict[str, str] | None = None) -> None:
    """Write version ``version``: rows of the batch's files replaced, the others as they were. Repeating a batch changes nothing."""
    spark = batch.sparkSession
    fresh = scan(batch.select("path", "text"), defines)
    older = [v for v in _versions(spark, table) if v < version]
    base = spark.read.parquet(f"{table}/v={older[-1]}") if older else None
    gone = batch.select("path")
    out = fresh if base is None else patch(base.join(gone, "path", "left_anti"), fresh, gone.where("false"))
    out.write.mode("overwrite").parquet(f"{table}/v={version}")


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, *, defines: dict[str, str] | None = None, once: bool = True) -> StreamingQuery:
    """Follow Parquet files of (path, text) in ``folder``; each micro-batch makes one version of the scanned table.

    Of a path that occurs twice in a batch the longer text counts.
    """
    stream = spark.readStream.schema(_FILES).parquet(folder)

    def put(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("text", F.length("text")).alias("text"))
        apply_batch(last, epoch, table, defines)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()
