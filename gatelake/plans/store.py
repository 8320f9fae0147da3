"""Materialised tables in the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set where the session names no folder, and only with a local master, whose driver and tasks are one process.
LOCAL_DIR = "/tmp/checkpoints/gatelake"
#: Rows up to which Spark may broadcast a table. The size of its files does not tell: numbers in order and repeated names pack
#: millions of rows into the few MB that Spark takes for small, and the driver has to hold them unpacked.
BROADCAST_ROWS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. On a cluster it has to be set."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
    return LOCAL_DIR


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; it goes when the session's process ends."""
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def keep(df: DataFrame, label: str = "frame") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends, and executors may be lost.

    The files go with ``drop``, or when the session's process ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def counted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that may be broadcast only if it has at most BROADCAST_ROWS rows (``rows``, else they are counted)."""
    return df.hint("merge") if (df.count() if rows is None else rows) > BROADCAST_ROWS else df


def drop(*frames: DataFrame) -> None:
    """Remove the files of kept frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jvm is None or spark.sparkContext._jsc is None:
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
