"""Tables kept under a key of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.plans.store import shared_dir


def content_key(files: DataFrame, settings: Mapping[str, object]) -> str:
    """A digest over every file's path and text, whatever the order of rows, and over settings such as definitions.

    One row of sums leaves the cluster: 128-bit hashes of the files are added up in four parts.
    """
    h = F.sha2(F.concat_ws("\u0001", "path", F.coalesce("text", F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    row = files.agg(F.count(F.lit(1)).alias("n"), *parts).head()
    return hashlib.sha256(json.dumps([[str(x) for x in row], {str(k): str(v) for k, v in sorted(settings.items())}]).encode()).hexdigest()[:32]


def load_or_build(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table of that name and key, and whether it was there. A build that did not end is made again."""
    path = f"{shared_dir(spark)}/cache/{name}/{key}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.parquet(path), True
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


#: Tiers of a walk cache, the most trusted first.
TIERS = ("validated", "preprocessed", "regex")


def put_tier(df: DataFrame, name: str, key: str, tier: str) -> None:
    """Keep ``df`` as one tier of the walk cache under a content key; a tier that is there is replaced."""
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {TIERS}, not {tier}")
    df.write.mode("overwrite").parquet(f"{shared_dir(df.sparkSession)}/cache/{name}/{key}/tier={tier}")


def best_tier(spark: SparkSession, name: str, key: str, *, least: str = "regex") -> tuple[DataFrame | None, str | None]:
    """The rows of the most trusted tier that is there, down to ``least``, with its name; none if the key is not known."""
    for tier in TIERS[: TIERS.index(least) + 1]:
        path = f"{shared_dir(spark)}/cache/{name}/{key}/tier={tier}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(path), tier
    return None, None
