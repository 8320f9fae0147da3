"""Query over personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.pii import BASE_KINDS, detect


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    got = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
