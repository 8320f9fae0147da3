"""Query over the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.license_scan import scan_licenses


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and fuzzy notice labels of every whole document; score is the best span's likeness (1 for a base place)."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    words = F.col("base.word")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("spans.label"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("spans.likeness")), F.lit(0.0))).alias("score"),
        F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["word"], s["words"], s["edits"])).alias("spans"),
    )
