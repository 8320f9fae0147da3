"""Query over the fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.fingerprint import fingerprint_documents


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every whole document and of its edited text."""
    out = fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    as_text = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("fingerprint").alias("fingerprint"), as_text("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
