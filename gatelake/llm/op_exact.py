"""Query over exact de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatelake.llm.exact_dedup import exact_dedup


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all whole documents, unchanged; the largest doc_id of a group stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), normalise="none", keep="max")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
