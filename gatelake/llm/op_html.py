"""Query over main-text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.html_text import extract


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
