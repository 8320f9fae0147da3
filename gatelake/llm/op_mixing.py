"""Query over mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.mixing import SHARE, mix


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document's weight and probability under tempered source, language and topic marginals, and the draw of SHARE of all tokens."""
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), share=SHARE)
    return got.select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", F.round("mix.weight", 9).alias("weight"), F.round("mix.probability", 9).alias("probability"), "mix.selected")
