"""Query over language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.common import held_out
from gatelake.llm.language_id import predict, train


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))), text_col="text", label_col="lang", id_col="doc_id")
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
