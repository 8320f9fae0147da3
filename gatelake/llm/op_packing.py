"""Query over packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gatelake.llm.packing import pack_documents


def vocabulary() -> str:
    """The ranks of the vocabulary that byte_bpe_50k.json holds; both give the same ids."""
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents, tokenised and packed into sequences of at most 1024 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), size=1024)
