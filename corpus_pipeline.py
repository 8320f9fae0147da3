"""Corpus pipeline: quality, exact and near de-duplication, mixing, packing.

Stages take and return the columns of documents, whatever else these are called; only packing returns pieces. Null texts
count as empty ones, texts are read whole, and an empty table gives an empty one from every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.common import fresh, held_out, shared_table
from gatelake.llm.exact_dedup import kept_rows
from gatelake.llm.mixing import SHARE, mix
from gatelake.llm.near_dedup import near_duplicates
from gatelake.llm.op_packing import vocabulary
from gatelake.llm.packing import pack_documents
from gatelake.llm.quality import keep_good, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least one half.

    Empty and null texts are scored like any other, equal texts get equal scores, and repeated rows stay repeated. Without
    labels of both kinds every score is one half, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return keep_good(docs, train(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, the one with the largest doc_id; of rows that repeat an identifier and its text, one.

    Null and empty texts are one group. A null identifier stays only where its whole group has none.
    """
    return kept_rows(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each component of near-duplicates, the smallest doc_id: five words, 80 of 100.

    Documents without words are linked with nothing and stay, and so do rows without an identifier. Rows that repeat an
    identifier that stays all stay.
    """
    stay = near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("stay_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay_id"]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities, SHARE of all tokens.

    Null sources and languages count as empty ones; a text without tokens is drawn like its cell. Rows of one identifier and
    cell are drawn together. A rerun draws the same rows.
    """
    own = fresh(docs, "mix")
    return mix(docs, share=SHARE, out=own).where(F.col(f"{own}.selected")).drop(own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids.

    A null or empty text is the one id 0. Repeated rows are packed as often as they stand; ties between equal pieces may go
    either way.
    """
    return pack_documents(docs, vocabulary(), size=1024)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: The quality stage fits a model, and packing needs a tokeniser; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_table(docs, f"pipeline_{name}")
    return docs
