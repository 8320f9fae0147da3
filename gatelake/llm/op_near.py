"""Query over near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatelake.llm.near_dedup import near_duplicates


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all whole documents: three words, 85 of 100."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p, q FROM pairs JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
both_ways AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.q FROM reach r JOIN both_ways l ON l.p = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN reach r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
