"""I-Match document fingerprints.

Terms are kept if their document frequency lies in a band, the distinct ones are sorted, and the part of them that falls
into each of several randomised sub-lexicons is hashed. Two texts are alike in the share of sub-lexicons that hash equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import partitions, shared_table
from gatelake.llm.shingles import mix, text_chunks, word_hashes

#: Share of documents that a kept term occurs in, at least and at most; and the fewest documents.
BAND = (1.0e-4, 0.05)
MIN_DOCS = 2
#: Terms of the lexicon, 8 bytes each, that are broadcast at most. A term of the band is in BAND[0] of the documents or more,
#: so there are at most 1 / BAND[0] times as many as a document has distinct terms on average, however many documents.
MAX_LEXICON = 1 << 24
#: Sub-lexicons: for each level, one term in 2**level is in a sub-lexicon, and so many sub-lexicons are drawn.
LEVELS = ((2, 12), (4, 16), (6, 24), (8, 32))
#: Distinct terms that a task counts before it hands them on, and terms that it hashes together.
FLUSH, STEP = 1 << 21, 1 << 15

_SHIFT = np.concatenate([np.full(n, 64 - level, dtype=np.uint64) for level, n in LEVELS])
#: One odd multiplier for each sub-lexicon.
_DRAW = np.array([xxhash.xxh64_intdigest(f"sub-lexicon {i}") | 1 for i in range(len(_SHIFT))], dtype=np.uint64)


def distinct_terms(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text, sorted, as 64-bit hashes beside the number of their text.

    Terms are words between ASCII white space, A-Z lower-cased.
    """
    words, first = word_hashes(raw, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    order = np.lexsort((words, text))
    text, words = text[order], words[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    return text[new], words[new]


def document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """term and n: the documents in which each term occurs, for terms of MIN_DOCS or more; a null term has the number of rows.

    Every term of every row is counted. Tasks add up what they read before it is shuffled.
    """

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return terms, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(terms)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))], 0, 0
        out = lambda terms, n: pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])
        for batch in batches:
            rows += batch.num_rows
            for _, _, raw, bounds in text_chunks(batch.column(0)):
                held.append(np.unique(distinct_terms(raw, bounds)[1], return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [added(held)]
                    size = len(held[0][0])
                    if 2 * size > FLUSH:
                        yield out(held[0][0].view(np.int64), held[0][1])
                        held, size = [(held[0][0][:0], held[0][1][:0])], 0
        terms, n = added(held)
        yield out(terms.view(np.int64), n)
        yield out([None], [rows])

    counted = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")).mapInArrow(count, "term long, n long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_DOCS) | F.col("term").isNull())
    return shared_table(counted, "lexicon")


def lexicon(counts: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The terms in the band, as sorted 64-bit hashes."""
    rows = counts.where("term is null").agg(F.sum("n")).head()[0] or 0
    inside = counts.where(F.col("term").isNotNull() & (F.col("n") >= max(MIN_DOCS, band[0] * rows)) & (F.col("n") <= max(MIN_DOCS, band[1] * rows))).select("term")
    n = inside.count()
    if n > MAX_LEXICON:
        raise ValueError(f"{n} terms lie in the band {band}, more than {MAX_LEXICON}: raise its lower end")
    return np.sort(inside.toArrow().column("term").to_numpy().view(np.uint64))


def fingerprints(raw: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A row of 32-bit parts for each text: one for each sub-lexicon, zero where none of its terms occurs, and one for all terms.

    ``known`` is the lexicon. A text without terms in it uses all its terms.
    """
    n = len(bounds) - 1
    text, terms = distinct_terms(raw, bounds)
    kept = known[np.minimum(np.searchsorted(known, terms), len(known) - 1)] == terms if len(known) else np.zeros(len(terms), dtype=bool)
    kept |= ~(np.bincount(text[kept], minlength=n) > 0)[text]
    text, terms = text[kept], terms[kept]
    sums, some = np.zeros((len(_DRAW) + 1, n), dtype=np.uint64), np.zeros((len(_DRAW) + 1, n), dtype=bool)
    for a in range(0, len(terms), STEP):
        own, t = text[a : a + STEP], terms[a : a + STEP]
        value, spread = mix(t ^ np.uint64(0x5851F42D4C957F2D)), t ^ (t >> np.uint64(31))
        for k, (draw, shift) in enumerate(zip(_DRAW, _SHIFT)):
            at = np.flatnonzero((spread * draw) >> shift == 0)
            np.add.at(sums[k], own[at], value[at])
            some[k, own[at]] = True
        np.add.at(sums[-1], own, value)
    # The last part tells texts apart that no sub-lexicon covers.
    some[-1] = True
    parts = (mix(sums + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    return np.where(some, np.maximum(parts, 1), 0).T.astype(np.uint32)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of two tables of parts: the share of equal parts among those not empty in both; 1 for equal rows."""
    same = (x == y).all(axis=1)
    x, y = x[:, :-1], y[:, :-1]
    live, start, best = (x != 0) | (y != 0), 0, np.zeros(len(x))
    for _, n in LEVELS:  # levels whose sub-lexicons hold many terms of these texts say nothing about far likeness
        own = live[:, start : start + n]
        total = own.sum(axis=1)
        share = (own & (x[:, start : start + n] == y[:, start : start + n])).sum(axis=1) / np.maximum(total, 1)
        best = np.where(total >= 4, np.maximum(best, share), best)
        start += n
    return np.where(same, 1.0, best)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, target and edge: rows dealt into blocks of ascending identifiers, sorted; each block ends with the next block's first row, marked edge.

    The texts are shuffled once. The driver sees one identifier for each block, and blocks are as many as partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = rows.select(F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 20 * n)).head()[0] or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)

    @F.arrow_udf("int")
    def block(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(ids.is_valid().to_numpy(zero_copy_only=False), at, 0), pa.int32())

    rows = rows.withColumn("block", block("doc_id"))
    heads = sorted((r["block"], r["n"], r["first"]) for r in rows.groupBy("block").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("n")).collect())
    edges = [(None if nulls else first, heads[i - 1][0]) for i, (_, nulls, first) in enumerate(heads)]
    sent = spark.createDataFrame(edges or [(None, None)], "first long, before int")
    dealt = rows.join(F.broadcast(sent), rows["doc_id"].eqNullSafe(sent["first"]), "left")
    copies = F.array(F.struct(F.col("block").alias("target"), F.lit(0).alias("edge")), F.struct(F.col("before").alias("target"), F.lit(1).alias("edge")))
    dealt = dealt.select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.target", "to.edge").where("target is not null")
    return dealt.repartition(n, "target").sortWithinPartitions("target", "edge", F.col("doc_id").asc_nulls_first(), "text")


OUT = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each whole text, of its edited text and their likeness; the edited text itself stays in ``edited``.

    The edited text has its second half replaced by the start of the next document, in ascending identifier; the last
    document's next is the first. A null text counts as empty; null identifiers come first; rows with one identifier are
    ordered by text. A single row is its own next. Texts are read whole, however long; other columns, also of clashing
    names, are not read. An empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(lexicon(document_counts(docs, text_col), band))  # 8 bytes x MAX_LEXICON at most

    def parts(texts: list[str]) -> np.ndarray:
        got = [fingerprints(raw, bounds, known.value) for _, _, raw, bounds in text_chunks(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()))]
        return np.concatenate(got) if got else np.zeros((0, len(_DRAW) + 1), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: doc_id, text, block, edge, parts
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, texts, blocks, edges = (batch.column(i).slice(at, 1024).to_pylist() for i in range(4))
                own = parts(texts)
                if last is not None:
                    ids, texts, blocks, edges, own = [last[0], *ids], [last[1], *texts], [last[2], *blocks], [last[3], *edges], np.concatenate([last[4], own])
                last = (ids[-1], texts[-1], blocks[-1], edges[-1], own[-1:])
                # Within a block each row is followed by its next document.
                a = np.array([k for k in range(len(ids) - 1) if not edges[k] and blocks[k] == blocks[k + 1]], dtype=np.int64)
                edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in a]
                changed = parts(edited)
                as_bytes = lambda table: pa.array([r.tobytes() for r in table.astype(">u4")], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in a], pa.int64()), pa.array([len(texts[k]) for k in a], pa.int64()), pa.array(edited, pa.string()), as_bytes(own[a]), as_bytes(changed), pa.array(likeness(own[a], changed)), pa.array(likeness(own[a], own[a + 1]))],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(docs, id_col, text_col).mapInArrow(run, OUT)
