"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import unit_hash

#: log2 of the number of hashed features; the broadcast matrix has 2**BITS rows and a column per language.
BITS = 16
ORDERS = (1, 2, 3)
#: At most about this many documents, an equal part for each language, are counted for training.
MAX_TRAIN_ROWS = 20_000
#: Additive smoothing of the n-gram counts.
ALPHA = 0.5
UNKNOWN = "und"

#: Texts hashed together; bounds the memory of one step.
STEP_CHARS = 1 << 21

LETTER = re.compile(r"[^\W\d_]")
MULTIPLIER = np.uint32(2654435761)


def feature_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram ids of lower-cased texts, one after another, and where each text starts (n-grams end at its last space)."""
    joined = "".join(f" {t.lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    codes = np.where((codes >= 48) & (codes < 58), np.uint32(48), codes)
    per, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in ORDERS:
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * MULTIPLIER if n > 1 else (codes + np.uint32(1)) * MULTIPLIER
        h = h ^ (h >> np.uint32(15))
        ids = np.full(len(codes), -1, dtype=np.int32)
        ids[: len(h)] = ((h * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int32)
        if n > 1:  # an n-gram may not run into the next text
            for back in range(1, n):
                ids[starts[1:] - back] = -1
        per.append(ids)
    return np.stack(per, axis=1), starts


def _steps(texts: list[str]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > STEP_CHARS:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group


def train(docs: DataFrame, *, text_col: str, label_col: str, id_col: str, max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log prior and log-probability matrix (2**BITS by languages) from labelled rows.

    Rows without text or language are left out. Each language may use an equal part of ``max_rows``; of one with more rows a
    share is drawn by a hash of the identifier, so a rare language is learned whatever the size of the others, and what is
    counted stays bounded while the input grows. Priors are counted over all rows. Other columns, also of clashing names,
    are not read; an empty table gives a model without languages.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = [x for lang, n in sorted(totals.items()) for x in (F.lit(lang), F.lit(max_rows / len(totals) / n))]
    if shares:
        rows = rows.where(unit_hash(F.lit("train"), F.col("id")) < F.try_element_at(F.create_map(*shares), F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(labels):
                own = [t for t, x in zip(texts, labels) if x == lang]
                for group in _steps(own):
                    ids, _ = feature_ids([own[i] for i in group])
                    seen[lang] = seen.get(lang, 0) + np.bincount(ids[ids >= 0], minlength=1 << BITS)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "feature", "n"]
            )

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, feature int, n long")
    got = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()  # languages x 2**BITS rows at most
    langs = sorted(set(got.column("lang").to_pylist()))
    place = {lang: k for k, lang in enumerate(langs)}
    matrix, prior = np.zeros((1 << BITS, len(langs))), np.array([totals[lang] for lang in langs], dtype=float)
    matrix[got.column("feature").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    matrix += ALPHA
    return langs, np.log(np.maximum(prior, 1) / max(prior.sum(), 1)), np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the posterior of that language) for each row of ``docs``.

    A text that is null, empty or has no letter gives ``und`` with score 0, and so does every text if nothing was
    learned. Ties go to the language first in the alphabet. Texts are read whole; repeated rows give repeated results.
    """
    langs, prior, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.vstack([shared.value, np.zeros((1, len(langs)), dtype=np.float32)])  # id -1 adds nothing
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            live = [i for i, t in enumerate(texts) if langs and t and LETTER.search(t)]
            for group in _steps([texts[i] for i in live]):
                ids, starts = feature_ids([texts[live[i]] for i in group])
                logs = np.zeros((len(ids), len(langs)), dtype=np.float32)
                for order in range(len(ORDERS)):
                    logs += weights[ids[:, order]]
                total = np.add.reduceat(logs, starts, axis=0, dtype=np.float64) + prior
                top = total.argmax(axis=1)
                posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, k, p in zip(group, top, posterior):
                    pred[live[i]], best[live[i]] = langs[k], p
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(best, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")
