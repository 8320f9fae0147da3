"""Quality classifier: Bradley-Terry pairwise ranking.

Document scores are linear in features of the text. Preference pairs (a document marked good over one marked bad) give
the weights by logistic loss on feature differences; the decision is a threshold at a quantile of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import unit_hash
from gatelake.llm.shingles import CHUNK, SPACE, mix, span_hashes, text_chunks, word_spans

#: At most about this many labelled rows, drawn by a hash of their identifier, are used for training.
MAX_TRAIN_ROWS = 20_000
#: Good documents that each bad one is paired with.
PARTNERS = 24
RIDGE = 1e-3
STEPS = 60

FEATURES = (
    "log_words", "word_length", "long_words", "symbol_share", "symbol_words", "bang_words", "pipe_share", "upper_share", "digit_share", "punct_share",
    "repeat_next", "distinct_share", "distinct_500", "top_word", "repeat_lines", "worst_line_symbols", "worst_line_upper", "worst_line_repeat", "bad_lines", "short_words", "words_a_line", "empty",
)

def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = (_bytes("".join(map(chr, range(a, b)))) for a, b in ((65, 91), (97, 123), (48, 58)))
_PUNCT = _bytes(".,;:!?'\"()-")
_MARK = _bytes("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())) & ~_PUNCT
#: Bytes that begin a character that is no white space.
_CHAR = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
_LINE = _bytes("\n")
_SYMBOL = _bytes("%&$#*|<>{}[]\\^~=_@+/`")


def feature_table(texts: pa.Array) -> np.ndarray:
    """A row for each text, a column for each name in FEATURES; all zero but ``empty`` for a text without words.

    Texts are read whole, in numpy over the bytes of as many texts as fit a chunk. Words stand between ASCII white space and
    are compared whatever the case of A-Z; a null text counts as empty.
    """
    parts = [_features(raw, bounds) for _, _, raw, bounds in text_chunks(texts, CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    starts, ends, first = word_spans(raw, bounds)
    count = np.diff(first)
    out = np.zeros((n, len(FEATURES)))
    out[:, -1] = count == 0
    if not len(starts):
        return out
    text = np.repeat(np.arange(n), count)
    by_text = lambda values: np.bincount(text, weights=values, minlength=n)
    # From the start of a word to the next one's; what is counted is not white space, but for the line ends.
    within = lambda table: np.add.reduceat(table[raw], starts, dtype=np.int64)
    chars, marks, upper, symbol = within(_CHAR), within(_MARK), within(_UPPER), within(_SYMBOL)
    last, some = raw[ends - 1], np.maximum(count, 1)
    upper = (chars > 1) & (upper > 0) & (within(_LOWER) == 0)
    hashes = span_hashes(raw, starts, ends)
    # Lines: runs of words with no line end between them.
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (within(_LINE)[:-1] > 0) | (text[1:] != text[:-1])
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    line_at = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    of, words = text[line_at], np.diff(np.append(line_at, len(starts)))
    share = lambda mask: np.add.reduceat(mask.astype(np.float64), line_at) / words
    symbols, uppers, repeats = share(_SYMBOL[last]), share(upper), share(again & ~new)
    lines = np.maximum(np.bincount(of, minlength=n), 1)
    place = (np.arange(len(starts)) - line_at[line]).astype(np.uint64)
    whole = np.add.reduceat(mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)), line_at)
    worst = lambda values: _most(of, np.where(words >= 8, values, 0.0), n)
    # Equal words of a text stand together in this order.
    order = np.lexsort((hashes, text))
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.flatnonzero(edge)
    kind, times = text[order][at], np.diff(np.append(at, len(order)))
    early = np.minimum.reduceat((np.arange(len(starts)) - first[text])[order], at) < 500
    solid = np.maximum(1, by_text(ends - starts))
    got = {
        "log_words": np.log1p(count), "word_length": by_text(chars) / some, "long_words": by_text(chars > 12) / some, "symbol_share": by_text(marks) / solid,
        "symbol_words": by_text(symbol > 0) / some, "bang_words": by_text(last == 33) / some, "pipe_share": by_text((last == 124) & (ends - starts == 1)) / some,
        "upper_share": by_text(upper) / some, "digit_share": by_text(within(_DIGIT)) / solid, "punct_share": by_text(within(_PUNCT)) / solid, "repeat_next": by_text(again) / some,
        "distinct_share": np.bincount(kind, minlength=n) / some, "distinct_500": np.bincount(kind[early], minlength=n) / np.clip(count, 1, 500), "top_word": _most(kind, times, n) / some,
        "repeat_lines": 1 - _distinct(of, whole, n) / lines, "worst_line_symbols": worst(symbols), "worst_line_upper": worst(uppers), "worst_line_repeat": worst(repeats),
        "bad_lines": np.bincount(of, weights=((symbols > 0.3) | (uppers > 0.5) | (repeats > 0.3)) * words, minlength=n) / some, "short_words": by_text(chars <= 3) / some,
        "words_a_line": np.minimum(100.0, count / lines) / 100,
    }
    for k, name in enumerate(FEATURES[:-1]):
        out[:, k] = np.where(count > 0, got[name], 0.0)
    return out


def _most(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, group, values)
    return out


def _distinct(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n)


def with_features(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """``columns`` of ``docs`` beside ``features``, an array in the order of FEATURES; a null text counts as empty."""
    kept = docs.select(*columns, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_table(batch.column(batch.num_columns - 1))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(x), pa.list_(pa.float64()))], names=[*columns, "features"])

    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)
    return kept.mapInArrow(run, f"{kinds}, features array<double>")


def fit_pairs(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Means, scales, weights, threshold and spread. Newton steps on the mean logistic loss of the pairs' differences.

    The threshold is the quantile of the training scores that leaves the fewest training rows on the wrong side.
    Without both kinds of rows the weights are 0 and every score is one half.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    w = np.zeros(x.shape[1])
    if not len(up) or not len(down):
        return mean, scale, w, 0.0, 1.0
    rng = np.random.default_rng(7)
    pairs = rng.choice(len(up), size=(len(down), PARTNERS))
    diff = (z[up][pairs] - z[down][:, None, :]).reshape(-1, x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + RIDGE * np.eye(len(w)), diff.T @ p / len(diff) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate(([0], np.cumsum(np.where(good[order] == 1, 1, -1)))) + len(down)  # rows below the cut are called bad
    cut = int(np.argmin(wrong))
    quantile = cut / len(s)
    return mean, scale, w, float(np.quantile(s, min(1.0, max(0.0, quantile - 0.5 / len(s))))), max(float(s.std()), 1e-9)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> tuple:
    """A model from the labelled rows; of more than ``max_rows`` labelled identifiers a share is drawn by hash.

    Null labels and identifiers are left out; of several labels of one identifier the mean counts, and a tie is good. A
    null text is an empty one. Rows that repeat an identifier all count. Without good or without bad rows, as in an empty
    table, the model scores every text one half. Other columns, also of clashing names, are not read.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__good"))
    share = max_rows / max(marks.count(), 1)
    marks = marks.where(unit_hash(F.lit("quality"), F.col("__id")) < share)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body")).join(F.broadcast(marks), "__id")
    got = with_features(rows, ["__id", "__good"], "__body").toArrow()  # max_rows short rows
    order = np.argsort(got.column("__id").to_numpy(zero_copy_only=False), kind="stable")
    x = np.array(got.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))[order]
    return fit_pairs(x, np.array(got.column("__good").to_pylist(), dtype=np.int64)[order] if len(order) else np.zeros(0))


def score_documents(docs: DataFrame, model: tuple, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1; at least one half: as good as the rows above the threshold) per row; empty texts too.

    Texts are read whole. Repeated rows give repeated results, an empty table an empty result.
    """
    mean, scale, weights, threshold, spread = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_table(batch.column(1))
            s = np.clip((x - mean) / scale, -8, 8) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip((s - threshold) / spread * 4, -50, 50))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple, *, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``at_least``, with all their columns; nothing is shuffled.

    Null and empty texts are scored as empty ones; equal texts, so repeated rows, get equal scores; an empty table stays
    empty. Columns are passed on by place, so their names do not matter.
    """
    mean, scale, weights, threshold, spread = model
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_table(batch.column(at))
            s = np.clip((x - mean) / scale, -8, 8) @ weights
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip((s - threshold) / spread * 4, -50, 50))) >= at_least))

    return docs.mapInArrow(run, docs.schema)
