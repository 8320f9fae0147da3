"""Packing token pieces into fixed-length sequences by cutting-stock column generation.

Documents are cut into whole sequences and a rest. Over the histogram of the rests a linear program chooses patterns
(multisets of lengths that fit into one sequence): dynamic programming over the knapsack prices new patterns, the
master is solved by the revised simplex method, and the solution is rounded down. The pieces of each length are ranked,
and a rank decides which copy of which pattern a piece goes to. Rests that rounding leaves are placed best fit first.
"""

from __future__ import annotations

import base64
import hashlib
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm.common import shared_table

#: Pre-tokenisation pattern of the vocabulary; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 0
#: The added token of byte_bpe_50k.json, after its ranks; matched in any text, as its tokeniser does by default.
MARKER = "<|endoftext|>"
#: Ranks of one length are counted in parts, so that no task orders all pieces of a frequent length: one for each PER_PART
#: pieces, and at least PARTS.
PARTS, PER_PART = 64, 1 << 17
#: The simplex method stops within this share of the lower bound, or after so many columns.
GAP = 5e-4
MAX_COLUMNS = 1500
#: Lengths are rounded up to multiples of this many ids in the program; what rounding adds is the padding it may cost.
UNIT = 8

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(ranks: bytes) -> tiktoken.Encoding:
    key = hashlib.md5(ranks).hexdigest()
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding(f"ranks-{key}", pat_str=PATTERN, mergeable_ranks=table, special_tokens={MARKER: len(table)})
    return _encoders[key]


def token_ids(coder: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text. Runs of white space too long for the encoder's own splitter are split here, by the same pattern."""
    try:
        return coder.encode(text, allowed_special={MARKER})
    except ValueError:
        out = []
        for k, part in enumerate(text.split(MARKER)):
            out += [coder.encode_single_token(MARKER)] if k else []
            for m in regex.finditer(PATTERN, part):
                out += coder._encode_single_piece(m[0])
        return out


def tokenize_pieces(docs: DataFrame, vocabulary: str, *, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` token ids (little-endian unsigned 32-bit), each document's ids followed by id 0.

    ``vocabulary`` is a file of byte-level BPE ranks that the driver reads. A null text counts as empty and gives the
    one id 0. Texts are encoded whole, however long. Repeated rows give repeated pieces, other columns (also of clashing
    names) are not read, an empty table gives an empty result.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                ids, starts, lengths, totals, blobs = [], [], [], [], []
                part = batch.slice(first, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = np.array([*token_ids(coder, text or ""), SEPARATOR], dtype="<u4").tobytes()
                    n = len(raw) // 4
                    for a in range(0, n, size):
                        ids.append(doc_id)
                        starts.append(a)
                        lengths.append(min(size, n - a))
                        totals.append(n)
                        blobs.append(raw[4 * a : 4 * (a + size)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def price(duals: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming over ascending ``lengths``."""
    best, taken = np.zeros(size + 1), np.full(size + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - lengths[:k]] + duals[:k]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], taken[c] = value[i], i
    pattern, c = np.zeros(len(lengths), dtype=np.int64), size
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= lengths[taken[c]]
    return float(best[size]), pattern


def generate(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is used in the linear program's solution."""
    m = len(lengths)
    basis = np.diag(size // lengths).astype(float)  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for k in range(MAX_COLUMNS + 1 if m else 0):
        duals = inverse.sum(axis=0)
        worth, pattern = price(duals, lengths, size)
        if worth <= 1 + 1e-9 or 1 / worth >= 1 - GAP:  # the objective divided by ``worth`` bounds the optimum from below
            break
        if k == MAX_COLUMNS:
            warnings.warn(f"column generation stopped after {MAX_COLUMNS} columns, at most {worth - 1:.2%} above the optimum", stacklevel=2)
            break
        d = inverse @ pattern
        ratio = np.full(m, np.inf)
        np.divide(x, d, out=ratio, where=d > 1e-9)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        inverse[out] /= d[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(d[others], inverse[out])
        basis[:, out] = pattern
    return np.rint(basis.T).astype(np.int64), x


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows (units, first rank, ranks, first sequence, pieces a sequence, slot), ordered by units and rank; ``counts`` holds pieces by units.

    Piece number r of a class, in the row with first rank <= r, goes to slot + (r - first) mod pieces of sequence
    first sequence + (r - first) div pieces. The number of rows depends on ``size``, not on how many pieces there are.
    """
    rows, sequence = [], 0
    if n := counts.get(size, 0):
        rows.append((size, 0, n, 0, 1, 0))
        sequence = n
    lengths = np.array(sorted(x for x, n in counts.items() if 0 < x < size and n > 0), dtype=np.int64)
    demand = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    used = np.zeros(len(lengths), dtype=np.int64)
    patterns, times = generate(lengths, demand.astype(float), size)
    for pattern, t in zip(patterns, times):
        full = int(t + 1e-6)
        own = pattern > 0
        if own.any():
            full = min(full, int(((demand - used)[own] // pattern[own]).min()))
        if full <= 0:
            continue
        slot = 0
        for i in np.flatnonzero(own)[::-1]:
            a = int(pattern[i])
            rows.append((int(lengths[i]), int(used[i]), a * full, sequence, a, slot))
            used[i] += a * full
            slot += a
        sequence += full
    # What rounding leaves, less than one sequence for each pattern, is placed best fit, largest first.
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        length = int(lengths[i])
        while used[i] < demand[i]:
            space = next((s for s in range(length, size + 1) if room[s]), None)
            if space is None:
                space, (at, slot) = size, (sequence, 0)
                sequence += 1
            else:
                at, slot = room[space].pop()
            rows.append((length, int(used[i]), 1, at, 1, slot))
            used[i] += 1
            if space > length:
                room[space - length].append((at, slot + 1))
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack_pieces(pieces: DataFrame, *, size: int = 1024, unit: int = UNIT) -> DataFrame:
    """``pieces`` with sequence_id and offset: no two overlap, offsets in a sequence run from 0 without gaps.

    The program sees lengths rounded up to multiples of ``unit``. The driver gets one count for each of these (``size`` /
    ``unit`` at most) and sends back the plan, whose size depends on ``size`` only. Pieces are ranked by doc_id, start and
    ids_crc32; equal rows may change places. Empty input gives an empty result.
    """
    if size % unit:
        raise ValueError(f"size {size} is not a multiple of unit {unit}")
    parts = max(PARTS, math.ceil(pieces.count() / PER_PART))
    rows = pieces.withColumns({"units": F.ceil(F.col("length") / unit).cast("long"), "part": F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int")})
    counted = shared_table(rows.groupBy("units", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    totals = {r["units"]: r["n"] for r in counted.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(plan(totals, size // unit))
    earlier = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("units", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = pieces.columns
    own = F.row_number().over(Window.partitionBy("units", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    # Both sides are dealt by (units, part) already, so the join moves no piece again.
    ranked = rows.withColumn("rank", own.cast("long")).join(before, ["units", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            units, r = get("units"), get("rank")
            own = rows[np.searchsorted(keys, units << 44 | r, side="right") - 1] if len(units) else rows[:0]
            k = r - own[:, 1]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(own[:, 3] + k // own[:, 4]), pa.array(own[:, 5] + k % own[:, 4])], names=[*names, "sequence_id", "slot"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")


def pack_documents(docs: DataFrame, vocabulary: str, *, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32, sequence_id and offset of each piece.

    The ids are hashed where they are made and not shuffled; ``sequences`` joins them again. Null and empty texts are one
    piece of id 0; repeated rows are packed as often as they stand; an empty table gives an empty result.
    """
    made = tokenize_pieces(docs, vocabulary, size=size, id_col=id_col, text_col=text_col)
    return pack_pieces(shared_table(made.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32")), "pieces"), size=size)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, *, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and its token ids (little-endian unsigned 32-bit, without padding) for documents whose doc_id is unique."""
    made = tokenize_pieces(docs, vocabulary, size=size, id_col=id_col, text_col=text_col).select("doc_id", "start", "ids")
    whole = packed.join(made, ["doc_id", "start"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
