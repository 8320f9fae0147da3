"""Near-duplicate detection by min-max hashing.

Under each of ``PERMUTATIONS`` hash functions a document keeps both the smallest and the largest value of its shingles, so
a signature of 2 * PERMUTATIONS values costs half the hash evaluations. Bands of the signature give buckets, buckets that
share a document give families, and inside families links are confirmed on the full shingle sets:

* documents with equal sets are one class from the start, so copies cost one row;
* a family of at most ``SMALL`` classes is settled in one task, comparing only classes that are not yet connected;
* a larger family is never gathered. A class with so many shingles of its own that no partner can reach the similarity is
  out; the class closest to the shingles that most of the family has is compared with all others; only what is not settled
  then is compared with the rest, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm.common import partitions, shared_table
from gatelake.llm.shingles import shingle_sets
from gatelake.plans.components import connected_components

PERMUTATIONS = 64
#: 25 bands of 5 of the 128 values: a pair at 0.85 shares no band with probability 4e-7, one at 0.8 with 5e-5.
BANDS, ROWS = 25, 5
#: Classes of a family that one task settles, and the blocks of larger ones.
SMALL, LEFT, RIGHT = 400, 128, 1024
#: A family with more than 1 / (SPREAD * partitions) of all members is kept out of shuffles by family.
SPREAD = 4

_rng = np.random.default_rng(64128)
_MULTIPLY = _rng.integers(1, 1 << 63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, size=PERMUTATIONS, dtype=np.uint64)
_ORDER = _rng.permutation(2 * PERMUTATIONS)[: BANDS * ROWS].reshape(BANDS, ROWS)
_BAND = (_rng.integers(1, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest values under each permutation, then largest ones."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for a in range(0, len(shingles), 4096):
        h = _MULTIPLY[:, None] * shingles[None, a : a + 4096] + _ADD[:, None]
        low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    h = ((values[_ORDER] >> np.uint64(17)) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _BAND[:, 0]
    return h ^ (h >> np.uint64(29))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for s in shingle_sets(batch.column(1), width):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """node, family and sorted shingles from node, family and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.astype(np.int64) for s in shingle_sets(batch.column(2), width)], pa.list_(pa.int64()))], ["node", "family", "shingles"])

    return rows.mapInArrow(run, "node long, family long, shingles array<long>")


def links_among(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Enough of the pairs with 100 * shared >= percent * union to connect what all such pairs connect.

    With ``left``, only pairs of which one side is marked are compared. Sets are sorted and distinct.
    """
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    # Local numbers of the shingles, and for each of them the sets that hold it.
    flat = np.concatenate(sets) if n else np.zeros(0)
    _, codes = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by_code = np.argsort(codes, kind="stable")
    holders, first = owner[by_code], np.searchsorted(codes[by_code], np.arange(int(codes.max()) + 2 if len(codes) else 1))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(n):
        if left is not None and not left[i]:
            continue
        mine = codes[starts[i] : starts[i + 1]]
        length = first[mine + 1] - first[mine]
        shift = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        shared = np.bincount(holders[np.arange(len(shift)) + shift], minlength=n)
        hit = 100 * shared >= percent * (sizes + sizes[i] - shared)
        for j in np.flatnonzero(hit & (sizes > 0)):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _settle(table: pa.Table, percent: int) -> pa.Table:
    """Links of one group of node and shingles; rows marked ``left`` are compared with all, or all if there is no mark."""
    table = table.combine_chunks().sort_by("node")
    ids = table.column("node").to_numpy()
    shingles = table.column("shingles").combine_chunks()
    shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
    sets = [np.asarray(shingles[i].values) for i in range(len(ids))]
    left = table.column("left").to_numpy().astype(bool) if "left" in table.column_names else None
    got = links_among(sets, percent, left)
    return pa.table({"a": pa.array([ids[i] for i, _ in got], pa.int64()), "b": pa.array([ids[j] for _, j in got], pa.int64())})


def _large_links(members: DataFrame, percent: int) -> DataFrame:
    """Links of families too large for one task. ``members`` holds node, family, shingles and may be read several times."""
    t = percent / 100
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("total"), F.min(F.size("shingles")).alias("smallest"))
    flat = members.join(sizes, "family").select("family", "node", "total", "smallest", F.explode("shingles").alias("shingle"))
    seen = members.select("family", F.explode("shingles").alias("shingle")).groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("df"))
    # AQE may split a shingle that the whole family shares.
    per = flat.join(seen, ["family", "shingle"]).groupBy("family", "node").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("df") == 1).alias("own"), F.count_if(2 * F.col("df") >= F.col("total")).alias("common"), F.first("smallest").alias("smallest")
    )
    # At most size - own shingles are shared, and a partner has at least ``smallest`` of them.
    most = F.col("size") - F.col("own")
    per = per.withColumn("open", most >= t * F.greatest(F.col("size"), F.col("smallest") + F.col("own")))
    per = shared_table(per.join(members.select("node", "shingles"), "node"), "near_large")
    alive = per.where("open")
    centre = alive.groupBy("family").agg(F.max_by("node", F.struct(F.col("common") - F.col("size") / 4, -F.col("node"))).alias("centre"), F.count(F.lit(1)).alias("alive"))
    centre = centre.join(alive.select(F.col("node").alias("centre"), F.col("shingles").alias("middle")), "centre")
    shared = F.size(F.array_intersect("shingles", "middle"))
    near = alive.join(centre, "family").select("family", "node", "centre", "alive", "shingles", (100 * shared >= percent * (F.size("shingles") + F.size("middle") - shared)).alias("linked"))
    near = shared_table(near, "near_centre")
    star = near.where("linked and node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    rest = near.where("not linked").groupBy("family").agg(F.count(F.lit(1)).alias("lefts"))
    near = near.join(rest, "family")
    part = lambda n, size: F.pmod(F.xxhash64("node", F.lit(size)), F.ceil(F.col(n) / size)).cast("int")
    every = lambda n, size: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / size) - 1).cast("int")))
    lefts = near.where("not linked").select("family", "node", "shingles", F.lit(True).alias("left"), part("lefts", LEFT).alias("l"), every("alive", RIGHT).alias("r"))
    # A pair of two lefts is compared where one of them is on the right.
    rights = near.select("family", "node", "shingles", F.lit(False).alias("left"), every("lefts", LEFT).alias("l"), part("alive", RIGHT).alias("r"))
    blocks = lefts.union(rights).groupBy("family", "l", "r").applyInArrow(lambda t: _settle(t, percent), "a long, b long")
    return star.union(blocks)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Shingles are of ``width`` words; two documents are linked if 100 * shared shingles >= percent * all their shingles,
    and component_id is the smallest identifier that links reach. A null or empty text has no shingles and is linked
    with nothing; a text with fewer words has one shingle. Rows that repeat an identifier give repeated results. Rows
    with a null identifier are alone in their component, which is null, and kept. Texts are read whole, however long; other
    columns, also of clashing names, are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = shared_table(_signed(rows, width), "near_signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    classes = shared_table(classes, "near_classes")
    buckets = classes.select("node", F.posexplode("bands").alias("band", "key"))
    ends = buckets.groupBy("band", "key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    stars = buckets.join(ends, ["band", "key"]).where("node > a").select("a", F.col("node").alias("b")).distinct()
    families = connected_components(stars, lambda df: shared_table(df, "near_families")).withColumnRenamed("component", "family")
    # At most SPREAD * partitions families hold more than 1 / (SPREAD * partitions) of the members; they are broadcast, so no
    # shuffle by family moves them. Every other family is small enough for one task's share.
    count = shared_table(families.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "near_sizes")
    total = count.agg(F.sum("n")).head()[0] or 0
    limit = max(SMALL, total // (SPREAD * partitions(docs.sparkSession)))
    hot = F.broadcast(count.where(F.col("n") > limit).select("family"))
    found = rows.where("doc_id is not null").join(families, rows["doc_id"] == families["node"]).select("node", "family", "text")
    members = shared_table(_with_sets(found, width).dropDuplicates(["node"]), "near_members")
    sized = members.join(hot, "family", "left_anti").join(count.where(F.col("n") <= limit), "family")
    few = sized.where(F.col("n") <= SMALL).select("family", "node", "shingles").groupBy("family").applyInArrow(lambda t: _settle(t, percent), "a long, b long")
    if count.where(F.col("n") > SMALL).isEmpty():
        links = few
    else:
        several = sized.where(F.col("n") > SMALL).select("node", "family", "shingles")
        links = few.union(_large_links(shared_table(several.union(members.join(hot, "family", "left_semi").select(*several.columns)), "near_many"), percent))
    # Links are made in Python tasks and connected in others, so no task holds workers of both.
    joined = connected_components(shared_table(links, "near_pairs"), lambda df: shared_table(df, "near_links"))
    named = classes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
