"""Exact de-duplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, an external sort puts equal texts side by side, and the sorted
neighbours are compared in full: a run ends where the text differs. A text that more rows hold than a sub-range should is
dealt over several sub-ranges, as many as its count asks for; every other group is finished where it was sorted. The runs
of the dealt texts, a bounded number, are merged by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm.common import fresh, partitions, shared_table

#: Characters of a text that the range splitters see.
HEAD = 32
#: A text is dealt out if it is in more than 1 / (SPREAD * partitions) of all rows, so at most SPREAD * partitions texts are.
SPREAD = 4

NORMALISERS = {
    "none": lambda t: t,
    "lower": F.lower,
    "space": lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")),
}


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, normalise: str, keep: str, carry: list[str]) -> tuple[DataFrame, bool, dict[str, str]]:
    """``docs`` sorted by content: each row with its place in its run, the run's best identifier and size; whether any text was dealt out.

    The last value names the added columns, which clash with none of ``docs``.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep}")
    n = partitions(docs.sparkSession)
    names = {c: fresh(docs, f"__{c}") for c in ("id", "body", "head", "rest", "salts", "salt", "place", "run_keep", "run_size")}
    c = lambda name: F.col(names[name])
    body = NORMALISERS[normalise](F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    counts = docs.select(F.xxhash64(body).alias("rest")).groupBy("rest").agg(F.count(F.lit(1)).alias("n"))
    counts = shared_table(counts.where("n > 1"), "exact_counts")
    total = docs.select(F.lit(1)).count()
    limit = max(1, total // (SPREAD * n))
    hot = counts.where(F.col("n") > limit).select(F.col("rest").alias("__hot"), F.ceil(F.col("n") / limit).cast("int").alias(names["salts"]))
    dealt = not hot.isEmpty()
    rows = docs.select(*[F.col(f"`{x}`") for x in carry], F.col(f"`{id_col}`").alias(names["id"]), body.alias(names["body"]))
    # Splitters are sampled on the driver, so they hold the texts' first characters and a hash, not whole texts.
    rows = rows.withColumns({names["head"]: F.substring(c("body"), 1, HEAD), names["rest"]: F.xxhash64(c("body"))})
    key = [c("head"), c("rest")]
    if dealt:  # at most SPREAD * partitions rows are broadcast
        rows = rows.join(F.broadcast(hot), c("rest") == F.col("__hot"), "left").drop("__hot")
        rows = rows.withColumn(names["salt"], F.when(c("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(c("id")), c("salts"))))
        key.append(c("salt"))
    # The range partitioning clusters the window's groups, so the window adds a sort but no exchange.
    rows = rows.repartitionByRange(n, *key)
    run = Window.partitionBy(*key, c("body"))
    first = run.orderBy(c("id").asc_nulls_last() if keep == "min" else c("id").desc_nulls_last())
    best = F.min if keep == "min" else F.max
    rows = rows.withColumns({names["place"]: F.row_number().over(first), names["run_keep"]: best(c("id")).over(run), names["run_size"]: F.count(F.lit(1)).over(run)})
    return rows, dealt, names


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: str = "none", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``min`` (smallest identifier of a group stays) or ``max``. A null text counts as empty, and empty texts
    form one group. Rows that repeat an identifier and its text count in group_size, and one of them is kept. A null
    identifier is kept only where its whole group has none. Texts are compared whole, however long. An empty table gives an
    empty result; other columns, also of clashing names, are not read.
    """
    runs, dealt, c = _sorted_runs(docs, id_col, text_col, normalise, keep, [])
    sha = F.sha2(F.col(c["body"]), 256)
    out = lambda keep_id, size, kept: [F.col("doc_id"), keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("text_sha256")]
    runs = runs.select(F.col(c["id"]).alias("doc_id"), (F.col(c["salts"]).isNotNull() if dealt else F.lit(False)).alias("dealt"), F.col(c["place"]).alias("place"), F.col(c["run_keep"]).alias("run_keep"), F.col(c["run_size"]).alias("run_size"), sha.alias("text_sha256"))
    if not dealt:
        return runs.select(*out(F.col("run_keep"), F.col("run_size"), F.col("place") == 1))
    runs = shared_table(runs.withColumn("text_sha256", F.unhex("text_sha256")), "exact_runs")
    best = F.min if keep == "min" else F.max
    # At most SPREAD * partitions texts were dealt out, in about as many runs, but the texts and runs are counted all the same.
    merged = runs.where("dealt and place = 1").groupBy(F.col("text_sha256").alias("of")).agg(best("run_keep").alias("keep_id"), F.sum("run_size").alias("group_size"))
    runs = runs.join(F.broadcast(merged), F.col("dealt") & (F.col("text_sha256") == F.col("of")), "left").withColumn("text_sha256", F.lower(F.hex("text_sha256")))
    # Equal identifiers are dealt to one run, so the best one is first in a single run.
    one = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return runs.select(*out(F.when(F.col("dealt"), F.col("keep_id")).otherwise(F.col("run_keep")), F.when(F.col("dealt"), F.col("group_size")).otherwise(F.col("run_size")), F.when(F.col("dealt"), one).otherwise(F.col("place") == 1)))


def kept_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: str = "none", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an identifier and its text, one.

    The rows ride along in the content sort, so they are shuffled once. What was dealt out leaves one row for each run, and
    the best of these stays. Nulls, empty texts and empty tables are as in ``exact_dedup``.
    """
    runs, dealt, c = _sorted_runs(docs, id_col, text_col, normalise, keep, docs.columns)
    own = [F.col(f"`{x}`") for x in docs.columns]
    first = runs.where(F.col(c["place"]) == 1)
    if not dealt:
        return first.select(*own)
    first = shared_table(first.select(*own, F.col(c["salts"]).isNotNull().alias(c["salts"]), F.col(c["run_keep"]).alias(c["id"]), F.sha2(F.col(c["body"]), 256).alias(c["rest"])), "exact_first")
    order = F.col(c["id"]).asc_nulls_last() if keep == "min" else F.col(c["id"]).desc_nulls_last()
    best = first.where(F.col(c["salts"])).withColumn(c["place"], F.row_number().over(Window.partitionBy(c["rest"]).orderBy(order))).where(F.col(c["place"]) == 1)
    return first.where(~F.col(c["salts"])).select(*own).unionByName(best.select(*own))
