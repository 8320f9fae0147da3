"""Reading Verilog files, digests and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File name endings of Verilog sources.
PATTERN = "*.{v,sv,vh,svh}"


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path and text, a row for each file; invalid UTF-8 is replaced."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text"))


def read_directory(spark: SparkSession, root: str, *, recursive: bool = True, pattern: str = PATTERN) -> DataFrame:
    got = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(root)
    return got.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def digests(files: DataFrame) -> DataFrame:
    """path and the SHA-256 of its text."""
    return files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and state of two digest tables: changed, removed or added; files that are the same are left out."""
    both = old.select("path", F.col("digest").alias("o")).join(new.select("path", F.col("digest").alias("n")), "path", "full_outer")
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("o").eqNullSafe(F.col("n"))).select("path", state.alias("state"))


def resolve_includes(uses: DataFrame, files: DataFrame, incdirs: Sequence[str]) -> DataFrame:
    """source, name, quote and the path each include finds, or null: quoted ones beside the source first, then the directories in order."""
    folder = F.regexp_replace("source", "[^/]*$", "")
    own = F.when(F.col("quote") == '"', F.array(F.struct(F.lit(0).alias("place"), F.concat(folder, "name").alias("path")))).otherwise(F.array().cast("array<struct<place:int,path:string>>"))
    dirs = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.concat(F.lit(d.rstrip("/") + "/"), "name").alias("path")) for i, d in enumerate(incdirs)]) if incdirs else F.array().cast("array<struct<place:int,path:string>>")
    tries = uses.withColumn("t", F.explode_outer(F.concat(own, dirs))).select("source", "name", "quote", "t.place", "t.path")
    hit = tries.join(files.select("path", F.lit(True).alias("there")), "path", "left")
    return hit.groupBy("source", "name", "quote").agg(F.min_by("path", F.when(F.col("there"), F.col("place"))).alias("path"))


def defines_as_of(ops: DataFrame, uses: DataFrame) -> DataFrame:
    """path, name and value: what the last define or undef of a name in files before each use says, in list order.

    ``ops`` has pos, line, name and value (null: undefined), ``uses`` has pos, path and name. An as-of join: both on one
    time line for each name, and the last operation so far.
    """
    every = ops.select("pos", "line", "name", F.struct("value").alias("op"), F.lit(None).cast("string").alias("path"))
    asked = uses.select("pos", F.lit(-1).alias("line"), "name", F.lit(None).cast(every.schema["op"].dataType).alias("op"), "path")
    w = Window.partitionBy("name").orderBy("pos", "line").rowsBetween(Window.unboundedPreceding, 0)
    seen = every.unionByName(asked).withColumn("now", F.last("op", ignorenulls=True).over(w))
    return seen.where("path is not null and now.value is not null").select("path", "name", F.col("now.value").alias("value"))
