"""Sinks: tab-separated reports, index tables, JSON and graph sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTANCE_COLUMNS = ["full_path", "inst_leaf", "module", "depth", "file", "stop_reason", "via_filelist", "filelist_chain"]
SEARCH_COLUMNS = ["full_path", "matched", "module", "depth", "file", "via_filelist", "filelist_chain", "stop_reason", "kind", "port", "port_found", "port_line", "port_decl", "port_param_note", "path_chain"]
TEXT_COLUMNS = ["check_id", "endpoint_a", "endpoint_b", "connected_text", "mode", "note", "errors", "hops", "a_rtl", "a_via_filelist", "a_filelist_chain", "b_rtl", "b_via_filelist", "b_filelist_chain", "phase"]
LOGICAL_COLUMNS = [*TEXT_COLUMNS[:4], "connected_logical", "connected", "mode", "note", "logical_notes", *TEXT_COLUMNS[6:]]
CONE_COLUMNS = ["kind", "scope", "net", "module", "detail", "rtl", "via_filelist", "filelist_chain"]
TRACE_COLUMNS = ["origin_port", "trace_direction", "boundary_kind", *CONE_COLUMNS[1:]]
WAYPOINT_COLUMNS = ["source", "event_kind", "scope", "net", "rtl_file", "rtl_line", "waypoint_hit", "waypoint_qualified", "is_terminator", "side", "peer_matched", "path_kind"]


def report(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a report, in order and as text: arrays joined by `` -> ``, booleans 1 or 0, what is not there empty."""

    def shown(c: str) -> Column:
        if c not in df.columns:
            return F.lit("").alias(c)
        kind = dict(df.dtypes)[c]
        x = F.array_join(c, " -> ") if kind == "array<string>" else F.when(F.col(c), "1").otherwise("0") if kind == "boolean" else F.col(c).cast("string")
        return F.coalesce(x, F.lit("")).alias(c)

    return df.select(*[shown(c) for c in columns])


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    report(df, columns).write.option("sep", "\t").option("quote", "").option("emptyValue", "").mode("overwrite").csv(path, header=True)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """The essential index: files, modules, ports and build_timing as Parquet under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark, path: str, names: tuple[str, ...] = ("files", "modules", "ports", "build_timing")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_json(df: DataFrame, path: str, fingerprint: str) -> None:
    df.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").json(path)


def read_json(spark, path: str, schema: str, fingerprint: str) -> DataFrame:
    """The stored rows, none if they were written under another fingerprint."""
    return spark.read.schema(schema + ", fingerprint string").json(path).where(F.col("fingerprint") == fingerprint).drop("fingerprint")


def path_chain_text(chain: Column) -> Column:
    return F.array_join(F.transform(chain, lambda s: F.concat(s["full_path"], F.lit("@"), s["module"])), " > ")


def dot(edges: DataFrame, *, max_nodes: int = 500) -> DataFrame:
    """One row, a Graphviz sketch of the edges among the first nodes by name."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().orderBy("n").limit(max_nodes)
    shown = edges.join(F.broadcast(nodes.withColumnRenamed("n", "src")), "src", "left_semi").join(F.broadcast(nodes.withColumnRenamed("n", "dst")), "dst", "left_semi")
    lines = F.array_sort(F.collect_list(F.format_string('  "%s" -> "%s";', "src", "dst")))
    return shown.agg(F.concat(F.lit("digraph cone {\n"), F.array_join(lines, "\n"), F.lit("\n}\n")).alias("dot"))


def upsert(old: DataFrame, new: DataFrame, key: str = "check_id") -> DataFrame:
    """Hand-over rows by key: those of ``new``, and those of ``old`` whose key ``new`` does not have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))


def with_summary(df: DataFrame, columns: list[str], *, kind: str = "summary") -> DataFrame:
    """A report with one more row, whose first column is ``kind`` and whose second is the number of rows."""
    rows = report(df, columns)
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(total.select(F.lit(kind).alias(columns[0]), F.col("n").cast("string").alias(columns[1]), *[F.lit("").alias(c) for c in columns[2:]]))
