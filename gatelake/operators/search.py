"""Search over flat rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import columns as C
from gatelake.functions import patterns as P


def split_patterns(patterns: str | Sequence[str]) -> list[str]:
    """One pattern, several separated by commas (quotes allowed), or a list."""
    if isinstance(patterns, str):
        patterns = patterns.split(",") if "," in patterns else [patterns]
        return [x for p in patterns if (x := p.strip().strip('"').strip("'"))]
    return [p.strip() for p in patterns if p.strip()]


def row_matches(pattern: str, *, match_inst: bool = True, match_module: bool = True, kind: str = "auto", case_insensitive: bool = False) -> Column:
    """Predicate of one pattern: with a dot it is a path pattern, else it is held against instance names; modules by name."""
    path, inst = F.col("full_path"), F.col("inst_leaf")
    leaf = F.when(inst.startswith("\\"), inst).otherwise(F.regexp_extract(inst, r"([^.]*)$", 1))
    out = F.lit(False)
    dotted = "." in pattern
    if match_inst and (kind == "path" or (kind == "auto" and dotted)):
        out = out | P.matches_path(path, pattern, case_insensitive=case_insensitive)
    if match_inst and (kind == "instance" or (kind == "auto" and not dotted)):
        out = out | P.matches_name(leaf, pattern, case_insensitive=case_insensitive)
    if match_module:
        out = out | P.matches_name(F.col("module"), pattern, case_insensitive=case_insensitive)
    return out


def search(rows: DataFrame, patterns: str | Sequence[str], *, match_inst: bool = True, match_module: bool = True, include_subtree: bool = False, kind: str = "auto", case_insensitive: bool = False) -> DataFrame:
    """Rows that any pattern matches, with ``matched``: hit, or under for rows below one where the subtree is wanted.

    Descendants come by an equi-join on exploded prefixes, not by comparing every row with every anchor.
    """
    conditions = [row_matches(p, match_inst=match_inst, match_module=match_module, kind=kind, case_insensitive=case_insensitive) for p in split_patterns(patterns)]
    hits = rows.where(reduce(or_, conditions, F.lit(False))).withColumn("matched", F.lit("hit"))
    if not include_subtree:
        return hits
    above = rows.select("full_path", F.explode(F.slice(C.prefixes(F.col("full_path")), 1, F.size(C.segments(F.col("full_path"))) - 1)).alias("anchor"))
    under = above.join(hits.select(F.col("full_path").alias("anchor")), "anchor").select("full_path").distinct()
    rest = rows.join(under, "full_path", "left_semi").join(hits.select("full_path"), "full_path", "left_anti")
    return hits.unionByName(rest.withColumn("matched", F.lit("under")))


def search_ports(rows: DataFrame, ports: DataFrame, pattern: str, *, case_insensitive: bool = False) -> DataFrame:
    """full_path, module, kind, port and port_found of a hierarchy pattern whose last segment may be a port.

    If the whole pattern is an instance path these are the hits. Else each instance that the pattern without its last
    segment matches is joined with its module's ports; an instance without such a port gives a miss row, unless the
    instance pattern is a glob.
    """
    whole = rows.where(P.matches_path(F.col("full_path"), pattern, case_insensitive=case_insensitive)).select("full_path", "module", F.lit("hierarchy").alias("kind"), F.lit("").alias("port"), F.lit(None).cast("boolean").alias("port_found"))
    head, _, tail = pattern.rpartition(".")
    if not head:
        return whole
    none = whole.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    anchors = rows.where(P.matches_path(F.col("full_path"), head, case_insensitive=case_insensitive)).join(F.broadcast(none), F.lit(True))
    own = ports.select("module", F.explode("names").alias("port")).where(P.matches_port(F.col("port"), tail)).distinct()
    got = anchors.join(own, "module", "left").withColumn("port_found", F.col("port").isNotNull())
    if P.is_glob(head) or P.is_regex(head):
        got = got.where("port_found")
    got = got.select("full_path", "module", F.when(F.col("port_found"), "hierarchy-port").otherwise("hierarchy-port-miss").alias("kind"), F.coalesce("port", F.lit(tail)).alias("port"), "port_found")
    return whole.unionByName(got)


def structured_search(rows: DataFrame, spec: dict) -> DataFrame:
    """Union of a spec's instance, path and hierarchy_path patterns; a path found twice keeps its first kind."""
    common = {"case_insensitive": bool(spec.get("case_insensitive")), "include_subtree": bool(spec.get("search_subtree"))}
    parts = []
    for k, (name, kind) in enumerate((("instance", "instance"), ("path", "path"), ("hierarchy_path", "path"))):
        given = spec.get(name) or []
        if given:
            found = search(rows, given, match_module=bool(spec.get("search_module")) and name == "instance", kind=kind, **common)
            parts.append(found.withColumns({"kind": F.lit(name), "__order": F.lit(k)}))
    if not parts:
        return rows.where("false").withColumns({"matched": F.lit(""), "kind": F.lit("")})
    every = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("full_path").orderBy("__order")
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__order")


def with_provenance(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with the listing of their instance, where rows has one."""
    return hits.join(rows.select("full_path", "file", "via_filelist"), "full_path", "left")
