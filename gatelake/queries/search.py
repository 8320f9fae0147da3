"""Queries that search the instance tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.catalog import query
from gatelake.functions import patterns as P
from gatelake.operators import search
from gatelake.sources import star

_TREE = star.FLAT_ROWS_SQL


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[1-3]+') AS by_regex, regexp_matches(p_brand, '#.2') AS by_glob, p_brand = 'Brand#22' AS by_name, lower(p_brand) = 'brand#22' AS by_name_ci FROM part")
def q082_segment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment against a regex, a glob (tried anchored and anywhere) and a plain name."""
    b = F.col("p_brand")
    m = P.matches_segment
    return star.table(spark, sf_dir, "part").select("p_partkey", m(b, "re:Brand#[1-3]+").alias("by_regex"), m(b, "#?2").alias("by_glob"), m(b, "Brand#22").alias("by_name"), m(b, "brand#22", case_insensitive=True).alias("by_name_ci"))


@query("SELECT p_partkey, contains(lower(p_type), 'steel') AS by_part, regexp_full_match(p_type, '.*TIN') AS by_glob, regexp_full_match(p_type, '(SMALL|LARGE).*') AS by_regex FROM part")
def q083_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name against a substring (whatever the case), a glob and a regex."""
    t = F.col("p_type")
    return star.table(spark, sf_dir, "part").select("p_partkey", P.matches_name(t, "STEEL").alias("by_part"), P.matches_name(t, "*TIN").alias("by_glob"), P.matches_name(t, "re:(SMALL|LARGE).*").alias("by_regex"))


@query(_TREE + """
SELECT full_path, regexp_matches(full_path, '(^|\\.)u_c1$|(^|\\.)u_c1\\.') AS any_segment, regexp_full_match(full_path, 'top\\.u_r1\\.[^.]*u_n[^.]*') AS fixed, regexp_full_match(full_path, 'top\\.([^.]+\\.)+[^.]*u_c1[^.]*') AS skip,
  regexp_full_match(full_path, 'top\\.u_r2(\\.[^.]+)+') AS under, regexp_full_match(full_path, '([^.]+\\.)+u_n1') AS lead, regexp_full_match(full_path, 'top\\.u_r[0-2]+\\.u_n[0-9]') AS with_regex FROM flat_rows
""")
def q084_path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path patterns: one segment, fixed depth, skips inside, at the end and at the start, and a regex segment."""
    p = F.col("full_path")
    m = P.matches_path
    return star.flat_rows(spark, sf_dir).select("full_path", m(p, "u_c1").alias("any_segment"), m(p, "top.u_r1.u_n*").alias("fixed"), m(p, "top..u_c1*").alias("skip"), m(p, "top.u_r2..").alias("under"), m(p, "..u_n1").alias("lead"), m(p, "top.re:u_r[0-2]+.re:u_n[0-9]").alias("with_regex"))


@query(_TREE + "SELECT full_path FROM flat_rows WHERE regexp_full_match(full_path, 'top\\.u_r[^.]*\\.u_n[12]')")
def q085_equal_depth_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many segments as the pattern."""
    return star.flat_rows(spark, sf_dir).where(P.matches_equal_depth(F.col("full_path"), "top.u_r*.re:u_n[12]")).select("full_path")


@query(_TREE + """
, hits AS (SELECT full_path FROM flat_rows WHERE contains(inst_leaf, 'u_n1') OR full_path = 'top.u_r2.u_n8')
SELECT full_path, 'hit' AS matched FROM hits UNION ALL SELECT DISTINCT f.full_path, 'under' FROM flat_rows f JOIN hits h ON starts_with(f.full_path, h.full_path || '.') WHERE f.full_path NOT IN (SELECT full_path FROM hits)
""")
def q086_flat_row_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several patterns with their subtrees."""
    return search.search(star.flat_rows(spark, sf_dir), "u_n1, top.u_r2.u_n8", match_module=False, include_subtree=True).select("full_path", "matched")


@query(_TREE + "SELECT full_path FROM flat_rows WHERE contains(module, 'cus_77') OR contains(inst_leaf, 'cus_77')")
def q087_module_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By module name."""
    return search.search(star.flat_rows(spark, sf_dir), "cus_77").select("full_path")


@query(_TREE + """
, ports AS (SELECT 'nat_' || n_nationkey AS module, 'bus[' || i || ']' AS port FROM nation, range(0, 8) t(i) WHERE i < n_nationkey % 4 + 5)
SELECT f.full_path, f.module, CASE WHEN p.port IS NULL THEN 'hierarchy-port-miss' ELSE 'hierarchy-port' END AS kind, coalesce(p.port, 'bus[6]') AS port, p.port IS NOT NULL AS port_found
FROM flat_rows f LEFT JOIN ports p ON p.module = f.module AND p.port = 'bus[6]' WHERE f.full_path = 'top.u_r1.u_n1'
UNION ALL SELECT f.full_path, f.module, 'hierarchy-port', p.port, true FROM flat_rows f JOIN ports p ON p.module = f.module WHERE p.port LIKE 'bus[%' AND f.depth = 2
""")
def q088_port_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trailing port: a miss row for a plain instance, none for a glob; indices by a bracket glob."""
    n = star.table(spark, sf_dir, "nation")
    names = F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") % 4 + 4).cast("int")), lambda i: F.concat(F.lit("bus["), i.cast("string"), F.lit("]")))
    ports = n.select(F.concat(F.lit("nat_"), F.col("n_nationkey").cast("string")).alias("module"), F.lit("bus").alias("name"), names.alias("names"))
    rows = star.flat_rows(spark, sf_dir)
    return search.search_ports(rows, ports, "top.u_r1.u_n1.bus[6]").unionByName(search.search_ports(rows, ports, "top.u_r*.u_n*.bus[*]"))


@query(_TREE + """
SELECT full_path, min_by(kind, k) AS kind FROM (SELECT full_path, 'instance' AS kind, 0 AS k FROM flat_rows WHERE contains(inst_leaf, 'u_c12')
UNION ALL SELECT full_path, 'path', 1 FROM flat_rows WHERE regexp_matches(full_path, '(^|\\.)u_r3(\\.|$)') UNION ALL SELECT full_path, 'hierarchy_path', 2 FROM flat_rows WHERE regexp_full_match(full_path, 'top\\.u_r1\\.[^.]*')) GROUP BY 1
""")
def q089_structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of patterns; a path found twice keeps its first kind."""
    return search.structured_search(star.flat_rows(spark, sf_dir), {"instance": ["u_c12"], "path": ["u_r3"], "hierarchy_path": ["top.u_r1.*"]}).select("full_path", "kind")


@query(_TREE + "SELECT full_path, module || '.v' AS file, 'list_' || (depth % 2) || '.f' AS via_filelist FROM flat_rows WHERE contains(inst_leaf, 'u_n2')")
def q090_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their file and list."""
    rows = star.flat_rows(spark, sf_dir).withColumns({"file": F.concat("module", F.lit(".v")), "via_filelist": F.concat(F.lit("list_"), (F.col("depth") % 2).cast("string"), F.lit(".f"))})
    return search.with_provenance(search.search(rows, "u_n2", match_module=False).select("full_path"), rows)


@query(_TREE + "SELECT full_path, 'hit' AS matched, module, CAST(depth AS VARCHAR) AS depth, '' AS file, '' AS via_filelist, '' AS filelist_chain, '' AS stop_reason, '' AS kind, '' AS port, '' AS port_found, '' AS port_line, '' AS port_decl, '' AS port_param_note, '' AS path_chain FROM flat_rows WHERE contains(inst_leaf, 'u_n1')")
def q020_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search report columns as text."""
    from gatelake.sources import sinks

    return sinks.report(search.search(star.flat_rows(spark, sf_dir), "u_n1", match_module=False), sinks.SEARCH_COLUMNS)
