"""Queries over file lists, files, manifests, definitions and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.catalog import query
from gatelake.functions import columns as C
from gatelake.functions import patterns as P
from gatelake.operators import hierarchy, scan
from gatelake.plans.frontier import expand
from gatelake.plans.store import fresh_path, keep
from gatelake.sources import filelist, rtl, sinks, star
from gatelake.sources.config import checks_table, parse


def _lists(spark: SparkSession, sf_dir: str) -> filelist.FileList:
    """Lists written from region and nation (30 rows at every scale): the top list names a list for each region."""
    regions = sorted(r[0] for r in star.table(spark, sf_dir, "region").select("r_regionkey").collect())
    nations = sorted((r[0], r[1]) for r in star.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect())
    texts = {"lists/top.f": "// top\n+define+TOP+WIDTH=8\n" + "".join(f"-f r{r}/region.f\n" for r in regions) + "-f gone.f\n${ROOT}/common.v\n-y lib\n-v cells.v\n+libext+.v+.sv\n-top top\n"}
    for r in regions:
        own = [n for x, n in nations if x == r]
        texts[f"lists/r{r}/region.f"] = f"+incdir+inc/r{r} +define+REGION_{r}={r * 10}\n" + "".join(f"rtl/nat_{n}.v\n" for n in own) + "rtl/nat_0.v # again\n"
    return filelist.expand("lists/top.f", read=texts.get, env={"ROOT": "rtl"})


@query("""
SELECT CAST(row_number() OVER (ORDER BY g, n_regionkey, k, n_nationkey) - 1 AS INTEGER) AS pos, path, via_filelist, chain FROM (
  SELECT 0 AS g, n_regionkey, CASE WHEN n_nationkey = 0 AND n_regionkey <> first_r THEN 1 ELSE 0 END AS k, n_nationkey, 'rtl/nat_' || n_nationkey || '.v' AS path,
    'lists/r' || n_regionkey || '/region.f' AS via_filelist, 'lists/top.f -> lists/r' || n_regionkey || '/region.f' AS chain
  FROM (SELECT *, (SELECT min(r_regionkey) FROM region) AS first_r FROM nation)
  UNION ALL SELECT 1, 0, 0, 0, 'rtl/common.v', 'lists/top.f', 'lists/top.f')
""")
def q001_filelist_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested file lists: sources in order with their list and chain, first occurrence only."""
    return filelist.tables(spark, _lists(spark, sf_dir))["sources"].withColumn("chain", F.array_join("chain", " -> "))


@query("""
SELECT 'edge' AS kind, 'lists/top.f' AS a, 'lists/r' || r_regionkey || '/region.f' AS b FROM region UNION ALL SELECT 'edge', 'lists/top.f', 'lists/gone.f'
UNION ALL SELECT 'define', 'REGION_' || r_regionkey, CAST(r_regionkey * 10 AS VARCHAR) FROM region UNION ALL SELECT 'define', 'TOP', '1' UNION ALL SELECT 'define', 'WIDTH', '8'
UNION ALL SELECT 'error', 'missing filelist lists/gone.f', ''
""")
def q003_filelist_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List edges, definitions and errors of the same lists."""
    t = filelist.tables(spark, _lists(spark, sf_dir))
    rows = t["filelist_edges"].select(F.lit("edge").alias("kind"), F.col("parent").alias("a"), F.col("child").alias("b"))
    rows = rows.union(t["defines"].select(F.lit("define"), "name", "value"))
    return rows.union(t["errors"].select(F.lit("error"), "message", F.lit("")))


@query("""
SELECT p_partkey, replace(replace(replace('$ROOT/${KIND}/$(NAME).v', '$ROOT', 'rtl'), '${KIND}', lower(substr(p_brand, 1, 5))), '$(NAME)', 'p' || p_partkey) AS path FROM part
""")
def q004_env_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment names in paths, as a chain of replacements over a column."""
    path = C.expand_names(F.lit("$ROOT/${KIND}/$(NAME).v"), {"ROOT": F.lit("rtl"), "KIND": F.lower(F.substring("p_brand", 1, 5)), "NAME": F.concat(F.lit("p"), F.col("p_partkey").cast("string"))})
    return star.table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


@query("SELECT 'nat_' || n_nationkey || '.v' AS file, 1 AS modules FROM nation UNION ALL SELECT DISTINCT 'reg_' || n_regionkey || '.v', 1 FROM nation UNION ALL SELECT 'top.v', 1 UNION ALL SELECT 'leaf.v', 1 UNION ALL SELECT DISTINCT 'cell_' || lower(substr(c_mktsegment, 1, 4)) || '.v', 1 FROM customer")
def q005_read_rtl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written, read back whole from their folder, and their modules counted."""
    root = fresh_path(spark, "rtl_files")
    text = star.rtl(spark, sf_dir).select("text", F.regexp_extract("path", r"([^/]*)\.v$", 1).alias("name"))
    text.write.mode("overwrite").partitionBy("name").option("lineSep", "\u0003").text(root)
    got = rtl.read_directory(spark, root, pattern="*.txt")
    name = F.concat(F.regexp_extract("path", r"name=([^/]*)/", 1), F.lit(".v"))
    return scan.declared_modules(got).groupBy(name.alias("file")).agg(F.count(F.lit(1)).cast("int").alias("modules"))


@query("""
SELECT path, state FROM (
  SELECT 'o' || o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'removed' WHEN o_orderpriority = '1-URGENT' THEN 'changed' END AS state FROM orders
  UNION ALL SELECT 'new' || c_custkey, 'added' FROM customer) WHERE state IS NOT NULL
""")
def q008_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two states of a file set: changed, removed and added."""
    o = star.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    old = rtl.digests(o.select(path.alias("path"), F.col("o_orderpriority").alias("text")))
    new = o.where("o_orderstatus <> 'F'").select(path.alias("path"), F.when(F.col("o_orderpriority") == "1-URGENT", "edited").otherwise(F.col("o_orderpriority")).alias("text"))
    added = star.table(spark, sf_dir, "customer").select(F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("path"), F.lit("x").alias("text"))
    return rtl.diff(old, rtl.digests(new.union(added)))


_LIBRARY_SQL = """
SELECT module, stop_reason, is_blackbox FROM (
  SELECT 'p' || p_partkey AS module, '' AS stop_reason, false AS is_blackbox FROM part WHERE p_size <= 25
  UNION ALL SELECT 'p' || p_partkey, 'ignorePath', true FROM part WHERE p_size > 25)
"""


@query(_LIBRARY_SQL)
def q007_library_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library modules come in as black boxes where the design has none of the name."""
    part = star.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("module"), "p_size")
    return scan.with_library(part.where("p_size <= 25"), part)


@query("SELECT 'nat_' || n_nationkey AS module, 'rtl/nat_' || n_nationkey || '.v' AS path FROM nation UNION ALL SELECT 'reg_' || r_regionkey, 'rtl/reg_' || r_regionkey || '.v' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'top', 'rtl/top.v' UNION ALL SELECT 'leaf', 'rtl/leaf.v' UNION ALL SELECT DISTINCT 'cell_' || lower(substr(c_mktsegment, 1, 4)), 'rtl/cell_' || lower(substr(c_mktsegment, 1, 4)) || '.v' FROM customer")
def q009_declared_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after module at the start of a line, without preprocessing."""
    return scan.declared_modules(star.rtl(spark, sf_dir)).select("module", "path")


@query("SELECT lower(p_brand) AS module, string_agg('f' || (p_partkey % 50), ',' ORDER BY 'f' || (p_partkey % 50)) AS files FROM part GROUP BY 1")
def q010_module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each module, duplicates kept, in order."""
    d = star.table(spark, sf_dir, "part").select(F.lower("p_brand").alias("module"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("path"))
    return scan.module_files(d).withColumn("files", F.array_join("files", ","))


@query("SELECT 'f' || (p_partkey % 50) AS path, string_agg(DISTINCT lower(p_brand), ',' ORDER BY lower(p_brand)) AS modules FROM part GROUP BY 1")
def q011_file_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index: modules of each file."""
    d = star.table(spark, sf_dir, "part").select(F.lower("p_brand").alias("module"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("path"))
    return scan.file_modules(d).withColumn("modules", F.array_join("modules", ","))


@query("SELECT 'p' || p_partkey AS name, 'f' || (p_partkey % 50) AS file_id FROM part")
def q012_index_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The essential index written and read again."""
    root = fresh_path(spark, "index")
    part = star.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("file_id"))
    sinks.write_index({"modules": part}, root)
    return sinks.read_index(spark, root, ("modules",))["modules"]


@query("SELECT c_custkey, c_name FROM customer")
def q013_json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON index with a fingerprint, written and read again; rows of another fingerprint do not come back."""
    path = fresh_path(spark, "json_index")
    sinks.write_json(star.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, "v1")
    schema = "c_custkey bigint, c_name string"
    return sinks.read_json(spark, path, schema, "v1").union(sinks.read_json(spark, path, schema, "v2"))


_PROBES_SQL = "probes AS (SELECT 'top.u_r' || n_regionkey || '.u_n' || c_nationkey || '.u_c' || (c_custkey * 2) || '.u_o1' AS path FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(star.FLAT_ROWS_SQL + f""", {_PROBES_SQL}
SELECT p.path, max_by(f.full_path, f.depth) AS full_path, CAST(5 - max(f.depth) - 1 AS INTEGER) AS tail FROM (SELECT DISTINCT path FROM probes) p JOIN flat_rows f ON p.path = f.full_path OR starts_with(p.path, f.full_path || '.') GROUP BY p.path
""")
def q014_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each probe's longest known prefix, by exploded prefixes and an equi-join."""
    c = star.table(spark, sf_dir, "customer").join(F.broadcast(star.table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    probe = F.concat(F.lit("top.u_r"), F.col("n_regionkey").cast("string"), F.lit(".u_n"), F.col("c_nationkey").cast("string"), F.lit(".u_c"), (F.col("c_custkey") * 2).cast("string"), F.lit(".u_o1"))
    return hierarchy.longest_prefix(star.flat_rows(spark, sf_dir), c.select(probe.alias("path"))).select("path", "full_path", F.col("tail").cast("int").alias("tail"))


@query("SELECT 'check-connect-batch' AS mode, 2 AS checks, 'both' AS phase, 'W' AS define")
def q017_run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run configuration with comments."""
    c = parse('{"top": "top", // name\n "connect-phase": "both", "defines": {"W": 8}, /* two */ "checks": [{"a": "x", "b": "y"}, {"from": "p", "to": "q"},]}')
    return spark.createDataFrame([(c.mode, len(c.checks), c.phases[0], *c.defines)], "mode string, checks int, phase string, define string")


@query("SELECT * FROM (VALUES ('c1', 'a', 'b'), ('check_1', 's', 'x|y'), ('check_2', 'm', 'n')) t(check_id, a, b)")
def q018_check_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks from JSON with their other key names."""
    t = checks_table(spark, '{"checks": [{"id": "c1", "a": "a", "b": "b"}, {"src": "s", "dst": ["x", "y"]}, {"endpoint_a": "m", "endpoint_b": "n"}]}')
    return t.select("check_id", F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"))


@query(star.FLAT_ROWS_SQL + "SELECT full_path, inst_leaf, module, CAST(depth AS VARCHAR) AS depth, '' AS file, '' AS stop_reason, '' AS via_filelist, '' AS filelist_chain FROM flat_rows")
def q019_instance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance report columns as text."""
    return sinks.report(star.flat_rows(spark, sf_dir), sinks.INSTANCE_COLUMNS)


@query("WITH e AS (SELECT DISTINCT 'reg_' || n_regionkey AS src, 'nat_' || n_nationkey AS dst FROM nation) SELECT 'digraph cone {' || chr(10) || string_agg('  \"' || src || '\" -> \"' || dst || '\";', chr(10) ORDER BY '  \"' || src || '\" -> \"' || dst || '\";') || chr(10) || '}' || chr(10) AS dot FROM e")
def q023_dot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Graphviz sketch; the limit on nodes is the feature."""
    n = star.table(spark, sf_dir, "nation")
    e = n.select(F.concat(F.lit("reg_"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("nat_"), F.col("n_nationkey").cast("string")).alias("dst")).distinct()
    return sinks.dot(e, max_nodes=500)


_COMMENTED = "'assign o' || o_orderkey || ' = ' || o_orderstatus || '; // ' || o_orderpriority || chr(10) || 'wire w; /* ' || o_custkey || chr(10) || ' // x */ reg r' || o_orderkey || '; /* open'"


def _commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey").cast("string"), F.lit
    text = F.concat(s("assign o"), k, s(" = "), "o_orderstatus", s("; // "), "o_orderpriority", s("\nwire w; /* "), F.col("o_custkey").cast("string"), s("\n // x */ reg r"), k, s("; /* open"))
    return star.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query(f"SELECT o_orderkey, regexp_replace({_COMMENTED}, '//[^\\n]*|(?s:/\\*.*?(?:\\*/|\\z))', '', 'g') AS text FROM orders")
def q027_strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and block comments in one expression, left to right."""
    return _commented(spark, sf_dir).select("o_orderkey", C.strip_comments(F.col("text")).alias("text"))


@query(f"SELECT o_orderkey, regexp_replace({_COMMENTED}, '//[^\\n]*', '', 'g') AS text FROM orders")
def q029_strip_line_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse strip leaves block comments."""
    return _commented(spark, sf_dir).select("o_orderkey", C.strip_line_comments(F.col("text")).alias("text"))


@query("""
WITH ops AS (SELECT o_custkey AS pos, o_orderkey AS line, 'M_' || o_orderpriority AS name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS value FROM orders),
last_op AS (SELECT pos, name, max_by(coalesce(value, chr(1)), line) AS value FROM ops GROUP BY pos, name),
spans AS (SELECT name, value, pos AS lo, lead(pos) OVER (PARTITION BY name ORDER BY pos) AS hi FROM last_op)
SELECT 'f' || c_custkey AS path, name, value FROM customer JOIN spans ON name = CASE WHEN c_custkey % 2 = 0 THEN 'M_1-URGENT' ELSE 'M_2-HIGH' END AND c_custkey > lo AND (hi IS NULL OR c_custkey <= hi) WHERE value <> chr(1)
""")
def q033_defines_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions visible at each file: an as-of join by union and the last value so far."""
    o = star.table(spark, sf_dir, "orders")
    ops = o.select(F.col("o_custkey").alias("pos"), F.col("o_orderkey").alias("line"), F.concat(F.lit("M_"), "o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")).alias("value"))
    uses = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_custkey") % 2 == 0, "M_1-URGENT").otherwise("M_2-HIGH").alias("name"))
    return rtl.defines_as_of(ops, uses)


@query("""
WITH uses AS (SELECT 'src/' || (p_partkey % 3) || '/p' || p_partkey || '.v' AS source, 'h' || p_size || '.vh' AS name, CASE WHEN p_partkey % 2 = 0 THEN '"' ELSE '<' END AS quote FROM part),
files AS (SELECT 'src/1/h' || g || '.vh' AS path FROM range(1, 60) t(g) WHERE g % 4 = 0 UNION ALL SELECT 'inc/a/h' || g || '.vh' FROM range(1, 60) t(g) WHERE g % 2 = 0 UNION ALL SELECT 'inc/b/h' || g || '.vh' FROM range(1, 60) t(g) WHERE g % 3 = 0)
SELECT source, name, quote, CASE WHEN quote = '"' AND regexp_extract(source, '^(.*/)', 1) || name IN (SELECT path FROM files) THEN regexp_extract(source, '^(.*/)', 1) || name
  WHEN 'inc/a/' || name IN (SELECT path FROM files) THEN 'inc/a/' || name WHEN 'inc/b/' || name IN (SELECT path FROM files) THEN 'inc/b/' || name END AS path FROM uses
""")
def q034_include_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes found by ranked equi-joins: beside the source for quoted ones, then the directories in order."""
    p = star.table(spark, sf_dir, "part")
    uses = p.select(F.concat(F.lit("src/"), (F.col("p_partkey") % 3).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".v")).alias("source"), F.concat(F.lit("h"), F.col("p_size").cast("string"), F.lit(".vh")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, '"').otherwise("<").alias("quote"))
    g = spark.range(1, 60)
    named = lambda d, n: g.where(f"id % {n} = 0").select(F.concat(F.lit(d), F.col("id").cast("string"), F.lit(".vh")).alias("path"))
    return rtl.resolve_includes(uses, named("src/1/h", 4).union(named("inc/a/h", 2)).union(named("inc/b/h", 3)), ["inc/a", "inc/b/"])


@query("""
WITH RECURSIVE inc AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1 UNION SELECT c_custkey, c_custkey // 3 + 1 FROM customer WHERE c_custkey > 1),
walk(label, node) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT w.label, i.dst FROM walk w JOIN inc i ON i.src = w.node)
SELECT label, node FROM walk
""")
def q035_include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive includes of every file over a graph with cycles, in one frontier loop."""
    c = star.table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    some = c.where("c_custkey > 1")
    edges = some.select(k.alias("src"), F.expr("c_custkey div 2").alias("dst")).union(some.select(k, F.expr("c_custkey div 3 + 1"))).distinct()
    return expand(c.select(k.alias("label"), k.alias("node")), keep(edges), max_hops=400).select("label", "node")


@query("SELECT o_orderkey, NOT (contains(lower(o_orderpriority), 'urgent') OR o_orderpriority LIKE '4-%' OR o_orderstatus = 'P') AS kept FROM orders")
def q038_ignore_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore rules: a substring, a glob on the base name and a glob on any part."""
    o = star.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("rtl/"), "o_orderstatus", F.lit("/"), "o_orderpriority")
    ignored = P.matches_ignore(path, "urgent") | P.matches_ignore(path, "4-*") | P.matches_ignore(path, "[P]")
    return o.select("o_orderkey", (~ignored).alias("kept"))


@query("SELECT DISTINCT 'p' || l_partkey AS module, 'ignorePath' AS stop_reason FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def q039_ignore_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that no module defines, by an anti join, labelled once ignore rules are set."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    edges = star.table(spark, sf_dir, "lineitem").select(name("l_partkey").alias("child"))
    known = star.table(spark, sf_dir, "part").where("p_size <= 40").select(name("p_partkey").alias("module"))
    return scan.undefined_targets(edges, known, ignoring=True)


@query("SELECT c_custkey, 'cell_' || c_nationkey AS module FROM customer")
def q015_index_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table kept under the digest of its files and settings: built once, then read."""
    from gatelake.sources import cache

    files = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("cell_"), F.col("c_nationkey").cast("string")).alias("text"))
    key = cache.content_key(files, {"W": 8})
    build = lambda: files.select(F.col("path").cast("bigint").alias("c_custkey"), F.col("text").alias("module"))
    cache.load_or_build(spark, "customers", key, build)
    got, there = cache.load_or_build(spark, "customers", key, build)
    return got.where(F.lit(there))
