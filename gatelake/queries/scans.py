"""Queries over what is read from rendered Verilog; the tables it was rendered from give the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.catalog import query
from gatelake.operators import graph, scan
from gatelake.sources import star

#: Customers whose instance stands in an active branch.
_LIVE = "c_acctbal >= 0"
_CELL = "'cell_' || lower(substr(c_mktsegment, 1, 4))"
_OTHER_FILES = "SELECT DISTINCT 'rtl/reg_' || n_regionkey || '.v' AS path FROM nation UNION ALL SELECT 'rtl/top.v' UNION ALL SELECT 'rtl/leaf.v' UNION ALL SELECT DISTINCT 'rtl/cell_' || lower(substr(c_mktsegment, 1, 4)) || '.v' FROM customer"
_PORT_MAPS = f"""
SELECT 'nat_' || c_nationkey AS module, 'u_c' || c_custkey AS inst, x.port, x.expr FROM customer, LATERAL (SELECT 'clk' AS port, 'clk' AS expr UNION ALL SELECT 'd', 'bus[' || (c_custkey % 5) || ']' UNION ALL SELECT 'q', 'w_' || c_custkey) x WHERE {_LIVE}
UNION ALL SELECT 'nat_' || n_nationkey, 'g[' || i || '].u_l', x.port, x.expr FROM nation, range(0, 4) t(i), LATERAL (SELECT 'a' AS port, 'bus[' || i || ']' AS expr UNION ALL SELECT 'b', 'y[' || i || ']') x WHERE i < n_nationkey % 4
UNION ALL SELECT 'reg_' || n_regionkey, 'u_n' || n_nationkey, x.port, x.expr FROM nation, LATERAL (SELECT 'clk' AS port, 'clk' AS expr UNION ALL SELECT 'bus', 'b' UNION ALL SELECT 'y', 'o[' || n_nationkey || ']') x
UNION ALL SELECT 'top', 'u_r' || r_regionkey, p, p FROM region, (VALUES ('clk'), ('en')) t(p)
"""
_INSTANCES = f"""
SELECT 'nat_' || c_nationkey AS module, 'u_c' || c_custkey AS inst, {_CELL} AS child FROM customer WHERE {_LIVE}
UNION ALL SELECT 'nat_' || n_nationkey, 'g[' || i || '].u_l', 'leaf' FROM nation, range(0, 4) t(i) WHERE i < n_nationkey % 4
UNION ALL SELECT 'reg_' || n_regionkey, 'u_n' || n_nationkey, 'nat_' || n_nationkey FROM nation
UNION ALL SELECT 'top', 'u_r' || r_regionkey, 'reg_' || r_regionkey FROM region
"""


@query(f"""
SELECT 'rtl/nat_' || n_nationkey || '.v' AS path, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND {_LIVE}) AS INTEGER) AS instances, 'N + 5' AS width, 1 AS ops FROM nation
UNION ALL SELECT path, 0, '', 0 FROM ({_OTHER_FILES})
""")
def q030_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional compilation, macro expansion and definitions of each rendered file."""
    got = scan.preprocess(star.rtl(spark, sf_dir))
    return got.select("path", F.regexp_count("text", F.lit(r"\bu_c\d+ ")).alias("instances"), F.regexp_extract("text", r"parameter W = ([^)]*)\)", 1).alias("width"), F.size("ops").alias("ops"))


@query("""
SELECT 'nat_' || n_nationkey AS module, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal <= 5000)
  + CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000) THEN 1 ELSE 0 END + n_nationkey % 4 AS INTEGER) AS instances FROM nation
UNION ALL SELECT 'reg_' || n_regionkey, CAST(count(*) AS INTEGER) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'top', CAST(count(*) AS INTEGER) FROM region
""")
def q032_file_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that come with each file: with POOR set the other branches are read."""
    sources = star.rtl(spark, sf_dir).withColumn("defines", F.create_map(F.lit("POOR"), F.lit("1")))
    return scan.instance_edges(scan.scan(sources)).groupBy("module").agg(F.count(F.lit(1)).cast("int").alias("instances"))


@query("""
SELECT 'nat_' || n_nationkey AS module, 'module' AS kind, 'rtl/nat_' || n_nationkey || '.v' AS path FROM nation UNION ALL SELECT DISTINCT 'reg_' || n_regionkey, 'module', 'rtl/reg_' || n_regionkey || '.v' FROM nation
UNION ALL SELECT 'top', 'module', 'rtl/top.v' UNION ALL SELECT 'leaf', 'module', 'rtl/leaf.v' UNION ALL SELECT DISTINCT 'cell_' || lower(substr(c_mktsegment, 1, 4)), 'module', 'rtl/cell_' || lower(substr(c_mktsegment, 1, 4)) || '.v' FROM customer
""")
def q040_module_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module blocks with kind and file."""
    return scan.module_texts(star.rtl(spark, sf_dir)).select("module", "kind", "path")


@query("SELECT 'nat_' || n_nationkey AS module, 'N' AS name, CAST(n_nationkey % 4 AS VARCHAR) AS value FROM nation UNION ALL SELECT 'nat_' || n_nationkey, 'W', CAST(n_nationkey % 4 + 5 AS VARCHAR) FROM nation UNION ALL SELECT 'leaf', 'ID', '0' UNION ALL SELECT DISTINCT 'cell_' || lower(substr(c_mktsegment, 1, 4)), 'K', '1' FROM customer")
def q044_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters after the fixpoint: one is defined by another through a macro."""
    return scan.scan(star.rtl(spark, sf_dir)).select("module", F.explode("parameters").alias("p")).select("module", "p.name", "p.value")


@query(_INSTANCES)
def q047_instance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of all modules, generate loops unrolled and inactive branches left out."""
    return scan.instance_edges(scan.scan(star.rtl(spark, sf_dir))).select("module", "inst", "child")


@query(f"""
SELECT 'nat_' || c_nationkey AS module, 'u_c' || c_custkey AS inst, 'K' AS name, CAST(2 * (c_custkey % 7) + 1 AS VARCHAR) AS value FROM customer WHERE {_LIVE}
UNION ALL SELECT 'nat_' || n_nationkey, 'g[' || i || '].u_l', 'ID', CAST(i * 10 AS VARCHAR) FROM nation, range(0, 4) t(i) WHERE i < n_nationkey % 4
UNION ALL SELECT 'reg_' || n_regionkey, 'u_n' || n_nationkey, 'N', CAST(n_nationkey % 3 AS VARCHAR) FROM nation
""")
def q045_constant_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant expressions in overrides."""
    return scan.instance_edges(scan.scan(star.rtl(spark, sf_dir))).select("module", "inst", F.explode("overrides").alias("name", "value"))


@query(f"SELECT 'nat_' || c_nationkey AS module, 'u_c' || c_custkey AS inst FROM customer WHERE {_LIVE} AND c_mktsegment = 'BUILDING'")
def q048_instance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of one cell, by a filter on the scanned table."""
    return scan.instance_edges(scan.scan(star.rtl(spark, sf_dir))).where("child = 'cell_buil'").select("module", "inst")


@query("""
SELECT p_partkey, CASE WHEN w <= 16 THEN 'u[' || i || ']' ELSE 'u[' || p_size || ':' || (p_partkey % 20) || ']' END AS name
FROM (SELECT *, abs(p_size - p_partkey % 20) + 1 AS w FROM part), range(0, 70) t(i) WHERE (w <= 16 AND i BETWEEN least(p_size, p_partkey % 20) AND greatest(p_size, p_partkey % 20)) OR (w > 16 AND i = 0)
""")
def q049_instance_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance arrays in either direction; ranges over the limit stay literal."""
    p = star.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(scan.expand_array(F.lit("u"), (F.col("p_partkey") % 20).cast("int"), F.col("p_size"), 16)).alias("name"))


_DUPLICATES = "SELECT 'm' || o_custkey AS module, 'u' || (o_orderkey % 3) AS inst, 'c' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END AS child, o_orderkey AS pos FROM orders"


@query(f"""
WITH d AS ({_DUPLICATES}), known AS (SELECT DISTINCT 'c' || c_custkey AS child FROM customer WHERE c_custkey % 2 = 0)
SELECT module, inst, child FROM (SELECT d.*, row_number() OVER (PARTITION BY module, inst ORDER BY (child IN (SELECT child FROM known)) DESC, length(child) DESC, pos) AS n FROM d) WHERE n = 1
""")
def q050_edge_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one instance name an indexed child is preferred, then the longer name, then the first."""
    o = star.table(spark, sf_dir, "orders")
    s = lambda c: c.cast("string")
    child = F.concat(F.lit("c"), F.when(F.col("o_orderkey") % 2 == 0, s(F.col("o_orderkey"))).otherwise(s(F.col("o_custkey"))))
    rows = o.select(F.concat(F.lit("m"), s(F.col("o_custkey"))).alias("module"), F.struct(F.concat(F.lit("u"), s(F.col("o_orderkey") % 3)).alias("inst"), child.alias("child"), F.create_map().cast("map<string,string>").alias("overrides"), F.col("o_orderkey").cast("int").alias("line")).alias("i"))
    grouped = rows.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("i.line").alias("at"), F.struct("i.inst", "i.child", F.col("i.line").alias("line")).alias("x")))), lambda e: F.struct(e["x"]["inst"].alias("inst"), e["x"]["child"].alias("child"), F.create_map().cast("map<string,string>").alias("overrides"), e["x"]["line"].alias("line"))).alias("instances"))
    known = star.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), s(F.col("c_custkey"))).alias("module"), F.array().cast(grouped.schema["instances"].dataType).alias("instances"))
    return scan.instance_edges(grouped.union(known)).select("module", "inst", "child")


@query("SELECT module, CAST(CASE WHEN module LIKE 'cell%' THEN 2 ELSE 1 END AS INTEGER) AS version FROM (SELECT 'nat_' || n_nationkey AS module FROM nation UNION ALL SELECT DISTINCT 'reg_' || n_regionkey FROM nation UNION ALL SELECT 'top' UNION ALL SELECT DISTINCT 'cell_' || lower(substr(c_mktsegment, 1, 4)) FROM customer)")
def q051_incremental_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan patched after the cells' files changed and the leaf's file went."""
    files = star.rtl(spark, sf_dir)
    old = scan.scan(files).select("path", "module").withColumn("version", F.lit(1))
    changed = scan.scan(files.where("path like '%/cell%'")).select("path", "module").withColumn("version", F.lit(2))
    return scan.patch(old, changed, files.where("path like '%/leaf%'")).select("module", "version")


@query(f"""
SELECT 'nat_' || n_nationkey AS module, CAST(k AS INTEGER) AS n, CAST(k AS INTEGER) AS leaves, CAST(k + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND {_LIVE}) AS INTEGER) AS instances FROM nation, range(0, 4) t(k)
UNION ALL SELECT 'reg_' || n_regionkey, k, 0, CAST(count(*) AS INTEGER) FROM nation, range(0, 4) t(k) GROUP BY n_regionkey, k UNION ALL SELECT 'top', k, 0, CAST(count(*) AS INTEGER) FROM region, range(0, 4) t(k) GROUP BY k
UNION ALL SELECT module, k, 0, 0 FROM (SELECT 'leaf' AS module UNION ALL SELECT DISTINCT {_CELL} FROM customer), range(0, 4) t(k)
""")
def q052_under_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module bodies read again under four parameter contexts each."""
    texts = scan.module_texts(star.rtl(spark, sf_dir))
    ctx = F.create_map(F.lit("N"), F.col("k").cast("string"))
    asked = texts.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumns({"ctx": ctx, "ctx_key": F.col("k").cast("string")})
    leaves = F.size(F.filter("instances", lambda i: i["child"] == "leaf"))
    return scan.scan_under(asked).select("module", F.col("ctx_key").cast("int").alias("n"), leaves.alias("leaves"), F.size("instances").alias("instances"))


@query(f"""
SELECT 'nat_' || n_nationkey AS module, 'bus' AS name, 'input' AS direction, CAST(n_nationkey % 4 + 5 + 2 AS INTEGER) AS names FROM nation UNION ALL SELECT 'nat_' || n_nationkey, 'clk', 'input', 1 FROM nation UNION ALL SELECT 'nat_' || n_nationkey, 'y', 'output', 6 FROM nation
UNION ALL SELECT DISTINCT 'reg_' || n_regionkey, p, 'input', 1 FROM nation, (VALUES ('clk'), ('en')) t(p) UNION ALL SELECT 'top', p, 'input', 1 FROM (VALUES ('clk'), ('en')) t(p)
UNION ALL SELECT DISTINCT {_CELL}, p, d, 1 FROM customer, (VALUES ('clk', 'input'), ('d', 'input'), ('q', 'output')) t(p, d) UNION ALL SELECT 'leaf', p, d, 1 FROM (VALUES ('a', 'input'), ('b', 'output')) t(p, d)
""")
def q053_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports of both header styles with directions, and how many names a resolved bus has."""
    return scan.ports(scan.scan(star.rtl(spark, sf_dir))).select("module", "name", "direction", F.size("names").alias("names"))


@query("SELECT 'm' || p_partkey AS module, 'u_chk' AS inst, 'chk' AS child, port, expr FROM part, (VALUES ('a', 'n1'), ('b', 'n2')) t(port, expr)")
def q055_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bind statements as port maps of the module they are bound into."""
    k = F.col("p_partkey").cast("string")
    p = star.table(spark, sf_dir, "part").select(k.alias("path"), F.concat(F.lit("module t"), k, F.lit("; bind m"), k, F.lit(" chk u_chk (.a(n1), .b(n2)); endmodule")).alias("text"))
    return scan.with_binds(scan.scan(p))


@query(f"SELECT 'nat_' || c_nationkey AS module, 'w_' || c_custkey AS name, '' AS dims FROM customer WHERE {_LIVE} UNION ALL SELECT 'nat_' || n_nationkey, 'i', '' FROM nation UNION ALL SELECT DISTINCT 'reg_' || n_regionkey, n, d FROM nation, (VALUES ('clk', ''), ('en', ''), ('b', '[15:0]')) t(n, d)")
def q056_declared_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared nets with resolved dimensions."""
    return scan.nets(scan.scan(star.rtl(spark, sf_dir)))


@query(_PORT_MAPS)
def q057_port_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named connections of instances."""
    return scan.port_maps(scan.scan(star.rtl(spark, sf_dir))).select("module", "inst", "port", "expr")


_LOCAL = f"""
SELECT 'nat_' || c_nationkey AS module, 'w_' || c_custkey AS src, 'y_' || c_custkey AS dst, 'assign' AS kind FROM customer WHERE {_LIVE}
UNION ALL SELECT 'nat_' || c_nationkey, 'y_' || c_custkey, 'r_' || c_custkey, 'ff' FROM customer WHERE {_LIVE}
UNION ALL SELECT 'leaf', 'a', 'b', 'assign' UNION ALL SELECT DISTINCT {_CELL}, 'd', 'q', 'ff' FROM customer
"""


@query(_LOCAL)
def q093_local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver-to-load edges of each module: assigns with masked terms folded away, and registers."""
    return scan.local_edges(scan.scan(star.rtl(spark, sf_dir)))


@query(f"SELECT * FROM ({_LOCAL}) UNION ALL SELECT 'nat_' || c_nationkey, 'bus[0]', 'y_' || c_custkey, 'assign' FROM customer WHERE {_LIVE}")
def q095_grep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text view: every name on a right side counts."""
    return scan.local_edges(scan.scan(star.rtl(spark, sf_dir), fold_constants=False))


@query(f"SELECT * FROM ({_LOCAL}) WHERE kind <> 'ff'")
def q098_register_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without register edges."""
    return scan.local_edges(scan.scan(star.rtl(spark, sf_dir)), include_ff=False)


@query("SELECT 'g' || (p_partkey % 100) AS module, 'i' || p_partkey AS src, 'o' || p_partkey AS dst, 'gate' AS kind FROM part UNION ALL SELECT 'g' || (p_partkey % 100), 'j' || p_partkey, 'o' || p_partkey, 'gate' FROM part")
def q099_primitive_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitive gates: the first pin is driven by the others."""
    k = F.col("p_partkey").cast("string")
    s = F.lit
    gate = F.concat(s("  and x"), k, s(" (o"), k, s(", i"), k, s(", j"), k, s(");\n"))
    m = F.concat(s("g"), (F.col("p_partkey") % 100).cast("string"))
    p = star.table(spark, sf_dir, "part").groupBy(m.alias("path")).agg(F.array_join(F.array_sort(F.collect_list(gate)), "").alias("body"))
    return scan.local_edges(scan.scan(p.select("path", F.concat(s("module "), "path", s(";\n"), "body", s("endmodule\n")).alias("text"))))


@query("SELECT 'm' || p_partkey AS module, x.src, 'y' AS dst, 'comb' AS kind FROM part, (SELECT 0 AS k, 'b' AS src UNION ALL SELECT 0, 'c' UNION ALL SELECT 1, 'c' UNION ALL SELECT 2, 'e' UNION ALL SELECT 2, 'f') x WHERE x.k = p_partkey % 3")
def q097_comb_case_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinational blocks: the last assignment wins, unknown conditions join both arms, constant ones fold."""
    k = F.col("p_partkey").cast("string")
    body = F.when(F.col("p_partkey") % 3 == 0, "y = a; if (s) y = b; else y = c;").when(F.col("p_partkey") % 3 == 1, "if (0) y = b; else y = c;").otherwise("case (s) 1: y = e; default: y = f; endcase")
    p = star.table(spark, sf_dir, "part").select(k.alias("path"), F.concat(F.lit("module m"), k, F.lit("; always_comb begin "), body, F.lit(" end endmodule")).alias("text"))
    return scan.local_edges(scan.scan(p))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, l_returnflag AS kind FROM lineitem WHERE l_partkey <> l_suppkey")
def q061_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal edges once, none from a node to itself."""
    e = star.table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("src"), F.greatest("l_partkey", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return graph.dedup_edges(e)


@query("""
WITH e AS (SELECT DISTINCT 'p' || (l_partkey % 500) AS src, 's' || l_suppkey AS dst FROM lineitem), el AS (SELECT DISTINCT 'p' || (l_partkey % 500) AS net, '[' || (l_quantity % 4)::INT || ']' AS sel FROM lineitem WHERE l_linenumber = 1 UNION SELECT DISTINCT 's' || l_suppkey, '[' || (l_quantity % 3)::INT || ']' FROM lineitem WHERE l_linenumber = 2)
SELECT src, dst, 'port' AS kind FROM e UNION ALL SELECT DISTINCT src || a.sel, dst || a.sel, 'port' FROM e JOIN el a ON a.net = e.src JOIN el b ON b.net = e.dst AND a.sel = b.sel
""")
def q062_element_mirroring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole port edges repeated for the elements that both ends have."""
    li = star.table(spark, sf_dir, "lineitem")
    p, s = F.concat(F.lit("p"), (F.col("l_partkey") % 500).cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    sel = lambda n: F.concat(F.lit("["), (F.col("l_quantity") % n).cast("int").cast("string"), F.lit("]"))
    e = li.select(p.alias("src"), s.alias("dst"), F.lit("port").alias("kind")).distinct()
    el = li.where("l_linenumber = 1").select(p.alias("net"), sel(4).alias("sel")).union(li.where("l_linenumber = 2").select(s, sel(3))).distinct()
    return graph.mirror_elements(e, el).distinct()


@query(f"""
SELECT 'nat_' || n_nationkey AS module, CAST(2 + 4 * (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND {_LIVE}) AS INTEGER) AS statements, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND {_LIVE}) AS INTEGER) AS assigns FROM nation
UNION ALL SELECT 'reg_' || n_regionkey, CAST(3 + count(*) AS INTEGER), 0 FROM nation GROUP BY n_regionkey UNION ALL SELECT 'top', CAST(count(*) AS INTEGER), 0 FROM region UNION ALL SELECT DISTINCT {_CELL}, 1, 0 FROM customer UNION ALL SELECT 'leaf', 1, 1
""")
def q042_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level statements of each module; blocks and loops are one each."""
    got = scan.statements(scan.module_texts(star.rtl(spark, sf_dir)))
    return got.groupBy("module").agg(F.count(F.lit(1)).cast("int").alias("statements"), F.count_if(F.col("kind") == "assign").cast("int").alias("assigns"))


@query("SELECT 'f' || p_partkey AS path, 's = \"//' || p_brand || '\"; ' || chr(10) || repeat(' ', 3 + length(p_type)) || chr(10) || '    x' AS text FROM part")
def q028_blank_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string-aware strip: strings stay, block comments become blanks and keep their line ends."""
    p = star.table(spark, sf_dir, "part")
    text = F.concat(F.lit('s = "//'), "p_brand", F.lit('"; // c\n/* '), "p_type", F.lit("\n */ x"))
    return scan.blank_comments(p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), text.alias("text")))


@query("SELECT p_partkey, 'a' || p_partkey || ',bus[' || p_size || '],u.q[3:0],s' AS nodes FROM part")
def q058_connect_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of an expression with their selects, literals left out."""
    k, w = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    e = F.concat(F.lit("(a"), k, F.lit(" & 8'hF0) | bus["), w, F.lit("] ? u.q[3:0] : {s, 2'b1x, bus["), w, F.lit("], 12}"))
    return star.table(spark, sf_dir, "part").select("p_partkey", F.array_join(scan.connect_nodes(e), ",").alias("nodes"))


@query(f"""
SELECT * FROM ({_LOCAL}) UNION ALL SELECT 'nat_' || c_nationkey, 'bus[0]', 'y_' || c_custkey, 'assign' FROM customer WHERE {_LIVE}
UNION ALL SELECT module, expr, inst || '.' || port, 'port' FROM ({_PORT_MAPS})
""")
def q059_dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges of each file's first module: actuals drive formals."""
    return scan.dependency_edges(star.rtl(spark, sf_dir)).select("module", "src", "dst", "kind")


@query("SELECT 'm' || p_partkey AS module, 'k' || p_partkey AS src, 'z' AS dst, 'assign' AS kind FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'm' || p_partkey, 'a', 'b', 'assign' FROM part")
def q096_constant_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets tied to constants carry nothing on."""
    k = F.col("p_partkey").cast("string")
    tie = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("assign k"), k, F.lit(" = 2'b01;")))
    p = star.table(spark, sf_dir, "part").select(k.alias("path"), F.concat(F.lit("module m"), k, F.lit("; supply0 gnd; assign b = a; assign y = gnd; assign z = k"), k, F.lit(";"), tie, F.lit(" endmodule")).alias("text"))
    return scan.local_edges(scan.scan(p))


@query("SELECT p_partkey, p_size % 3 = 0 AS exact, p_size % 3 = 0 OR p_size % 3 = 1 AS any_index, p_size % 3 < 2 AND p_partkey % 10 = 4 AS by_glob FROM part")
def q054_port_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port names against exact patterns (whatever the case) and bracket globs."""
    from gatelake.functions import patterns as P

    name = F.concat(F.lit("Data"), (F.col("p_partkey") % 10).cast("string"))
    port = F.when(F.col("p_size") % 3 == 0, F.concat(name, F.lit("[0]"))).when(F.col("p_size") % 3 == 1, F.concat(name, F.lit("["), F.col("p_size").cast("string"), F.lit("]"))).otherwise(name)
    same = lambda: F.lower(port) == F.lower(F.concat(name, F.lit("[0]")))
    return star.table(spark, sf_dir, "part").select("p_partkey", (P.matches_port(F.replace(port, name, F.lit("Data")), "DATA[0]") & same()).alias("exact"), P.matches_port(port, "Data?[*]").alias("any_index"), P.matches_port(port, "*4[*]").alias("by_glob"))
