"""Queries over modes and hand-overs: second list dialect, whole preprocessing, path-scoped reading, cache tiers, connect index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.catalog import query
from gatelake.operators import graph, hierarchy, scan
from gatelake.plans.frontier import elaborate
from gatelake.plans.store import fresh_path, keep
from gatelake.queries.hierarchy import _EXIST, _names, _specs
from gatelake.sources import cache, filelist, rtl, sinks, star


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _text(*parts: Column | str) -> Column:
    """A concatenation; texts are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""
SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INTEGER) AS pos, 'lists/r' || n_regionkey || '/rtl/nat_' || n_nationkey || '.v' AS path, 'lists/r' || n_regionkey || '/region.f' AS via_filelist FROM nation
""")
def q002_second_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the second dialect the entries of a list named by -F follow that list's directory."""
    nations = sorted((r[0], r[1]) for r in star.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect())
    texts = {"lists/top.f": "".join(f"-F lists/r{r}/region.f\n" for r in sorted({r for r, _ in nations}))}
    for r, n in nations:
        texts[f"lists/r{r}/region.f"] = texts.get(f"lists/r{r}/region.f", "") + f"rtl/nat_{n}.v\n"
    return filelist.tables(spark, filelist.expand("lists/top.f", read=texts.get, dialect="second"))["sources"].drop("chain")


@query("SELECT 'n' || n_nationkey AS name, CAST(length('module nat_' || n_nationkey || '; // ' || n_name) AS INTEGER) AS n FROM nation")
def q006_directory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of folders read whole; without recursion there is nothing at its top."""
    root = fresh_path(spark, "rtl_folder")
    text = star.table(spark, sf_dir, "nation").select(_text("module nat_", _s("n_nationkey"), "; // ", F.col("n_name")).alias("text"), _text("n", _s("n_nationkey")).alias("name"))
    text.write.partitionBy("name").option("lineSep", "\u0003").text(root)
    got = rtl.read_directory(spark, root, pattern="*.txt")
    return got.select(F.regexp_extract("path", r"name=([^/]*)/", 1).alias("name"), F.length(F.rtrim(F.replace("text", F.lit("\u0003"), F.lit("")))).alias("n"))


@query("SELECT c_custkey, 'walked ' || c_nationkey AS note, 'validated' AS tier FROM customer")
def q016_walk_cache_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiers under one key: the most trusted that is there is read, and an unknown key has none."""
    c = star.table(spark, sf_dir, "customer")
    name = fresh_path(spark, "walk").rsplit("/", 1)[1]
    for tier, word in (("regex", "seen "), ("validated", "walked "), ("preprocessed", "read ")):
        cache.put_tier(c.select("c_custkey", _text(word, _s("c_nationkey")).alias("note")), name, "k1", tier)
    got, tier = cache.best_tier(spark, name, "k1")
    assert cache.best_tier(spark, name, "k2") == (None, None)
    return got.withColumn("tier", F.lit(tier))


@query("SELECT o_orderkey AS check_id, CASE WHEN o_orderstatus = 'F' THEN 'walk' ELSE 'gate' END AS phase FROM orders UNION ALL SELECT -c_custkey, 'walk' FROM customer")
def q025_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate hands to the walk: later rows replace those of their check, new ones come in; written and read again.

    A check is named by its table and key: order 0 and customer 0 have the same number.
    """
    check = lambda kind, key: F.format_string(f"{kind} %s", key).alias("check")
    o = star.table(spark, sf_dir, "orders").select(check("order", "o_orderkey"), F.col("o_orderkey").alias("check_id"), "o_orderstatus")
    c = star.table(spark, sf_dir, "customer").select(check("customer", "c_custkey"), (-F.col("c_custkey")).alias("check_id"), F.lit("walk").alias("phase"))
    new = o.where("o_orderstatus = 'F'").select("check", "check_id", F.lit("walk").alias("phase")).union(c)
    path = fresh_path(spark, "handoff")
    sinks.write_json(sinks.upsert(o.select("check", "check_id", F.lit("gate").alias("phase")), new, "check"), path, "v1")
    return sinks.read_json(spark, path, "check_id bigint, phase string", "v1")


@query("SELECT p_partkey, 'assign y = ' || CASE WHEN p_size % 2 = 0 THEN 'a' || p_partkey ELSE 'b' END || ' ;' AS active, 'assign y = a' || p_partkey || ' b ;' AS every FROM part")
def q031_inline_ifdef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives in the middle of a line: the active branch, and the mode that keeps all branches."""
    k = _s("p_partkey")
    defines = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("FAST"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    p = star.table(spark, sf_dir, "part").select(k.alias("path"), _text("assign y = `ifdef FAST a", k, " `else b `endif ;").alias("text"), defines.alias("defines"))
    words = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    on = scan.preprocess(p).select("path", words("text").alias("active"))
    every = scan.preprocess(p, preserve=True).select("path", words("text").alias("every"))
    return on.join(every, "path").select(F.col("path").cast("bigint").alias("p_partkey"), "active", "every")


@query("SELECT p_partkey, 'wire [' || p_size || '+1:0] x = 3 + `SUM; `NONE' AS text FROM part")
def q036_macro_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros in macros; a value that starts with a parenthesis, and an unknown name, stay as they are written."""
    k = _s("p_partkey")
    text = _text("`define W ", _s("p_size"), "\n`define TOP `W+1\n`define SUM (1+2)\nwire [`TOP:0] x = 3 + `SUM; `NONE")
    got = scan.preprocess(star.table(spark, sf_dir, "part").select(k.alias("path"), text.alias("text")))
    return got.select(F.col("path").cast("bigint").alias("p_partkey"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query("SELECT 'src/p' || p_partkey || '.v' AS path, CASE WHEN p_size <= 40 THEN 'wire base; wire [' || (p_size * 2) || ':0] x;' ELSE 'wire [`WIDTH:0] x;' END AS text FROM part")
def q037_whole_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes put in, through a header that includes another one; headers above 40 are not there."""
    p = star.table(spark, sf_dir, "part")
    sources = p.select(_text("src/p", _s("p_partkey"), ".v").alias("path"), _text('`include "h', _s("p_size"), '.vh"\nwire [`WIDTH:0] x;').alias("text"))
    own = spark.range(1, 41).select(_text("inc/h", _s("id"), ".vh").alias("path"), _text("`include <common.vh>\n`define WIDTH ", (F.col("id") * 2).cast("string"), "\n").alias("text"))
    headers = own.union(spark.createDataFrame([("inc/common.vh", "`ifndef ONCE\n`define ONCE\nwire base;\n`endif\n")], "path string, text string"))
    got = scan.preprocess(scan.with_includes(sources, headers, ["inc"]))
    return got.select("path", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query("SELECT 'leaf' AS module, 'module leaf#(parameter ID=0)(input a,output b)' AS header UNION ALL SELECT DISTINCT 'cell_' || lower(substr(c_mktsegment, 1, 4)), 'module cell_' || lower(substr(c_mktsegment, 1, 4)) || '#(parameter K=1)(input clk,input d,output reg q)' FROM customer UNION ALL SELECT 'reg_' || r_regionkey, 'module reg_' || r_regionkey || '(clk,en)' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'top', 'module top(input clk,input en)' UNION ALL SELECT 'nat_' || n_nationkey, 'module nat_' || n_nationkey || '#(parameter N=' || (n_nationkey % 4) || ',parameter W=N+5)(input clk,input[W-1:0]bus,output reg[3:0]y)' FROM nation")
def q041_header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of all modules, apart from their bodies."""
    return scan.module_headers(scan.module_texts(star.rtl(spark, sf_dir))).select("module", "header")


@query("SELECT 'm' || p_partkey AS module, 'g[' || i || '].u_l' AS inst FROM part, range(0, 50) t(i) WHERE i < p_size UNION ALL SELECT 'm' || p_partkey, CASE WHEN p_size > 25 THEN 'u_big' ELSE 'u_small' END FROM part")
def q043_generate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops unrolled under a parameter, and the branch that its value takes."""
    k = _s("p_partkey")
    text = _text("module m", k, " #(parameter N = ", _s("p_size"), ") (input a); genvar i; generate for (i = 0; i < N; i = i + 1) begin : g leaf u_l (.a(a)); end if (N > 25) big u_big (.a(a)); else small u_small (.a(a)); endgenerate endmodule")
    part = star.table(spark, sf_dir, "part")
    part = part.repartition(max(spark.sparkContext.defaultParallelism, part.count() // 5_000), "p_partkey")  # few files hold the keys of many modules
    got = keep(scan.scan(part.select(k.alias("path"), text.alias("text"))).select("module", "instances"))  # read twice below
    return scan.instance_edges(got).select("module", "inst")


@query("SELECT 'm' || p_partkey AS module, x.name, x.value FROM part, LATERAL (SELECT 'A' AS name, CAST(p_size AS VARCHAR) AS value UNION ALL SELECT 'B', CAST(p_size * 2 AS VARCHAR) UNION ALL SELECT 'C', CAST(p_size * 3 + 1 AS VARCHAR) UNION ALL SELECT 'D', CAST(p_size * 3 + 2 AS VARCHAR)) x")
def q046_parameter_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that stand before what they are made of settle in rounds."""
    k = _s("p_partkey")
    text = _text("module m", k, " #(parameter D = C + 1, parameter C = A + B + 1, parameter B = A * 2, parameter A = ", _s("p_size"), ") (input a); endmodule")
    got = scan.scan(star.table(spark, sf_dir, "part").select(k.alias("path"), text.alias("text")))
    return got.select("module", F.explode("parameters").alias("p")).select("module", "p.name", "p.value")


@query("""
WITH e AS (SELECT DISTINCT 'top.u' || (o_custkey % 50) AS h, 'd' || (o_orderkey % 7) AS b, '[' || (o_orderkey % 4) || ']' AS s, 'top.v' || (o_orderkey % 50) AS h2, CASE WHEN o_orderstatus = 'F' THEN 'port' ELSE 'assign' END AS kind FROM orders)
SELECT h AS src_hier, b AS src_base, s AS src_sel, h2 AS dst_hier, 'q' AS dst_base, '' AS dst_sel, kind FROM e UNION SELECT h, b, '', h2, 'q', '', kind FROM e WHERE kind = 'port'
UNION SELECT h, b, s, h, b, '', 'array_el' FROM e UNION SELECT h, b, '', h, b, s, 'array_el' FROM e
""")
def q060_elaborated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net edges keyed by hierarchy, net and select, with the edges between elements and whole nets; a select that is no number falls back to the whole net."""
    o = star.table(spark, sf_dir, "orders")
    m = lambda c, n: (F.col(c) % n).cast("string")
    edges = o.select(_text("top.u", m("o_custkey", 50), ".d", m("o_orderkey", 7), "[", m("o_orderkey", 4), "]").alias("src"), _text("top.v", m("o_orderkey", 50), ".q[W-1]").alias("dst"), F.when(F.col("o_orderstatus") == "F", "port").otherwise("assign").alias("kind"))
    part = lambda c: [F.col(f"{c}.{f}").alias(f"{c}_{f}") for f in ("hier", "base", "sel")]
    return graph.elaborated_graph(edges).select(*part("src"), *part("dst"), "kind")


_WALK = "SELECT 'top.u_r' || n_regionkey || '.u_n' || n_nationkey || x.tail AS path, x.ok AS ok FROM nation, (VALUES ('.bus[2:0]', true), ('.nothing', false), ('', true)) x(tail, ok) WHERE n_regionkey = 1"


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources = keep(star.rtl(spark, sf_dir).select("path", "text"))
    n = star.table(spark, sf_dir, "nation").where("n_regionkey = 1")
    specs = n.select(F.explode(F.array(*[_text("top.u_r1.u_n", _s("n_nationkey"), t) for t in (".bus[2:0]", ".nothing", "")])).alias("path"))
    return hierarchy.walk_files(sources, scan.declared_modules(sources), specs, top="top")


@query(_WALK)
def q069_path_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs below one region, walked by reading the files on their way."""
    return _walked(spark, sf_dir)[0].select("path", "ok")


@query("SELECT 'nat_' || n_nationkey AS module, 'rtl/nat_' || n_nationkey || '.v' AS path FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'top', 'rtl/top.v' UNION ALL SELECT 'reg_1', 'rtl/reg_1.v'")
def q069b_files_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that such a walk opens: none of the other regions."""
    return _walked(spark, sf_dir)[1]


_CANDIDATES = "c AS (SELECT 'm' || (p_partkey % 300) AS module, 'rtl/b' || (p_size % 5) || '/p' || p_partkey || '.v' AS path, p_size % 5 AS b FROM part)"


@query(f"""
WITH {_CANDIDATES}, asked AS (SELECT 'm' || k AS module FROM range(0, 320) t(k)), n AS (SELECT module, count(*) AS n, min(path) AS single, min_by(path, CASE WHEN b = 2 THEN '0' ELSE '1' END || path) AS near FROM c GROUP BY 1)
SELECT a.module, p.policy, CASE WHEN n.n = 1 THEN single WHEN p.policy = 'recovery' THEN near END AS path, CASE WHEN n.n IS NULL THEN 'missing' WHEN n.n = 1 THEN 'confident' WHEN p.policy = 'recovery' THEN 'recovered' ELSE 'deferred' END AS status
FROM asked a LEFT JOIN n ON n.module = a.module, (VALUES ('confident'), ('recovery')) p(policy)
""")
def q070_child_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file a child is read from: one is taken, several are deferred or settled by nearness, none is missing."""
    p = star.table(spark, sf_dir, "part")
    found = p.select(_text("m", (F.col("p_partkey") % 300).cast("string")).alias("module"), _text("rtl/b", (F.col("p_size") % 5).cast("string"), "/p", _s("p_partkey"), ".v").alias("path"))
    asked = spark.range(320).select(_text("m", _s("id")).alias("module"), F.lit("rtl/b2/x.v").alias("anchor"))
    got = [hierarchy.resolve_child(asked, found, policy=x).withColumn("policy", F.lit(x)) for x in ("confident", "recovery")]
    return got[0].unionByName(got[1]).drop("anchor")


@query(_EXIST)
def q075_cached_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All specs against the instance table that is there already."""
    return hierarchy.exist_cached(star.flat_rows(spark, sf_dir), _names(spark, sf_dir), _specs(spark, sf_dir))


@query("""
WITH c AS (SELECT 'top.u_r' || n_regionkey || '.u_n' || n_nationkey AS up, c_custkey AS k, c_acctbal >= 0 AS live FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT up || '.w_' || k AS path, CASE WHEN live THEN 'net' ELSE 'tail' END AS kind FROM c UNION SELECT up || '.u_c' || k, CASE WHEN live THEN 'instance' ELSE 'tail' END FROM c
UNION SELECT up || '.u_c' || k || '.q', CASE WHEN live THEN 'port' ELSE 'miss' END FROM c UNION SELECT up || '.bus', 'port' FROM c
""")
def q078_scanned_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets, instances and ports found in the scanned tables of the rendered design."""
    got = keep(scan.scan(star.rtl(spark, sf_dir)))
    rows = keep(elaborate(keep(scan.instance_edges(got).select("module", "inst", "child")), got.where("module = 'top'").select("module")))
    c = star.table(spark, sf_dir, "customer").join(F.broadcast(star.table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    up, k = _text("top.u_r", _s("n_regionkey"), ".u_n", _s("n_nationkey")), _s("c_custkey")
    ends = c.select(F.explode(F.array(_text(up, ".w_", k), _text(up, ".u_c", k), _text(up, ".u_c", k, ".q"), _text(up, ".bus"))).alias("path"))
    return hierarchy.resolve_endpoints(rows, scan.ports(got), scan.nets(got), ends).select("path", "kind")


_MASKED = ("a + 0", "a - a", "a * 1", "a ^ a", "a & a", "a & ~a", "a | ~a", "a * 0", "a & 0", "a | b", "8'h3", "(1'b1) ? a : b")


@query("SELECT 'm' || p_partkey AS module, x.src FROM part, (VALUES (9, 'a'), (9, 'b'), (11, 'a')) x(k, src) WHERE x.k = p_partkey % 12")
def q094_constant_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a constant folds away give no edge: sums with 0, products with 1 and 0, a net with itself or its inverse."""
    k = _s("p_partkey")
    rhs = F.element_at(F.array(*[F.lit(x) for x in _MASKED]), (F.col("p_partkey") % 12 + 1).cast("int"))
    p = star.table(spark, sf_dir, "part").select(k.alias("path"), _text("module m", k, " (input [7:0] a, input [7:0] b, output [7:0] y); assign y = ", rhs, "; endmodule").alias("text"))
    return scan.local_edges(scan.scan(p)).where("dst = 'y'").select("module", "src")


@query("""
WITH live AS (SELECT n_nationkey AS n, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) AS INTEGER) AS c FROM nation)
SELECT 'nat_' || n AS module, CAST(k AS INTEGER) AS n, f AS folded, CAST(c * CASE WHEN f THEN 2 ELSE 3 END AS INTEGER) AS edges, CAST(3 * c + 2 * k AS INTEGER) AS maps FROM live, range(0, 4) t(k), (VALUES (true), (false)) x(f)
""")
def q104_connect_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connect index of the nations' modules under four parameter contexts, with and without folding."""
    texts = scan.module_texts(star.rtl(spark, sf_dir)).where("module like 'nat%'")
    asked = keep(texts.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumns({"ctx": F.create_map(F.lit("N"), F.col("k").cast("string")), "ctx_key": F.col("k").cast("string")}))
    got = scan.connect_index(asked, flags=((True, True), (True, False)))
    return got.select("module", F.col("ctx_key").cast("int").alias("n"), F.col("fold_constants").alias("folded"), F.size("edges").alias("edges"), F.size("port_maps").alias("maps"))


@query("SELECT 'fanout' AS kind, 'top.u' || o_custkey AS scope, 'n' || o_orderkey AS net, '' AS module, o_orderpriority AS detail, '' AS rtl, '' AS via_filelist, 'a.f -> b.f' AS filelist_chain FROM orders UNION ALL SELECT 'summary', CAST(count(*) AS VARCHAR), '', '', '', '', '', '' FROM orders")
def q022b_cone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cone report with its summary row."""
    o = star.table(spark, sf_dir, "orders").select(F.lit("fanout").alias("kind"), _text("top.u", _s("o_custkey")).alias("scope"), _text("n", _s("o_orderkey")).alias("net"), F.col("o_orderpriority").alias("detail"), F.array(F.lit("a.f"), F.lit("b.f")).alias("filelist_chain"))
    return sinks.with_summary(o, sinks.CONE_COLUMNS)


@query("SELECT c_custkey AS check_id, c_custkey + 100 AS b, c_custkey + 100 <= (SELECT max(c_custkey) FROM customer) AS connected, CASE WHEN c_custkey + 100 <= (SELECT max(c_custkey) FROM customer) THEN 100 END AS hops FROM customer WHERE c_custkey % 101 = 1")
def q106b_far_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends a hundred hops apart on chains of customers: nothing but the graph ends the search."""
    c = star.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    following = c.select((k - 1).alias("src"), k.alias("dst")).where("src % 101 <> 0")
    checks = c.where("c_custkey % 101 = 1").select(k.alias("check_id"), k.alias("a"), (k + 100).alias("b"))
    return graph.connected(checks, following, directed=True).select("check_id", "b", "connected", F.col("hops").cast("int").alias("hops"))
