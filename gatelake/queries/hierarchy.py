"""Queries over the instance tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.catalog import query
from gatelake.functions import columns as C
from gatelake.operators import hierarchy, scan
from gatelake.plans.frontier import elaborate, expand
from gatelake.plans.store import keep
from gatelake.sources import star

_TREE = star.FLAT_ROWS_SQL


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(star.module_edges(spark, sf_dir))


def _top(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("top",)], "module string")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


@query(_TREE + "SELECT full_path, inst_leaf, module, depth, parent_path, '' AS stop_reason FROM tree")
def q063_elaborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole instance tree from its top, level by level."""
    return elaborate(_edges(spark, sf_dir), _top(spark))


@query(_TREE + "SELECT full_path, module, depth FROM tree WHERE depth <= 2")
def q063b_elaborate_to_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree down to a depth."""
    return elaborate(_edges(spark, sf_dir), _top(spark), max_depth=2).select("full_path", "module", "depth")


@query("SELECT t.full_path, t.module FROM (VALUES ('loop_a', 'loop_a'), ('loop_a.u_b', 'loop_b'), ('loop_a.u_b.u_a', 'loop_a')) t(full_path, module)")
def q063c_recursion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that contain each other stop at the first that comes back."""
    edges = spark.createDataFrame([("loop_a", "u_b", "loop_b"), ("loop_b", "u_a", "loop_a")], "module string, inst string, child string")
    return elaborate(edges, spark.createDataFrame([("loop_a",)], "module string")).select("full_path", "module")


@query(f"WITH RECURSIVE module_edges AS ({star.MODULE_EDGES_SQL}), walk(full_path, module) AS (SELECT 'reg_' || r_regionkey, 'reg_' || r_regionkey FROM region UNION ALL SELECT w.full_path || '.' || e.inst, e.child FROM walk w JOIN module_edges e ON e.module = w.module) SELECT full_path, module FROM walk")
def q064_elaborate_many_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several tops as seeds of one loop."""
    tops = star.table(spark, sf_dir, "region").select(F.concat(F.lit("reg_"), _s("r_regionkey")).alias("module"))
    return elaborate(_edges(spark, sf_dir), tops).select("full_path", "module")


@query(f"WITH module_edges AS ({star.MODULE_EDGES_SQL}), names AS (SELECT module AS name FROM module_edges UNION SELECT 'cus_' || c_custkey FROM customer UNION SELECT 'spare_' || n_nationkey FROM nation) SELECT name AS module FROM names WHERE name NOT IN (SELECT child FROM module_edges)")
def q065_top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that nothing instantiates, by an anti join."""
    edges = star.module_edges(spark, sf_dir)
    spare = star.table(spark, sf_dir, "nation").select(F.concat(F.lit("spare_"), _s("n_nationkey")))
    customers = star.table(spark, sf_dir, "customer").select(F.concat(F.lit("cus_"), _s("c_custkey")))
    return hierarchy.top_modules(edges.select("module").union(customers).union(spare), edges)


@query(_TREE + "SELECT full_path, depth FROM flat_rows f WHERE EXISTS (SELECT 1 FROM flat_rows g WHERE g.module IN (SELECT 'cus_' || c_custkey FROM customer WHERE c_acctbal > 5000) AND (g.full_path = f.full_path OR starts_with(g.full_path, f.full_path || '.')))")
def q066_scoped_elaboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what leads to the endpoints is opened: a semi join inside the loop."""
    rich = star.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("cus_"), _s("c_custkey")).alias("module"))
    ends = star.flat_rows(spark, sf_dir).join(rich, "module", "left_semi").select(F.concat("full_path", F.lit("[3:0]")).alias("path"))
    return elaborate(_edges(spark, sf_dir), _top(spark), scope=keep(hierarchy.scope_paths(ends))).select("full_path", "depth")


@query("""
SELECT 'top.u_r' || n_regionkey || '.u_n' || n_nationkey AS full_path, 'N' AS name, CAST(n_nationkey % 3 AS VARCHAR) AS value FROM nation
UNION ALL SELECT 'top.u_r' || n_regionkey || '.u_n' || n_nationkey, 'W', CAST(n_nationkey % 3 + 5 AS VARCHAR) FROM nation
UNION ALL SELECT 'top.u_r' || n_regionkey || '.u_n' || n_nationkey || '.g[' || i || '].u_l', 'ID', CAST(i * 10 AS VARCHAR) FROM nation, range(0, 3) t(i) WHERE i < n_nationkey % 3
UNION ALL SELECT 'top.u_r' || n_regionkey || '.u_n' || n_nationkey || '.u_c' || c_custkey, 'K', CAST(2 * (c_custkey % 7) + 1 AS VARCHAR) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0
""")
def q067_parameter_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered text elaborated with parameters passed down: overrides change what the loops unroll to."""
    got = hierarchy.elaborate_parameters(scan.module_texts(star.rtl(spark, sf_dir)), _top(spark))
    return got.select("full_path", F.explode("param_ctx").alias("name", "value"))


@query(_TREE + "SELECT c.full_path AS path, string_agg(a.full_path || '@' || a.module, ' > ' ORDER BY a.depth) AS chain FROM flat_rows c JOIN flat_rows a ON c.full_path = a.full_path OR starts_with(c.full_path, a.full_path || '.') WHERE c.depth = 3 GROUP BY 1")
def q068_path_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of instances from the root to each path."""
    from gatelake.sources.sinks import path_chain_text

    rows = star.flat_rows(spark, sf_dir)
    got = hierarchy.path_chain(rows, rows.where("depth = 3").select(F.col("full_path").alias("path")))
    return got.select("path", path_chain_text(F.col("chain")).alias("chain"))


@query("""
WITH c AS (SELECT p_brand AS module, 'rtl/' || lower(split_part(p_type, ' ', 1)) || '/' || (p_size % 3) || '/p' || p_partkey || '.v' AS path, lower(split_part(p_type, ' ', 1)) AS a, p_size % 3 AS b FROM part)
SELECT module, path, CAST(CASE WHEN a = 'small' AND b = 1 THEN 0 WHEN a = 'small' THEN 2 ELSE 4 END AS INTEGER) AS distance FROM c
""")
def q071_listing_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree distance of each candidate's folder from an anchor's."""
    p = star.table(spark, sf_dir, "part")
    path = F.concat(F.lit("rtl/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("/"), (F.col("p_size") % 3).cast("string"), F.lit("/p"), _s("p_partkey"), F.lit(".v"))
    got = hierarchy.nearest_listing(p.select(F.col("p_brand").alias("module"), path.alias("path")), F.lit("rtl/small/1/x.v"))
    return got.select("module", "path", F.col("distance").cast("int").alias("distance"))


_SPECS_SQL = "specs AS (SELECT 'top.u_r' || n_regionkey || '.u_n' || n_nationkey || '.u_c' || (c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) || CASE WHEN c_custkey % 3 = 0 THEN '.acctbal' WHEN c_custkey % 3 = 1 THEN '' ELSE '.nothing' END AS path, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _specs(spark: SparkSession, sf_dir: str, sep: str = ".") -> DataFrame:
    c = star.table(spark, sf_dir, "customer").join(F.broadcast(star.table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    k = (F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)).cast("string")
    tail = F.when(F.col("c_custkey") % 3 == 0, sep + "acctbal").when(F.col("c_custkey") % 3 == 1, "").otherwise(sep + "nothing")
    lead = "/top/u_r" if sep == "/" else "top.u_r"
    return c.select(F.concat(F.lit(lead), _s("n_regionkey"), F.lit(f"{sep}u_n"), _s("n_nationkey"), F.lit(f"{sep}u_c"), k, tail).alias("path"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "customer").select(F.concat(F.lit("cus_"), _s("c_custkey")).alias("module"), F.lit("acctbal").alias("name"))


_EXIST = _TREE + f""", {_SPECS_SQL}
SELECT DISTINCT path, (inst IN (SELECT full_path FROM flat_rows)) AND NOT ends_with(path, '.nothing') AS ok FROM (SELECT path, regexp_replace(path, '\\.(acctbal|nothing)$', '') AS inst FROM specs)
"""


@query(_EXIST)
def q076_batch_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths walked hop by hop in one loop; the last segment may be a signal."""
    return hierarchy.exist(_edges(spark, sf_dir), _names(spark, sf_dir), _specs(spark, sf_dir), top="top").select("path", "ok")


@query(_EXIST.replace("SELECT DISTINCT path,", "SELECT DISTINCT '/' || replace(path, '.', '/') AS path,"))
def q073_slash_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with slashes."""
    return hierarchy.exist(_edges(spark, sf_dir), _names(spark, sf_dir), _specs(spark, sf_dir, "/"), top="top", slash=True).select("path", "ok")


@query("""
WITH RECURSIVE step AS (SELECT DISTINCT 'm' || (o_custkey % 40) AS module, 'u' || (o_orderkey % 5) AS inst, 'm' || (o_orderkey % 40) AS child FROM orders),
walk(spec, hop, module) AS (SELECT s, 0, 'm' || s FROM range(0, 40) t(s) UNION SELECT w.spec, w.hop + 1, e.child FROM walk w JOIN step e ON e.module = w.module AND e.inst = 'u' || ((w.spec + w.hop) % 5) WHERE w.hop < 2)
SELECT CAST(spec AS INTEGER) AS spec, CAST(hop AS INTEGER) AS hop, count(DISTINCT module) AS candidates, count(DISTINCT module) > 1 AS ambiguous FROM walk GROUP BY 1, 2
""")
def q072_ambiguous_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk that branches where several candidates survive a hop; more than one is ambiguous."""
    o = star.table(spark, sf_dir, "orders")
    m = lambda c: F.concat(F.lit("m"), (F.col(c) % 40).cast("string"))
    e = o.select(m("o_custkey").alias("src"), (F.col("o_orderkey") % 5).cast("int").alias("seg"), m("o_orderkey").alias("dst")).distinct()
    seeds = spark.range(40).select(F.col("id").cast("int").alias("label"), F.concat(F.lit("m"), _s("id")).alias("node"), F.lit(0).alias("at"))
    step = lambda f, e: f.join(e, (f["node"] == e["src"]) & (e["seg"] == (f["label"] + f["at"]) % 5)).select("label", F.col("dst").alias("node"), (F.col("at") + 1).alias("at"))
    got = expand(seeds, keep(e), key=("label", "node", "at"), step=step, max_hops=2)
    return got.groupBy(F.col("label").alias("spec"), F.col("at").alias("hop")).agg(F.countDistinct("node").alias("candidates"), (F.countDistinct("node") > 1).alias("ambiguous"))


@query("SELECT l_orderkey, l_linenumber, 'top.u' || l_partkey || '.bus' AS bare, 'bus' AS leaf, 3 AS segments FROM lineitem")
def q074_spec_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selects stripped, segments counted, leaf taken."""
    path = F.concat(F.lit("top.u"), _s("l_partkey"), F.lit("[0].bus["), _s("l_linenumber"), F.lit(":0]"))
    bare = C.strip_selects(path)
    return star.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bare.alias("bare"), F.element_at(C.segments(bare), -1).alias("leaf"), F.size(C.segments(bare)).alias("segments"))


_RESOLVED = _TREE + f""", {_SPECS_SQL}, d AS (SELECT DISTINCT path FROM specs),
e AS (SELECT path, regexp_replace(path, '\\.[^.]*$', '') AS up, regexp_extract(path, '([^.]*)$', 1) AS leaf FROM d)
SELECT e.path, CASE WHEN u.module LIKE 'cus%' AND leaf = 'acctbal' THEN 'port' WHEN e.path IN (SELECT full_path FROM flat_rows) THEN 'instance' WHEN u.full_path IS NOT NULL THEN 'tail' ELSE 'miss' END AS kind FROM e LEFT JOIN flat_rows u ON u.full_path = e.up
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = _names(spark, sf_dir).withColumn("direction", F.lit("input"))
    return hierarchy.resolve_endpoints(star.flat_rows(spark, sf_dir), ports, ports.select("module", "name").where("false"), _specs(spark, sf_dir))


@query(_RESOLVED)
def q079_endpoint_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints as ports, instances, tails or misses."""
    return _resolved(spark, sf_dir).select("path", "kind")


@query(f"SELECT role, miss_reason, count(*) AS n FROM (SELECT CASE WHEN kind = 'port' THEN 'fanin' ELSE 'internal' END AS role, CASE WHEN kind = 'miss' THEN 'inst-not-found' ELSE '' END AS miss_reason FROM ({_RESOLVED})) GROUP BY 1, 2")
def q077_resolve_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by port direction, and why paths are missed."""
    ports = _names(spark, sf_dir).withColumn("direction", F.lit("input"))
    got = hierarchy.roles(_resolved(spark, sf_dir), star.flat_rows(spark, sf_dir), ports)
    return got.groupBy("role", "miss_reason").agg(F.count(F.lit(1)).alias("n"))


_LISTED = "listed AS (SELECT 'rtl/' || c_mktsegment || '/' || (c_custkey % 40) || '/c' || c_custkey || '.v' AS path, 'seg' || (c_custkey % 40) || '.f' AS via_filelist, c_custkey FROM customer), covered AS (SELECT path, via_filelist, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 AND o_custkey % 40 < 30) AS reached FROM listed)"


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = star.table(spark, sf_dir, "customer").select(F.concat(F.lit("rtl/"), "c_mktsegment", F.lit("/"), (k % 40).cast("string"), F.lit("/c"), k.cast("string"), F.lit(".v")).alias("path"), F.concat(F.lit("seg"), (k % 40).cast("string"), F.lit(".f")).alias("via_filelist"), k)
    o = star.table(spark, sf_dir, "orders").where("o_totalprice > 200000 and o_custkey % 40 < 30").select(F.col("o_custkey").alias("c_custkey"))
    return hierarchy.coverage(c, c.join(o, "c_custkey", "left_semi").select(F.col("path").alias("file")))


@query(f"WITH {_LISTED} SELECT path, via_filelist, reached FROM covered")
def q080_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files that the hierarchy reaches, and those it does not."""
    return _covered(spark, sf_dir)


@query(f"WITH {_LISTED} SELECT via_filelist, count(*) AS files FROM covered GROUP BY 1 HAVING NOT bool_or(reached)")
def q080b_unused_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of which no file is reached."""
    return hierarchy.unused_listings(_covered(spark, sf_dir))


@query(f"""
WITH {_LISTED}, dirs AS (SELECT reached, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS dir FROM covered, range(1, 4) t(n)), cold AS (SELECT dir FROM dirs GROUP BY 1 HAVING NOT bool_or(reached))
SELECT dir FROM cold WHERE NOT contains(dir, '/') OR regexp_replace(dir, '/[^/]*$', '') NOT IN (SELECT dir FROM cold)
""")
def q080c_untouched_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shallowest folders without a reached file."""
    return hierarchy.untouched_roots(_covered(spark, sf_dir))


@query(_TREE + "SELECT full_path FROM flat_rows WHERE full_path = 'top.u_r1' OR starts_with(full_path, 'top.u_r1.')")
def q081_ancestor_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the lowest common ancestor of two paths."""
    return hierarchy.prune_to_ancestor(star.flat_rows(spark, sf_dir), F.lit("top.u_r1.u_n1.u_c4"), F.lit("top.u_r1.u_n2")).select("full_path")
