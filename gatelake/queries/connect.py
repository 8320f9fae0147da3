"""Queries over net graphs and connectivity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelake.catalog import query
from gatelake.functions import columns as C
from gatelake.operators import checks, graph, hierarchy, scan
from gatelake.plans.components import connected_components
from gatelake.plans.frontier import elaborate, expand, until_budget
from gatelake.plans.store import keep
from gatelake.sources import star


def _s(c: str) -> Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- coarse name connectivity

_BODY = "'// head ' || o_orderpriority || chr(10) || CASE o_orderkey % 5 WHEN 0 THEN 'assign o = a' || o_custkey || ' & b' || (o_custkey % 7) || ';' WHEN 1 THEN 'assign o = a' || o_custkey || ';' || repeat(' ', 120) || 'wire b' || (o_custkey % 7) || ';' WHEN 2 THEN 'wire a' || o_custkey || '; reg b' || (o_custkey % 7) || ';' WHEN 3 THEN 'wire A' || o_custkey || ';' ELSE 'wire z;' END"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = star.table(spark, sf_dir, "orders")
    a, b, s = F.concat(F.lit("a"), _s("o_custkey")), F.concat(F.lit("b"), (F.col("o_custkey") % 7).cast("string")), F.lit
    k = F.col("o_orderkey") % 5
    body = (
        F.when(k == 0, F.concat(s("assign o = "), a, s(" & "), b, s(";"))).when(k == 1, F.concat(s("assign o = "), a, s(";" + " " * 120 + "wire "), b, s(";")))
        .when(k == 2, F.concat(s("wire "), a, s("; reg "), b, s(";"))).when(k == 3, F.concat(s("wire A"), _s("o_custkey"), s(";"))).otherwise("wire z;")
    )
    return o.select("o_orderkey", "o_custkey", F.concat(s("// head "), "o_orderpriority", s("\n"), body).alias("text"), a.alias("a"), b.alias("b"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'assign' WHEN 1 THEN 'assign-one-sided' WHEN 2 THEN 'word' WHEN 3 THEN 'word-partial' ELSE 'miss' END AS mode FROM orders")
def q091_name_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How one file connects two names, from the same statement down to one word."""
    return _bodies(spark, sf_dir).select("o_orderkey", C.bloom_ladder(F.col("text"), F.col("a"), F.col("b")).alias("mode"))


@query("SELECT o_custkey AS check_id, min(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) < 5 AS connected FROM orders GROUP BY 1")
def q092_name_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check over all files in its scope: the best rung counts."""
    rung = C.bloom_ladder(F.col("text"), F.col("a"), F.col("b"))
    order = F.array(*[F.lit(x) for x in ("same-net", "assign", "assign-one-sided", "word", "word-partial", "miss")])
    got = _bodies(spark, sf_dir).select(F.col("o_custkey").alias("check_id"), F.array_position(order, rung).alias("rank"))
    return got.groupBy("check_id").agg((F.min("rank") < 6).alias("connected"))


# ---------------------------------------------------------------- components and expansion


@query("WITH " + star.EVENT_EDGES_SQL + ", ends AS (SELECT src AS event_id FROM event_edges UNION SELECT dst FROM event_edges) SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id) AS component FROM events JOIN ends USING (event_id)")
def q101_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components: each user's chain of events is one, whatever the direction of its edges."""
    return connected_components(star.event_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")), keep)


@query(f"""
SELECT 'nat_' || c_nationkey AS module, x.net || c_custkey AS net, 'r_' || c_custkey AS rep FROM customer, (VALUES ('w_'), ('y_'), ('r_')) x(net) WHERE c_acctbal >= 0
UNION ALL SELECT DISTINCT 'cell_' || lower(substr(c_mktsegment, 1, 4)), n, 'd' FROM customer, (VALUES ('d'), ('q')) t(n) UNION ALL SELECT 'leaf', n, 'a' FROM (VALUES ('a'), ('b')) t(n)
""")
def q101b_local_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of a module that its own edges connect share a representative."""
    return graph.local_representatives(scan.local_edges(scan.scan(star.rtl(spark, sf_dir))))


@query("""
WITH e AS (SELECT DISTINCT 'n' || (o_custkey % 50) || '[' || (o_orderkey % 3) || ']' AS src, 'm' || (o_orderkey % 50) AS dst FROM orders),
x AS (SELECT src, dst, regexp_replace(src, '\\[.*', '') AS bs FROM e)
SELECT src, dst FROM x UNION SELECT bs, dst FROM x UNION SELECT bs, src FROM x
""")
def q102_slice_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice edges joined by those of their whole nets."""
    e = star.table(spark, sf_dir, "orders").select(F.concat(F.lit("n"), (F.col("o_custkey") % 50).cast("string"), F.lit("["), (F.col("o_orderkey") % 3).cast("string"), F.lit("]")).alias("src"), F.concat(F.lit("m"), (F.col("o_orderkey") % 50).cast("string")).alias("dst"))
    return graph.promote_slices(e.distinct())


@query("SELECT 'm' || c_nationkey AS module, min('n' || c_custkey) AS src, x.dst FROM customer JOIN (SELECT c_nationkey AS k, c_mktsegment AS seg, 'n' || c_custkey AS dst FROM customer) x ON x.k = c_nationkey AND x.seg = c_mktsegment GROUP BY c_nationkey, c_mktsegment, x.dst HAVING min('n' || c_custkey) <> x.dst")
def q103_bind_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent nets that one component of a bound cell joins are linked."""
    c = star.table(spark, sf_dir, "customer")
    bound = c.select(F.concat(F.lit("m"), _s("c_nationkey")).alias("module"), F.lit("u_b").alias("inst"), F.lit("cell").alias("child"), F.concat("c_mktsegment", F.lit("_"), _s("c_custkey")).alias("port"), F.concat(F.lit("n"), _s("c_custkey")).alias("expr"))
    reps = c.select(F.lit("cell").alias("module"), F.concat("c_mktsegment", F.lit("_"), _s("c_custkey")).alias("net"), F.col("c_mktsegment").alias("rep"))
    return graph.fold_binds(bound, reps)


@query("SELECT 'p' || p_partkey AS module, 'i' AS src, 'o' AS dst FROM part WHERE p_size < 20 AND p_retailprice <= 1200")
def q100_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty modules with one scalar input and output pass through."""
    p = star.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), _s("p_partkey")).alias("module"), "p_size", "p_retailprice")
    wide = F.when(F.col("p_size").between(20, 30), "[3:0]").otherwise("")
    ports = p.select("module", F.lit("i").alias("name"), F.lit("input").alias("direction"), wide.alias("dims")).union(p.select("module", F.lit("o"), F.lit("output"), F.lit(""))).union(p.where("p_size > 30").select("module", F.lit("x"), F.lit("input"), F.lit("")))
    return graph.passthrough(ports, p.where("p_retailprice > 1200").select("module"))


_NATIONS = "SELECT n_nationkey AS n, 'top.u_r' || n_regionkey || '.u_n' || n_nationkey AS p, 'top.u_r' || n_regionkey AS up FROM nation"
_NET_EDGES = f"""
WITH nat AS ({_NATIONS}), c AS (SELECT *, 'w_' || c_custkey AS w, 'bus[' || (c_custkey % 5) || ']' AS b FROM customer JOIN nat ON n = c_nationkey WHERE c_acctbal >= 0)
SELECT p || '.' || w AS src, p || '.y_' || c_custkey AS dst, 'assign' AS kind FROM c UNION ALL SELECT p || '.y_' || c_custkey, p || '.r_' || c_custkey, 'ff' FROM c
UNION ALL SELECT p || '.' || x.e, p || '.u_c' || c_custkey || '.' || x.f, 'port' FROM c, LATERAL (SELECT 'clk' AS e, 'clk' AS f UNION ALL SELECT b, 'd' UNION ALL SELECT w, 'q') x
UNION ALL SELECT p || '.u_c' || c_custkey || '.d', p || '.u_c' || c_custkey || '.q', 'ff' FROM c
UNION ALL SELECT p || '.' || x.e, p || '.g[' || i || '].u_l.' || x.f, 'port' FROM nat, range(0, 4) t(i), LATERAL (SELECT 'bus[' || i || ']' AS e, 'a' AS f UNION ALL SELECT 'y[' || i || ']', 'b') x WHERE i < n % 4
UNION ALL SELECT p || '.g[' || i || '].u_l.a', p || '.g[' || i || '].u_l.b', 'assign' FROM nat, range(0, 4) t(i) WHERE i < n % 4
UNION ALL SELECT up || '.' || x.e, p || '.' || x.f, 'port' FROM nat, LATERAL (SELECT 'clk' AS e, 'clk' AS f UNION ALL SELECT 'b', 'bus' UNION ALL SELECT 'o[' || n || ']', 'y') x
UNION ALL SELECT 'top.' || s, 'top.u_r' || r_regionkey || '.' || s, 'port' FROM region, (VALUES ('clk'), ('en')) t(s)
"""


def _net_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net edges of the rendered design under its top, each module read with its default parameters."""
    got = keep(scan.scan(star.rtl(spark, sf_dir)))
    rows = elaborate(keep(scan.instance_edges(got).select("module", "inst", "child")), got.where("module = 'top'").select("module"))
    return graph.net_edges(rows, scan.local_edges(got), scan.port_maps(got))


@query(_NET_EDGES)
def q105_net_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges over whole nets: rows joined with local edges and port maps."""
    return _net_edges(spark, sf_dir)


_EVENTS = "WITH RECURSIVE " + star.EVENT_EDGES_SQL
_CHECKS = "checks AS (SELECT event_id AS check_id, event_id AS a, coalesce(CASE WHEN event_type <> 'click' THEN lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) END, event_id + 37) AS b FROM events)"


def _event_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every event to the user's third one after it, or to another that it is hardly connected with."""
    third = F.lead("event_id", 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = star.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "click", third).alias("third"))
    return keep(e.select(F.col("event_id").alias("check_id"), F.col("event_id").alias("a"), F.coalesce("third", F.col("event_id") + 37).alias("b")))


_PLACES = "p AS (SELECT event_id, user_id, row_number() OVER w AS place, count(*) FILTER (event_type = 'purchase') OVER w AS bought FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""WITH {_CHECKS}, {_PLACES}
SELECT c.check_id, c.a, c.b, y.place IS NOT NULL AS connected, CAST(abs(x.place - y.place) AS INTEGER) AS hops FROM checks c JOIN p x ON x.event_id = c.a LEFT JOIN p y ON y.event_id = c.b AND y.user_id = x.user_id
""")
def q106_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check for every event; all expand from both ends in one loop until they meet, however far apart."""
    return graph.connected(_event_checks(spark, sf_dir), star.event_edges(spark, sf_dir)).withColumn("hops", F.col("hops").cast("int")).drop("cut")


@query("SELECT 'o' || o_orderkey AS check_id, c_nationkey = o_orderkey % 25 AS connected, CASE WHEN c_nationkey = o_orderkey % 25 THEN 1 END AS hops FROM orders JOIN customer ON c_custkey = o_custkey")
def q107_to_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided expansion to a scope: does an order's customer lie in a nation?"""
    o = star.table(spark, sf_dir, "orders").join(star.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.lit("o"), _s("o_orderkey"))
    edges = keep(o.select(name.alias("src"), F.concat(F.lit("n"), _s("c_nationkey"), F.lit(".c"), _s("c_custkey")).alias("dst")))
    checks_ = o.select(name.alias("check_id"), name.alias("a"), F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string")).alias("b"))
    return graph.reaches_scope(checks_, edges, max_hops=1).withColumn("hops", F.col("hops").cast("int"))


@query(f"""WITH {_CHECKS}, {_PLACES},
t AS (SELECT c.check_id, coalesce(y.place >= x.place, false) AS text, coalesce(y.place >= x.place AND y.bought = x.bought, false) AS logical FROM checks c JOIN p x ON x.event_id = c.a LEFT JOIN p y ON y.event_id = c.b AND y.user_id = x.user_id)
SELECT check_id, text AS connected_text, CASE WHEN text THEN logical END AS connected_logical, logical AS connected FROM t
""")
def q114_text_then_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap phase first; only what it connects is asked of the second, where registers are barriers."""
    c, e = _event_checks(spark, sf_dir), star.event_edges(spark, sf_dir)
    text = keep(graph.connected(c, e, directed=True))
    again = c.join(text.where("connected").select("check_id"), "check_id", "left_semi")
    logical = graph.connected(keep(again), e.where("kind <> 'purchase'"), directed=True)
    return checks.text_then_logical(text, logical)


@query(_EVENTS + """, w(label, node, hop) AS (SELECT event_id, event_id, 0 FROM events UNION ALL SELECT w.label, e.dst, w.hop + 1 FROM w JOIN event_edges e ON e.src = w.node
  WHERE w.hop < 6 AND (w.hop = 0 OR w.node NOT IN (SELECT event_id FROM events WHERE event_type IN ('error', 'signup'))))
SELECT label, node, CAST(hop AS INTEGER) AS hop, CASE WHEN hop = 0 THEN '' WHEN t.event_type = 'error' THEN 'blackbox' WHEN t.event_type = 'signup' THEN 'ff-sink' WHEN hop = 6 AND node IN (SELECT src FROM event_edges) THEN 'trace-depth' ELSE '' END AS boundary FROM w JOIN events t ON t.event_id = w.node
""")
def q120_fanout_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fan-out cone for every event, with boundaries that are kept and not passed."""
    t = star.table(spark, sf_dir, "events")
    bounds = t.where("event_type in ('error', 'signup')").select(F.col("event_id").alias("node"), F.when(F.col("event_type") == "error", "blackbox").otherwise("ff-sink").alias("boundary"))
    seeds = t.select(F.col("event_id").alias("label"), F.col("event_id").alias("node"))
    return graph.cone(seeds, star.event_edges(spark, sf_dir), bounds, max_depth=6)


@query(_EVENTS + """, w(label, node, hop) AS (SELECT event_id, event_id, 0 FROM events UNION ALL SELECT w.label, e.src, w.hop + 1 FROM w JOIN event_edges e ON e.dst = w.node
  WHERE w.hop < 5 AND (w.hop = 0 OR w.node NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')))
SELECT label, node, CAST(hop AS INTEGER) AS hop, CASE WHEN hop = 0 THEN '' WHEN t.event_type = 'purchase' THEN 'ff-driver' WHEN hop = 5 AND node IN (SELECT dst FROM event_edges) THEN 'trace-depth' ELSE '' END AS boundary FROM w JOIN events t ON t.event_id = w.node
""")
def q121_fanin_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fan-in cone for every event."""
    t = star.table(spark, sf_dir, "events")
    bounds = t.where("event_type = 'purchase'").select(F.col("event_id").alias("node"), F.lit("ff-driver").alias("boundary"))
    seeds = t.select(F.col("event_id").alias("label"), F.col("event_id").alias("node"))
    return graph.cone(seeds, star.event_edges(spark, sf_dir), bounds, direction="fanin", max_depth=5)


@query("SELECT DISTINCT 'm' || a.o_custkey AS module, 'd' || a.o_orderkey AS src, 'q' || b.o_orderkey AS dst, 'ff-jump' AS kind FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
def q120b_register_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across registers a cone jumps from any data net of a module to all its outputs."""
    o = star.table(spark, sf_dir, "orders")
    return graph.register_jumps(o.select(F.concat(F.lit("m"), _s("o_custkey")).alias("module"), F.concat(F.lit("d"), _s("o_orderkey")).alias("src"), F.concat(F.lit("q"), _s("o_orderkey")).alias("dst"), F.lit("ff").alias("kind")))


@query(star.FLAT_ROWS_SQL + "SELECT full_path, starts_with(full_path, 'top.u_r1.') AS below_only, full_path = 'top.u_r2' OR starts_with(full_path, 'top.u_r2.') AS self_and_below, regexp_full_match(full_path, '.*u_n1[0-9]') AS by_glob FROM flat_rows")
def q122_stop_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where traces stop: strictly below, self and below, by glob."""
    p = F.col("full_path")
    return star.flat_rows(spark, sf_dir).select(p, graph.stop_rule(p, ignore=["top.u_r1.*"]).alias("below_only"), graph.stop_rule(p, ignore=["top.u_r2"]).alias("self_and_below"), graph.stop_rule(p, ignore=["*u_n1[0-9]"]).alias("by_glob"))


@query("""
WITH p AS (SELECT c_custkey AS k, c_nationkey % 3 AS d, lag(c_custkey) OVER (ORDER BY c_custkey) AS before, lead(c_custkey) OVER (ORDER BY c_custkey) AS after FROM customer)
SELECT 'c' || k || '.p' AS origin_port, x.side AS trace_direction, 'port-edge' AS boundary_kind, 'c' || CASE WHEN x.side = 'driver' THEN before ELSE after END || '.p' AS node, 1 AS hop
FROM p, (VALUES ('driver'), ('sinker')) x(side) WHERE (side = 'driver' AND d <> 1 AND before IS NOT NULL) OR (side = 'sinker' AND d <> 0 AND after IS NOT NULL)
""")
def q123_instance_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every port of every instance traced by its direction, in one loop for each side."""
    c = star.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), _s("c_custkey"))
    inst = c.select(name.alias("full_path"), name.alias("module"))
    ports = c.select(name.alias("module"), F.lit("p").alias("name"), F.when(F.col("c_nationkey") % 3 == 0, "input").when(F.col("c_nationkey") % 3 == 1, "output").otherwise("inout").alias("direction"))
    edges = c.select(F.concat(name, F.lit(".p")).alias("src"), F.concat(F.lit("c"), (F.col("c_custkey") + 1).cast("string"), F.lit(".p")).alias("dst"))
    edges = edges.join(c.select(F.concat(name, F.lit(".p")).alias("dst")), "dst", "left_semi").select("src", "dst")
    bounds = c.select(F.concat(name, F.lit(".p")).alias("node"), F.lit("port-edge").alias("boundary"))
    return graph.instance_trace(inst, ports, edges, bounds)


@query(_EVENTS + """, wp AS (SELECT event_id FROM events WHERE event_type = 'click'), s AS (SELECT event_id, user_id FROM events WHERE event_type = 'signup'), peers AS (SELECT s.event_id AS label, t.event_id AS node FROM s JOIN events t ON t.user_id = s.user_id AND t.event_type = 'purchase'),
w(label, node, qualified, ended, hop) AS (SELECT event_id, event_id, false, false, 0 FROM s
  UNION ALL SELECT w.label, e.dst, w.qualified OR e.dst IN (SELECT event_id FROM wp), e.dst IN (SELECT node FROM peers), w.hop + 1 FROM w JOIN event_edges e ON e.src = w.node WHERE NOT w.ended)
SELECT label, node, qualified, ended AS is_terminator, CAST(hop AS INTEGER) AS hop FROM w
""")
def q124_waypoint_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-out of every signup that remembers whether a click was passed, up to the user's purchases, however far."""
    t = star.table(spark, sf_dir, "events")
    src = t.where("event_type = 'signup'").select(F.col("event_id").alias("label"), F.col("event_id").alias("node"), "user_id")
    peers = src.select("label", "user_id").join(t.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("node")), "user_id").select("label", "node")
    return graph.waypoint_fanout(src.select("label", "node"), keep(peers), star.event_edges(spark, sf_dir), t.where("event_type = 'click'").select(F.col("event_id").alias("node")))


@query(_EVENTS + """, w(label, node, spent, hop) AS (SELECT event_id, event_id, 0, 0 FROM events
  UNION ALL SELECT w.label, e.dst, w.spent + CASE WHEN e.kind = 'purchase' THEN 1 ELSE 0 END, w.hop + 1 FROM w JOIN event_edges e ON e.src = w.node WHERE w.hop < 64 AND w.spent + CASE WHEN e.kind = 'purchase' THEN 1 ELSE 0 END <= 1)
SELECT label, node, CAST(hop AS INTEGER) AS hop, CAST(spent AS INTEGER) AS spent, CASE WHEN spent >= 1 THEN 'satisfied' WHEN hop >= 64 THEN 'truncated' WHEN node NOT IN (SELECT src FROM event_edges) THEN 'exhausted' ELSE 'internal' END AS status FROM w
""")
def q125_until_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cone for every event that ends after one register edge; what costs nothing is still taken at the budget, for 64 hops."""
    seeds = star.table(spark, sf_dir, "events").select(F.col("event_id").alias("label"), F.col("event_id").alias("node"))
    return until_budget(seeds, star.event_edges(spark, sf_dir), kind="purchase", limit=1)


@query(_EVENTS + """, w(label, node, hop) AS (SELECT event_id, event_id, 0 FROM events UNION ALL SELECT w.label, e.dst, w.hop + 1 FROM w JOIN event_edges e ON e.src = w.node WHERE w.hop < 3)
SELECT label, node, CAST(hop AS INTEGER) AS hop, CAST(hop AS INTEGER) AS spent, CASE WHEN hop >= 3 THEN 'satisfied' WHEN node NOT IN (SELECT src FROM event_edges) THEN 'exhausted' ELSE 'internal' END AS status FROM w
""")
def q125b_until_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of hops ends the way at once."""
    seeds = star.table(spark, sf_dir, "events").select(F.col("event_id").alias("label"), F.col("event_id").alias("node"))
    return until_budget(seeds, star.event_edges(spark, sf_dir), kind="hop", limit=3)


@query("SELECT label, rule, net, ok FROM (VALUES (5, 'must_satisfy', 'x', true), (5, 'must_satisfy', 'y', false), (5, 'must_not_coi', 'z', true), (5, 'must_not_coi', 'x', false), (5, 'must_exhaust', 'y', true)) t(label, rule, net, ok)")
def q126_cone_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules held against a budget cone."""
    cone = spark.createDataFrame([(5, "top.x", "satisfied"), (5, "top.y", "exhausted"), (5, "top.yz", "internal")], "label int, node string, status string")
    rules = spark.createDataFrame([(5, r, n) for r, n in (("must_satisfy", "x"), ("must_satisfy", "y"), ("must_not_coi", "z"), ("must_not_coi", "x"), ("must_exhaust", "y"))], "label int, rule string, net string")
    return checks.verify_cone(cone, rules)


@query("""
WITH s AS (SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS c, o_orderstatus AS st, '[' || substr(o_orderpriority, 1, 1) || ']' AS sel FROM orders)
SELECT a.node || a.sel AS src, b.node || b.sel AS dst, a.c AS meet, 2 AS hops, CASE WHEN a.sel = b.sel THEN 'slice_identity' ELSE 'base' END AS connectivity_level FROM s a JOIN s b ON a.c = b.c AND a.st = 'F' AND b.st = 'P'
""")
def q127_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled orders against pending ones: pairs that meet at their customer, with the level their selects allow."""
    o = star.table(spark, sf_dir, "orders")
    node, sel = F.concat(F.lit("o"), _s("o_orderkey")), F.concat(F.lit("["), F.substring("o_orderpriority", 1, 1), F.lit("]"))
    s = o.select("o_orderstatus", node.alias("node"), F.concat(node, sel).alias("path"), sel.alias("sel"))
    e = o.select(node.alias("src"), F.concat(F.lit("c"), _s("o_custkey")).alias("dst"))
    got = graph.meet(s.where("o_orderstatus = 'F'"), s.where("o_orderstatus = 'P'"), e, max_hops=2)
    return got.withColumn("hops", F.col("hops").cast("int"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS h, CAST(l_quantity AS INTEGER) - l_linenumber + 1 AS l, l_partkey % 9 + 20 AS h2, l_partkey % 9 + 10 AS l2, l_suppkey % 5 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'select_approx' ELSE CASE WHEN h = h2 AND l = l2 THEN 'slice_identity' WHEN l <= h2 AND l2 <= h THEN 'base' END END AS strict,
  CASE k WHEN 0 THEN 'base' WHEN 1 THEN 'select_approx' ELSE CASE WHEN h = h2 AND l = l2 THEN 'slice_identity' ELSE 'base' END END AS loose FROM r
""")
def q128_slice_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels at which two selects may pair, strict and not."""
    li = star.table(spark, sf_dir, "lineitem")
    i = lambda c: c.cast("int").cast("string")
    q, n, p = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")
    a = F.concat(F.lit("["), i(q - n + 1), F.lit(":"), i(q), F.lit("]"))
    k = F.col("l_suppkey") % 5
    b = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "[W-1:0]").otherwise(F.concat(F.lit("["), i(p % 9 + 20), F.lit(":"), i(p % 9 + 10), F.lit("]")))
    return li.select("l_orderkey", "l_linenumber", C.slice_level(a, b, allow_base=False).alias("strict"), C.slice_level(a, b).alias("loose"))


@query("SELECT 'h' || (k % 7) AS hier, 'b' || (k % 11) AS base, string_agg(path, ',' ORDER BY k) AS members, count(DISTINCT sel) > 1 OR (bool_or(sel IS NULL) AND bool_or(sel IS NOT NULL)) AS mixed_or_approx FROM (SELECT p_partkey AS k, 'p' || p_partkey || coalesce(s, '') AS path, s AS sel FROM (SELECT *, CASE WHEN p_size > 25 THEN '[' || (p_size % 4) || ']' END AS s FROM part)) GROUP BY 1, 2")
def q129_coalesced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of one net together, in first-seen order, with a flag where selects differ."""
    k = F.col("p_partkey")
    sel = F.when(F.col("p_size") > 25, F.concat(F.lit("["), (F.col("p_size") % 4).cast("string"), F.lit("]")))
    s = star.table(spark, sf_dir, "part").select(k.alias("pos"), F.concat(F.lit("p"), _s("p_partkey"), F.coalesce(sel, F.lit(""))).alias("path"), F.concat(F.lit("h"), (k % 7).cast("string")).alias("hier"), F.concat(F.lit("b"), (k % 11).cast("string")).alias("base"), sel.alias("sel"))
    return graph.coalesce_seeds(s, mode="base").withColumn("members", F.array_join("members", ","))


@query(star.FLAT_ROWS_SQL + "SELECT DISTINCT r.full_path FROM flat_rows r JOIN flat_rows s ON s.module IN (SELECT 'cus_' || c_custkey FROM customer WHERE c_acctbal > 9000) AND (s.full_path = r.full_path OR starts_with(s.full_path, r.full_path || '.'))")
def q130_cone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on the way to the seeds, by a semi join on prefixes."""
    rows = star.flat_rows(spark, sf_dir)
    seeds = star.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("cus_"), _s("c_custkey")).alias("module"))
    return hierarchy.on_the_way(rows, seeds).select("full_path")


@query(_EVENTS + """, w(label, node, chain, hop) AS (SELECT event_id, event_id, CAST(event_id AS VARCHAR), 0 FROM events UNION ALL SELECT w.label, e.dst, w.chain || '>' || e.dst, w.hop + 1 FROM w JOIN event_edges e ON e.src = w.node WHERE w.hop < 4)
SELECT label, node, chain FROM w
""")
def q131_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of nodes from each event to each node of its cone."""
    seeds = star.table(spark, sf_dir, "events").select(F.col("event_id").alias("label"), F.col("event_id").alias("node"))
    return graph.evidence(seeds, star.event_edges(spark, sf_dir), max_hops=4).select("label", "node", F.array_join("chain", ">").alias("chain"))


@query("WITH " + star.EVENT_EDGES_SQL + """, runs AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
joined AS (SELECT src AS event_id FROM event_edges WHERE kind <> 'purchase' UNION SELECT dst FROM event_edges WHERE kind <> 'purchase')
SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, run) AS component FROM runs JOIN joined USING (event_id)""")
def q118_electrical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over wire-only edges: a purchase is logic and does not join what is before it with what is after."""
    e = star.event_edges(spark, sf_dir)
    return graph.electrical(e.withColumn("kind", F.when(F.col("kind") == "purchase", "logic").when(F.col("kind") == "click", "port").otherwise("wire")))


@query("""
WITH b AS (SELECT c_custkey AS check_id, 'x' || (c_custkey % 5) AS base, c_nationkey % 3 AS k FROM customer),
hit AS (SELECT check_id, base || s AS node, s FROM b, (VALUES (''), ('[1]')) v(s) WHERE (s = '' AND k < 2) OR (s = '[1]' AND k = 1))
SELECT check_id, node AS b, 'PASS' AS verdict FROM hit h WHERE s <> '' OR NOT EXISTS (SELECT 1 FROM hit g WHERE g.check_id = h.check_id AND g.s <> '')
UNION ALL SELECT check_id, NULL, 'FAIL' FROM b WHERE check_id NOT IN (SELECT check_id FROM hit)
""")
def q119_electrical_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each matched slice; the whole net gives way to its slices; else one failure."""
    c = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("check_id"), (F.col("c_nationkey") % 3).alias("k"))
    k = F.col("check_id")
    scope = lambda n: F.concat(F.lit("c"), k.cast("string"), F.lit("."), n)
    comp = c.select(scope(F.lit("a")).alias("node"), scope(F.lit("a")).alias("component")).union(c.where("k < 2").select(scope(F.lit("x")), scope(F.lit("a")))).union(c.where("k = 1").select(scope(F.lit("x[1]")), scope(F.lit("a"))))
    ends = c.select("check_id", scope(F.lit("x")).alias("node")).union(c.select("check_id", scope(F.lit("x[1]"))))
    got = graph.electrical_pairs(comp, c.select("check_id", scope(F.lit("a")).alias("a")), ends)
    return got.select("check_id", F.regexp_replace("b", r"^c\d+\.x", F.concat(F.lit("x"), (k % 5).cast("string"))).alias("b"), "verdict")


# ---------------------------------------------------------------- checks


@query("""
SELECT c_custkey AS check_id, CAST((i * 2 + j) AS INTEGER) AS sub, 'u' || (3 - i) || '.x' || CASE j WHEN 0 THEN 'p' ELSE 'q' END AS a, 'v.' || CASE j WHEN 0 THEN 'p' ELSE 'q' END AS b, '' AS error FROM customer, range(0, 4) a(i), range(0, 2) b(j)
UNION ALL SELECT 0, CAST((i * 2 + j) AS INTEGER), 'u{K}', 'v', 'unbound loop placeholder K' FROM range(0, 4) a(i), range(0, 2) b(j)
""")
def q111_loop_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders over a descending range and a list, nested in order; what stays unbound is an error."""
    c = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("check_id"), F.lit("u{I}.x{J}").alias("a"), F.lit("v.{J}").alias("b"))
    c = c.union(spark.createDataFrame([(0, "u{K}", "v")], "check_id bigint, a string, b string")).withColumns({"loop_I": F.lit("3:0"), "loop_J": F.lit("p, q")})
    return checks.expand_loops(c, ["I", "J"]).select("check_id", "sub", "a", "b", "error")


@query("""
WITH c AS (SELECT p_partkey AS k, p_size % 4 AS w FROM part)
SELECT k AS check_id, '[' || i || ']' AS sub_id, 'a[' || i || ']' AS a, 'b[' || (i + 2) || ']' AS b, '' AS error FROM c, range(0, 4) t(i) WHERE i <= w AND k % 4 = 0
UNION ALL SELECT k, '->' || i, 's', 't' || i, '' FROM c, range(0, 3) t(i) WHERE k % 4 = 1
UNION ALL SELECT k, '', '', '', 'length mismatch: 2 vs 3' FROM c WHERE k % 4 = 2
UNION ALL SELECT k, x.sub_id, x.a, x.b, '' FROM c, (VALUES ('[0]', 'm', 'd[1]'), ('[2]', 'n', 'd[0]')) x(sub_id, a, b) WHERE k % 4 = 3
""")
def q112_pair_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buses zipped bit by bit, a source with many sinks, unequal lengths, and a concat against a bus."""
    p = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("check_id"), (F.col("p_size") % 4).alias("w"))
    k, w = F.col("check_id") % 4, F.col("w")
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    a = F.when(k == 0, F.array(F.concat(F.lit("a["), w.cast("string"), F.lit(":0]")))).when(k == 1, lit("s")).when(k == 2, lit("x[1:0]")).otherwise(lit("{m, 1'b0, n}"))
    b = F.when(k == 0, F.array(F.concat(F.lit("b["), (w + 2).cast("string"), F.lit(":2]")))).when(k == 1, lit("t0", "t1", "t2")).when(k == 2, lit("y[2:0]")).otherwise(lit("d[1:0]"))
    return checks.pair_up(p.select("check_id", a.alias("a"), b.alias("b")))


@query("SELECT o_custkey AS check_id, bool_and(o_orderstatus = 'F') AS connected, count(*) AS checked, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1")
def q113_aggregate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sub-results of a check."""
    return checks.aggregate(star.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("check_id"), (F.col("o_orderstatus") == "F").alias("connected")))


@query("SELECT o_custkey AS check_id, bool_or(o_orderstatus = 'P') AS connected, count(*) AS checked, count(*) FILTER (o_orderstatus <> 'P') AS failed FROM orders GROUP BY 1")
def q113b_aggregate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any sub-result of a check; unknown ones count as failed."""
    ok = F.when(F.col("o_orderstatus") == "P", F.lit(True)).when(F.col("o_orderstatus") == "F", F.lit(False))
    return checks.aggregate(star.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("check_id"), ok.alias("connected")), mode="any")


@query("""
WITH c AS (SELECT o_orderkey AS check_id, 'n' || (o_custkey % 30) AS x, 'm' || (o_orderkey % 30) AS y FROM orders), k AS (SELECT check_id, least(x, y) || '|' || greatest(x, y) AS key FROM c), f AS (SELECT key, min(check_id) AS first_id FROM k GROUP BY 1)
SELECT k.check_id, f.first_id, f.first_id % 2 = 0 AS connected FROM k JOIN f USING (key)
""")
def q110_check_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that differ in selects or in order only are asked once; the verdict goes to all of them."""
    o = star.table(spark, sf_dir, "orders")
    x = F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string"), F.lit("["), _s("o_orderkey"), F.lit("]"))
    y = F.concat(F.lit("m"), (F.col("o_orderkey") % 30).cast("string"))
    swap = F.col("o_orderkey") % 2 == 0
    first, every = checks.deduplicated(o.select(F.col("o_orderkey").alias("check_id"), F.when(swap, y).otherwise(x).alias("a"), F.when(swap, x).otherwise(y).alias("b")))
    verdict = first.select("key", F.col("check_id").alias("first_id"), (F.col("check_id") % 2 == 0).alias("connected"))
    return every.join(verdict, "key").select("check_id", "first_id", "connected")


_SIDES = "SELECT o_custkey AS check_id, o_orderkey % 2 AS side, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'ambiguous' ELSE 'ok' END AS status, o_orderkey % 11 = 0 AS waypoint FROM orders"
_GATE = f"SELECT check_id, CASE WHEN bool_or(status = 'missing') THEN 'reject' WHEN bool_or(waypoint) OR bool_or(status = 'ambiguous') THEN 'fallback' ELSE 'pass' END AS action FROM ({_SIDES}) GROUP BY 1"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return star.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("check_id"), (k % 2).alias("side"), F.when(k % 7 == 0, "missing").when(k % 5 == 0, "ambiguous").otherwise("ok").alias("status"), (k % 11 == 0).alias("waypoint"))


@query(_GATE)
def q115_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass, fallback or reject by the states of a check's sides."""
    return checks.gate(_sides(spark, sf_dir))


@query(f"WITH g AS ({_GATE}) SELECT check_id, 'gate' AS phase, false AS connected FROM g WHERE action = 'reject' UNION ALL SELECT check_id, 'walk', CASE WHEN c_acctbal > 0 THEN c_nationkey < 12 END FROM g LEFT JOIN customer ON c_custkey = check_id WHERE action <> 'reject'")
def q116_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate rejects is decided; the others take the next phase's verdict."""
    walk = star.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("check_id"), (F.col("c_nationkey") < 12).alias("connected"))
    return checks.cascade(keep(checks.gate(_sides(spark, sf_dir))), walk)


@query(f"SELECT check_id, side, bool_and(status = 'ok') AS ok FROM ({_SIDES}) GROUP BY 1, 2")
def q117_and_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of a side has to resolve."""
    return checks.and_gate(_sides(spark, sf_dir).select("check_id", "side", (F.col("status") == "ok").alias("ok")))


@query("SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)) WHERE n <= 64")
def q109_text_fanout_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text phase takes the first 64 peers of a net by name; the limit is the feature."""
    return graph.first_peers(star.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(), 64)


@query("SELECT class, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS pct FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'empty-path' WHEN o_orderkey % 7 = 0 THEN 'ambiguous' WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'F' THEN 'top-not-indexed' WHEN o_orderkey % 5 = 0 THEN 'inst-not-found' WHEN o_orderkey % 4 = 0 THEN 'leaf-not-found' WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE 'pass' END AS class FROM orders) GROUP BY 1")
def q132_failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints by failure class."""
    o = star.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "miss").when(k % 4 == 0, "tail").when(k % 11 != 0, "port")
    cls = checks.failure_class(kind, k % 7 == 0, F.when(k % 9 == 0, "").otherwise("p"), F.when(F.col("o_orderstatus") == "F", "").otherwise("top"))
    total = o.count()
    return o.select(cls.alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / total, 1))


@query("SELECT CASE WHEN c_custkey % 2 = 0 AND c_acctbal > 0 THEN 'pass' WHEN c_custkey % 2 = 1 AND c_acctbal <= 0 THEN 'both-fail' WHEN c_custkey % 2 = 1 THEN 'endpoint-a-fail' ELSE 'endpoint-b-fail' END AS class, count(*) AS n, min(c_nationkey) AS least, max(c_nationkey) AS most FROM customer GROUP BY 1")
def q132b_pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by which end failed, with hop statistics."""
    c = star.table(spark, sf_dir, "customer")
    return c.groupBy(checks.pair_class(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") > 0).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("c_nationkey").alias("least"), F.max("c_nationkey").alias("most"))


@query("SELECT c_custkey, CASE WHEN c_nationkey >= 20 THEN '' WHEN c_acctbal < 0 THEN 'inactive' WHEN c_acctbal > 5000 THEN 'ifndef POOR' ELSE 'active' END AS activation FROM customer")
def q133_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the activation of their branch, empty where none is known."""
    c = star.table(spark, sf_dir, "customer")
    known = c.where("c_nationkey < 20").select("c_custkey", F.when(F.col("c_acctbal") < 0, "inactive").when(F.col("c_acctbal") > 5000, "ifndef POOR").otherwise("active").alias("activation"))
    return hierarchy.with_activation(c.select("c_custkey"), known, "c_custkey")


_COMPARE = "SELECT coalesce(e.k, a.k) AS check_id, e.v AS expected, a.v AS actual, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN e.v IS NOT DISTINCT FROM a.v THEN 'equal' ELSE 'differs' END AS state FROM (SELECT c_custkey AS k, c_acctbal > 0 AS v FROM customer WHERE c_nationkey <> 3) e FULL JOIN (SELECT c_custkey AS k, c_acctbal > 1000 AS v FROM customer WHERE c_nationkey <> 7) a ON a.k = e.k"


@query(_COMPARE)
def q134_suite_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual verdicts; nations 3 and 7 lack one of them."""
    c = star.table(spark, sf_dir, "customer")
    pick = lambda n, v: c.where(F.col("c_nationkey") != n).select(F.col("c_custkey").alias("check_id"), (F.col("c_acctbal") > v).alias("connected"))
    return checks.compare(pick(3, 0), pick(7, 1000))


@query("SELECT 'p' || p_partkey AS check_id, true AS expected, p_size > 20 AS actual, CASE WHEN p_size > 20 THEN 'equal' ELSE 'differs' END AS state FROM part")
def q135_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same designs read with and without folding, and what that changes in each check."""
    k = _s("p_partkey")
    rhs = F.when(F.col("p_size") > 20, "i | j").otherwise("i & 1'b0")
    p = star.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("path"), F.concat(F.lit("module p"), k, F.lit(" (input i, input j, output o); assign o = "), rhs, F.lit("; endmodule")).alias("text"))

    def verdicts(fold: bool) -> DataFrame:
        e = scan.local_edges(scan.scan(p, fold_constants=fold)).where("dst = 'o' and src = 'i'").select(F.col("module").alias("check_id")).distinct()
        return p.select(F.col("path").alias("check_id")).join(e.withColumn("connected", F.lit(True)), "check_id", "left").withColumn("connected", F.coalesce("connected", F.lit(False)))

    return checks.compare(verdicts(False), verdicts(True))


@query("SELECT m.check_id, m.side, m.prefix, m.module FROM (SELECT c_custkey AS check_id, 'a' AS side, unnest(['top', 'top.u_r' || n_regionkey, 'top.u_r' || n_regionkey || '.u_n' || n_nationkey]) AS prefix, unnest(['top', 'reg_' || n_regionkey, 'nat_' || n_nationkey]) AS module FROM customer JOIN nation ON n_nationkey = c_nationkey) m")
def q024_hierarchy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each resolved prefix of each side of a check."""
    rows = star.flat_rows(spark, sf_dir)
    ends = rows.where("depth = 3").select(F.substring("inst_leaf", 4, 20).try_cast("bigint").alias("check_id"), F.lit("a").alias("side"), F.col("parent_path").alias("path"))
    return hierarchy.evidence_rows(rows, ends)


@query(_EVENTS + """, w(label, node, hop) AS (SELECT event_id, event_id, 0 FROM events UNION ALL SELECT w.label, e.dst, w.hop + 1 FROM w JOIN event_edges e ON e.src = w.node WHERE w.hop < 5) SELECT label, count(*) AS nodes, max(hop) AS depth FROM w GROUP BY 1""")
def q022_cone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary row for the cone of every event."""
    seeds = star.table(spark, sf_dir, "events").select(F.col("event_id").alias("label"), F.col("event_id").alias("node"))
    got = expand(seeds, keep(star.event_edges(spark, sf_dir).select("src", "dst")), max_hops=5)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.max("hop").alias("depth"))


@query("""
SELECT c_custkey AS check_id, CASE k WHEN 0 THEN 'port-port' WHEN 3 THEN 'hierarchy-hierarchy' ELSE 'port-hierarchy' END AS mode, CASE k WHEN 0 THEN c_acctbal > 0 WHEN 1 THEN true WHEN 2 THEN false ELSE c_nationkey > 12 END AS connected FROM (SELECT *, c_nationkey % 4 AS k FROM customer)
""")
def q108_pair_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by what their ends are, each mode with its own search."""
    c = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("check_id"), (F.col("c_nationkey") % 4).alias("k"), F.col("c_nationkey").alias("n"), "c_acctbal")
    net = F.concat(F.lit("top.u"), _s("check_id"))
    a = F.when(F.col("k") == 3, F.lit("top.x")).otherwise(F.concat(net, F.lit(".a")))
    b = F.when(F.col("k") == 0, F.concat(net, F.lit(".b"))).when(F.col("k") == 1, net).when(F.col("k") == 2, F.lit("top.elsewhere")).otherwise(F.when(F.col("n") > 12, "top.x.y").otherwise("top.z"))
    kind = lambda inst: F.when(inst, "instance").otherwise("port")
    checks_ = c.select("check_id", a.alias("a"), b.alias("b"), kind(F.col("k") == 3).alias("a_kind"), kind(F.col("k") > 0).alias("b_kind"))
    rich = c.where("c_acctbal > 0")
    edges = rich.select(F.concat(net, F.lit(".a")).alias("src"), F.concat(net, F.lit(".m")).alias("dst")).union(rich.select(F.concat(net, F.lit(".b")), F.concat(net, F.lit(".m"))))
    return graph.connect_pairs(checks_, edges)


@query("SELECT 'c' || o_orderkey AS check_id, 'n' || o_custkey AS endpoint_a, '' AS endpoint_b, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS connected_text, '' AS mode, o_orderpriority AS note, '' AS errors, CAST(o_orderkey % 9 AS VARCHAR) AS hops, '' AS a_rtl, '' AS a_via_filelist, 'top.f -> sub.f' AS a_filelist_chain, '' AS b_rtl, '' AS b_via_filelist, '' AS b_filelist_chain, 'text' AS phase FROM orders")
def q021_connect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connect report columns as text."""
    from gatelake.sources import sinks

    o = star.table(spark, sf_dir, "orders")
    got = o.select(F.concat(F.lit("c"), _s("o_orderkey")).alias("check_id"), F.concat(F.lit("n"), _s("o_custkey")).alias("endpoint_a"), (F.col("o_orderstatus") == "F").alias("connected_text"), F.col("o_orderpriority").alias("note"), (F.col("o_orderkey") % 9).alias("hops"), F.array(F.lit("top.f"), F.lit("sub.f")).alias("a_filelist_chain"), F.lit("text").alias("phase"))
    return sinks.report(got, sinks.TEXT_COLUMNS)
