"""Designs made from the star-schema tables: a module tree, net graphs and rendered Verilog. Inputs for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module, inst, child: top > region > nation > customer > order, a module each."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    levels = [
        t("region").select(F.lit("top").alias("module"), name("u_r", "r_regionkey").alias("inst"), name("reg_", "r_regionkey").alias("child")),
        t("nation").select(name("reg_", "n_regionkey"), name("u_n", "n_nationkey"), name("nat_", "n_nationkey")),
        t("customer").select(name("nat_", "c_nationkey"), name("u_c", "c_custkey"), name("cus_", "c_custkey")),
        t("orders").select(name("cus_", "o_custkey"), name("u_o", "o_orderkey"), name("ord_", "o_orderkey")),
    ]
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


#: The same as SQL.
MODULE_EDGES_SQL = """
SELECT 'top' AS module, 'u_r' || r_regionkey AS inst, 'reg_' || r_regionkey AS child FROM region
UNION ALL SELECT 'reg_' || n_regionkey, 'u_n' || n_nationkey, 'nat_' || n_nationkey FROM nation
UNION ALL SELECT 'nat_' || c_nationkey, 'u_c' || c_custkey, 'cus_' || c_custkey FROM customer
UNION ALL SELECT 'cus_' || o_custkey, 'u_o' || o_orderkey, 'ord_' || o_orderkey FROM orders
"""


def flat_rows(spark: SparkSession, sf_dir: str, *, orders: bool = True) -> DataFrame:
    """full_path, inst_leaf, module, depth, parent_path and file of the module tree, by plain joins."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = lambda *xs: F.concat_ws(".", F.lit("top"), *xs)
    u = lambda a, col: F.concat(F.lit(a), F.col(col).cast("string"))
    region, nation, customer = u("u_r", "n_regionkey"), u("u_n", "n_nationkey"), u("u_c", "c_custkey")
    cn = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation is 25 rows at every scale
    row = lambda path, leaf, module, depth, parent: [path.alias("full_path"), leaf.alias("inst_leaf"), module.alias("module"), F.lit(depth).alias("depth"), parent.alias("parent_path")]
    top = spark.range(1).select(*row(F.lit("top"), F.lit("top"), F.lit("top"), 0, F.lit(None).cast("string")))
    r = table(spark, sf_dir, "region").select(*row(p(u("u_r", "r_regionkey")), u("u_r", "r_regionkey"), u("reg_", "r_regionkey"), 1, F.lit("top")))
    nn = n.select(*row(p(region, nation), nation, u("nat_", "n_nationkey"), 2, p(region)))
    cc = cn.select(*row(p(region, nation, customer), customer, u("cus_", "c_custkey"), 3, p(region, nation)))
    out = top.union(r).union(nn).union(cc)
    if orders:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(cn, F.col("o_custkey") == F.col("c_custkey"))
        out = out.union(o.select(*row(p(region, nation, customer, u("u_o", "o_orderkey")), u("u_o", "o_orderkey"), u("ord_", "o_orderkey"), 4, p(region, nation, customer))))
    return out


FLAT_ROWS_SQL = f"""
WITH RECURSIVE module_edges AS ({MODULE_EDGES_SQL}),
tree(full_path, inst_leaf, module, depth, parent_path) AS (
  SELECT 'top', 'top', 'top', 0, CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT t.full_path || '.' || e.inst, e.inst, e.child, t.depth + 1, t.full_path FROM tree t JOIN module_edges e ON e.module = t.module
),
flat_rows AS (SELECT full_path, inst_leaf, module, depth, parent_path FROM tree)
"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind: each user's events in order; an edge has the type of the event it leads to."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.lead("event_id").over(w).alias("dst"), F.lead("event_type").over(w).alias("kind"))
    return e.where("dst is not null").select(F.col("node").alias("src"), "dst", "kind")


EVENT_EDGES_SQL = """
event_edges AS (
  SELECT src, dst, kind FROM (
    SELECT event_id AS src, lead(event_id) OVER w AS dst, lead(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
  ) WHERE dst IS NOT NULL
)
"""


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: parts and the suppliers that lines of quantity 50 name, as net names."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_partkey", "l_suppkey")
    return rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()


def rtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text and pos: a rendered design. Customers are instances in their nation's module, behind conditional compilation by balance."""
    c = table(spark, sf_dir, "customer")
    k, cell = F.col("c_custkey").cast("string"), F.concat(F.lit("cell_"), F.lower(F.substring("c_mktsegment", 1, 4)))
    inst = F.concat(
        F.lit("  wire w_"), k, F.lit(";\n  "), cell, F.lit(" #(.K("), F.lit("2 * "), (F.col("c_custkey") % 7).cast("string"), F.lit(" + 1)) u_c"), k,
        F.lit(" (.clk(clk), .d(bus["), (F.col("c_custkey") % 5).cast("string"), F.lit("]), .q(w_"), k, F.lit(")); // customer "), k, F.lit("\n"),
        F.lit("  assign y_"), k, F.lit(" = w_"), k, F.lit(" | (bus[0] & 1'b0);\n  always_ff @(posedge clk) r_"), k, F.lit(" <= y_"), k, F.lit(";\n"),
    )
    inst = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("`ifdef POOR\n"), inst, F.lit("`endif\n"))).when(F.col("c_acctbal") > 5000, F.concat(F.lit("`ifndef POOR\n"), inst, F.lit("`else\n  wrong u_wrong (.x(bus));\n`endif\n"))).otherwise(inst)
    bodies = c.select("c_nationkey", F.struct("c_custkey", inst.alias("body")).alias("x")).groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["body"]), "").alias("body"))
    n = table(spark, sf_dir, "nation").join(bodies, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    nk = F.col("n_nationkey").cast("string")
    nations = n.select(
        F.concat(F.lit("rtl/nat_"), nk, F.lit(".v")).alias("path"),
        F.concat(
            F.lit("// nation "), "n_name", F.lit("\n`define WIDTH N + 5\nmodule nat_"), nk, F.lit(" #(parameter N = "), (F.col("n_nationkey") % 4).cast("string"), F.lit(", parameter W = `WIDTH) (input clk, input [W-1:0] bus, output reg [3:0] y);\n"),
            F.lit("  /* block\n     comment; fake u_no (.a(b)); */\n  genvar i;\n  generate for (i = 0; i < N; i = i + 1) begin : g\n    leaf #(.ID(i * 10)) u_l (.a(bus[i]), .b(y[i]));\n  end endgenerate\n"),
            F.coalesce("body", F.lit("")), F.lit("endmodule\n"),
        ).alias("text"), (F.col("n_nationkey") + 10).alias("pos"),
    )
    reg = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: F.concat(F.lit("  nat_"), x.cast("string"), F.lit(" #(.N("), (x % 3).cast("string"), F.lit(")) u_n"), x.cast("string"), F.lit(" (.clk(clk), .bus(b), .y(o["), x.cast("string"), F.lit("]));\n"))), "").alias("body")
    )
    rk = F.col("n_regionkey").cast("string")
    regions = reg.select(F.concat(F.lit("rtl/reg_"), rk, F.lit(".v")).alias("path"), F.concat(F.lit("module reg_"), rk, F.lit(" (clk, en);\n  input clk; input en;\n  wire [15:0] b;\n"), "body", F.lit("endmodule\n")).alias("text"), (F.col("n_regionkey") + 1).alias("pos"))
    tops = table(spark, sf_dir, "region").agg(
        F.concat(
            F.lit("module top (input clk, input en);\n"),
            F.array_join(F.transform(F.array_sort(F.collect_list("r_regionkey")), lambda x: F.concat(F.lit("  reg_"), x.cast("string"), F.lit(" u_r"), x.cast("string"), F.lit(" (.clk(clk), .en(en));\n"))), ""), F.lit("endmodule\n"),
        ).alias("text")
    ).select(F.lit("rtl/top.v").alias("path"), "text", F.lit(0).alias("pos"))
    cells = table(spark, sf_dir, "customer").select(F.lower(F.substring("c_mktsegment", 1, 4)).alias("s")).distinct().select(
        F.concat(F.lit("rtl/cell_"), "s", F.lit(".v")).alias("path"),
        F.concat(F.lit("module cell_"), "s", F.lit(" #(parameter K = 1) (input clk, input d, output reg q);\n  always @(posedge clk) q <= d;\nendmodule\n")).alias("text"), F.lit(100).alias("pos"),
    )
    leaf = spark.range(1).select(F.lit("rtl/leaf.v").alias("path"), F.lit("module leaf #(parameter ID = 0) (input a, output b);\n  assign b = a;\nendmodule\n").alias("text"), F.lit(99).alias("pos"))
    every = tops.union(regions.select("path", "text", F.col("pos").cast("int"))).union(nations.select("path", "text", F.col("pos").cast("int"))).union(cells).union(leaf)
    # Rendering gathers a nation's customers in one row; the rows are dealt out so that reading them is not one task.
    return every.repartition(spark.sparkContext.defaultParallelism, "path")
