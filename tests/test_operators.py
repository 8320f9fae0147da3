from pyspark.sql import functions as F

from gatelake.operators import checks, graph, hierarchy, scan, search
from gatelake.sources import cache


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def seeds(spark, *paths):
    rows = [(p, p, p[p.index("[") :] if "[" in p else None) for p in paths]
    return frame(spark, rows, "path string, node string, sel string")


def test_meet_keeps_elements_apart(spark):
    edges = frame(spark, [("m", "m[0]", "array_el"), ("m", "m[1]", "array_el"), ("a0", "m[0]", "assign"), ("m[0]", "b0", "assign"), ("a1", "m[1]", "assign"), ("m[1]", "b1", "assign")], "src string, dst string, kind string")
    got = {(r["src"], r["dst"]) for r in graph.meet(seeds(spark, "a0", "a1"), seeds(spark, "b0", "b1"), edges, elements=True).collect()}
    assert got == {("a0", "b0"), ("a1", "b1")}
    loose = {(r["src"], r["dst"]) for r in graph.meet(seeds(spark, "a0", "a1"), seeds(spark, "b0", "b1"), edges).collect()}
    assert len(loose) == 4
    whole = {(r["src"], r["dst"]) for r in graph.meet(seeds(spark, "m"), seeds(spark, "b0", "b1"), edges, elements=True).collect()}
    assert whole == {("m", "b0"), ("m", "b1")}


def test_meet_strict_slices(spark):
    edges = frame(spark, [("x", "y")], "src string, dst string")
    a = frame(spark, [("x[0]", "x", "[0]"), ("x[1]", "x", "[1]")], "path string, node string, sel string")
    b = frame(spark, [("y[0]", "y", "[0]")], "path string, node string, sel string")
    assert {(r["src"], r["connectivity_level"]) for r in graph.meet(a, b, edges, allow_base=False).collect()} == {("x[0]", "slice_identity")}
    assert {(r["src"], r["connectivity_level"]) for r in graph.meet(a, b, edges).collect()} == {("x[0]", "slice_identity"), ("x[1]", "base")}


def test_cone_ignores_scopes_and_exempts_seeds(spark):
    edges = frame(spark, [("t.a", "t.u.b"), ("t.u.b", "t.u.c"), ("t.a", "t.d"), ("t.d", "t.a")], "src string, dst string")
    bounds = frame(spark, [("t.a", "port-in")], "node string, boundary string")
    got = {r["node"]: r["boundary"] for r in graph.cone(frame(spark, [("s", "t.a")], "label string, node string"), edges, bounds, ignore=["t.u"]).collect()}
    assert got == {"t.a": "", "t.u.b": "ignore-hierarchy", "t.d": ""}


def test_top_modules_fall_back_to_all(spark):
    mods = frame(spark, [("a",), ("b",)], "module string")
    assert {r[0] for r in hierarchy.top_modules(mods, frame(spark, [("a", "b"), ("b", "a")], "module string, child string")).collect()} == {"a", "b"}
    assert {r[0] for r in hierarchy.top_modules(mods, frame(spark, [("a", "b")], "module string, child string")).collect()} == {"a"}


def test_parameters_go_down_and_recursion_stops(spark):
    text = "module top; mid #(.N(3)) u (); mid v (); endmodule module mid #(parameter N = 1) (); for (genvar i = 0; i < N; i = i + 1) begin : g leaf #(.W(N * 2)) l (); end gone x (); endmodule module leaf #(parameter W = 0) (); leaf again (); endmodule"
    texts = scan.module_texts(frame(spark, [("t.v", text)], "path string, text string"))
    got = {r["full_path"]: (r["param_ctx"], r["stop_reason"]) for r in hierarchy.elaborate_parameters(texts, frame(spark, [("top",)], "module string")).collect()}
    assert got["top.u.g[2].l"] == ({"W": "6"}, "") and got["top.v.g[0].l"] == ({"W": "2"}, "") and "top.v.g[1].l" not in got
    assert got["top.u.x"][1] == "unknown" and got["top.u.g[0].l.again"][1] == "recursion"


def test_endpoint_priorities(spark):
    rows = frame(spark, [("t", "top"), ("t.u", "cell")], "full_path string, module string")
    ports = frame(spark, [("top", "u"), ("cell", "p")], "module string, name string")
    nets = frame(spark, [("cell", "n")], "module string, name string")
    ends = frame(spark, [(p,) for p in ("t.u", "t.u.p", "t.u.n[3]", "t.u.z", "t.gone.p")], "path string")
    got = {r["path"]: (r["kind"], r["scope"], r["net"]) for r in hierarchy.resolve_endpoints(rows, ports, nets, ends).collect()}
    assert got == {"t.u": ("port", "t", "u"), "t.u.p": ("port", "t.u", "p"), "t.u.n[3]": ("net", "t.u", "n[3]"), "t.u.z": ("tail", "t.u", "z"), "t.gone.p": ("miss", "t", "p")}


def test_search_patterns_with_commas_and_quotes():
    assert search.split_patterns('"a", b ,') == ["a", "b"] and search.split_patterns(["x,y"]) == ["x,y"] and search.split_patterns("") == []


def test_loops_and_unequal_lengths(spark):
    c = frame(spark, [("k", ["x[3:0]"], ["y[1:0]"])], "check_id string, a array<string>, b array<string>")
    assert checks.pair_up(c).head()["error"] == "length mismatch: 4 vs 2"
    c = frame(spark, [("k", ["x[1:0]"], ["y[0:1]"])], "check_id string, a array<string>, b array<string>")
    assert [(r["a"], r["b"]) for r in checks.pair_up(c, bit_align="msb").collect()] == [("x[1]", "y[1]"), ("x[0]", "y[0]")]


def test_content_key_depends_on_every_file(spark):
    a = frame(spark, [("a", "x"), ("b", "y")], "path string, text string")
    b = frame(spark, [("b", "y"), ("a", "x")], "path string, text string").repartition(3)
    assert cache.content_key(a, {"W": 1}) == cache.content_key(b, {"W": 1}) != cache.content_key(a, {"W": 2})
    assert cache.content_key(a.where("path = 'a'"), {}) != cache.content_key(a, {})


def test_instance_edges_of_bound_cells(spark):
    got = scan.scan(frame(spark, [("t.v", "bind tgt chk u (.a(x)); module m; bind tgt chk w (.a(y)); endmodule")], "path string, text string"))
    assert [(r["module"], r["inst"], r["port"], r["expr"]) for r in scan.with_binds(got).collect()] == [("tgt", "w", "a", "y")]


def test_net_edges_of_expressions(spark):
    rows = frame(spark, [("t", "top"), ("t.u", "c")], "full_path string, module string")
    maps = frame(spark, [("top", "u", "d", "{a, 1'b0, b[2]}"), ("top", "u", "e", "~c")], "module string, inst string, port string, expr string")
    got = {(r["src"], r["dst"], r["kind"]) for r in graph.net_edges(rows, frame(spark, [("c", "d", "q", "ff")], "module string, src string, dst string, kind string"), maps).collect()}
    assert got == {("t.a", "t.u.d", "port"), ("t.b[2]", "t.u.d", "port"), ("t.c", "t.u.e", "port"), ("t.u.d", "t.u.q", "ff")}


def test_row_search_without_dots_is_a_substring(spark):
    rows = frame(spark, [("t", "t", "top"), ("t.u_Niu0", "u_Niu0", "x")], "full_path string, inst_leaf string, module string")
    assert search.search(rows, "niu").select(F.col("full_path")).collect()[0][0] == "t.u_Niu0"


def test_nothing_is_cut_in_silence(spark):
    edges = spark.createDataFrame([(f"m{k}", "u", f"m{k + 1}") for k in range(81)], "module string, inst string, child string")
    top = spark.createDataFrame([("m0",)], "module string")
    from gatelake.operators import scan
    from gatelake.plans.frontier import elaborate

    whole = elaborate(edges, top)
    assert whole.count() == 82 and whole.where("stop_reason <> ''").count() == 0
    short = {r["depth"]: r["stop_reason"] for r in elaborate(edges, top, max_depth=3).collect()}
    assert short == {0: "", 1: "", 2: "", 3: "max-depth"}
    deep = "module d; always_comb " + "begin " * 4000 + "y = a; " + "end " * 4000 + "endmodule\nmodule e; assign y = a; endmodule"
    got = {r["module"]: r["kind"] for r in scan.scan(spark.createDataFrame([("p", deep)], "path string, text string")).collect()}
    assert got == {"d": "too-deep", "e": "module"}


def test_connected_says_where_it_was_cut(spark):
    from gatelake.operators import graph

    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")
    checks = spark.createDataFrame([(1, 0, 3), (2, 0, 9), (3, 0, 99)], "check_id long, a long, b long")
    got = {r["check_id"]: (r["connected"], r["hops"], r["cut"]) for r in graph.connected(checks, edges, max_hops=4).collect()}
    assert got[1] == (True, 3, False) and got[2] == (False, None, True) and got[3][0] is False
    whole = {r["check_id"]: (r["connected"], r["hops"], r["cut"]) for r in graph.connected(checks, edges).collect()}
    assert whole == {1: (True, 3, False), 2: (True, 9, False), 3: (False, None, False)}


def test_names_are_replaced_where_they_end(spark):
    from pyspark.sql import functions as F

    from gatelake.functions import columns as C

    df = spark.createDataFrame([("$A/$AB/${A}/$(A)$A",)], "p string")
    assert df.select(C.expand_names(F.col("p"), {"A": F.lit("x$y")})).head()[0] == "x$y/$AB/x$y/x$yx$y"
