from hypothesis import given
from hypothesis import strategies as st

from gatelake.functions import verilog as V


def scope(text, name=None, defines=None, **how):
    ms = V.modules(V.preprocess(text, defines).text)
    return V.Scope(next(m for m in ms if name in (None, m.name)), **how).out


def edges(text, **how):
    return {(e.src, e.dst, e.kind) for e in scope(f"module t; {text} endmodule", **how).edges}


def instances(text, **how):
    return [(i.name, i.cell) for i in scope(f"module t #(parameter N = 2); {text} endmodule", **how).instances]


def test_comments():
    assert V.strip_comments('a // x /* y\nb /* c\n d */ e /* open') == "a \nb  e "
    assert V.strip_comments('s = "http://x";') == 's = "http:'
    assert V.blank_comments('s = "http://x"; /* a\nb */ c') == 's = "http://x";     \n     c'.replace("     \n", "     \n")


def test_inactive_values_count_as_undefined():
    for value in V.INACTIVE:
        assert V.preprocess("`ifdef A\nx\n`else\ny\n`endif", {"A": value}).text.split() == ["y"]
    assert V.preprocess("`ifdef A\nx\n`endif", {"A": "1"}).text.split() == ["x"]


def test_conditional_nesting_and_inline():
    text = "`ifdef A `ifdef B both `else only_a `endif `elsif C c `else none `endif"
    for names, want in (({"A": "1", "B": "1"}, "both"), ({"A": "1"}, "only_a"), ({"C": "1"}, "c"), ({}, "none"), ({"A": "1", "C": "1"}, "only_a")):
        assert V.preprocess(text, names).text.split() == [want]


def test_macros():
    p = V.preprocess("`define W 8\n`define V `W\n`define P (1+2)\nw=`V; p=`P; u=`U;\n`undef W\nz=`W;")
    assert p.text.split() == ["w=8;", "p=`P;", "u=`U;", "z=`W;"]
    assert p.ops == [("set", "W", "8"), ("set", "V", "`W"), ("set", "P", "(1+2)"), ("undef", "W", "")]


def test_includes_are_put_in_and_define():
    files = {"a.vh": "`define X 3\nwire a;", "b.vh": '`include "a.vh"\n'}
    p = V.preprocess('`include "b.vh"\nw=`X;\n`include <gone.vh>', include=lambda q, n: files.get(n))
    assert "wire a;" in p.text and "w=3;" in p.text and ("<", "gone.vh") in p.includes


def test_constant_expressions():
    ctx = {"A": "3", "B": "A + 1", "L": "L"}
    for text, want in (("2*(A+1)-1", 7), ("8'hF0", 240), ("-3 + 5", 2), ("A == 3 ? B : 0", 4), ("!A", 0), ("A < 2", 0), ("A / 2", None), ("1 << 2", None), ("A % 2", None), ("A && 1", None), ("X", None), ("L", None), ("", None), ("(1", None), ("4'b1x0z", None)):
        assert V.evaluate(text, ctx) == want, text


@given(st.integers(0, 999), st.integers(0, 999), st.integers(0, 99), st.sampled_from(["+", "-", "*"]), st.sampled_from(["+", "-", "*"]))
def test_constant_expressions_like_python(a, b, c, p, q):
    assert V.evaluate(f"{a} {p} {b} {q} {c}", {}) == eval(f"{a} {p} {b} {q} {c}")


def test_parameters_fixpoint_and_overrides():
    declared = [("W", "N * 2"), ("N", "4"), ("S", "\"x\"")]
    assert V.resolve_parameters(declared) == {"W": "8", "N": "4", "S": '"x"'}
    assert V.resolve_parameters(declared, {"N": "P + 1"}, {"P": "2"}) == {"N": "3", "W": "6", "S": '"x"'}


def test_instances_and_arrays():
    assert instances("mem u_arr [3:0] (); wire u_b; foo #(.A(1)) u_a (.x(y)), u_c ();") == [(f"u_arr[{i}]", "mem") for i in range(4)] + [("u_a", "foo"), ("u_c", "foo")]
    assert instances("mem u [0:1][1:0] ();") == [("u[0][0]", "mem"), ("u[0][1]", "mem"), ("u[1][0]", "mem"), ("u[1][1]", "mem")]


def test_generate():
    assert instances("for (genvar i = 0; i < N; i = i + 1) begin : g leaf u (); end") == [("g[0].u", "leaf"), ("g[1].u", "leaf")]
    assert instances("if (N == 2) begin a u (); end else begin b u (); end") == [("u", "a")]
    assert instances("if (X) a u (); else b v ();") == [("v", "b")]
    assert instances("if (X) a u (); else b v ();", over_approximate=False) == []
    assert instances("case (N) 1: a u (); 2: b v (); default: c w (); endcase") == [("v", "b")]


def test_assign_edges_and_folds():
    assert edges("assign y = a & b;") == {("a", "y", "assign"), ("b", "y", "assign")}
    for rhs in ("1'b0", "a + 0", "a - a", "a * 1", "a ^ a", "a & a", "a & ~a", "a | ~a", "a * 0", "a & 0", "f(a)"):
        assert edges(f"assign y = {rhs};") == set(), rhs
    assert edges("assign y = a & 0;", fold_constants=False) == {("a", "y", "assign")}
    assert edges("assign y = 1 ? a : b;") == {("a", "y", "assign")}
    assert edges("assign y = s ? a : b;", over_approximate=False) == {("b", "y", "assign")}
    assert edges("assign {p, q} = {a, b};") == {("a", "p", "assign"), ("b", "q", "assign")}
    assert edges("assign {p, q} = {a, b, c};") == set()
    assert edges("assign y[1] = x[3:2];") == {("x[3:2]", "y[1]", "assign")}
    assert edges("assign t = 1'b1; assign y = t;") == set()


def test_procedural_edges():
    assert edges("always_ff @(posedge clk) if (r) q <= 0; else q <= d;") == {("d", "q", "ff")}
    assert edges("always @(posedge clk or negedge n) begin q <= d; end") == {("d", "q", "ff")}
    assert edges("always_comb begin y = a; y = b; end") == {("b", "y", "comb")}
    assert edges("always @* case (2) 1: y = a; 2: y = b; endcase") == {("b", "y", "comb")}
    assert edges("always @(*) casez (s) 2'b1?: y = a; default: y = b; endcase") == set()
    assert edges("nand (o, a, b);") == {("a", "o", "gate"), ("b", "o", "gate")}


def test_ports():
    out = scope("module t #(parameter W = 3) (input clk, input [W-1:0] a, b, output reg [1:0][X:0] y); inout z; endmodule")
    got = {p.name: (p.direction, p.names) for p in out.ports}
    assert got["a"] == ("input", ["a[0]", "a[1]", "a[2]", "a[2:0]", "a"]) and got["b"][1][-1] == "b" and got["clk"] == ("input", ["clk"])
    assert got["y"][0] == "output" and got["z"][0] == "inout"


def test_port_maps_of_arrays_and_positional():
    out = scope("module t; c u [1:0] (.a(x), .b(y[1]), .clk(clk), .d()); c v (p, q); endmodule")
    assert [i.ports for i in out.instances] == [[("a", f"x[{k}]"), ("b", "y[1]" ), ("clk", "clk"), ("d", "")] for k in (0, 1)] + [[]]


@given(st.text(alphabet="module endmodule begin end();`ifdef x=[]{}:?'\"\n/*", max_size=200))
def test_any_text_is_read(text):
    for m in V.modules(V.preprocess("module a;\n" + text).text):
        V.Scope(m)


def test_a_loop_reads_an_instance_once_for_equal_numbers(monkeypatch):
    read, real = [], V.split_top
    monkeypatch.setattr(V, "split_top", lambda ts, sep=",": (read.append(sep), real(ts, sep))[1])
    text = "module m #(parameter N = 40) (input a); genvar i; for (i = 0; i < N; i = i + 1) begin : g leaf u (.a(a), .b(N)); cell #(.K(i)) v (.a(x[i])); end endmodule"
    out = V.Scope(V.modules(text)[0]).out
    assert [(i.name, i.overrides, i.ports) for i in out.instances] == [x for i in range(40) for x in ((f"g[{i}].u", {}, [("a", "a"), ("b", "N")]), (f"g[{i}].v", {"K": str(i)}, [("a", f"x[{i}]")]))]
    assert out.instances[0].ports is not out.instances[2].ports
    short = len(read)
    read.clear()
    V.Scope(V.modules(text.replace("N = 40", "N = 20"))[0])
    assert short - len(read) == 20 * 4  # of each further round only the instance that depends on i is split: overrides, names, ports and a select
