"""Verilog text to relations: one Arrow pass over the files, then ordinary tables by explode."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import verilog
from gatelake.plans.frontier import expand
from gatelake.plans.store import keep
from gatelake.sources.rtl import resolve_includes

_STR, _INT = pa.string(), pa.int32()
_PAIR = lambda a, b: pa.struct([(a, _STR), (b, _STR)])
_INSTANCE = pa.struct([("inst", _STR), ("child", _STR), ("overrides", pa.map_(_STR, _STR)), ("ports", pa.list_(_PAIR("port", "expr"))), ("line", _INT)])
_SCAN = pa.schema(
    [
        ("path", _STR), ("module", _STR), ("kind", _STR), ("line", _INT), ("parameters", pa.list_(_PAIR("name", "value"))),
        ("ports", pa.list_(pa.struct([("name", _STR), ("direction", _STR), ("dims", _STR), ("line", _INT), ("names", pa.list_(_STR))]))),
        ("nets", pa.list_(_PAIR("name", "dims"))), ("instances", pa.list_(_INSTANCE)),
        ("edges", pa.list_(pa.struct([("src", _STR), ("dst", _STR), ("kind", _STR), ("line", _INT)]))),
        ("binds", pa.list_(pa.struct([("target", _STR), ("inst", _STR), ("child", _STR), ("ports", pa.list_(_PAIR("port", "expr")))]))),
    ]
)
SCAN = (
    "path string, module string, kind string, line int, parameters array<struct<name:string,value:string>>, "
    "ports array<struct<name:string,direction:string,dims:string,line:int,names:array<string>>>, nets array<struct<name:string,dims:string>>, "
    "instances array<struct<inst:string,child:string,overrides:map<string,string>,ports:array<struct<port:string,expr:string>>,line:int>>, "
    "edges array<struct<src:string,dst:string,kind:string,line:int>>, binds array<struct<target:string,inst:string,child:string,ports:array<struct<port:string,expr:string>>>>"
)


def _maps(ports: list[tuple[str, str]]) -> list[dict]:
    return [{"port": p, "expr": e} for p, e in ports]


def _read(path: str, m: verilog.Module, *args, **options) -> dict:
    """The record of a module; one nested too deeply to be read has the kind ``too-deep`` and no contents."""
    try:
        return _record(path, m, verilog.Scope(m, *args, **options))
    except RecursionError:
        return {"path": path, "module": m.name, "kind": "too-deep", "line": m.line} | {c: [] for c in ("parameters", "ports", "nets", "instances", "edges", "binds")}


def _record(path: str, m: verilog.Module, scope: verilog.Scope) -> dict:
    out = scope.out
    return {
        "path": path, "module": m.name, "kind": m.kind, "line": m.line, "parameters": [{"name": n, "value": scope.ctx.get(n, v)} for n, v in dict(out.parameters).items()],
        "ports": [{"name": p.name, "direction": p.direction, "dims": p.dims, "line": p.line, "names": p.names} for p in out.ports],
        "nets": [{"name": n, "dims": d} for n, d in dict(out.nets).items()],
        "instances": [{"inst": i.name, "child": i.cell, "overrides": list(i.overrides.items()), "ports": _maps(i.ports), "line": i.line} for i in out.instances],
        "edges": [{"src": e.src, "dst": e.dst, "kind": e.kind, "line": e.line} for e in out.edges],
        "binds": [{"target": t, "inst": i.name, "child": i.cell, "ports": _maps(i.ports)} for t, i in out.binds],
    }


def preprocess(sources: DataFrame, defines: dict[str, str] | None = None, *, preserve: bool = False) -> DataFrame:
    """path and text after comment strip, conditional compilation and macro expansion; includes named, and define ops.

    A column ``defines`` (map) on ``sources`` overlays the common ones, file by file; a column ``headers`` (map of include
    name to text, see ``with_includes``) is what includes are replaced with. ``preserve`` keeps the text of all branches.
    """
    extra = [c for c in ("defines", "headers") if c in sources.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                headers = dict(r.get("headers") or [])
                p = verilog.preprocess(r["text"] or "", (defines or {}) | dict(r.get("defines") or []), lambda _, name: headers.get(name), preserve=preserve)  # noqa: B023
                rows.append({"path": r["path"], "text": p.text, "ops": [{"op": a, "name": b, "value": c} for a, b, c in p.ops], "includes": [n for _, n in p.includes]})
            kind = pa.schema([("path", _STR), ("text", _STR), ("ops", pa.list_(pa.struct([("op", _STR), ("name", _STR), ("value", _STR)]))), ("includes", pa.list_(_STR))])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return sources.select("path", "text", *extra).mapInArrow(run, "path string, text string, ops array<struct<op:string,name:string,value:string>>, includes array<string>")


def with_includes(sources: DataFrame, headers: DataFrame, incdirs: Sequence[str]) -> DataFrame:
    """``sources`` (path, text) with ``headers``: the texts of everything a file includes, through any number of files, by include name.

    ``headers`` has path and text. All files share the rounds of one closure; of equal names the nearest include wins, then
    the first path.
    """
    said = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)`include\s+([\"<][^\">\n]+)[\">]"), F.lit(1)))
    both = sources.select("path", "text").union(headers.select("path", "text"))
    uses = both.select(F.col("path").alias("source"), said.alias("s")).select("source", F.substring("s", 2, 1 << 30).alias("name"), F.substring("s", 1, 1).alias("quote")).distinct()
    found = keep(resolve_includes(uses, headers, incdirs).where("path is not null"))
    reached = expand(sources.select(F.col("path").alias("label"), F.col("path").alias("node")), keep(found.select(F.col("source").alias("src"), F.col("path").alias("dst")).distinct()))
    named = reached.join(found, reached["node"] == found["source"]).groupBy("label", "name").agg(F.min_by("path", F.struct("hop", "path")).alias("path"))
    bodies = named.join(headers.select("path", "text"), "path").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("headers"))
    return sources.join(bodies.withColumnRenamed("label", "path"), "path", "left")


def scan(sources: DataFrame, defines: dict[str, str] | None = None, *, over_approximate: bool = True, fold_constants: bool = True, preprocessed: bool = False) -> DataFrame:
    """One row for each module of each file, with its parameters, ports, nets, instances, edges and binds under default parameters.

    Reading, preprocessing and scanning are one pass; the text does not leave the task.
    """
    has = "defines" in sources.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["text"] or ""
                if not preprocessed:
                    text = verilog.preprocess(text, (defines or {}) | dict(r.get("defines") or [])).text
                rows += [_read(r["path"], m, over_approximate=over_approximate, fold_constants=fold_constants) for m in verilog.modules(text)]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)

    return sources.select("path", "text", *(["defines"] if has else [])).mapInArrow(run, SCAN)


def module_texts(sources: DataFrame, defines: dict[str, str] | None = None) -> DataFrame:
    """module, kind, path, line and body text of each module after preprocessing; of equal names the first by path."""
    kind = pa.schema([("module", _STR), ("kind", _STR), ("path", _STR), ("line", _INT), ("body", _STR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [{"module": m.name, "kind": m.kind, "path": path, "line": m.line, "body": m.text} for m in verilog.modules(verilog.preprocess(text or "", defines).text)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    found = sources.select("path", "text").mapInArrow(run, "module string, kind string, path string, line int, body string")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("module").orderBy("path", "line"))).where("n = 1").drop("n")


def scan_under(contexts: DataFrame, *, over_approximate: bool = True, fold_constants: bool = True) -> DataFrame:
    """``scan`` of module bodies under parameter contexts: module, kind, path, line, body and ctx (map) per row; ``ctx_key`` names the context."""
    kind = _SCAN.append(pa.field("ctx_key", _STR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                m = verilog.Module(r["module"], r["kind"], r["body"], r["line"])
                rows.append(_read(r["path"], m, dict(r["ctx"] or []), over_approximate=over_approximate, fold_constants=fold_constants) | {"ctx_key": r["ctx_key"]})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return contexts.select("module", "kind", "path", "line", "body", "ctx", "ctx_key").mapInArrow(run, SCAN + ", ctx_key string")


def context_key(ctx: Column) -> Column:
    """A text that names a parameter map, whatever the order of its entries."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(ctx)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def declared_modules(sources: DataFrame) -> DataFrame:
    """path and module of lines that start with module, interface or program; nothing is preprocessed."""
    names = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*(?:module|interface|program)\s+(?:automatic\s+|static\s+)?([A-Za-z_][\w$]*)"), F.lit(1))
    return sources.select("path", F.explode(names).alias("module"))


def module_files(declared: DataFrame) -> DataFrame:
    """module and its files in order; duplicates stay."""
    return declared.groupBy("module").agg(F.array_sort(F.collect_list("path")).alias("files"))


def file_modules(declared: DataFrame) -> DataFrame:
    return declared.groupBy("path").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def instance_edges(scanned: DataFrame) -> DataFrame:
    """module, inst, child, overrides and line; of one name in a module an indexed child wins, then the longer child name, then the first."""
    rows = scanned.select("module", F.posexplode("instances").alias("pos", "i")).select("module", "i.inst", "i.child", "i.overrides", "i.line", "pos")
    known = scanned.select(F.col("module").alias("child")).distinct().withColumn("known", F.lit(1))
    order = Window.partitionBy("module", "inst").orderBy(F.coalesce("known", F.lit(0)).desc(), F.length("child").desc(), "pos")
    return rows.join(known, "child", "left").withColumn("n", F.row_number().over(order)).where("n = 1").select("module", "inst", "child", "overrides", "line")


def ports(scanned: DataFrame) -> DataFrame:
    return scanned.select("module", F.explode("ports").alias("p")).select("module", "p.*")


def port_maps(scanned: DataFrame) -> DataFrame:
    """module, inst, child, port and expr of named connections."""
    return scanned.select("module", F.explode("instances").alias("i")).select("module", "i.inst", "i.child", F.explode("i.ports").alias("m")).select("module", "inst", "child", "m.port", "m.expr")


def nets(scanned: DataFrame) -> DataFrame:
    return scanned.select("module", F.explode("nets").alias("n")).select("module", "n.*")


def local_edges(scanned: DataFrame, *, include_ff: bool = True) -> DataFrame:
    """module, src, dst, kind; equal edges once, none from a net to itself. Without ``include_ff`` registers are barriers."""
    rows = scanned.select("module", F.explode("edges").alias("e")).select("module", "e.src", "e.dst", "e.kind").where("src <> dst")
    return (rows if include_ff else rows.where("kind <> 'ff'")).distinct()


def with_binds(scanned: DataFrame) -> DataFrame:
    """Port maps of bound cells under the module they are bound into."""
    return scanned.select(F.explode("binds").alias("b")).select(F.col("b.target").alias("module"), "b.inst", "b.child", F.explode("b.ports").alias("m")).select("module", "inst", "child", "m.port", "m.expr")


def undefined_targets(edges: DataFrame, modules: DataFrame, *, ignoring: bool = False) -> DataFrame:
    """Targets of instances that no module has, as stubs: ``ignorePath`` once any ignore rule is set, else ``unknown``."""
    return edges.select(F.col("child").alias("module")).distinct().join(modules.select("module"), "module", "left_anti").withColumn("stop_reason", F.lit("ignorePath" if ignoring else "unknown"))


def with_library(modules: DataFrame, library: DataFrame) -> DataFrame:
    """Design modules beside those library modules (as black boxes) that the design does not define."""
    own = modules.select("module", F.lit("").alias("stop_reason"), F.lit(False).alias("is_blackbox"))
    added = library.select("module").distinct().join(own.select("module"), "module", "left_anti")
    return own.unionByName(added.select("module", F.lit("ignorePath").alias("stop_reason"), F.lit(True).alias("is_blackbox")))


def patch(old: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """A scan after files changed: rows of changed and removed files leave, rows of the new scan come."""
    gone = changed.select("path").union(removed.select("path")).distinct()
    return old.join(gone, "path", "left_anti").unionByName(changed)


def expand_array(base: F.Column, lo: F.Column, hi: F.Column, max_width: int = 64) -> Column:
    """Names of an instance array, counted upward; wider ones keep their literal range."""
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    each = F.transform(F.sequence(a, b), lambda i: F.concat(base, F.lit("["), i.cast("string"), F.lit("]")))
    return F.when(b - a + 1 <= max_width, each).otherwise(F.array(F.concat(base, F.lit("["), hi.cast("string"), F.lit(":"), lo.cast("string"), F.lit("]"))))


def statements(texts: DataFrame) -> DataFrame:
    """module, idx, line, kind and text of a module body's top-level statements; ``texts`` is ``module_texts``.

    Blocks, loops and cases are one statement each, whatever semicolons they hold.
    """
    kind = pa.schema([("module", _STR), ("idx", _INT), ("line", _INT), ("kind", _STR), ("text", _STR)])

    def flat(s: tuple) -> list[verilog.Tok]:
        out = []
        for part in s[1:]:
            if isinstance(part, verilog.Tok):
                out.append(part)
            elif isinstance(part, (list, tuple)):
                out += flat(("", *part))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for module, line, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ts = verilog.Scope._split(verilog.tokens(body, line))[1]
                for k, s in enumerate(verilog.Parser(ts).all()):
                    own = flat(s)
                    rows.append({"module": module, "idx": k, "line": own[0].line if own else line, "kind": s[0] if s[0] != "simple" else own[0].text if own and own[0].text in ("assign", "wire", "reg", "logic", "genvar", "input", "output") else "simple", "text": verilog.text_of(own)})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return texts.select("module", "line", "body").mapInArrow(run, "module string, idx int, line int, kind string, text string")


def blank_comments(sources: DataFrame) -> DataFrame:
    """path and text without comments, aware of strings; block comments become blanks, so lines keep their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([verilog.blank_comments(t or "") for t in batch.column(1).to_pylist()], _STR)], ["path", "text"])

    return sources.select("path", "text").mapInArrow(run, "path string, text string")


def connect_nodes(expr: Column) -> Column:
    """Signals of an expression with constant selects kept (``bus[0]`` is not ``bus[1]``); literals are no signals."""
    bare = F.regexp_replace(expr, r"\d*'[sS]?[bodhBODH][0-9a-fA-FxXzZ_?]+", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![\w$.])[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*(?:\[\d+(?::\d+)?\])*"), F.lit(0)))


def dependency_edges(sources: DataFrame, defines: dict[str, str] | None = None) -> DataFrame:
    """The second reading of a file: path, module, src, dst, kind of its first module; every named actual drives the formal.

    Only the first module's name of a file is kept, and any clocked or non-blocking procedure counts as ff.
    """
    first = scan(sources, defines, fold_constants=False).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where("n = 1")
    own = first.select("path", "module", F.explode("edges").alias("e")).select("path", "module", "e.src", "e.dst", F.col("e.kind").alias("kind"))
    maps = first.select("path", "module", F.explode("instances").alias("i")).select("path", "module", "i.inst", F.explode("i.ports").alias("m"))
    down = maps.select("path", "module", F.explode(connect_nodes(F.col("m.expr"))).alias("src"), F.concat("inst", F.lit("."), "m.port").alias("dst"), F.lit("port").alias("kind"))
    return own.union(down).distinct()


def module_headers(texts: DataFrame) -> DataFrame:
    """module, header and body: what stands before the first semicolon of a module outside brackets, and after; ``texts`` is ``module_texts``."""
    kind = pa.schema([("module", _STR), ("header", _STR), ("body", _STR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for module, line, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                header, rest = verilog.Scope._split(verilog.tokens(body, line))
                rows.append({"module": module, "header": verilog.text_of(header), "body": verilog.text_of(rest)})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return texts.select("module", "line", "body").mapInArrow(run, "module string, header string, body string")


def connect_index(contexts: DataFrame, *, flags: Sequence[tuple[bool, bool]] = ((True, True),)) -> DataFrame:
    """The connect index of module bodies: module, ctx_key, over_approximate, fold_constants, parameters, ports, nets, port maps and edges.

    One row for each module, parameter context and pair of flags; ``contexts`` is as in ``scan_under``.
    """
    parts = [scan_under(contexts, over_approximate=o, fold_constants=f).withColumns({"over_approximate": F.lit(o), "fold_constants": F.lit(f)}) for o, f in flags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    maps = F.flatten(F.transform("instances", lambda i: F.transform(i["ports"], lambda m: F.struct(i["inst"].alias("inst"), i["child"].alias("child"), m["port"].alias("port"), m["expr"].alias("expr")))))
    return out.select("module", "ctx_key", "over_approximate", "fold_constants", "parameters", "ports", "nets", maps.alias("port_maps"), "edges")
