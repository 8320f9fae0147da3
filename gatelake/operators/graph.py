"""Connectivity over net graphs: expansion, meeting, cones, traces and electrical components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import columns as C
from gatelake.plans.components import connected_components
from gatelake.plans.frontier import expand, meet_ends
from gatelake.plans.store import counted, keep


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    back = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back).distinct()


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Edges with equal ends and kind once, none from a node to itself."""
    return edges.where("src <> dst").dropDuplicates(["src", "dst", "kind"])


def promote_slices(edges: DataFrame) -> DataFrame:
    """Undirected edges beside those between a slice's net and the net as a whole, and between the whole nets."""
    base = lambda c: F.regexp_replace(c, r"\[[^\]]*\]$", "")
    a, b = F.col("src"), F.col("dst")
    pairs = F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(base(a).alias("src"), b.alias("dst")), F.struct(a.alias("src"), base(b).alias("dst")), F.struct(base(a).alias("src"), base(b).alias("dst")), F.struct(base(a).alias("src"), a.alias("dst")), F.struct(base(b).alias("src"), b.alias("dst")))
    sliced = edges.where(a.endswith("]") | b.endswith("]"))
    return edges.select("src", "dst").union(sliced.select(F.explode(pairs).alias("p")).select("p.src", "p.dst")).where("src <> dst").distinct()


def mirror_elements(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Whole-to-whole port edges repeated for each element (net, sel) that both ends have."""
    left = elements.select(F.col("net").alias("src"), "sel")
    right = elements.select(F.col("net").alias("dst"), "sel")
    each = edges.where("kind = 'port'").join(left, "src").join(right, ["dst", "sel"])
    return edges.unionByName(each.select(F.concat("src", "sel").alias("src"), F.concat("dst", "sel").alias("dst"), "kind").distinct())


def local_representatives(edges: DataFrame) -> DataFrame:
    """module, net and rep: nets that the module's own edges connect, whatever the direction, share the smallest name."""
    key = lambda c: F.concat("module", F.lit("\u0001"), F.col(c))
    got = connected_components(edges.select(key("src").alias("a"), key("dst").alias("b")), keep)
    part = lambda c, n: F.split_part(F.col(c), F.lit("\u0001"), F.lit(n))
    return got.select(part("node", 1).alias("module"), part("node", 2).alias("net"), part("component", 2).alias("rep"))


def net_edges(rows: DataFrame, local: DataFrame, maps: DataFrame) -> DataFrame:
    """src, dst, kind over whole nets named ``scope.net``: each module's own edges in every instance, and named port maps.

    A port edge leads from the actual to the formal; ``directed_ports`` turns outputs round.
    """
    name = lambda scope, net: F.concat(scope, F.lit("."), net)
    inside = rows.select("full_path", "module").join(local, "module").select(name(F.col("full_path"), F.col("src")).alias("src"), name(F.col("full_path"), F.col("dst")).alias("dst"), "kind")
    roots = F.filter(F.regexp_extract_all("expr", F.lit(r"[A-Za-z_][\w$]*(?:\[[\d:]+\])*"), F.lit(0)), lambda s: ~s.rlike("^'|^[0-9]"))
    plain = F.regexp_replace("expr", r"\d*'[sS]?[bodhBODH][0-9a-fA-FxXzZ_?]+", "")
    actual = F.explode(F.when(F.contains("expr", F.lit("'")), F.regexp_extract_all(plain, F.lit(r"[A-Za-z_][\w$]*(?:\[[\d:]+\])*"), F.lit(0))).otherwise(roots))
    through = rows.select(F.col("full_path").alias("up"), "module").join(maps.select("module", "inst", "port", actual.alias("net")), "module")
    ports = through.select(name(F.col("up"), F.col("net")).alias("src"), F.concat("up", F.lit("."), "inst", F.lit("."), "port").alias("dst"), F.lit("port").alias("kind"))
    return inside.union(ports).distinct()


def passthrough(ports: DataFrame, edges: DataFrame) -> DataFrame:
    """module, src, dst of modules without contents that have one input and one output, both scalar."""
    empty = ports.join(edges.select("module").distinct(), "module", "left_anti")
    one = empty.groupBy("module").agg(F.count_if(F.col("direction") == "input").alias("i"), F.count_if(F.col("direction") == "output").alias("o"), F.count_if(F.col("dims") != "").alias("wide"), F.max(F.when(F.col("direction") == "input", F.col("name"))).alias("src"), F.max(F.when(F.col("direction") == "output", F.col("name"))).alias("dst"))
    return one.where("i = 1 and o = 1 and wide = 0").select("module", "src", "dst")


def fold_binds(bound: DataFrame, reps: DataFrame) -> DataFrame:
    """module, src, dst: parent nets that one component of a bound cell joins, each linked with the group's first net."""
    group = bound.join(reps.select(F.col("module").alias("child"), F.col("net").alias("port"), "rep"), ["child", "port"], "left").withColumn("rep", F.coalesce("rep", "port"))
    first = group.groupBy("module", "inst", "rep").agg(F.min("expr").alias("src"), F.max("expr").alias("last")).where("src < last")
    return group.join(first, ["module", "inst", "rep"]).where("expr <> src").select("module", "src", F.col("expr").alias("dst")).distinct()


def connected(checks: DataFrame, edges: DataFrame, *, directed: bool = False, max_hops: int | None = None) -> DataFrame:
    """check_id, a, b, connected, hops (fewest) and cut of checks with ends a and b. One loop serves all checks.

    Without ``max_hops`` ends in different components (direction aside) are told apart first, by components, and the rest
    is followed from both ends until they meet or one has nowhere to go on to. With it both sides expand, half the hops each
    at most, and meet on (check_id, net); ``cut`` says that a check is not connected as far as was looked, and that a side
    was still going on.
    """
    graph = keep(edges.select("src", "dst").distinct() if directed else both_ways(edges.select("src", "dst")))
    if max_hops is None:
        parts = connected_components(graph, keep, a="src", b="dst")
        placed = checks.select(F.col("check_id").alias("label"), "a", "b")
        for end in "ab":
            at = parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            placed = placed.join(at, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        met = meet_ends(keep(placed.where("of_a = of_b").select("label", "a", "b")), graph, undirected=not directed)
        got = checks.join(met.withColumnRenamed("label", "check_id"), "check_id", "left")
        return got.select("check_id", "a", "b", F.col("hops").isNotNull().alias("connected"), "hops", F.lit(False).alias("cut"))
    ends = lambda c: checks.select(F.col("check_id").alias("label"), F.col(c).alias("node"))
    half, rest = (max_hops + 1) // 2, max_hops // 2
    ahead = expand(ends("a"), graph, max_hops=half, undirected=not directed)
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    behind = expand(ends("b"), back, max_hops=rest, undirected=not directed).withColumnRenamed("hop", "other")
    going = ahead.where(F.col("hop") == half).select("label").union(behind.where(F.col("other") == rest).select("label")).distinct().withColumn("going", F.lit(True))
    met = ahead.join(behind, ["label", "node"]).groupBy("label").agg(F.min(F.col("hop") + F.col("other")).alias("hops"))
    got = checks.join(met, checks["check_id"] == met["label"], "left").drop("label").join(going.withColumnRenamed("label", "check_id"), "check_id", "left")
    return got.select("check_id", "a", "b", F.col("hops").isNotNull().alias("connected"), "hops", (F.col("hops").isNull() & F.coalesce("going", F.lit(False))).alias("cut"))


def reaches_scope(checks: DataFrame, edges: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """check_id, connected and hops where b is a scope: any net at or below it will do."""
    graph = keep(both_ways(edges.select("src", "dst")))
    checks = keep(checks)
    got = expand(checks.select(F.col("check_id").alias("label"), F.col("a").alias("node")), graph, max_hops=max_hops, undirected=True)
    hit = got.join(counted(checks.select(F.col("check_id").alias("label"), "b")), "label").where(C.below(F.col("node"), F.col("b"))).groupBy("label").agg(F.min("hop").alias("hops"))
    return checks.join(hit, checks["check_id"] == hit["label"], "left").select("check_id", F.col("hops").isNotNull().alias("connected"), "hops")


def stop_rule(path: Column, *, ignore: Sequence[str] = ()) -> Column:
    """Scopes where a trace stops: ``p.*`` strictly below p, ``p`` itself and below, or a glob."""
    from gatelake.functions.patterns import glob_regex, is_glob

    out = F.lit(False)
    for p in ignore:
        if p.endswith(".*") and not is_glob(p[:-2]):
            out = out | path.startswith(p[:-1])
        elif is_glob(p):
            out = out | path.rlike(f"^{glob_regex(p)}$")
        else:
            out = out | (path == p) | path.startswith(p + ".")
    return out


def cone(seeds: DataFrame, edges: DataFrame, boundaries: DataFrame, *, direction: str = "fanout", max_depth: int | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """label, node, hop and boundary (its kind, or empty) of a fan-out or fan-in cone.

    ``boundaries`` has node and boundary; these nodes, scopes of ``ignore`` and depth ``max_depth`` (none if not given) end the cone: they are
    in it and not expanded. Seeds are exempt.
    """
    graph = edges.select("src", "dst") if direction == "fanout" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    marked = counted(keep(boundaries.groupBy("node").agg(F.min("boundary").alias("boundary"))))
    ignored = stop_rule(F.col("dst"), ignore=ignore)
    graph = graph.join(marked.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", F.when(ignored, "ignore-hierarchy").otherwise(F.coalesce("boundary", F.lit(""))).alias("mark"))
    graph = keep(graph.distinct())
    step = lambda front, e: front.join(e, front["node"] == e["src"]).select("label", F.col("dst").alias("node"), e["mark"].alias("boundary"))
    start = seeds.select("label", "node").distinct().withColumn("boundary", F.lit(""))
    got = expand(start, graph, step=step, stop=F.col("boundary") != "", max_hops=max_depth)
    if max_depth is None:
        return got.select("label", "node", "hop", "boundary")
    going = got.where((F.col("hop") == max_depth) & (F.col("boundary") == "")).select("node").distinct()
    more = keep(going.join(counted(graph.select(F.col("src").alias("node"))), "node", "left_semi").withColumn("cut", F.lit(True)))
    return got.join(counted(more), "node", "left").select("label", "node", "hop", F.when(F.coalesce("cut", F.lit(False)) & (F.col("hop") == max_depth), "trace-depth").otherwise(F.col("boundary")).alias("boundary"))


def register_jumps(edges: DataFrame) -> DataFrame:
    """Jumps across registers of a module: from any data net to every output net of the module's registers."""
    ff = edges.where("kind = 'ff'")
    d, q = ff.select("module", "src").distinct(), ff.select("module", "dst").distinct()
    return d.join(q, "module").where("src <> dst").select("module", "src", "dst", F.lit("ff-jump").alias("kind"))


def instance_trace(instances: DataFrame, ports: DataFrame, edges: DataFrame, boundaries: DataFrame, *, direction: str = "both", max_depth: int | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """One cone for each declared port of each instance: inputs trace their drivers, outputs their sinks, inouts both."""
    seeds = instances.join(ports, "module").select(F.concat("full_path", F.lit("."), "name").alias("node"), "direction").withColumn("label", F.col("node"))
    out = []
    for side, way, kinds in (("driver", "fanin", ("input", "inout")), ("sinker", "fanout", ("output", "inout"))):
        if direction in ("both", side):
            got = cone(seeds.where(F.col("direction").isin(*kinds)), edges, boundaries, direction=way, max_depth=max_depth, ignore=ignore)
            out.append(got.where("boundary <> ''").select(F.col("label").alias("origin_port"), F.lit(side).alias("trace_direction"), F.col("boundary").alias("boundary_kind"), "node", "hop"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def waypoint_fanout(sources: DataFrame, peers: DataFrame, edges: DataFrame, waypoints: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """label, node, hop, qualified and is_terminator: fan-out whose state knows whether a waypoint was passed.

    ``peers`` (label, node) end a way; a check is connected where one of them is reached qualified.
    """
    mark = waypoints.select(F.col("node").alias("dst"), F.lit(True).alias("hit")).distinct()
    ends = peers.select(F.col("label"), F.col("node"), F.lit(True).alias("end")).distinct()
    graph = keep(edges.select("src", "dst").distinct().join(mark, "dst", "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("hit")))
    at = mark.withColumnRenamed("dst", "node")
    start = sources.select("label", "node").distinct().join(at, "node", "left").select("label", "node", F.coalesce("hit", F.lit(False)).alias("qualified"), F.lit(False).alias("ended"))

    def step(front: DataFrame, e: DataFrame) -> DataFrame:
        moved = front.join(e, front["node"] == e["src"]).select("label", F.col("dst").alias("node"), (F.col("qualified") | F.col("hit")).alias("qualified"))
        return moved.join(ends, ["label", "node"], "left").select("label", "node", "qualified", F.coalesce("end", F.lit(False)).alias("ended"))

    got = expand(start, graph, key=("label", "node", "qualified"), step=step, stop=F.col("ended"), max_hops=max_hops)
    return got.select("label", "node", "hop", "qualified", F.col("ended").alias("is_terminator"))


def _base(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[^\]]*\]$", "")


def _select(c: Column) -> Column:
    return F.regexp_extract(c, r"(\[[^\]]*\])$", 1)


def _pinned(front: DataFrame, edges: DataFrame) -> DataFrame:
    """A step that remembers which element a whole net stands for: no way leads from one element over the whole to another.

    Bookkeeping edges between a net and its elements have kind array_el; other edges between them pass where no pin says otherwise.
    """
    moved = front.join(edges, front["node"] == edges["src"])
    a, b, kind = F.col("node"), F.col("dst"), F.col("kind")
    same, element = _base(a) == _base(b), kind == "array_el"
    pin = F.try_element_at("pins", _base(a))
    up = same & (_select(a) != "") & (_select(b) == "")
    down = same & (_select(a) == "") & (_select(b) != "")
    across = same & (_select(a) != "") & (_select(b) != "") & (_select(a) != _select(b))
    put = lambda sel: F.map_concat(F.map_filter("pins", lambda k, _: k != _base(a)), F.create_map(_base(a), sel))
    pins = F.when(up, put(_select(a))).when(down & element & pin.isNull(), put(_select(b))).otherwise(F.col("pins"))
    blocked = element & (across | (down & pin.isNotNull() & (pin != _select(b))))
    return moved.where(~F.coalesce(blocked, F.lit(False))).select("label", b.alias("node"), pins.alias("pins"), F.to_json(pins).alias("pins_key"))


def meet(a: DataFrame, b: DataFrame, edges: DataFrame, *, max_hops: int | None = None, allow_base: bool = True, elements: bool = False) -> DataFrame:
    """Pairs of seed groups that meet: src, dst, meet (first by hops, then name), hops and connectivity_level.

    ``a`` and ``b`` have path, node (the seed's net) and sel (null: all of it). Labels are isolated by seed; the graph is
    walked undirected from both sides, ``max_hops`` in all if given. With ``elements``, ``edges`` has kind, a whole seed also
    starts from its elements, an element seed from its whole net, and element pins hold.
    """
    if elements:
        graph = keep(both_ways(edges.select("src", "dst", "kind")))
        whole = graph.select(F.col("src").alias("element")).distinct().where(_select(F.col("element")) != "").withColumn("node", _base(F.col("element")))
        none = F.create_map().cast("map<string,string>")

        def seeded(side: DataFrame) -> DataFrame:
            own = side.select(F.col("path").alias("label"), "node").distinct()
            pinned = F.when(_select(F.col("node")) != "", F.create_map(_base(F.col("node")), _select(F.col("node")))).otherwise(none)
            every = own.select("label", "node", pinned.alias("pins")).union(own.where(_select(F.col("node")) != "").select("label", _base(F.col("node")), pinned)).union(own.join(whole, "node").select("label", "element", none))
            return every.withColumn("pins_key", F.to_json("pins"))

        walk = lambda side, hops: expand(seeded(side), graph, step=_pinned, order=("pins_key",), max_hops=hops)
    else:
        graph = keep(both_ways(edges.select("src", "dst")))
        walk = lambda side, hops: expand(side.select(F.col("path").alias("label"), "node").distinct(), graph, max_hops=hops, undirected=True)
    half = None if max_hops is None else (max_hops + 1) // 2
    left, right = walk(a, half), walk(b, None if max_hops is None else max_hops - half)
    pin = F.try_element_at("pins", _base(F.col("node"))) if elements else F.lit(None).cast("string")
    pairs = left.select(F.col("label").alias("src"), "node", F.col("hop").alias("h1"), pin.alias("p1")).join(right.select(F.col("label").alias("dst"), "node", F.col("hop").alias("h2"), pin.alias("p2")), "node")
    pairs = pairs.where("p1 is null or p2 is null or p1 = p2")  # a whole net that stands for two elements is no meeting
    best = pairs.groupBy("src", "dst").agg(F.min(F.struct((F.col("h1") + F.col("h2")).alias("hops"), F.col("node").alias("meet"))).alias("m"))
    sel = lambda df, n: df.select(F.col("path").alias(n), F.col("node").alias(f"{n}_node"), F.col("sel").alias(f"{n}_sel")).distinct()
    got = best.join(sel(a, "src"), "src").join(sel(b, "dst"), "dst")
    if elements:  # two different literal selects pair only over a direct edge
        direct = graph.where("kind <> 'array_el'").select(F.col("src").alias("src_node"), F.col("dst").alias("dst_node"), F.lit(True).alias("direct")).distinct()
        differ = C.bit_range(F.col("src_sel")) != C.bit_range(F.col("dst_sel"))
        got = got.join(direct, ["src_node", "dst_node"], "left").where(~F.coalesce(differ, F.lit(False)) | F.coalesce("direct", F.lit(False)))
    level = C.slice_level(F.col("src_sel"), F.col("dst_sel"), allow_base=allow_base)
    return got.select("src", "dst", "m.meet", "m.hops", level.alias("connectivity_level")).where("connectivity_level is not null")


def coalesce_seeds(seeds: DataFrame, *, mode: str = "strict_slice") -> DataFrame:
    """Seeds (pos, path, hier, base, sel) that share hierarchy, net and, unless ``mode`` is base, select: members in first-seen order."""
    key = ["hier", "base"] + ([] if mode == "base" else ["sel"])
    sels = F.size(F.collect_set("sel"))
    whole = F.bool_or(F.col("sel").isNull()) & F.bool_or(F.col("sel").isNotNull())
    members = F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda s: s["path"])
    return seeds.groupBy(*key).agg(members.alias("members"), (whole | (sels > 1)).alias("mixed_or_approx"))


def evidence(seeds: DataFrame, edges: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """label, node, hop and the chain of nodes on the first way found (fewest hops, then by name)."""
    start = seeds.select("label", "node").distinct().withColumn("chain", F.array("node"))
    graph = keep(edges.select("src", "dst").distinct())
    step = lambda front, e: front.join(e, front["node"] == e["src"]).select("label", F.col("dst").alias("node"), F.array_append("chain", F.col("dst")).alias("chain"))
    return expand(start, graph, step=step, order=("chain",), max_hops=max_hops)


def electrical(edges: DataFrame) -> DataFrame:
    """node and component over wire-only edges: port connections and plain assigns."""
    return connected_components(edges.where("kind in ('port', 'wire')").select(F.col("src").alias("a"), F.col("dst").alias("b")), keep)


def electrical_pairs(components: DataFrame, checks: DataFrame, ends: DataFrame) -> DataFrame:
    """check_id, b and verdict: a PASS row for each b (check_id, node) in a's component, else one FAIL row.

    Where selected forms of a net match, the whole net gives no row of its own.
    """
    c = components.select("node", "component")
    a = checks.select("check_id", F.col("a").alias("node")).join(c, "node", "left").select("check_id", F.coalesce("component", "node").alias("component"))
    b = ends.join(c, "node", "left").select("check_id", "node", F.coalesce("component", "node").alias("component"))
    hit = b.join(a, ["check_id", "component"]).select("check_id", "node").distinct().withColumn("base", F.regexp_replace("node", r"\[.*$", ""))
    selected = Window.partitionBy("check_id", "base")
    hit = hit.withColumn("has_sel", F.max(F.contains("node", F.lit("["))).over(selected)).where(F.contains("node", F.lit("[")) | ~F.col("has_sel"))
    passed = hit.select("check_id", F.col("node").alias("b"), F.lit("PASS").alias("verdict"))
    failed = checks.select("check_id").join(hit.select("check_id"), "check_id", "left_anti").select("check_id", F.lit(None).cast("string").alias("b"), F.lit("FAIL").alias("verdict"))
    return passed.unionByName(failed)


def first_peers(edges: DataFrame, n: int = 64) -> DataFrame:
    """At most ``n`` peers of a node, first by name: the text phase's fan-out limit inside a module."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("place") <= n).drop("place")


def check_mode(a_kind: Column, b_kind: Column) -> Column:
    """How a pair is checked by what its ends are: port-port, port-hierarchy or hierarchy-hierarchy."""
    a, b = a_kind == "instance", b_kind == "instance"
    return F.when(a & b, "hierarchy-hierarchy").when(a | b, "port-hierarchy").otherwise("port-port")


def connect_pairs(checks: DataFrame, edges: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """check_id, mode and connected of checks with a, b, a_kind and b_kind; each mode has its own search, all checks of a mode share it.

    Two instances are connected if they are the same or one is above the other.
    """
    moded = keep(checks.withColumn("mode", check_mode(F.col("a_kind"), F.col("b_kind"))))
    ports = connected(moded.where("mode = 'port-port'").select("check_id", "a", "b"), edges, max_hops=max_hops).select("check_id", F.lit("port-port").alias("mode"), "connected")
    swap = F.col("a_kind") == "instance"
    mixed = moded.where("mode = 'port-hierarchy'").select("check_id", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    mixed = reaches_scope(mixed, edges, max_hops=max_hops).select("check_id", F.lit("port-hierarchy").alias("mode"), "connected")
    both = moded.where("mode = 'hierarchy-hierarchy'").select("check_id", "mode", (C.below(F.col("a"), F.col("b")) | C.below(F.col("b"), F.col("a"))).alias("connected"))
    return ports.unionByName(mixed).unionByName(both)


def elaborated_graph(edges: DataFrame) -> DataFrame:
    """src, dst (structs of hier, base, sel) and kind of directed edges over nets named ``scope.net[sel]``.

    An element and its whole net are joined both ways by ``array_el`` edges, and a port edge from an element also leads from
    the whole net. A select that is no number or range falls back to the whole net.
    """
    def key(c: str) -> Column:
        sel = F.regexp_extract(c, r"(\[\d+(?::\d+)?\])$", 1)
        bare = F.regexp_replace(c, r"\[[^\]]*\]$", "")
        return F.struct(F.regexp_replace(bare, r"\.?[^.]*$", "").alias("hier"), F.regexp_extract(bare, r"([^.]*)$", 1).alias("base"), sel.alias("sel"))

    whole = lambda k: F.struct(k["hier"].alias("hier"), k["base"].alias("base"), F.lit("").alias("sel"))
    own = edges.select(key("src").alias("src"), key("dst").alias("dst"), "kind")
    ends = own.select(F.explode(F.array("src", "dst")).alias("n")).where("n.sel <> ''").distinct()
    pair = F.explode(F.array(F.struct(F.col("n").alias("src"), whole(F.col("n")).alias("dst")), F.struct(whole(F.col("n")).alias("src"), F.col("n").alias("dst")))).alias("p")
    short = own.where("kind = 'port' and src.sel <> ''").select(whole(F.col("src")).alias("src"), "dst", "kind")
    return own.unionByName(ends.select(pair).select("p.src", "p.dst", F.lit("array_el").alias("kind"))).unionByName(short).distinct()
