"""Hierarchy operators over module and instance tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import columns as C
from gatelake.operators.scan import context_key, scan, scan_under
from gatelake.plans.store import keep


def top_modules(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that nothing instantiates; black boxes and stopped ones do not count. If there is none, all candidates."""
    live = modules
    if "is_blackbox" in modules.columns:
        live = live.where(~F.coalesce("is_blackbox", F.lit(False)))
    if "stop_reason" in modules.columns:
        live = live.where(F.coalesce("stop_reason", F.lit("")) == "")
    live = live.select("module").distinct()
    tops = live.join(edges.select(F.col("child").alias("module")), "module", "left_anti")
    # Both sides are lazy: the candidates only come in where there is no top.
    none = tops.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return tops.union(live.join(F.broadcast(none.select(F.lit(1).alias("__on"))), F.lit(1) == F.col("__on")).select("module"))


def scope_paths(endpoints: DataFrame, column: str = "path") -> DataFrame:
    """All prefixes of the endpoints' paths, selects left out: what elaboration has to open."""
    return endpoints.select(F.explode(C.prefixes(C.strip_selects(F.col(column)))).alias("path")).distinct()


def elaborate_parameters(texts: DataFrame, tops: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """Instance tree with parameter contexts: full_path, inst_leaf, module, depth, parent_path, param_ctx and stop_reason.

    ``texts`` is ``scan.module_texts``. Each round scans the distinct (module, context) pairs of the frontier once, so a
    module is read again only where its parameters differ.
    """
    texts = keep(texts)
    empty = F.create_map().cast("map<string,string>")
    front = tops.select("module").distinct().select("module", F.col("module").alias("full_path"), F.col("module").alias("inst_leaf"), F.lit(None).cast("string").alias("parent_path"), empty.alias("ctx"), F.array().cast("array<string>").alias("ancestors"))
    levels = []
    for depth in count() if max_depth is None else range(max_depth + 1):
        front = keep(front.withColumn("ctx_key", context_key(F.col("ctx"))))
        if front.isEmpty():
            break
        asked = front.dropDuplicates(["module", "ctx_key"]).select("module", "ctx", "ctx_key").join(texts, "module")
        scanned = keep(scan_under(asked).select("module", "ctx_key", F.map_from_entries(F.transform("parameters", lambda p: F.struct(p["name"], p["value"]))).alias("param_ctx"), F.transform("instances", lambda i: F.struct(i["inst"], i["child"], i["overrides"])).alias("instances")))
        loop = F.array_contains("ancestors", F.col("module"))
        rows = keep(front.join(scanned, ["module", "ctx_key"], "left").withColumn("stop_reason", F.when(loop, "recursion").when(F.col("instances").isNull(), "unknown").otherwise("")).withColumn("depth", F.lit(depth)))
        levels.append(rows.select("full_path", "inst_leaf", "module", "depth", "parent_path", F.coalesce("param_ctx", empty).alias("param_ctx"), "stop_reason"))
        live = rows.where("stop_reason = ''")
        front = live.select(F.col("full_path").alias("parent_path"), F.array_append("ancestors", F.col("module")).alias("ancestors"), F.explode("instances").alias("i")).select(
            F.col("i.child").alias("module"), F.concat_ws(".", "parent_path", "i.inst").alias("full_path"), F.col("i.inst").alias("inst_leaf"), "parent_path", F.col("i.overrides").alias("ctx"), "ancestors"
        )
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def path_chain(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """path and its chain of (depth, path, module) from the root, for each of ``paths``."""
    steps = paths.select("path", F.explode(C.prefixes(F.col("path"))).alias("full_path"))
    found = steps.join(rows.select("full_path", "depth", "module"), "full_path")
    return found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "full_path", "module"))).alias("chain"))


def longest_prefix(rows: DataFrame, probes: DataFrame, *, ok: Column | None = None) -> DataFrame:
    """For each probe its own row, even one that is not ok, else its longest ok prefix: path, full_path and tail segments."""
    rows = rows.withColumn("__ok", F.lit(True) if ok is None else ok).select("full_path", "__ok")
    steps = probes.select("path", F.explode(C.prefixes(F.col("path"))).alias("full_path"))
    hit = steps.join(rows, "full_path").where(F.col("__ok") | (F.col("path") == F.col("full_path")))
    best = hit.groupBy("path").agg(F.max_by("full_path", F.size(C.segments(F.col("full_path")))).alias("full_path"))
    tail = F.size(C.segments(F.col("path"))) - F.size(C.segments(F.col("full_path")))
    return probes.select("path").distinct().join(best, "path", "left").withColumn("tail", F.coalesce(tail, F.size(C.segments(F.col("path")))))


def resolve_endpoints(rows: DataFrame, ports: DataFrame, nets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """path, scope, net, kind and port_found. Only the last segment may be a signal.

    In this order: a port of the parent's module, an instance, a declared net, any tail of an instance; else a miss with
    the nearest instance.
    """
    e = endpoints.select("path").distinct()
    bare = C.strip_selects(F.col("path"))
    parts = C.segments(bare)
    e = e.withColumns({"bare": bare, "leaf": F.element_at(parts, -1), "up": F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")})
    own = rows.select(F.col("full_path").alias("bare"), F.lit(True).alias("is_inst"))
    up = rows.select(F.col("full_path").alias("up"), F.col("module").alias("up_module"))
    e = e.join(own, "bare", "left").join(up, "up", "left")
    e = e.join(ports.select(F.col("module").alias("up_module"), F.col("name").alias("leaf"), F.lit(True).alias("is_port")).distinct(), ["up_module", "leaf"], "left")
    e = e.join(nets.select(F.col("module").alias("up_module"), F.col("name").alias("leaf"), F.lit(True).alias("is_net")).distinct(), ["up_module", "leaf"], "left")
    kind = F.when(F.col("is_port"), "port").when(F.col("is_inst"), "instance").when(F.col("is_net"), "net").when(F.col("up_module").isNotNull(), "tail").otherwise("miss")
    near = longest_prefix(rows, e.where(kind == "miss").select("path")).select("path", F.col("full_path").alias("nearest"))
    inst = F.col("kind") == "instance"
    return e.withColumn("kind", kind).join(near, "path", "left").select(
        "path", F.when(inst, F.col("bare")).when(F.col("kind") == "miss", F.coalesce("nearest", F.lit(""))).otherwise(F.col("up")).alias("scope"),
        F.when(inst, "").otherwise(F.regexp_extract("path", r"([^.]*)$", 1)).alias("net"), "kind", (F.col("kind") == "port").alias("port_found"),
    )


def roles(resolved: DataFrame, rows: DataFrame, ports: DataFrame) -> DataFrame:
    """Adds ``role`` (input: fanin, output: fanout, inout, else internal), ``needs_detail`` for indexed paths and ``miss_reason``."""
    module = rows.select(F.col("full_path").alias("scope"), "module")
    base = C.strip_selects(F.col("net"))
    dirs = ports.select("module", F.col("name").alias("base"), "direction")
    got = resolved.withColumn("base", base).join(module, "scope", "left").join(dirs, ["module", "base"], "left")
    role = F.when(F.col("direction") == "input", "fanin").when(F.col("direction") == "output", "fanout").when(F.col("direction") == "inout", "inout").otherwise("internal")
    return got.select(*resolved.columns, role.alias("role"), F.contains("path", F.lit("[")).alias("needs_detail"), F.when(F.col("kind") == "miss", F.when(F.col("scope") == "", "top-not-indexed").otherwise("inst-not-found")).otherwise("").alias("miss_reason"))


def exist(edges: DataFrame, names: DataFrame, specs: DataFrame, *, top: str, slash: bool = False) -> DataFrame:
    """path, ok, hops and fail_segment of specs walked hop by hop from ``top``: instances on the way, at the end a name of that module.

    All specs share the rounds; each hop is a join on (module, segment).
    """
    path = F.regexp_replace(F.regexp_replace("path", "^/", ""), "/", ".") if slash else F.col("path")
    s = specs.select("path").distinct().withColumn("parts", C.segments(C.strip_selects(path)))
    s = s.withColumn("parts", F.when(F.get("parts", F.lit(0)) == top, F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).otherwise(F.col("parts")))
    front = keep(s.select("path", "parts", F.lit(top).alias("module"), F.lit(0).alias("hop")))
    step = edges.select("module", F.col("inst").alias("segment"), "child").dropDuplicates(["module", "segment"])
    last = names.select("module", F.col("name").alias("segment"), F.lit(True).alias("named")).distinct()
    done = []
    while True:
        ended = front.where(F.size("parts") <= F.col("hop")).select("path", F.lit(True).alias("ok"), F.col("hop").alias("hops"), F.lit("").alias("fail_segment"))
        done.append(ended)
        live = front.where(F.size("parts") > F.col("hop")).withColumn("segment", F.get("parts", F.col("hop")))
        live = keep(live.join(step, ["module", "segment"], "left").join(last, ["module", "segment"], "left"))
        if live.isEmpty():
            break
        miss = live.where("child is null")
        leaf = F.coalesce("named", F.lit(False)) & (F.size("parts") == F.col("hop") + 1)
        done.append(miss.select("path", leaf.alias("ok"), (F.col("hop") + leaf.cast("int")).alias("hops"), F.when(leaf, "").otherwise(F.col("segment")).alias("fail_segment")))
        front = keep(live.where("child is not null").select("path", "parts", F.col("child").alias("module"), (F.col("hop") + 1).alias("hop")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def coverage(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Each listed file and whether the hierarchy reaches it; ``sources`` has path and via_filelist, ``rows`` has file."""
    reached = rows.select(F.col("file").alias("path")).distinct().withColumn("reached", F.lit(True))
    return sources.select("path", "via_filelist").distinct().join(reached, "path", "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def unused_listings(covered: DataFrame) -> DataFrame:
    return covered.groupBy("via_filelist").agg(F.bool_or("reached").alias("used"), F.count(F.lit(1)).alias("files")).where("not used").select("via_filelist", "files")


def untouched_roots(covered: DataFrame) -> DataFrame:
    """Shallowest directories under which no file is reached."""
    parts = F.split("path", "/")
    dirs = covered.select("reached", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    cold = dirs.groupBy("dir").agg(F.bool_or("reached").alias("hot")).where("not hot").select("dir")
    parent = F.regexp_replace("dir", "/[^/]*$", "")
    return cold.withColumn("parent", F.when(F.contains("dir", F.lit("/")), parent)).join(cold.select(F.col("dir").alias("parent")), "parent", "left_anti").select("dir")


def prune_to_ancestor(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows at or below the lowest common ancestor of two paths; a route that leaves it is not seen any more."""
    return rows.where(C.below(F.col("full_path"), C.common_ancestor(a, b)))


def nearest_listing(candidates: DataFrame, anchor: Column) -> DataFrame:
    """Candidates (module, path) by tree distance of their directory from the anchor's, then by path; ``place`` from 1."""
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, "/[^/]*$", ""), "/", ".")
    ranked = candidates.withColumn("distance", C.tree_distance(folder(F.col("path")), folder(anchor)))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy("distance", "path")))


def on_the_way(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """The rows (full_path, module, ...) of the instances of ``modules`` and of all that is above them: what a cone has to open."""
    way = rows.join(modules.select("module"), "module", "left_semi").select(F.explode(C.prefixes(F.col("full_path"))).alias("full_path"))
    return rows.join(way, "full_path", "left_semi")


def with_activation(rows: DataFrame, known: DataFrame, *on: str) -> DataFrame:
    """``rows`` with the activation of their branch from ``known`` (the columns ``on`` and activation), empty where none is known."""
    return rows.join(known.select(*on, "activation"), list(on), "left").withColumn("activation", F.coalesce("activation", F.lit("")))


def evidence_rows(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """check_id, side, prefix and module: a row for each known prefix of each side's path; ``ends`` has check_id, side and path."""
    steps = ends.select("check_id", "side", F.explode(C.prefixes(F.col("path"))).alias("full_path"))
    return steps.join(rows.select("full_path", "module"), "full_path").select("check_id", "side", F.col("full_path").alias("prefix"), "module")


def exist_cached(rows: DataFrame, names: DataFrame, specs: DataFrame) -> DataFrame:
    """path and ok of specs held against an instance table that is there already: an instance, or a name of the module above.

    Two equi-joins for all specs, however deep.
    """
    bare = C.strip_selects(F.col("path"))
    s = specs.select("path").distinct().withColumns({"full_path": bare, "up": F.regexp_replace(bare, r"\.?[^.]*$", ""), "name": F.regexp_extract(bare, r"([^.]*)$", 1)})
    own = rows.select("full_path", F.lit(True).alias("there")).distinct()
    up = rows.select(F.col("full_path").alias("up"), "module").distinct()
    last = names.select("module", "name", F.lit(True).alias("named")).distinct()
    got = s.join(own, "full_path", "left").join(up, "up", "left").join(last, ["module", "name"], "left")
    return got.groupBy("path").agg(F.bool_or(F.coalesce("there", F.lit(False)) | F.coalesce("named", F.lit(False))).alias("ok"))


def resolve_child(asked: DataFrame, candidates: DataFrame, *, policy: str = "confident") -> DataFrame:
    """module, anchor, path and status for each (module, anchor) of ``asked``: the file that a child module is read from.

    ``candidates`` has module and path. One file is taken as it is (``confident``). Of several, the confident policy takes
    none (``deferred``); the recovery policy takes the one listed nearest to the anchor, then first by path
    (``recovered``). No file at all is ``missing``.
    """
    if policy not in ("confident", "recovery"):
        raise ValueError(f"policy must be confident or recovery, not {policy}")
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, "/[^/]*$", ""), "/", ".")
    each = asked.select("module", "anchor").distinct().join(candidates.select("module", "path").distinct(), "module", "left")
    near = F.struct(C.tree_distance(folder(F.col("path")), folder(F.col("anchor"))), "path")
    got = each.groupBy("module", "anchor").agg(F.count("path").alias("n"), F.min_by("path", near).alias("path"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "confident").otherwise("recovered" if policy == "recovery" else "deferred")
    return got.select("module", "anchor", F.when(status != "deferred", F.col("path")).alias("path"), status.alias("status"))


def walk_files(sources: DataFrame, declared: DataFrame, specs: DataFrame, *, top: str, policy: str = "recovery") -> tuple[DataFrame, DataFrame]:
    """(path, ok, hops) of specs, and the (module, path) that were read: only files on the specs' chains are opened.

    ``declared`` is the module index (path, module) of the sources. Each round reads the files of the modules that the walks
    have come to and that were not read before; all specs share the rounds. The last segment may be a port or net.
    """
    s = specs.select("path").distinct().withColumn("parts", C.segments(C.strip_selects(F.col("path"))))
    s = s.withColumn("parts", F.when(F.get("parts", F.lit(0)) == top, F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).otherwise(F.col("parts")))
    front = keep(s.select("path", "parts", F.lit(top).alias("module"), F.lit("").alias("anchor"), F.lit(0).alias("hop")))
    read, done = None, []
    for _ in count():
        if front.isEmpty():
            break
        done.append(front.where(F.size("parts") <= F.col("hop")).select("path", F.lit(True).alias("ok"), F.col("hop").alias("hops")))
        live = front.where(F.size("parts") > F.col("hop")).withColumn("segment", F.get("parts", F.col("hop")))
        asked = live.select("module", "anchor").distinct()
        if read is not None:
            asked = asked.join(read.select("module"), "module", "left_anti")
        chosen = keep(resolve_child(asked, declared, policy=policy).where("path is not null").groupBy("module").agg(F.min("path").alias("file")))
        texts = sources.select("path", "text").join(chosen.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
        found = scan(texts).select("path", "module", F.transform("instances", lambda i: F.struct(i["inst"].alias("inst"), i["child"].alias("child"))).alias("instances"), F.concat(F.transform("ports", lambda p: p["name"]), F.transform("nets", lambda n: n["name"])).alias("names"))
        own = chosen.join(found.withColumnRenamed("path", "file"), ["module", "file"], "left").dropDuplicates(["module"])
        read = keep(own if read is None else read.unionByName(own))
        at = live.drop("anchor").join(read, "module", "left")
        child = F.get(F.filter(F.coalesce("instances", F.array()), lambda i: i["inst"] == F.col("segment")), F.lit(0))["child"]
        at = keep(at.withColumn("child", child))
        leaf = F.coalesce(F.array_contains("names", F.col("segment")), F.lit(False)) & (F.size("parts") == F.col("hop") + 1)
        done.append(at.where("child is null").select("path", leaf.alias("ok"), (F.col("hop") + leaf.cast("int")).alias("hops")))
        front = keep(at.where("child is not null").select("path", "parts", F.col("child").alias("module"), F.coalesce("file", F.lit("")).alias("anchor"), (F.col("hop") + 1).alias("hop")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, read.select("module", F.col("file").alias("path"))
