"""The frontier loop: labelled breadth-first expansion as joins, one round for each hop."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.plans.store import BROADCAST_ROWS, counted, keep


def expand(
    seeds: DataFrame,
    edges: DataFrame,
    *,
    key: tuple[str, ...] = ("label", "node"),
    step: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    stop: Column | None = None,
    order: tuple[str, ...] = (),
    max_hops: int | None = None,
    undirected: bool = False,
) -> DataFrame:
    """Every state reachable from ``seeds`` with ``hop``, the fewest hops; all labels share the rounds.

    ``edges`` has src and dst and, by default, leads a state's ``node`` from one to the other; ``step(frontier, edges)``
    gives the next states (columns of ``seeds``) where more is carried. States for which ``stop`` holds are kept and not
    expanded. Among arrivals at one key in the same hop the first by ``order`` is kept, any if it is empty. Seen states
    leave by an anti join, so cycles end; nothing else ends the loop unless ``max_hops`` is given. Where every edge is there
    in both directions and nothing stops (``undirected``), an arrival can only have been seen in the last two hops, so
    only these are shuffled for the anti join.
    """
    columns = seeds.columns
    if step is None:
        carried = [c for c in columns if c != "node"]
        step = lambda front, e: front.join(e, front["node"] == e["src"]).select(*[front[c] for c in carried], F.col("dst").alias("node")).select(*columns)
    first = keep(_one_each(seeds, key, order).withColumn("hop", F.lit(0)))
    seen, front, before, parts = first, first, first, 1
    rows = total = first.count()
    last, many = 0, None
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        live = front if stop is None else front.where(~stop)
        if rows > BROADCAST_ROWS and many is None:
            many = counted(edges)
        arrived = _one_each(step(live.drop("hop"), many if rows > BROADCAST_ROWS else edges), key, order)
        near = undirected and stop is None
        known = counted((before.unionByName(front) if near else seen).select(*key), last + rows if near else total)
        before, front = front, keep(arrived.join(known, list(key), "left_anti").select(*columns).withColumn("hop", F.lit(hop)))
        last, rows = rows, front.count()
        if not rows:
            break
        seen, parts, total = seen.unionByName(front), parts + 1, total + rows
        if parts % 16 == 0:
            seen = keep(seen)
    return seen


def meet_ends(checks: DataFrame, graph: DataFrame, *, undirected: bool = False) -> DataFrame:
    """label and hops (fewest) of the checks (label, a, b) whose b can be reached from a; nothing but ``graph`` ends the search.

    Both ends expand by one hop in each round, in one join: the far end against the edges. A check leaves as soon as its
    ends meet, which is in round k where they are 2k - 1 or 2k hops apart, or as soon as one end has nowhere to go on to.
    """
    sides = graph.select(F.lit(0).alias("side"), "src", "dst").unionByName(graph.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = keep(sides)
    ends = [checks.select("label", F.lit(k).alias("side"), F.col(c).alias("node")) for k, c in enumerate("ab")]
    front = keep(ends[0].union(ends[1]).where("node is not null").distinct().withColumn("hop", F.lit(0)))
    seen, before, parts = front, front, 1
    done = []
    for hop in count(1):
        other = (before.unionByName(front) if parts > 1 else front).where("side = 1").select("label", "node", F.col("hop").alias("other"))
        met = front.where("side = 0").join(other, ["label", "node"]).groupBy("label").agg(F.min(F.col("hop") + F.col("other")).alias("hops"))
        done.append(met)
        if len(done) % 8 == 0:
            done = [keep(_all(done))]
        both = front.groupBy("label").agg(F.countDistinct("side").alias("sides")).where("sides = 2").join(met, "label", "left_anti").select("label")
        going = front.join(both, "label", "left_semi")
        moved = going.join(edges, (going["node"] == edges["src"]) & (going["side"] == edges["side"])).select("label", going["side"], F.col("dst").alias("node")).distinct()
        known = before.unionByName(front) if undirected else seen
        before, front = front, keep(moved.join(known, ["label", "side", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            return _all(done)
        seen, parts = seen.unionByName(front), parts + 1
        if not undirected and parts % 16 == 0:
            seen = keep(seen)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _one_each(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    if not order:
        return df.dropDuplicates(list(key))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def elaborate(edges: DataFrame, tops: DataFrame, *, max_depth: int | None = None, scope: DataFrame | None = None, stopped: DataFrame | None = None) -> DataFrame:
    """Instance tree: full_path, inst_leaf, module, depth, parent_path and stop_reason.

    ``edges`` has module, inst and child, ``tops`` has module. All tops are seeds of one loop. A module on its own
    ancestor path is not opened again. ``scope`` (path) keeps only these paths, by a semi join inside the loop;
    ``stopped`` (module, stop_reason) names modules that are not opened. The tree is opened to its leaves; with ``max_depth``,
    what would go on below has the stop_reason ``max-depth``.
    """
    lookup = edges.select(F.col("module").alias("parent"), "inst", F.col("child").alias("module")).dropDuplicates(["parent", "inst"])

    def reason(df: DataFrame) -> DataFrame:
        if stopped is not None:
            df = df.join(stopped.select("module", "stop_reason"), "module", "left")
        else:
            df = df.withColumn("stop_reason", F.lit(None).cast("string"))
        loop = F.array_contains("ancestors", F.col("module"))
        return df.withColumn("stop_reason", F.when(loop, F.lit("recursion")).otherwise(F.coalesce("stop_reason", F.lit(""))))

    start = tops.select("module").distinct().select(
        "module", F.col("module").alias("full_path"), F.col("module").alias("inst_leaf"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_path"), F.array().cast("array<string>").alias("ancestors")
    )
    front = keep(reason(start))
    levels = [front]
    for depth in count(1):
        live = front.where("stop_reason = ''")
        if max_depth is not None and depth > max_depth:
            cut = live.join(lookup.select(F.col("parent").alias("module")).distinct(), "module", "left_semi").select("full_path", F.lit("max-depth").alias("cut"))
            levels[-1] = front.join(cut, "full_path", "left").withColumn("stop_reason", F.coalesce("cut", "stop_reason")).select(*front.columns)
            break
        down = live.select(F.col("module").alias("parent"), F.col("full_path").alias("parent_path"), F.array_append("ancestors", F.col("module")).alias("ancestors"))
        nxt = down.join(lookup, "parent").select(
            "module", F.concat_ws(".", "parent_path", "inst").alias("full_path"), F.col("inst").alias("inst_leaf"), F.lit(depth).alias("depth"), "parent_path", "ancestors"
        )
        if scope is not None:
            nxt = nxt.join(scope.select(F.col("path").alias("full_path")), "full_path", "left_semi")
        front = keep(reason(nxt))
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("full_path", "inst_leaf", "module", "depth", "parent_path", "stop_reason")


def until_budget(seeds: DataFrame, edges: DataFrame, *, kind: str, limit: int, max_hops: int = 64) -> DataFrame:
    """Cone under a budget: label, node, hop, spent and status.

    ``edges`` has src, dst, kind; edges of ``kind`` (or every edge, for ``hop``) cost one. A node keeps the counters of
    its first arrival: fewest hops, then least spent, then the parent first by name. At the budget only edges that cost
    nothing are taken, and none for ``hop``. satisfied: budget spent; exhausted: no way on; internal: led on, or all it
    led to was seen; truncated: cut by ``max_hops``.
    """
    cost = F.lit(1) if kind == "hop" else (F.col("kind") == kind).cast("int")
    priced = keep(edges.select("src", "dst", cost.alias("cost")).groupBy("src", "dst", "cost").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    start = seeds.select("label", "node").distinct().withColumns({"spent": F.lit(0), "via": F.lit(None).cast(edges.schema["src"].dataType)})

    def step(front: DataFrame, e: DataFrame) -> DataFrame:
        moved = front.join(e, front["node"] == e["src"]).where(F.col("spent") + F.col("cost") <= limit)
        return moved.select("label", F.col("dst").alias("node"), (F.col("spent") + F.col("cost")).alias("spent"), F.col("src").alias("via"))

    stop = (F.col("spent") >= limit) if kind == "hop" else F.lit(limit == 0)
    got = keep(expand(start, priced, step=step, stop=stop, order=("spent", "via"), max_hops=max_hops))
    out = counted(priced.groupBy("src").agg(F.max(F.lit(1)).alias("has"), F.min("cost").alias("least")), priced.count())
    judged = got.join(out, got["node"] == out["src"], "left")
    usable = F.coalesce(F.col("has") == 1, F.lit(False)) & (F.col("spent") + F.coalesce("least", F.lit(0)) <= limit)
    status = F.when(F.col("spent") >= limit, "satisfied").when(F.col("hop") >= max_hops, "truncated").when(usable, "internal").otherwise("exhausted")
    return judged.select("label", "node", "hop", "spent", status.alias("status"))
