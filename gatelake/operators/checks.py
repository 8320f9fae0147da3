"""Connectivity checks as tables: expansion, de-duplication, gates, aggregates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.functions import columns as C


def loop_values(spec: Column) -> Column:
    """Values of a loop entry: a range (descending ones count down), a comma list, or itself."""
    t = F.trim(spec)
    lo, hi = F.split_part(t, F.lit(":"), F.lit(1)).try_cast("int"), F.split_part(t, F.lit(":"), F.lit(-1)).try_cast("int")
    return F.when(F.contains(t, F.lit(":")), F.transform(F.sequence(lo, hi), lambda i: i.cast("string"))).when(F.contains(t, F.lit(",")), F.filter(F.transform(F.split(t, ","), lambda s: F.trim(s)), lambda s: s != "")).otherwise(F.array(t))


def expand_loops(checks: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each assignment of the loop keys (columns ``loop_KEY``), nested in the order of ``keys``; ``sub`` numbers them from 0.

    ``{KEY}`` in a and b is replaced; ``error`` names what stays unbound.
    """
    out = checks.withColumn("sub", F.lit(0))
    for key in keys:
        values = loop_values(F.col(f"loop_{key}"))
        out = out.withColumn("__n", F.size(values)).select("*", F.posexplode(values).alias("__k", "__v"))
        put = lambda c, key=key: F.replace(F.col(c), F.lit("{" + key + "}"), F.col("__v"))
        out = out.withColumns({"a": put("a"), "b": put("b"), "sub": F.col("sub") * F.col("__n") + F.col("__k")}).drop("__n", "__k", "__v")
    unbound = F.regexp_extract(F.concat("a", F.lit(" "), "b"), r"\{([A-Za-z_]\w*)\}", 1)
    return out.withColumn("error", F.when(unbound != "", F.concat(F.lit("unbound loop placeholder "), unbound)).otherwise(""))


def bus_bits(spec: Column, *, msb_first: bool = False) -> Column:
    """Bits of ``base[m:l]`` or ``base[n]``, counted upward unless ``msb_first``; anything else stands for itself."""
    base, inner = F.regexp_extract(spec, r"^(.*)\[(-?\d+(?::-?\d+)?)\]$", 1), F.regexp_extract(spec, r"^(.*)\[(-?\d+(?::-?\d+)?)\]$", 2)
    x, y = F.split_part(inner, F.lit(":"), F.lit(1)).try_cast("int"), F.split_part(inner, F.lit(":"), F.lit(-1)).try_cast("int")
    bits = F.transform(F.sequence(F.least(x, y), F.greatest(x, y)), lambda i: F.concat(base, F.lit("["), i.cast("string"), F.lit("]")))
    return F.when(inner != "", F.reverse(bits) if msb_first else bits).otherwise(F.array(spec))


def is_literal(element: Column) -> Column:
    return element.rlike(r"^\d+$|^\d*'[sS]?[bBoOdDhH][0-9a-fA-FxXzZ_?]+$")


def concat_elements(spec: Column) -> Column:
    """Elements of ``{a, b, 1'b0}``, most significant first, with their positions; literals are skipped."""
    parts = F.transform(F.split(F.regexp_replace(spec, r"^\s*\{|\}\s*$", ""), ","), lambda s: F.trim(s))
    return F.filter(F.transform(parts, lambda s, i: F.struct(i.alias("pos"), s.alias("name"))), lambda e: ~is_literal(e["name"]))


def pair_up(checks: DataFrame, *, bit_align: str = "lsb") -> DataFrame:
    """check_id, sub_id, a, b, error: expanded pairs of checks whose a and b are arrays of endpoints.

    A concat on the left is paired with the right's bits, most significant first. One source with several sinks fans out;
    else both sides are spread to bits and zipped, and unequal lengths give one error row.
    """
    first = F.get("a", F.lit(0))
    is_concat = (F.size("a") == 1) & first.startswith("{")
    elements = concat_elements(first)
    wide = F.when(is_concat, bus_bits(F.get("b", F.lit(0)), msb_first=True))
    spread = lambda c: F.flatten(F.transform(c, lambda s: bus_bits(s, msb_first=bit_align == "msb")))
    left = F.when(is_concat, F.transform(elements, lambda e: e["name"])).when((F.size("a") == 1) & (F.size("b") > 1), F.array_repeat(first, F.size("b"))).otherwise(spread("a"))
    fan = ~is_concat & (F.size("a") == 1) & (F.size("b") > 1)
    right = F.when(is_concat, wide).when(fan, F.col("b")).otherwise(spread("b"))
    ids = F.when(is_concat, F.transform(elements, lambda e: F.concat(F.lit("["), e["pos"].cast("string"), F.lit("]")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(left) - 1), lambda i: F.when(fan, F.concat(F.lit("->"), i.cast("string"))).otherwise(F.concat(F.lit("["), i.cast("string"), F.lit("]"))))
    )
    both = checks.select("check_id", left.alias("l"), right.alias("r"), ids.alias("ids"))
    wrong = F.size("l") != F.size("r")
    message = F.concat(F.lit("length mismatch: "), F.size("l").cast("string"), F.lit(" vs "), F.size("r").cast("string"))
    rows = F.when(wrong, F.array(F.struct(F.lit("").alias("ids"), F.lit("").alias("l"), F.lit("").alias("r"), message.alias("error")))).otherwise(F.transform(F.arrays_zip("ids", "l", "r"), lambda z: F.struct(z["ids"].alias("ids"), z["l"].alias("l"), z["r"].alias("r"), F.lit("").alias("error"))))
    return both.select("check_id", F.explode(rows).alias("p")).select("check_id", F.col("p.ids").alias("sub_id"), F.col("p.l").alias("a"), F.col("p.r").alias("b"), "p.error")


def aggregate(results: DataFrame, *, mode: str = "all") -> DataFrame:
    """check_id, connected, checked and failed over sub-results: all of them, or any. Unknown ones count as failed."""
    ok = F.coalesce("connected", F.lit(False))
    whole = F.bool_and(ok) if mode == "all" else F.bool_or(ok)
    return results.groupBy("check_id").agg(whole.alias("connected"), F.count(F.lit(1)).alias("checked"), F.count_if(~ok).alias("failed"))


def text_key(a: Column, b: Column) -> Column:
    """Coarse key of a text check: both ends without selects, in order."""
    x, y = C.strip_selects(a), C.strip_selects(b)
    return F.concat_ws("|", F.least(x, y), F.greatest(x, y))


def deduplicated(checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one check for each key, the smallest check_id) and (check_id, key): verdicts of the first go to all of the second."""
    keyed = checks.withColumn("key", text_key(F.col("a"), F.col("b")))
    return keyed.groupBy("key").agg(F.min_by(F.struct("check_id", "a", "b"), "check_id").alias("c")).select("key", "c.*"), keyed.select("check_id", "key")


def gate(sides: DataFrame, *, hgrep_only: bool = False) -> DataFrame:
    """check_id and action of (check_id, side, status, waypoint): reject, fallback or pass.

    A missing side rejects; a waypoint or, unless only the gate is asked, an ambiguous side falls back.
    """
    g = sides.groupBy("check_id").agg(F.bool_or(F.col("status") == "missing").alias("missing"), F.bool_or(F.col("status") == "ambiguous").alias("ambiguous"), F.bool_or(F.coalesce("waypoint", F.lit(False))).alias("waypoint"))
    soft = F.col("waypoint") if hgrep_only else F.col("waypoint") | F.col("ambiguous")
    return g.select("check_id", F.when(F.col("missing"), "reject").when(soft, "fallback").otherwise("pass").alias("action"))


def and_gate(resolved: DataFrame) -> DataFrame:
    """check_id, side, ok: every element of a side's list has to resolve."""
    return resolved.groupBy("check_id", "side").agg(F.bool_and("ok").alias("ok"))


def cascade(gated: DataFrame, decided: DataFrame) -> DataFrame:
    """Rejected checks fail at the gate; the others take the verdict of the next phase, unknown where it has none."""
    rest = gated.where("action <> 'reject'").join(decided, "check_id", "left").select("check_id", F.lit("walk").alias("phase"), "connected")
    return gated.where("action = 'reject'").select("check_id", F.lit("gate").alias("phase"), F.lit(False).alias("connected")).unionByName(rest)


def text_then_logical(text: DataFrame, logical: DataFrame) -> DataFrame:
    """check_id, connected_text, connected_logical, connected: what text rejects is not asked of logic."""
    got = text.select("check_id", F.col("connected").alias("connected_text")).join(logical.select("check_id", F.col("connected").alias("connected_logical")), "check_id", "left")
    known = F.when(F.col("connected_text"), F.col("connected_logical"))
    return got.select("check_id", "connected_text", known.alias("connected_logical"), F.coalesce(known, F.lit(False)).alias("connected"))


def failure_class(kind: Column, ambiguous: Column, path: Column, scope: Column) -> Column:
    return (
        F.when(path == "", "empty-path").when(ambiguous, "ambiguous").when((kind == "miss") & (scope == ""), "top-not-indexed").when(kind == "miss", "inst-not-found")
        .when(kind == "tail", "leaf-not-found").when(kind.isNull(), "unknown").otherwise("pass")
    )


def pair_class(a_ok: Column, b_ok: Column) -> Column:
    return F.when(a_ok & b_ok, "pass").when(~a_ok & ~b_ok, "both-fail").when(~a_ok, "endpoint-a-fail").otherwise("endpoint-b-fail")


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """check_id, expected, actual and state of two verdict tables: equal, differs, missing or extra."""
    e, a = expected.select("check_id", F.col("connected").alias("expected")), actual.select("check_id", F.col("connected").alias("actual"))
    both = e.withColumn("in_e", F.lit(True)).join(a.withColumn("in_a", F.lit(True)), "check_id", "full_outer")
    state = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "equal").otherwise("differs")
    return both.select("check_id", "expected", "actual", state.alias("state"))


def verify_cone(cone: DataFrame, rules: DataFrame) -> DataFrame:
    """label, rule, net and ok: must_satisfy, must_not_coi and must_exhaust against a budget cone; a net is its path or a dotted suffix."""
    keyed = cone.select("label", "node", "status")
    every = rules.join(keyed, "label", "left").withColumn("same", (F.col("node") == F.col("net")) | F.col("node").endswith(F.concat(F.lit("."), "net")))
    got = every.groupBy("label", "rule", "net").agg(F.coalesce(F.bool_or("same"), F.lit(False)).alias("seen"), F.coalesce(F.bool_or(F.col("same") & (F.col("status") == "satisfied")), F.lit(False)).alias("sat"), F.coalesce(F.bool_or(F.col("same") & (F.col("status") == "exhausted")), F.lit(False)).alias("exh"))
    return got.select("label", "rule", "net", F.when(F.col("rule") == "must_satisfy", F.col("sat")).when(F.col("rule") == "must_exhaust", F.col("exh")).otherwise(~F.col("seen")).alias("ok"))
