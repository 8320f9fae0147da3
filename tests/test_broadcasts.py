"""Tables of many rows that pack into few bytes are not broadcast to the driver, whatever the size of their files."""

import pytest
from pyspark.sql import functions as F

from gatelake.operators import graph
from gatelake.plans import frontier, store

ROWS, SHORT = 150_000, 3_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written."""
    seen = []

    def kept(df, *label):
        seen.append(plan(df))
        return store.keep(df, *label)

    for module in (frontier, graph):
        monkeypatch.setattr(module, "keep", kept)
    return seen


def test_scope_search_broadcasts_no_large_table(spark, plans):
    name, k = F.concat(F.lit("o"), F.col("id").cast("string")), F.col("id")
    edges = store.keep(spark.range(ROWS).select(name.alias("src"), F.concat(F.lit("n"), (k % 5).cast("string"), F.lit(".c"), (k % 1000).cast("string")).alias("dst")))
    checks = store.keep(spark.range(ROWS).select(name.alias("check_id"), name.alias("a"), F.concat(F.lit("n"), (k % 7).cast("string")).alias("b")))
    got = graph.reaches_scope(checks, edges, max_hops=1)
    assert not [p for p in [*plans, plan(got)] if "BroadcastHashJoin" in p]
    assert got.where("connected").count() == sum(k % 5 == k % 7 for k in range(ROWS)) and got.count() == ROWS


@pytest.fixture
def nothing_is_small(monkeypatch):
    """Every count is beyond the limit, so that short tables show what is counted."""
    for module in (frontier, store):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1, raising=False)


def chain(spark):
    """Events in a row, each third one led to by a purchase, and a seed at every event."""
    k = F.col("id")
    edges = store.keep(spark.range(SHORT - 1).select(k.alias("src"), (k + 1).alias("dst"), F.when((k + 1) % 3 == 0, "purchase").otherwise("view").alias("kind")))
    return store.keep(spark.range(SHORT).select(k.alias("label"), k.alias("node"))), edges


def test_fanout_cone_broadcasts_no_large_table(spark, plans, nothing_is_small):
    seeds, edges = chain(spark)
    bounds = store.keep(spark.range(0, 2 * SHORT, 2).select(F.col("id").alias("node"), F.lit("even").alias("boundary")))
    got = graph.cone(seeds, edges, bounds, max_depth=2)
    assert not [p for p in [*plans, plan(got)] if "BroadcastHashJoin" in p]
    want = {"": 0, "even": 0, "trace-depth": 0}
    for at in range(SHORT):
        want[""] += 1
        for hop, node in enumerate(range(at + 1, min(at + 3, SHORT)), 1):
            want["even" if node % 2 == 0 else "trace-depth" if hop == 2 and node + 1 < SHORT else ""] += 1
            if node % 2 == 0:
                break
    assert {r["boundary"]: r["count"] for r in got.groupBy("boundary").count().collect()} == {k: n for k, n in want.items() if n}


def test_fanin_cone_broadcasts_no_large_table(spark, plans, nothing_is_small):
    seeds, edges = chain(spark)
    bounds = store.keep(spark.range(0, SHORT, 3).select(F.col("id").alias("node"), F.lit("third").alias("boundary")))
    got = graph.cone(seeds, edges, bounds, direction="fanin", max_depth=2)
    assert not [p for p in [*plans, plan(got)] if "BroadcastHashJoin" in p]
    want = {"": 0, "third": 0, "trace-depth": 0}
    for at in range(SHORT):
        want[""] += 1
        for hop, node in enumerate(range(at - 1, max(at - 3, -1), -1), 1):
            want["third" if node % 3 == 0 else "trace-depth" if hop == 2 and node > 0 else ""] += 1
            if node % 3 == 0:
                break
    assert {r["boundary"]: r["count"] for r in got.groupBy("boundary").count().collect()} == {k: n for k, n in want.items() if n}


def test_hop_budget_broadcasts_no_large_table(spark, plans, nothing_is_small):
    got = frontier.until_budget(*chain(spark), kind="hop", limit=2)
    assert not [p for p in [*plans, plan(got)] if "BroadcastHashJoin" in p]
    assert {(r["status"], r["spent"]): r["count"] for r in got.groupBy("status", "spent").count().collect()} == {("internal", 0): SHORT - 1, ("internal", 1): SHORT - 2, ("satisfied", 2): SHORT - 2, ("exhausted", 0): 1, ("exhausted", 1): 1}


def test_register_budget_broadcasts_no_large_table(spark, plans, nothing_is_small):
    got = frontier.until_budget(*chain(spark), kind="purchase", limit=1)
    assert not [p for p in [*plans, plan(got)] if "BroadcastHashJoin" in p]
    want = {}
    for at in range(SHORT):
        spent = 0
        for node in range(at, SHORT):
            spent += node > at and node % 3 == 0
            if spent > 1:
                break
            status = "satisfied" if spent else "internal" if node + 1 < SHORT else "exhausted"
            want[status, spent] = want.get((status, spent), 0) + 1
    assert {(r["status"], r["spent"]): r["count"] for r in got.groupBy("status", "spent").count().collect()} == want
