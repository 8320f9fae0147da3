"""Connected components of an edge table, in joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.plans.store import drop

#: Edges that one task connects at once before it hands on what they lead to.
CHUNK = 1 << 18


def _forest(x: pa.Array, y: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For edges with x < y, each node but the smallest of its component, and that smallest one."""
    nodes = pc.unique(pa.concat_arrays([x, y]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    a, b = (pc.index_in(v, nodes).to_numpy(zero_copy_only=False).astype(np.int64) for v in (x, y))
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # A node's label is never above its own number, and labels lead down to a root.
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (further := label[label])).any():
            label = further
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes.take(pa.array(label[at])), nodes.take(pa.array(at))


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (x < y) as stars: what the edges of a task connect hangs on its smallest node."""
    held, rows = [], 0

    def settled() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x, y = _forest(*(pa.concat_arrays(table.column(c).chunks) for c in (0, 1)))
        return pa.RecordBatch.from_arrays([x, y], names=["x", "y"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield settled()
            held, rows = [], 0
    if rows:
        yield settled()


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], *, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for each end of ``edges``; direction and repeats do not matter.

    Every task first connects the edges it holds. Then each round points every node at its smallest neighbour, follows the
    pointers twice and contracts the edges to what they lead to. Contracted edges get fewer from round to round, so the
    first round is most of the work, and rounds grow with the logarithm of the longest path. Only the pointers of each round
    are kept; the nodes follow them once, at the end. ``keep`` materialises a DataFrame and cuts its lineage.
    """
    kind = edges.schema[a].dataType.simpleString()
    x, y = F.least(a, b), F.greatest(a, b)
    given = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(x.alias("x"), y.alias("y"))
    live = keep(given.where("x <> y").mapInArrow(_locally, f"x {kind}, y {kind}").distinct())
    pointers = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        # The larger end points at the smaller; a node that is the smaller end of all its edges points at itself.
        up = keep(live.groupBy("y").agg(F.min("x").alias("to")).withColumnRenamed("y", "node"))
        far = up
        for _ in range(2):
            over = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            far = far.join(over, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        far = keep(far)
        pointers.append(far)
        left = live.join(far.select(F.col("node").alias("x"), F.col("to").alias("p")), "x", "left").select(F.coalesce("p", "x").alias("x"), "y")
        both = left.join(far.select(F.col("node").alias("y"), F.col("to").alias("q")), "y", "left").select("x", F.coalesce("q", "y").alias("y"))
        both = both.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        before, live = live, keep(both.mapInArrow(_locally, f"x {kind}, y {kind}").distinct())
        drop(before, up)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = given.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("component", F.col("node"))
    for k, far in enumerate(pointers):
        to = far.select(F.col("node").alias("component"), "to")
        out = out.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        if k % 8 == 7:
            out = keep(out)
    out = keep(out)
    drop(live, *pointers)
    return out
