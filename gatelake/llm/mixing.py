"""Mixing by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their marginals meet the targets. The fitted share
over the present share is a cell's factor; a document is drawn with a probability in proportion to it, at most 1, by a
hash of its identifier. The scale is solved for the tokens to draw, so a cell too small for its share is kept whole and
the others make up for it.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import fresh, shared_table, unit_hash

DIMENSIONS = ("source", "lang", "topic")
#: A target share is in proportion to tokens to this power where no shares are given: below 1 flattens.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Raking stops when no marginal is further from its target than TOLERANCE, or warns that ROUNDS did not get there.
ROUNDS, TOLERANCE = 200, 1e-9
#: Cells that the driver may fit; more are fitted as a table.
MAX_DRIVER_CELLS = 50_000
#: Share of the tokens to draw where no budget is given.
SHARE = 0.7


def token_estimate(text: Column) -> Column:
    """Tokens of a text, at four bytes each."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def surface_topic(text: Column) -> Column:
    """A stand-in for a topic where the table has none: what the text's surface shows."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.lower(t).contains("licens"), "legal").when(t.rlike("[0-9]"), "records").when(F.length(t) > 4000, "long").otherwise("prose")


def fit(cells: list[tuple], mass: np.ndarray, targets: dict[str, dict[str, float]]) -> np.ndarray:
    """Fitted mass of each cell. Targets of values that no cell has are left out and the rest scaled to one."""
    x = mass.astype(float)
    if not x.sum():
        return x
    x = x / x.sum()
    axes = []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[d] for c in cells})
        want = np.array([max(0.0, targets[name].get(v, 0.0)) for v in values])
        axes.append((np.array([values.index(c[d]) for c in cells]), want / want.sum() if want.sum() else want))
    for _ in range(ROUNDS):
        worst = 0.0
        for at, want in axes:
            have = np.bincount(at, weights=x, minlength=len(want))
            worst = max(worst, float(np.abs(have - want).max()))
            x = x * np.where(have > 0, want / np.where(have > 0, have, 1), 0)[at]
        if worst < TOLERANCE:
            return x
    warnings.warn(f"marginals are still {worst:.2e} from their targets after {ROUNDS} rounds; they may contradict each other", stacklevel=2)
    return x


def default_targets(cells: list[tuple], mass: np.ndarray) -> dict[str, dict[str, float]]:
    out = {}
    for d, name in enumerate(DIMENSIONS):
        totals: dict[str, float] = {}
        for c, m in zip(cells, mass):
            totals[c[d]] = totals.get(c[d], 0.0) + float(m)
        powered = {k: v ** POWERS[name] for k, v in totals.items()}
        out[name] = {k: v / (sum(powered.values()) or 1) for k, v in powered.items()}
    return out


def _fit_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """``cells`` with the fitted mass, as joins and aggregates, where they are too many for the driver."""
    total = cells.agg(F.sum("tokens")).head()[0] or 1
    x = shared_table(cells.withColumn("fitted", F.col("tokens") / F.lit(float(total))), "mix_cells")
    for _ in range(ROUNDS):
        worst = 0.0
        for name in DIMENSIONS:
            have = x.groupBy(name).agg(F.sum("fitted").alias("have"), F.sum("tokens").alias("own"))
            if targets and name in targets:
                want = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[name].items()] or [("", 0.0)], f"{name} string, want double")
                have = have.join(want, name, "left").fillna(0.0, ["want"])
            else:
                have = have.withColumn("want", F.pow("own", F.lit(POWERS[name])))
            have = shared_table(have, "mix_margin")
            scale = have.agg(F.sum("want")).head()[0] or 1.0
            worst = max(worst, have.agg(F.max(F.abs(F.col("have") - F.col("want") / scale))).head()[0] or 0.0)
            step = have.select(name, F.when(F.col("have") > 0, F.col("want") / scale / F.col("have")).otherwise(0.0).alias("step"))
            x = shared_table(x.join(step, name).withColumn("fitted", F.col("fitted") * F.col("step")).drop("step"), "mix_cells")
        if worst < TOLERANCE:
            return x
    warnings.warn(f"marginals are still {worst:.2e} from their targets after {ROUNDS} rounds; they may contradict each other", stacklevel=2)
    return x


def scale_for(table: DataFrame, wanted: float) -> float:
    """The factor on ``weight`` whose probabilities, at most 1, draw ``wanted`` tokens in expectation.

    Newton steps from below on a concave, piecewise linear function; each step takes cells to 1 until no more reach it.
    Where all cells with weight are whole before that, the factor takes them all to 1.
    """
    some, least = table.where("weight > 0 and tokens > 0").agg(F.sum("tokens"), F.min("weight")).head()
    if not some or wanted <= 0:
        return 0.0
    if wanted >= some:
        return 1.0 / least
    scale, whole = 0.0, -1
    while True:
        full = F.col("weight") * scale >= 1.0
        n, mass, rest = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).head()
        if n <= whole or not rest:
            return scale
        scale, whole = max(scale, (wanted - mass) / rest), n


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, budget: int | None = None, share: float = SHARE, seed: int = 0, max_driver_cells: int = MAX_DRIVER_CELLS, out: str = "mix") -> DataFrame:
    """All columns of ``docs`` beside the struct ``out``: source, lang, topic, n_tokens, weight, probability and selected of the row.

    ``targets`` maps a dimension to the shares of its values; a dimension without them gets tempered shares (POWERS).
    ``budget`` is the tokens to draw in expectation; without it, ``share`` of all tokens. Cells whose probability would
    be above 1 are kept whole, so where they are many the drawn marginals fall short of the targets. Null sources and
    languages count as empty ones, a null text has no tokens. Rows that repeat an identifier (null ones among them) in a
    cell are drawn together; an empty table gives an empty result; a text without tokens has its cell's probability. Columns
    of clashing names are passed on unread.
    """
    text = F.col(f"`{text_col}`")
    info = F.struct(*[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in ("source", "lang")], (surface_topic(text) if topic is None else topic).alias("topic"), token_estimate(text).alias("n_tokens"))
    own = fresh(docs, "__mix")
    rows = docs.withColumn(own, info)
    cells = shared_table(rows.groupBy(*[F.col(f"{own}.{d}").alias(d) for d in DIMENSIONS]).agg(F.sum(f"{own}.n_tokens").alias("tokens")), "mix_cells")
    bounded = cells.count() <= max_driver_cells
    if bounded:
        got = sorted(cells.collect())
        keys, mass = [tuple(r)[:3] for r in got], np.array([r["tokens"] for r in got], dtype=float)
        wanted = default_targets(keys, mass) | (targets or {})
        fitted = fit(keys, mass, wanted)
        table = docs.sparkSession.createDataFrame([(*k, float(m), float(x)) for k, m, x in zip(keys, mass, fitted)], "source string, lang string, topic string, tokens double, fitted double")
    else:
        table = _fit_table(cells, targets)
    total = table.agg(F.sum("tokens").alias("t"), F.sum("fitted").alias("f")).head()
    factor = F.when(F.col("tokens") > 0, (F.col("fitted") / (total["f"] or 1.0)) / (F.col("tokens") / (total["t"] or 1.0))).otherwise(0.0)
    table = table.withColumn("weight", factor)
    scale = scale_for(table, float(budget) if budget is not None else share * (total["t"] or 0.0))
    names = {c: fresh(docs, f"__cell_{c}") for c in (*DIMENSIONS, "weight", "probability")}
    table = table.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * scale)).select(*[F.col(c).alias(n) for c, n in names.items()])
    # At most ``max_driver_cells`` rows are broadcast; a larger table is joined by shuffle, where AQE splits hot cells.
    table = F.broadcast(table) if bounded else table
    on = [F.col(f"{own}.{d}") == F.col(names[d]) for d in DIMENSIONS]
    rows = rows.join(table, on[0] & on[1] & on[2])
    drawn = unit_hash(F.lit(seed), F.col(f"`{id_col}`")) < F.col(names["probability"])
    fields = [F.col(f"{own}.{c}").alias(c) for c in (*DIMENSIONS, "n_tokens")]
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*fields, F.col(names["weight"]).alias("weight"), F.col(names["probability"]).alias("probability"), drawn.alias("selected")).alias(out))
