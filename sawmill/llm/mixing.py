"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sawmill.llm.common import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Sweeps over the dimensions between two looks at the gaps, and looks at most.
SWEEPS, LOOKS = 5, 12
#: Largest relative gap between a fitted marginal and its target at which the raking ends.
GAP = 1e-6
#: Exponent that turns the shares found into target shares where no targets are given: below 1 lifts the small.
TEMPER = 0.7
#: Topic shares of the production mix: prose first, the rest in small parts. Sources and languages get TEMPERed shares.
TOPIC_SHARES = {"prose": 0.8, "legal": 0.08, "contact": 0.06, "tabular": 0.03, "loud": 0.03}
#: Relative gap beyond which targets count as missed, and a warning says so.
MISSED = 1e-2
#: Share of all tokens that the sample should hold, at most: it is smaller where the targets ask for more of a category
#: than there is.
BUDGET = 0.6
#: By how much a sample that can't meet the targets is made smaller, and how often.
LESS, TRIES = 0.9, 40
#: Cells (combinations of categories) up to which their table is fitted on the driver and broadcast to the
#: documents; a larger one is fitted by joins and windows. Both ways give the same.
FEW_CELLS = 50_000

#: Topic of a text: the first whose pattern it holds, else prose.
TOPICS = (
    ("legal", r"(?i)licen[sc]e|all rights reserved|copyright"),
    ("contact", r"[\w.]@[\w.]+\.\w"),
    ("tabular", r" \| \S+ \| "),
    ("loud", r"!!"),
)


def topic_of(text: Column) -> Column:
    """A topic by simple marks in the text; null and empty texts are prose."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def words_of(text: Column) -> Column:
    """Tokens as words between white space; null and empty: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _targets(cells: DataFrame, dimension: str, given: dict[str | None, float] | None) -> DataFrame:
    """(dimension, goal): tokens that each category should have of the cells' total."""
    found = cells.groupBy(dimension).agg(F.sum("tokens").alias("n"))
    if given is None:
        weight = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), TEMPER)).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for value, w in given.items():
            weight = F.when(F.col(dimension).eqNullSafe(F.lit(value)) & (F.col("n") > 0), F.lit(float(w))).otherwise(weight)
    every = Window.partitionBy(F.lit(0))  # over the categories only
    weight_sum = F.sum("weight").over(every)
    return found.withColumn("weight", weight).select(dimension, F.when(weight_sum > 0, F.col("weight") / weight_sum * F.sum("n").over(every)).otherwise(F.col("n")).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``fitted`` tokens whose sums by each dimension meet the targets.

    Targets are shares by category for each dimension (scaled to sum to 1; categories left out: 0);
    a dimension without targets gets its shares found to the power TEMPER. Each sweep scales the
    cells to one dimension's goals after the other, all in Spark on the pre-aggregated table.
    Goals that no scaling can reach (empty combinations) leave a gap after LOOKS * SWEEPS sweeps.
    """
    for d in dimensions:
        goal = _targets(cells, d, (targets or {}).get(d)).select(F.col(d).alias("_d"), F.col("goal").alias(f"goal_{d}"))
        cells = cells.join(goal, F.col(d).eqNullSafe(F.col("_d"))).drop("_d")
    now = materialize(cells.withColumn("fitted", F.col("tokens").cast("double")), "cells")
    for _ in range(LOOKS):
        for _ in range(SWEEPS):
            for d in dimensions:
                total = F.sum("fitted").over(Window.partitionBy(d))
                now = now.withColumn("fitted", F.when(total > 0, F.col("fitted") * F.col(f"goal_{d}") / total).otherwise(0.0))
        now = materialize(now, "cells")
        gap = 0.0
        for d in dimensions:
            sums = now.groupBy(d).agg(F.sum("fitted").alias("s"), F.first(f"goal_{d}").alias("g"))
            gap = max(gap, sums.agg(F.max(F.abs(F.col("s") - F.col("g")) / F.greatest("g", F.lit(1.0)))).first()[0] or 0.0)
        if gap <= GAP:
            break
    _told(gap)
    return now.select(*cells.columns[: cells.columns.index("tokens") + 1], "fitted")


def calibrate(cells: DataFrame, budget: float = BUDGET, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``cells`` (dimensions, tokens, fitted) with ``probability``, at most 1, whose expected sample keeps the marginals of
    ``fitted``: of ``budget`` of all tokens, or of the largest part of them for which that can be.

    No cell can give more tokens than it has. Where scaling asks for more, it gives all and the others of its
    categories more instead: raking with upper bounds. What no raking reaches within MISSED is tried with a smaller part.
    """
    given = cells.columns
    for d in dimensions:
        every = Window.partitionBy(d)
        cells = cells.withColumns({f"_goal_{d}": F.sum("fitted").over(every), f"_found_{d}": F.sum("tokens").over(every).cast("double")})
    cells = materialize(cells, "cells")
    rooms = [F.min(F.when(F.col(f"_goal_{d}") > 0, F.col(f"_found_{d}") / F.col(f"_goal_{d}"))) for d in dimensions]
    part = min(budget, 1.0, *(r for r in cells.agg(*rooms).first() if r is not None))
    for _ in range(TRIES):
        now = cells.withColumn("_x", F.least(F.col("tokens").cast("double"), part * F.col("fitted")))
        for _ in range(LOOKS):
            for _ in range(SWEEPS):
                for d in dimensions:
                    now = _bounded(now, d, part)
            now = materialize(now, "cells")
            gap = max(_gap(now, d, part) for d in dimensions)
            if gap <= GAP:
                break
        if gap <= MISSED:
            break
        part *= LESS
    _told(gap, part, budget)
    ratio = F.when(F.col("tokens") > 0, F.col("_x") / F.col("tokens")).otherwise(0.0)
    return now.select(*given, F.least(F.lit(1.0), ratio).alias("probability"))


def _bounded(cells: DataFrame, d: str, part: float) -> DataFrame:
    """``_x`` scaled to a dimension's goals, full cells left full where more is asked."""
    full, every = F.col("_x") >= F.col("tokens"), Window.partitionBy(d)
    cells = cells.withColumns({"_s": F.sum("_x").over(every), "_f": F.sum(F.when(full, F.col("_x")).otherwise(0.0)).over(every)})
    goal = part * F.col(f"_goal_{d}")
    down = F.when(F.col("_s") > 0, goal / F.col("_s")).otherwise(0.0)
    up = F.when(F.col("_s") > F.col("_f"), (goal - F.col("_f")) / (F.col("_s") - F.col("_f"))).otherwise(1.0)
    new = F.when(down <= 1, F.col("_x") * down).when(full, F.col("_x")).otherwise(F.col("_x") * up)
    return cells.withColumn("_x", F.least(F.col("tokens").cast("double"), new)).drop("_s", "_f")


def _gap(cells: DataFrame, d: str, part: float) -> float:
    sums = cells.groupBy(d).agg(F.sum("_x").alias("s"), (part * F.first(f"_goal_{d}")).alias("g"))
    return sums.agg(F.max(F.abs(F.col("s") - F.col("g")) / F.greatest("g", F.lit(1.0)))).first()[0] or 0.0


def _told(gap: float, part: float | None = None, budget: float | None = None) -> None:
    """Warn of the sample's marginals off their targets, and of a sample smaller than asked for."""
    if gap > MISSED:
        warnings.warn(f"mixing ended with a marginal {gap:.1%} off its target: no weights of these cells meet them all", stacklevel=3)
    if part is not None and part < budget * (1 - 1e-9):
        warnings.warn(f"the targets hold for a sample of {part:.1%} of all tokens, not {budget:.1%}", stacklevel=3)


def _rake_few(rows: list[Row], targets: dict[str, dict[str | None, float]] | None, dimensions: tuple[str, ...]) -> np.ndarray:
    """``rake`` for a bounded number of cells."""
    tokens = np.array([r.tokens for r in rows], float)
    fitted, total, sides = tokens.copy(), tokens.sum(), []
    for d in dimensions:
        names = list(dict.fromkeys(r[d] for r in rows))
        place = {n: i for i, n in enumerate(names)}
        own = np.array([place[r[d]] for r in rows])
        found = np.bincount(own, tokens, len(names))
        given = (targets or {}).get(d)
        weight = np.where(found > 0, found**TEMPER if given is None else [float(given.get(n, 0)) for n in names], 0.0)
        sides.append((own, weight / weight.sum() * total if weight.sum() > 0 else found))
    for _ in range(LOOKS):
        for _ in range(SWEEPS):
            for own, goal in sides:
                sums = np.bincount(own, fitted, len(goal))
                fitted *= np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[own]
        gap = max(np.abs((np.bincount(own, fitted, len(goal)) - goal) / np.maximum(goal, 1)).max() for own, goal in sides)
        if gap <= GAP:
            break
    _told(gap)
    return fitted


def _calibrate_few(rows: list[Row], fitted: np.ndarray, budget: float, dimensions: tuple[str, ...]) -> np.ndarray:
    """``calibrate`` for a bounded number of cells."""
    tokens, sides = np.array([r.tokens for r in rows], float), []
    for d in dimensions:
        place = {n: i for i, n in enumerate(dict.fromkeys(r[d] for r in rows))}
        own = np.array([place[r[d]] for r in rows])
        sides.append((own, np.bincount(own, fitted), np.bincount(own, tokens)))
    room = min([1.0, *((found[goal > 0] / goal[goal > 0]).min() for _, goal, found in sides if (goal > 0).any())])
    part = min(budget, room)
    for _ in range(TRIES):
        x, gap = np.minimum(tokens, part * fitted), 0.0
        for _ in range(LOOKS):
            for _ in range(SWEEPS):
                for own, goal, _ in sides:
                    full = x >= tokens
                    s, f, g = np.bincount(own, x, len(goal)), np.bincount(own, np.where(full, x, 0.0), len(goal)), part * goal
                    down = np.divide(g, s, out=np.zeros_like(g), where=s > 0)[own]
                    up = np.divide(g - f, s - f, out=np.ones_like(g), where=s > f)[own]
                    x = np.minimum(tokens, np.where(down <= 1, x * down, np.where(full, x, x * up)))
            gap = max((np.abs(np.bincount(own, x, len(goal)) - part * goal) / np.maximum(part * goal, 1)).max() for own, goal, _ in sides)
            if gap <= GAP:
                break
        if gap <= MISSED:
            break
        part *= LESS
    _told(gap, part, budget)
    return np.minimum(1.0, np.divide(x, tokens, out=np.zeros_like(x), where=tokens > 0))


def chances(cells: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, budget: float = BUDGET) -> tuple[DataFrame, bool]:
    """(cells with ``probability``, whether they are few): raked and calibrated."""
    cells = materialize(cells, "cells")
    if cells.count() > FEW_CELLS:
        return materialize(calibrate(rake(cells, targets), budget).select(*DIMENSIONS, "probability"), "chances"), False
    rows = cells.collect()  # FEW_CELLS at most
    schema = T.StructType([*cells.select(*DIMENSIONS).schema, T.StructField("probability", T.DoubleType())])
    if not rows:
        return cells.sparkSession.createDataFrame([], schema), True
    fitted = _rake_few(rows, targets, DIMENSIONS)
    found = _calibrate_few(rows, fitted, budget, DIMENSIONS)
    return cells.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), float(p)) for r, p in zip(rows, found)], schema), True


def mix(docs: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, budget: float = BUDGET, seed: int = 11) -> DataFrame:
    """``docs`` with topic, tokens, probability and selected.

    Tokens are summed by source, language and topic (partial sums before the shuffle, so a source with
    a third of all rows is one row a task), raked to the targets and turned into one sampling
    probability a cell. A document is selected where a number drawn by hash from its doc_id and text is
    below it, the same in every run. Documents without words have probability 1: they weigh nothing.
    Null categories are categories of their own. Columns of the new ones' names give way.
    """
    docs = docs.drop("topic", "tokens", "probability", "selected")
    docs = docs.withColumn("topic", topic_of(F.coalesce("text", F.lit("")))).withColumn("tokens", words_of(F.col("text")))
    cells = docs.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells, few = chances(cells, targets, budget)
    cells = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "probability")
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
    out = docs.join(F.broadcast(cells) if few else cells, same, "left").drop(*[f"_{d}" for d in DIMENSIONS])
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") / float(1 << 53)
    out = out.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("probability")))
    return out.withColumn("selected", drawn < F.col("probability"))
