"""As-of join: for each left row the last right row at or before its time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Slices of time at most: their bounds are a tree of comparisons in the plan.
MOST_SLICES = 256


def slice_of(value: Column, bounds: list) -> Column:
    """The number of ``bounds`` (sorted) that are not above ``value``, by halving."""
    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(bounds))


def time_bounds(frames: list[DataFrame], on: str, slices: int) -> list:
    """Times that cut the rows of ``frames`` into ``slices`` parts of about as many rows each, from one pass over their times."""
    kind = frames[0].schema[on].dataType.simpleString()
    times = reduce(DataFrame.union, [f.select(F.col(on).alias("t")) for f in frames]).where("t is not null")
    number = F.unix_micros(F.col("t").cast("timestamp")) if kind.startswith("timestamp") else F.col("t")
    shares = [k / slices for k in range(1, slices)]
    found = times.agg(F.percentile_approx(number, shares, 1000).alias("p")).first().p or []  # one row of at most MOST_SLICES numbers
    return sorted(set(found))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], strict: bool = False, slices: int = 1) -> DataFrame:
    """``left`` with the columns of ``right`` from the last row of the same ``by`` with ``on`` not after
    (``strict``: before) the left row's; nulls where there is none.

    One shuffle and one sort by (by, on): both sides are stacked, and the last right row is carried
    down each group. ``right`` has one row for each (by, on). Null times match nothing.

    With ``slices`` (MOST_SLICES at most) a group is cut by time, so that one of any size is spread over tasks: the last
    right row is carried down each slice, and what a slice ends with, one row a slice, from slice to slice in a
    second, small pass. ``by`` may be empty then: all rows are one group. The bounds come from a pass over the times.
    """
    values = [c for c in right.columns if c not in (*by, on)]
    # at equal times right rows come first, or last if equal times don't count
    stacked = right.where(F.col(on).isNotNull()).select(*by, on, F.lit(int(strict)).alias("_side"), F.struct(*values).alias("_right"), F.lit(None).alias("_left"))
    rows = left.select(*by, on, F.lit(1 - int(strict)).alias("_side"), F.lit(None).alias("_right"), F.struct(*left.columns).alias("_left"))
    order = [F.col(on).asc_nulls_first(), F.col("_side")]
    every = stacked.unionByName(rows)
    if slices > 1:
        bounds = time_bounds([left, right], on, min(slices, MOST_SLICES))
        kind = left.schema[on].dataType.simpleString()
        number = F.unix_micros(F.col(on).cast("timestamp")) if kind.startswith("timestamp") else F.col(on)
        every = every.withColumn("_slice", F.when(F.col(on).isNull(), F.lit(-1)).otherwise(slice_of(number, bounds)))
        cut = [*by, "_slice"]
        ends = every.where("_right is not null").groupBy(*cut).agg(F.max_by("_right", on).alias("_end"))
        onward = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        parts = _null_safe(every.select(*cut).distinct(), ends, cut)
        before = parts.select(*cut, F.last("_end", ignorenulls=True).over(onward).alias("_before"))
        local = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        within = every.withColumn("_last", F.last("_right", ignorenulls=True).over(local)).where("_left is not null")
        carried = _null_safe(within, before, cut).withColumn("_last", F.when(F.col(on).isNotNull(), F.coalesce("_last", "_before")))
    else:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        carried = every.withColumn("_last", F.last("_right", ignorenulls=True).over(window)).where("_left is not null")
    return carried.select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join by equal keys, nulls equal to nulls; ``right`` has a row a key."""
    right = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(right, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
