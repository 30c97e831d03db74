"""Joins by overlap of ranges, without an equal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one cell on the right from which on they are dealt out to blocks of so many.
BLOCK = 20_000
#: Levels of cells: each is twice as wide as the one below.
LEVELS = 48
#: Bits of a place that one level of running counts takes.
BITS = 16


def _number(value: Column, kind: str) -> Column:
    """A place on the line as a whole number: microseconds of times, integers as they are."""
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(value.cast("timestamp"))
    return value.cast("long")


def _celled(rows: DataFrame, begin: Column, end: Column, width: int, levels: list[int], side: str) -> DataFrame:
    """A row for each level from the row's own on that is in use, and each of the two cells at most that its range meets there."""
    rows = rows.withColumns({f"_{side}b": begin, f"_{side}e": end}).where(F.col(f"_{side}b") <= F.col(f"_{side}e"))
    used = F.array(*[F.lit(n) for n in levels])
    place = lambda at, level: F.floor(at / (F.lit(float(width)) * F.pow(F.lit(2.0), level))).cast("long")
    cells = F.flatten(F.transform(F.filter(used, lambda n: n >= F.col(f"_{side}l")), lambda n: F.transform(
        F.sequence(place(F.col(f"_{side}b"), n), place(F.col(f"_{side}e"), n)), lambda c: F.struct(n.alias("level"), c.alias("cell")))))
    return rows.withColumn("_c", F.explode(cells)).withColumns({"_level": F.col("_c.level"), "_cell": F.col("_c.cell"), f"_{side}f": place(F.col(f"_{side}b"), F.col("_c.level"))}).drop("_c")


def _levelled(rows: DataFrame, begin: Column, end: Column, width: int, side: str) -> DataFrame:
    """The row's own level: the lowest whose cells are as wide as its range."""
    own = F.ceil(F.log2(F.greatest((end - begin).cast("double") / width, F.lit(1.0))))
    return rows.withColumn(f"_{side}l", F.least(own, F.lit(LEVELS)).cast("int"))


def interval_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: int, block: int = BLOCK) -> DataFrame:
    """Pairs of rows whose closed ranges overlap.

    Ranges are two columns of times, dates or integers (a point: one column twice). Places are cut into cells of ``width``
    (microseconds for times) and wider ones at higher levels, so a range of any length is in two cells at its level, and
    meets shorter ones there. Rows are joined by cell, each pair once, at the higher of its levels and in the first
    cell both have. Where over ``block`` right rows share a cell they are dealt out to blocks, and the left rows go
    to each of them. Rows with a null bound, or an end before the begin, have no partner. Columns of one name in both come twice.
    """
    kinds = dict(left.dtypes) | {f"right.{c}": k for c, k in right.dtypes}
    lb, le = (_number(F.col(f"_left.{c}"), kinds[c]) for c in left_range)
    rb, re = (_number(F.col(f"_right.{c}"), kinds[f"right.{c}"]) for c in right_range)
    a = left.select(F.struct("*").alias("_left"))
    b = right.select(F.struct("*").alias("_right"))
    a, b = _levelled(a, lb, le, width, "l"), _levelled(b, rb, re, width, "r")
    found = a.select(F.col("_ll").alias("n")).distinct().union(b.select(F.col("_rl")).distinct()).where("n is not null").distinct().collect()  # LEVELS at most
    levels = sorted(r.n for r in found)
    a, b = _celled(a, lb, le, width, levels, "l"), _celled(b, rb, re, width, levels, "r")
    hot = b.groupBy("_level", "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    hot = F.broadcast(hot.select("_level", "_cell", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))  # right rows by block at most
    a = a.join(hot, ["_level", "_cell"], "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    b = b.join(hot, ["_level", "_cell"], "left").withColumn("_block", F.pmod(F.xxhash64("_rb", "_re", "_right"), F.coalesce("_blocks", F.lit(1))).cast("int")).drop("_blocks")
    pairs = a.join(b, ["_level", "_cell", "_block"]).where(
        (F.col("_level") == F.greatest("_ll", "_rl")) & (F.col("_cell") == F.greatest("_lf", "_rf")) & (F.col("_lb") <= F.col("_re")) & (F.col("_rb") <= F.col("_le"))
    )
    return pairs.select("_left.*", "_right.*")


def _running(sums: DataFrame, shift: int = 0) -> DataFrame:
    """``sums`` (_place, _begins, _ends; a row a place) with ``_begun``, the begins up to the place, and ``_ended``, the ends up to it.

    Places that differ in their last BITS bits only are a group and summed there; the groups' own sums, places without
    those bits, are summed in the same way, so that no group has over 2**BITS rows however the places lie.
    """
    top = shift + BITS >= 64
    rows = sums.withColumn("_group", F.lit(0).cast("long") if top else F.shiftright("_place", BITS))
    within = Window.partitionBy("_group").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_begun": F.sum("_begins").over(within), "_ended": F.sum("_ends").over(within)})
    if top:
        return rows.drop("_group")
    groups = sums.groupBy(F.shiftright("_place", BITS).alias("_place")).agg(F.sum("_begins").alias("_begins"), F.sum("_ends").alias("_ends"))
    below = _running(groups, shift + BITS).select(F.col("_place").alias("_group"), (F.col("_begun") - F.col("_begins")).alias("_b"), (F.col("_ended") - F.col("_ends")).alias("_e"))
    return rows.join(below, "_group").select("_place", "_begins", "_ends", (F.col("_begun") + F.col("_b")).alias("_begun"), (F.col("_ended") + F.col("_e")).alias("_ended"))


def overlap_counts(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], width: int, block: int = BLOCK) -> DataFrame:
    """A row for each key of ``left``, and ``n``, the number of right rows whose range overlaps its own: also of keys without any.

    No pair is made: of the right ranges those overlap that begin up to the left one's end, less those that end before
    its begin, so both are read from running counts of the places. ``width`` and ``block`` are ``interval_join``'s and change nothing here.
    """
    kinds = dict(left.dtypes), dict(right.dtypes)
    (lb, le), (rb, re) = ([_number(F.col(c), k[c]) for c in some] for k, some in zip(kinds, (left_range, right_range)))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    asked = F.when(lb <= le, F.array(F.struct(le.alias("place"), F.lit(True).alias("last")), F.struct(lb.alias("place"), F.lit(False).alias("last"))))
    asks = left.select(F.col(key).alias("_key"), F.explode_outer(asked).alias("_a")).select("_key", "_a.*")
    marked = F.array(F.struct(rb.alias("_place"), one.alias("_begins"), zero.alias("_ends")), F.struct(re.alias("_place"), zero.alias("_begins"), one.alias("_ends")))
    marks = right.where(rb <= re).select(F.explode(marked).alias("_m")).select("_m.*")
    places = marks.union(asks.where("place is not null").select("place", zero, zero))
    counts = _running(places.groupBy("_place").agg(F.sum("_begins").alias("_begins"), F.sum("_ends").alias("_ends")))
    found = asks.join(counts, F.col("place") == F.col("_place"), "left")
    share = F.when(F.col("last"), F.col("_begun")).otherwise(F.col("_ends") - F.col("_ended"))
    return found.groupBy("_key").agg(F.coalesce(F.sum(share), zero).alias("n")).select(F.col("_key").alias(key), "n")
