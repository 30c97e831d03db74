"""Multi-line assembly: lines to the texts of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(lines: DataFrame, start_regex: str | None) -> DataFrame:
    """``lines`` (source, block, pos, value) with ``entry``, the number of entries begun in the source up to the line, and
    ``line``, its number in the source, from 1.

    A line begins an entry where the regex is found in it (null: only empty lines). The count runs
    within each block of a source; the blocks' totals, a row a block, are then summed over the source,
    so that a huge file isn't counted by one task.
    """
    begins = F.col("value").rlike(r"^$" if start_regex is None else start_regex)
    lines = lines.withColumn("_begins", begins.cast("long"))
    local = Window.partitionBy("source", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = lines.groupBy("source", "block").agg(F.sum("_begins").alias("_n"), F.count(F.lit(1)).alias("_m"))
    above = {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_above": F.coalesce(F.sum("_m").over(before), F.lit(0))}
    totals = totals.select(F.col("source").alias("_s"), F.col("block").alias("_b"), *[c.alias(n) for n, c in above.items()])
    counted = lines.withColumns({"_local": F.sum("_begins").over(local), "_row": F.count(F.lit(1)).over(local)})
    joined = counted.join(totals, (F.col("source") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return joined.select("source", "block", "pos", "value", (F.col("_before") + F.col("_local")).alias("entry"), (F.col("_above") + F.col("_row")).alias("line"))


def assemble(lines: DataFrame, start_regex: str | None) -> DataFrame:
    """(source, first_line, message) of each entry of ``lines`` (source, block, pos, value): its lines joined by line feeds,
    trailing line ends cut.

    Lines begin entries as in ``numbered``; a null line begins none. Lines are shuffled once, by block: entries that another one
    of their block follows are whole there. Only the lines before a block's first start and those of its last entry
    are put together over a source's blocks. Lines before a source's first start belong to no entry.
    """
    begins = F.coalesce(F.col("value").rlike(r"^$" if start_regex is None else start_regex), F.lit(False)).cast("long")
    block, source = Window.partitionBy("source", "block").orderBy("pos"), Window.partitionBy("source").orderBy("block", "pos")
    first, here, last = Window.unboundedPreceding, 0, Window.unboundedFollowing
    lines = lines.select("source", "block", "pos", "value", begins.alias("_begins"))
    counted = lines.withColumns({"_local": F.sum("_begins").over(block.rowsBetween(first, here)), "_total": F.sum("_begins").over(block.rowsBetween(first, last))})
    edges = counted.where("_local = 0 or _local = _total").withColumn("_entry", F.sum("_begins").over(source.rowsBetween(first, here)))
    rows = F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("rows")
    inner = counted.where("_local > 0 and _local < _total").groupBy("source", "block", "_local").agg(rows)
    crossing = edges.where("_entry > 0").groupBy("source", "_entry").agg(rows)
    text = F.array_join(F.transform("rows", lambda r: r.value), "\n")
    both = inner.select("source", "rows").union(crossing.select("source", "rows"))
    return both.select("source", F.col("rows")[0]["value"].alias("first_line"), F.regexp_replace(text, r"[\r\n]+\z", "").alias("message"))


def orphans(rows: DataFrame) -> DataFrame:
    """(source, value) of the lines of ``numbered`` that belong to no entry."""
    return rows.where("entry = 0").select("source", "value")
