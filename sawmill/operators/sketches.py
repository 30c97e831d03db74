"""Mergeable sketches beside the store: distinct counts and quantiles by day and level, without reading entries again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions import fields as ff
from sawmill.sources.state import StateTable

#: Accuracy: 2 ** LOG_K registers of a distinct count (about 1.04 / sqrt of that off), and the size of a quantile sketch.
LOG_K, QUANTILE_K = 12, 400


def sketch_table(spark: SparkSession, root: str) -> StateTable:
    """(part, day, Level, field, n, distinct, quantiles): a row for each day, level and field of a published part."""
    return StateTable(spark, root, "sketches", ("part", "day", "Level", "field"), "part string, day date, Level string, field string, n long, distinct binary, quantiles binary")


def sketched(entries: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(day, Level, field, n, distinct, quantiles) of ``entries``: each field's values as text in a distinct count, those of
    longs and doubles in a quantile sketch, too. One pass, added up by task before the shuffle."""
    columns = []
    for name, kind in fields.items():
        numeric = ff.value(name, kind).cast("double") if kind in ("long", "double") else F.lit(None).cast("double")
        columns.append(F.struct(F.lit(name).alias("field"), ff.raw(name).alias("text"), numeric.alias("number")))
    rows = entries.select(F.to_date("Timestamp").alias("day"), "Level", F.explode(F.array(*columns)).alias("_f")).where("_f.text is not null")
    return rows.groupBy("day", "Level", F.col("_f.field").alias("field")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_f.text", F.lit(LOG_K)).alias("distinct"), F.kll_sketch_agg_double("_f.number", F.lit(QUANTILE_K)).alias("quantiles")
    )


def sketch_part(entries: DataFrame, fields: dict[str, str], root: str, part: str) -> None:
    """Put a part's sketches beside the store; a part that is put in again counts once."""
    sketch_table(entries.sparkSession, root).upsert(sketched(entries, fields).withColumn("part", F.lit(part)).coalesce(1))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, distinct, quantiles): sketches merged over all else; they may be merged again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def approx_distinct(sketch: Column | str = "distinct") -> Column:
    return F.hll_sketch_estimate(sketch)


def approx_quantile(share: float, sketch: Column | str = "quantiles") -> Column:
    """Null where the field has no numbers."""
    sketch = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))
