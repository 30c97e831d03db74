"""The store of entries: Parquet by day in two zones, landing and optimized, and its file statistics."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.schema import ENTRY
from sawmill.sources.publish import filesystem, publish, read_text, write_text
from sawmill.sources.state import StateTable

LANDING, OPTIMIZED, REJECTS = "landing", "optimized", "rejects"
#: Compactions under way: which landing files give way to which new ones.
MANIFESTS = "_manifests"
MARKER = "_COMPACTION_COMPLETE"
DAY = ("year", "month", "day")
#: Fields that are columns of the optimized zone, by name and type: of some files, and of all.
PROMOTED = "promoted.json"
#: The last batch of each stream that was published.
BATCHES = "_batches"
COLUMN_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "datetime": T.TimestampType()}


def with_day(entries: DataFrame) -> DataFrame:
    """``entries`` with year, month and day of their own timestamps, zero-padded as the folders have them."""
    stamp = F.col("Timestamp")
    return entries.withColumns({"year": F.date_format(stamp, "yyyy"), "month": F.date_format(stamp, "MM"), "day": F.date_format(stamp, "dd")})


FILES = "path string, zone string, entries long, bytes long, min_timestamp timestamp, max_timestamp timestamp"


def file_table(spark: SparkSession, root: str) -> StateTable:
    """The stored index of the store's files: (path below the root, zone, entries, bytes, earliest and latest timestamp)."""
    return StateTable(spark, root, "files", ("path",), FILES)


def _measured(spark: SparkSession, root: str, files: list[tuple[str, str]]) -> DataFrame:
    """Rows of the index for files that hold entries, (where they are now, where they will be): of their data only
    the timestamps are read."""
    names = spark.createDataFrame([(_key(now), to.removeprefix(f"{root}/")) for now, to in files], "_now string, path string")
    here = F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/")
    found = spark.read.schema(ENTRY).parquet(*[now for now, _ in files]).groupBy(here.alias("_now"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.count(F.lit(1)).alias("entries"), F.min("Timestamp").alias("min_timestamp"), F.max("Timestamp").alias("max_timestamp")
    )
    return found.join(F.broadcast(names), "_now").withColumn("zone", F.split_part("path", F.lit("/"), F.lit(1))).select("path", "zone", "entries", "bytes", "min_timestamp", "max_timestamp")


def _key(path: str) -> str:
    """A path as ``_measured`` compares it: without its scheme."""
    return re.sub("^[a-z]+:/*", "/", path)


def write_zones(parts: dict[str, DataFrame], root: str, name: str | None = None, states: dict[str, DataFrame] | None = None,
                more: Callable[[DataFrame], dict[str, DataFrame]] | None = None, note: tuple[str, str] | None = None) -> bool:
    """Publish frames by zone (entries by day) and changes of state tables by folder, all or none. The new files of
    entries go into the index in the same step, and so does what ``more`` makes of the staged entries, by folder."""
    spark = next(iter(parts.values())).sparkSession
    by_day = lambda rows: with_day(rows).hint("rebalance", *DAY)  # few files a day, and many tasks for a large day
    dated = {zone: by_day(rows) if zone in (LANDING, OPTIMIZED) else rows for zone, rows in parts.items()}
    files = file_table(spark, root)

    def indexed(staged: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
        new = [f for zone in (LANDING, OPTIMIZED) for f in staged.get(zone, [])]
        if not new:
            return {}
        found = more(spark.read.schema(ENTRY).parquet(*[now for now, _ in new])) if more else {}
        return {files.folder: files.change(_measured(spark, root, new)).coalesce(1), **found}

    return publish(spark, root, dated | (states or {}), name, DAY, also=indexed, note=note)


def write_entries(entries: DataFrame, root: str, zone: str = LANDING) -> None:
    """Append entries to a zone, published whole. Failed tasks are tried again."""
    write_zones({zone: entries}, root)


def write_batch(parts: dict[str, DataFrame], root: str, stream: str, batch: int, more: Callable[[DataFrame], dict[str, DataFrame]] | None = None,
                states: dict[str, DataFrame] | None = None) -> bool:
    """Publish a stream's micro-batch, frames by zone and changes of state tables, once, however often it is run: the last batch
    of each stream that was published is noted, and those up to it are left alone. Whether this run wrote it."""
    spark = next(iter(parts.values())).sparkSession
    mark = f"{root}/{BATCHES}/{stream}.json"
    fs, make = filesystem(spark, root)
    if fs.exists(make(mark)) and json.loads(read_text(spark, mark))["batch"] >= batch:
        return False
    return write_zones(parts, root, f"{stream}-{batch}", states, more, note=(mark, json.dumps({"batch": batch})))


def promotions(spark: SparkSession, root: str) -> tuple[dict[str, str], dict[str, str]]:
    """Fields that are columns of some, and those that are columns of all files of the optimized zone."""
    fs, make = filesystem(spark, root)
    if not fs.exists(make(f"{root}/{PROMOTED}")):
        return {}, {}
    data = json.loads(read_text(spark, f"{root}/{PROMOTED}"))
    return data["some"], data["all"]


def note_promotions(spark: SparkSession, root: str, promote: dict[str, str]) -> None:
    """Say, before files with these columns are published, which columns the optimized zone will have."""
    fs, make = filesystem(spark, root)
    some, every = promotions(spark, root)
    for name, kind in promote.items():
        if some.get(name, kind) != kind:
            raise ValueError(f"field {name!r} was promoted as {some[name]} before, not {kind}")
    first = not (fs.globStatus(make(f"{root}/{OPTIMIZED}/year=*/month=*/day=*/*.parquet")) or [])
    every = dict(promote) if first else {k: v for k, v in every.items() if k in promote}
    write_text(spark, f"{root}/{PROMOTED}", json.dumps({"some": some | promote, "all": every}))


def manifests(spark: SparkSession, root: str) -> list[tuple[str, list[str], list[str]]]:
    """(path, replaced landing files, new files) of the compactions under way; files from the zone's name on."""
    fs, make = filesystem(spark, root)
    out = []
    for status in fs.globStatus(make(f"{root}/{MANIFESTS}/*.json")) or []:
        path = status.getPath().toString()
        data = json.loads(read_text(spark, path))
        out.append((path, data["replaced"], data["new"]))
    return out


def hidden_files(spark: SparkSession, root: str) -> set[str]:
    """Files that a reader must leave out: of each compaction under way the replaced ones if all the new
    ones are there, else the new ones. So an entry is seen once at any time."""
    fs, make = filesystem(spark, root)
    out: set[str] = set()
    for _, replaced, new in manifests(spark, root):
        done = all(fs.exists(make(f"{root}/{f}")) for f in new)
        out.update(replaced if done else new)
    return out


def read_zone(spark: SparkSession, root: str, zone: str, hidden: set[str] = frozenset()) -> DataFrame | None:
    """A zone's entries; None if it has no file. Only *.parquet counts: others are unfinished. The optimized
    zone has the promoted fields as columns, null in files that lack them."""
    path = f"{root}/{zone}"
    fs, make = filesystem(spark, path)
    found = fs.globStatus(make(f"{path}/year=*/month=*/day=*/*.parquet")) or []
    extra = promotions(spark, root)[0] if zone == OPTIMIZED else {}
    days = [T.StructField(d, T.IntegerType()) for d in DAY]
    reader = spark.read.schema(T.StructType([*ENTRY, *(T.StructField(n, COLUMN_TYPES[k]) for n, k in extra.items()), *days]))
    if hidden:
        files = [s.getPath().toString() for s in found]
        files = [f for f in files if "/".join(f.split("/")[-5:]) not in hidden]
        return reader.option("basePath", path).parquet(*files) if files else None
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if len(found) else None


def read_zones(spark: SparkSession, root: str) -> list[DataFrame]:
    """The zones that have entries, optimized first."""
    hidden = hidden_files(spark, root)
    return [z for z in (read_zone(spark, root, zone, hidden) for zone in (OPTIMIZED, LANDING)) if z is not None]


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """Both zones as one table, year, month and day as integers; no files: no rows."""
    zones = read_zones(spark, root)
    if not zones:
        return spark.createDataFrame([], ENTRY).selectExpr("*", "0 year", "0 month", "0 day")
    out = zones[0].select(*ENTRY.names, *DAY)
    for more in zones[1:]:
        out = out.unionByName(more)
    return out


def read_nested(spark: SparkSession, root: str) -> DataFrame:
    """A store whose day folders hold a landing folder each, year=/month=/day=[/landing]/*.parquet, in one scan."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(root)


def file_stats(spark: SparkSession, root: str) -> DataFrame:
    """(path, min_timestamp, max_timestamp, entries) of each file of the store."""
    entries = read_entries(spark, root)
    return entries.groupBy(F.input_file_name().alias("path")).agg(
        F.min("Timestamp").alias("min_timestamp"), F.max("Timestamp").alias("max_timestamp"), F.count(F.lit(1)).alias("entries")
    )


def indexed_stats(spark: SparkSession, root: str) -> DataFrame:
    """``file_stats`` from the stored index, with bytes: no file of entries is opened. Files written by other means than this
    module's are not in it until ``reindex``."""
    return file_table(spark, root).current().withColumn("path", F.concat(F.lit(f"{root}/"), "path"))


def index_replaced(spark: SparkSession, root: str, replaced: list[str], new: list[str]) -> None:
    """One change of the index: files, named from their zone on, that gave way, and those that hold their entries now."""
    files = file_table(spark, root)
    gone = files.change(spark.createDataFrame([(p,) for p in replaced], "path string"), deleted=True)
    publish(spark, root, {files.folder: files.change(_measured(spark, root, [(f"{root}/{p}", f"{root}/{p}") for p in new])).unionByName(gone).coalesce(1)})


def reindex(spark: SparkSession, root: str) -> int:
    """Bring the index up to date with the files that are there; how many were put in or taken out."""
    files = file_table(spark, root)
    hidden, (fs, make) = hidden_files(spark, root), filesystem(spark, root)
    there = [s.getPath().toString() for zone in (LANDING, OPTIMIZED) for s in fs.globStatus(make(f"{root}/{zone}/year=*/month=*/day=*/*.parquet")) or []]
    paths = ["/".join(f.split("/")[-5:]) for f in there]
    listed = spark.createDataFrame([(p,) for p in paths if p not in hidden], "path string")
    known = files.current().select("path")
    new = [r.path for r in listed.join(known, "path", "left_anti").collect()]
    gone = known.join(listed, "path", "left_anti")
    n_gone = gone.count()
    if n_gone:
        files.delete(gone)
    if new:
        files.upsert(_measured(spark, root, [(f"{root}/{p}", f"{root}/{p}") for p in new]).coalesce(1))
    return len(new) + n_gone


def files_between(stats: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The rows of ``stats`` whose files can hold entries of the half-open time range."""
    start, end = (t if t.tzinfo else t.replace(tzinfo=timezone.utc) for t in (start, end))
    return stats.where((F.col("max_timestamp") >= F.lit(start)) & (F.col("min_timestamp") < F.lit(end)))


def read_files_between(spark: SparkSession, stats: DataFrame, start: datetime, end: datetime, base: str | None = None) -> DataFrame:
    """Entries of the half-open time range from the files whose statistics meet it; no other file is opened."""
    start, end = (t if t.tzinfo else t.replace(tzinfo=timezone.utc) for t in (start, end))
    paths = [r.path for r in files_between(stats, start, end).select("path").collect()]  # the files of the range
    if not paths:
        return spark.createDataFrame([], ENTRY)
    reader = spark.read.option("basePath", base) if base else spark.read
    entries = reader.parquet(*paths)
    return entries.where((F.col("Timestamp") >= F.lit(start)) & (F.col("Timestamp") < F.lit(end)))
