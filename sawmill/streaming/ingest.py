"""Ingestion as batch jobs and as a stream; both parse by the same operators."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sawmill.config import ParserConfig, Plugin, Settings
from sawmill.operators.assemble import numbered
from sawmill.operators.extract import parse, parse_json
from sawmill.operators.templates import template_table, unknown_templates
from sawmill.plans.view import Registry
from sawmill.schema import SLOTS
from sawmill.sources.lines import read_lines, reconcile, routed
from sawmill.sources.publish import filesystem, read_text, settle
from sawmill.sources.state import StateTable
from sawmill.sources.store import LANDING, REJECTS, write_batch, write_zones
from sawmill.sources.tail import TailSource
from sawmill.streaming import plugins
from sawmill.streaming.metrics import Metrics, Observed

#: Parsers by plugin type: callables of (lines, plugin) that give (entries, rejects).
PARSERS = {"regex": lambda lines, plugin: parse(lines, plugin.parser), "json": lambda lines, plugin: parse_json(lines, plugin.parser)}
#: Where a store keeps its field registry.
REGISTRY = "registry"
#: A line of a file that came too late: its entry was stored when the file ended there.
LATE = "Late line of a stored entry"


def register_parser(kind: str, parser) -> None:
    PARSERS[kind] = parser


def parsed(lines: DataFrame, plugin: Plugin) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of sources that end with these lines, by the plugin's parser."""
    if plugin.type in plugins.FACTORIES:
        return plugins.parse_whole(lines, plugins.FACTORIES[plugin.type])
    return PARSERS[plugin.type](lines, plugin)


def parse_routed(lines: DataFrame, routes: tuple[Plugin, ...]) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of lines of many sources, each by its plugin's parser; lines of no plugin are left out."""
    parts = [parsed(mine, plugin) for plugin, mine in routed(lines, routes)]
    entries, rejects = parts[0]
    for e, r in parts[1:]:
        entries, rejects = entries.unionByName(e), rejects.unionByName(r)
    return entries, rejects


# --- the registry ----------------------------------------------------------------------------------


def registered(spark: SparkSession, routes: tuple[Plugin, ...], root: str) -> tuple[Registry, tuple[Plugin, ...], list[str]]:
    """(the store's registry with the plugins' fields in it, the plugins with the registered types, the fields whose
    types gave way). The first type of a field stays, whichever run or plugin brought it."""
    registry, conflicts = Registry(), []
    for plugin in routes:
        conflicts += registry.merge({r.field_name: r.type for r in plugin.parser.fields_regexes if r.field_name})
    conflicts += registry.save(spark, f"{root}/{REGISTRY}")

    def canonical(plugin: Plugin) -> Plugin:
        rules = tuple(replace(r, type=registry.types.get(r.field_name, r.type)) for r in plugin.parser.fields_regexes)
        return replace(plugin, parser=replace(plugin.parser, fields_regexes=rules))

    return registry, tuple(canonical(p) for p in routes), sorted(set(conflicts))


def conflict_rejects(entries: DataFrame, types: dict[str, str]) -> DataFrame:
    """(Source, Error, Text) of the values of ``entries`` that don't read as their field's registered type; the entry has
    them as text."""
    typed = {name: kind for name, kind in types.items() if SLOTS[kind] != "StringValue"}
    kinds = F.create_map(*[F.lit(x) for pair in typed.items() for x in pair]) if typed else F.create_map().cast("map<string,string>")
    bad = entries.select("Source", F.explode(F.filter("Fields", lambda f: f.StringValue.isNotNull() & F.array_contains(F.array(*[F.lit(n) for n in typed]).cast("array<string>"), f.Key))).alias("_f"))
    error = F.concat(F.lit("Field "), F.col("_f.Key"), F.lit(" is "), F.try_element_at(kinds, F.col("_f.Key")))
    return bad.select("Source", error.alias("Error"), F.col("_f.StringValue").alias("Text"))


def _follow_ups(routes: tuple[Plugin, ...], types: dict[str, str], root: str) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """What is published with staged entries: rejects for values that conflict with the registry, and new templates."""
    def more(entries: DataFrame) -> dict[str, DataFrame]:
        out = {f"{REJECTS}#conflicts": conflict_rejects(entries, types).coalesce(1)}
        hashed = [p for p in routes if p.parser.template_hashes]
        if hashed:
            table = template_table(entries.sparkSession, root)
            named = entries.withColumnRenamed("Source", "source")
            parts = [unknown_templates(mine, plugin, root) for plugin, mine in routed(named, routes) if plugin in hashed]
            out[table.folder] = table.change(reduce(DataFrame.unionByName, parts)).coalesce(1)
        return out

    return more


# --- batch -----------------------------------------------------------------------------------------

TRACKED = "path string, bytes long, mtime timestamp, lines long, entries long, head long, last long"


def tracked_files(spark: SparkSession, root: str) -> StateTable:
    """The files that batch ingestion has read: up to which byte, line and entry, and hashes of the first and last line."""
    return StateTable(spark, root, "tracked", ("path",), TRACKED)


def _listed(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """(path as lines have it, bytes, mtime, place) of the files below some folders; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.col("path").alias("place"))


def _starts(plugin: Plugin) -> str | None:
    return "" if plugin.type == "json" or plugin.type in plugins.FACTORIES else plugin.parser.start_of_entry_regex


def ingest(spark: SparkSession, settings: Settings) -> dict[str, int]:
    """Parse what is new in the files of the log paths into the landing zone; the number of files by change.

    A keyed table of the store says what was read (``tracked_files``): files that it doesn't have are read whole, those with
    a later time from the line on where the last run ended, those that begin with another line or became
    shorter whole again, and those that went are forgotten; their entries stay. Entries, rejects and the table change in one
    step, which an interrupted run's successor ends or drops, so running it again adds nothing. A file's last entry
    is stored as it is; lines that are added to it later are rejects, as is the rest of a line that had no end. One run
    at a time.
    """
    root = settings.data_path
    settle(spark, root, "ingest-")
    registry, routes, _ = registered(spark, settings.plugins, root)
    table = tracked_files(spark, root)
    known = table.current()
    listed = _listed(spark, settings.log_paths)
    changes = reconcile(listed, known).join(listed.select("path", "bytes", F.col("mtime").alias("now"), "place"), "path", "left").collect()  # a row a changed file
    counts = {kind: sum(r.change == kind for r in changes) for kind in ("Added", "Changed", "Removed")}
    paths = [r.path for r in changes if r.change != "Removed"]
    states, parts = [], {}
    if paths:
        lines = read_lines(spark, [r.place for r in changes if r.change != "Removed"])
        before = F.broadcast(known.join(spark.createDataFrame([(p,) for p in paths], "path string"), "path"))  # the changed files' rows
        sizes = spark.createDataFrame([(r.path, r.bytes, r.now) for r in changes if r.change != "Removed"], "path string, bytes long, mtime timestamp")
        entries, rejects, seen, some_known = [], [], [], counts["Changed"] > 0
        for plugin, mine in routed(lines, routes):
            if some_known:
                fresh, late, read = _unread(mine, _starts(plugin), before, sizes)
                rejects.append(late)
            else:  # of files that no run has read every line is new
                fresh, read = mine, _read_of(mine, _starts(plugin))
            e, r = parsed(fresh, plugin)
            entries.append(e)
            rejects.append(r)
            seen.append(read)
        union = lambda some: reduce(DataFrame.unionByName, some)
        parts = {LANDING: union(entries), REJECTS: union(rejects)}
        met = union(seen).join(F.broadcast(sizes), "path", "right")  # files without lines, or of no plugin, are known too
        zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "entries", "head", "last")}
        states.append(table.change(met.select("path", "bytes", "mtime", *zero.values())))
    gone = [(r.path,) for r in changes if r.change == "Removed"]
    if gone:
        states.append(table.change(spark.createDataFrame(gone, "path string"), deleted=True))
    if states:
        state = {table.folder: reduce(DataFrame.unionByName, states).coalesce(1)}
        write_zones(parts or {table.folder: state.pop(table.folder)}, root, f"ingest-{uuid.uuid4().hex}", state, _follow_ups(routes, registry.types, root))
        table.vacuum(64)
    return counts


def _read_of(lines: DataFrame, start: str | None) -> DataFrame:
    """What is known of files (path) when these lines, all of theirs, are read: counts of lines and entries, and hashes of the
    first and last line, by partial aggregates; no line is shuffled or numbered."""
    begins, place, line = F.col("value").rlike(r"^$" if start is None else start).cast("long"), F.struct("block", "pos"), F.xxhash64("value")
    return lines.groupBy(F.col("source").alias("path")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(begins).alias("entries"), F.min_by(line, place).alias("head"), F.max_by(line, place).alias("last")
    )


def _unread(lines: DataFrame, start: str | None, before: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines that no run has read, rejects of those that came too late, what is then known of the files).

    Lines are numbered over a file's blocks, so a file of any size is dealt out. A file whose first line
    differs from the one known, or that is shorter than what was read, is new.
    """
    rows, read = numbered(lines, start).withColumn("_hash", F.xxhash64("value")), _read_of(lines, start).withColumnRenamed("path", "source")
    same = (F.col("k.head") == F.col("r.head")) & (F.col("s.bytes") >= F.col("k.bytes"))
    marks = read.alias("r").join(before.alias("k"), F.col("k.path") == F.col("r.source")).join(F.broadcast(sizes).alias("s"), F.col("s.path") == F.col("r.source")).where(same)
    marks = marks.select(F.col("source").alias("_s"), F.col("k.lines").alias("_lines"), F.col("k.entries").alias("_entries"), F.col("k.last").alias("_last"))
    both = rows.join(F.broadcast(marks), F.col("source") == F.col("_s"), "left")
    new = F.col("_s").isNull() | (F.col("line") > F.col("_lines"))
    ended = (F.col("line") == F.col("_lines")) & (F.col("_hash") != F.col("_last"))
    stored = F.col("_s").isNotNull() & (F.col("entry") <= F.col("_entries")) & (F.col("_entries") > 0)
    late = both.where((new | ended) & stored).select(F.col("source").alias("Source"), F.lit(LATE).alias("Error"), F.col("value").alias("Text"))
    fresh = both.where((new | F.coalesce(ended, F.lit(False))) & ~F.coalesce(stored, F.lit(False)))
    return fresh.select("source", "block", "pos", "value"), late, read.withColumnRenamed("source", "path")


# --- streams ---------------------------------------------------------------------------------------


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint's own metadata gives its stream: a new one wherever a new checkpoint is begun."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The files as the last batch planned in a checkpoint has left them: the tailing source's option ``known``."""
    fs, make = filesystem(spark, checkpoint)
    numbers = [s.getPath().getName() for s in fs.globStatus(make(f"{checkpoint}/offsets/[0-9]*")) or []]
    numbers = [n for n in numbers if n.isdigit()]
    if not numbers:
        return None
    return json.loads(read_text(spark, f"{checkpoint}/offsets/{max(numbers, key=int)}").splitlines()[2])["files"]


class Drain:
    """A stream that ends where its files ended when it began: batch after batch within the limits, then it stops.

    It has what is used of a StreamingQuery: awaitTermination, stop, isActive, exception, lastProgress, recentProgress, id.
    """

    def __init__(self, query: StreamingQuery):
        self.query, self.failure = query, None
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        try:
            self.query.processAllAvailable()
            self.query.stop()
        except Exception as e:  # told by awaitTermination
            self.failure = e

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        self.thread.join(timeout)
        if self.failure is not None:
            raise self.failure
        return None if timeout is None else not self.thread.is_alive()

    def __getattr__(self, name: str):
        return getattr(self.query, name)


def ingest_stream(spark: SparkSession, folder: str, parser: ParserConfig | Plugin, root: str, checkpoint: str, include: str = "*", exclude: str = "",
                  flush_seconds: float = 5, available_now: bool = False, interval: str = "5 seconds", max_bytes: int = 64 << 20, max_entries: int = 0,
                  earlier: tuple[Plugin, ...] = (), on_lost: str = "fail", metrics: Metrics | None = None) -> StreamingQuery | Drain:
    """Follow the files of ``folder`` into the landing zone.

    Each micro-batch holds whole entries, at most ``max_bytes`` and ``max_entries`` (0: any number) of them, so it is parsed like
    any batch of lines; the checkpoint holds the files' offsets, and a restart goes on there. ``available_now`` reads
    all that is there when it begins, in as many batches as that takes. A batch that is run again is published
    once (``write_batch``), under the id in the checkpoint's metadata. Fields get the types of the store's registry.
    Files that ``earlier`` plugins take are left to them. ``metrics`` gets the counts of what is written. Of plugins with
    parsers of users (``register_plugin``) the store keeps what these remember, and changes it with each batch.
    """
    plugin = parser if isinstance(parser, Plugin) else Plugin(parser=parser)
    registry, (plugin,), _ = registered(spark, (plugin,), root)
    spark.dataSource.register(TailSource)
    start = _starts(plugin)
    lines = (
        spark.readStream.format("logtail").option("startRegex", "^$" if start is None else start).option("include", include).option("exclude", exclude)
        .option("flushSeconds", str(flush_seconds)).option("maxBytesPerBatch", str(max_bytes)).option("maxEntriesPerBatch", str(max_entries))
        .option("earlier", json.dumps([[p.include, p.exclude] for p in earlier])).option("availableNow", str(available_now).lower()).option("onLost", on_lost)
    )
    known = last_offset(spark, checkpoint)
    lines = (lines.option("known", known) if known else lines).load(folder)

    more = _follow_ups((replace(plugin, include=("*",), exclude=()),), registry.types, root)

    def write(batch: DataFrame, number: int) -> None:
        stream, states, kept = stream_id(spark, checkpoint), None, None
        if plugin.type in plugins.FACTORIES:
            entries, rejects, states, kept = plugins.parse_batch(batch, plugins.FACTORIES[plugin.type], root, stream)
        else:
            entries, rejects = PARSERS[plugin.type](batch, plugin)
        counted = Observed(entries, rejects) if metrics else None
        if counted:
            entries, rejects = counted.entries, counted.rejects
        if write_batch({LANDING: entries, REJECTS: rejects}, root, stream, number, more, states) and counted:
            counted.told(metrics)
        if kept is not None:
            kept.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime="0 seconds" if available_now else interval).start()
    return Drain(query) if available_now else query


def ingest_streams(spark: SparkSession, settings: Settings, checkpoint: str, available_now: bool = False) -> list[StreamingQuery | Drain]:
    """A stream for each plugin and log path, each with its own folder of the checkpoint."""
    return [
        ingest_stream(
            spark, folder, plugin, settings.data_path, f"{checkpoint}/{plugin.name}-{k}-{i}", ",".join(plugin.include), ",".join(plugin.exclude),
            settings.flush_seconds, available_now, max_bytes=settings.max_bytes_per_batch, max_entries=settings.max_entries_per_batch, earlier=settings.plugins[:k],
        )
        for k, plugin in enumerate(settings.plugins) for i, folder in enumerate(settings.log_paths)
    ]
