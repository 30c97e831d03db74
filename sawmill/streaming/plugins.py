"""Stateful parsers of users: code that takes a source's lines in order and may hold some back until more come."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.schema import ENTRY, UNKNOWN_LEVEL
from sawmill.sources.state import StateTable
from sawmill.sources.store import LANDING, REJECTS, write_zones


@dataclass
class Entry:
    """What a parser makes of lines; fields are text, whole or real numbers, or booleans by name."""

    message: str
    timestamp: datetime = datetime(1, 1, 1, tzinfo=timezone.utc)
    level: str = UNKNOWN_LEVEL
    fields: dict[str, str | int | float | bool] = field(default_factory=dict)


@dataclass
class Failure:
    error: str
    text: str


class LogParser:
    """A parser of one source. It is made anew for each task; what ``state`` gives is what it goes on from in the next
    batch, so that is all it may remember."""

    def __init__(self, source: str):
        self.source = source

    def parse(self, lines: Iterable[str]) -> Iterator[Entry | Failure]:
        """Results that are complete after these lines, which follow those of earlier calls."""
        raise NotImplementedError

    def flush(self) -> Iterator[Entry | Failure]:
        """What is left at the end of the source."""
        return iter(())

    def state(self) -> str:
        return ""

    def restore(self, state: str) -> None:
        """Go on from ``state``."""


#: Classes of parsers by plugin type: callables of a source that give a parser.
FACTORIES: dict[str, Callable[[str], LogParser]] = {}
RESULT = "kind int, source string, micros long, level string, message string, fields array<struct<Key string, StringValue string, LongValue bigint, DoubleValue double, BoolValue boolean>>, text string"
#: Lines that a parser gets at a time.
AT_ONCE = 4096
#: Columns of ``RESULT`` in Arrow.
SCHEMA = pa.schema([
    ("kind", pa.int32()), ("source", pa.string()), ("micros", pa.int64()), ("level", pa.string()), ("message", pa.string()),
    ("fields", pa.list_(pa.struct([("Key", pa.string()), ("StringValue", pa.string()), ("LongValue", pa.int64()), ("DoubleValue", pa.float64()), ("BoolValue", pa.bool_())]))),
    ("text", pa.string()),
])
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def register_plugin(kind: str, factory: Callable[[str], LogParser]) -> None:
    """Plugins of type ``kind`` are parsed by ``factory``, in batches and streams."""
    FACTORIES[kind] = factory


def _row(source: str, result: Entry | Failure) -> dict:
    if isinstance(result, Failure):
        return {"kind": 1, "source": source, "level": result.error, "text": result.text}
    slots = []
    for key, value in result.fields.items():
        slot = "BoolValue" if isinstance(value, bool) else "LongValue" if isinstance(value, int) else "DoubleValue" if isinstance(value, float) else "StringValue"
        slots.append({"Key": key, slot: value})
    stamp = result.timestamp if result.timestamp.tzinfo else result.timestamp.replace(tzinfo=timezone.utc)
    gap = stamp - EPOCH
    return {"kind": 0, "source": source, "micros": (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds, "level": result.level, "message": result.message, "fields": slots}


def results(lines: DataFrame, factory: Callable[[str], LogParser], states: DataFrame | None = None, last: bool = True) -> DataFrame:
    """What parsers make of ``lines`` (source, block, pos, value): rows of kind 0 for entries, 1 for failures, and unless this
    is the ``last`` of a source's lines, 2 for what its parser remembers.

    A source's lines come to one task in order, as an iterator: a parser needs them so, but no more than AT_ONCE are held.
    ``states`` (source, state) are what parsers go on from.
    """
    rows = lines.select("source", F.lit(1).alias("order"), "block", "pos", "value")
    if states is not None:
        held = states if last else states.join(lines.select("source").distinct(), "source", "left_semi")
        rows = rows.unionByName(held.select("source", F.lit(0).alias("order"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pos"), F.col("state").alias("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: LogParser | None = None
        out: list[dict] = []

        def closed() -> None:
            if parser is None:
                return
            if last:
                out.extend(_row(parser.source, r) for r in parser.flush())
            else:
                out.append({"kind": 2, "source": parser.source, "text": parser.state()})

        for batch in batches:
            sources, orders, values = (batch.column(c).to_pylist() for c in ("source", "order", "value"))
            at = 0
            while at < len(sources):
                if parser is None or sources[at] != parser.source:
                    closed()
                    parser = factory(sources[at])
                    parser.source = sources[at]
                if orders[at] == 0:
                    parser.restore(values[at])
                    at += 1
                    continue
                end = at
                while end < len(sources) and sources[end] == parser.source and end - at < AT_ONCE:
                    end += 1
                out.extend(_row(parser.source, r) for r in parser.parse(values[at:end]))
                at = end
            if len(out) > AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)
                out.clear()
        closed()
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    dealt = rows.where("source is not null").repartition("source").sortWithinPartitions("source", "order", "block", "pos")
    return dealt.mapInArrow(run, RESULT)


def split(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, rejects, states) of ``results``."""
    entries = found.where("kind = 0").select(
        F.timestamp_micros("micros").alias("Timestamp"), F.coalesce("level", F.lit(UNKNOWN_LEVEL)).alias("Level"), F.col("message").alias("Message"),
        F.col("source").alias("Source"), F.lit(0).cast("long").alias("TemplateHash"), F.col("fields").cast(ENTRY["Fields"].dataType.simpleString()).alias("Fields"),
    )
    rejects = found.where("kind = 1").select(F.col("source").alias("Source"), F.col("level").alias("Error"), F.col("text").alias("Text"))
    return entries, rejects, found.where("kind = 2").select("source", F.col("text").alias("state"))


def parse_whole(lines: DataFrame, factory: Callable[[str], LogParser]) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of sources that end with these lines."""
    return split(results(lines, factory))[:2]


def state_table(spark: SparkSession, root: str) -> StateTable:
    """What the parsers of streams remember: (stream, source, state)."""
    return StateTable(spark, root, "parsers", ("stream", "source"), "stream string, source string, state string")


def parse_batch(lines: DataFrame, factory: Callable[[str], LogParser], root: str, stream: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], DataFrame]:
    """(entries, rejects, the change of the parsers' states to publish with them, the kept results) of a stream's micro-batch."""
    table = state_table(lines.sparkSession, root)
    states = table.current().where(F.col("stream") == stream).select("source", "state")
    found = results(lines, factory, states, last=False).persist(StorageLevel.DISK_ONLY)  # read thrice; lost blocks are made again
    entries, rejects, after = split(found)
    return entries, rejects, {table.folder: table.change(after.withColumn("stream", F.lit(stream))).coalesce(1)}, found


def flush(spark: SparkSession, root: str, factory: Callable[[str], LogParser], stream: str) -> None:
    """Publish what the parsers of an ended stream still hold, and forget it, in one step."""
    table = state_table(spark, root)
    states = table.current().where(F.col("stream") == stream)
    none = spark.createDataFrame([], "source string, block long, pos long, value string")
    found = results(none, factory, states.select("source", "state")).persist(StorageLevel.DISK_ONLY)
    entries, rejects, _ = split(found)
    write_zones({LANDING: entries, REJECTS: rejects}, root, states={table.folder: table.change(states, deleted=True).coalesce(1)})
    found.unpersist()
