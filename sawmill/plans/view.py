"""The logical table ``logs``: base columns, and every registered field as a typed column."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.config import BASE_COLUMNS, Settings
from sawmill.functions import fields as ff
from sawmill.schema import ENTRY
from sawmill.sources.publish import create_text, filesystem, read_text


class Registry:
    """Field names and their canonical types. The first type registered stays; types never change."""

    def __init__(self, types: dict[str, str] | None = None):
        self.types: dict[str, str] = {}
        for name, kind in (types or {}).items():
            self.register(name, kind)

    def register(self, name: str, kind: str) -> bool:
        """False if the field has another type already."""
        if name.lower() in {c.lower() for c in BASE_COLUMNS}:
            raise ValueError(f"field {name!r} is named like a column of every entry")
        return self.types.setdefault(name, kind) == kind

    @classmethod
    def of(cls, settings: Settings) -> tuple[Registry, list[str]]:
        """The registry of all plugins' rules, and the fields whose later types gave way."""
        out = cls()
        conflicts = [r.field_name for p in settings.plugins for r in p.parser.fields_regexes if not out.register(r.field_name, r.type)]
        return out, conflicts

    def merge(self, types: dict[str, str]) -> list[str]:
        """Register what is new; the fields whose type is another than the registered one."""
        return [name for name, kind in types.items() if not self.register(name, kind)]

    def save(self, spark: SparkSession, path: str) -> list[str]:
        """Put these fields into the registry stored at ``path``, whose types stay, and take over all of it; the fields
        whose types gave way.

        Read, merge and write end only if no one else has written meanwhile: versions are numbered files, and of two
        writers of one number the later begins anew.
        """
        fs, make = filesystem(spark, path)
        own = self.types
        while True:
            last, stored = _stored_types(spark, path)
            self.types = dict(stored)
            conflicts = self.merge(own)
            if self.types == stored:
                return conflicts
            fs.mkdirs(make(path))
            if create_text(spark, f"{path}/{last + 1:010d}.json", json.dumps(self.types)):
                return conflicts

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        """The registry stored at ``path``; none there: no fields."""
        return cls(_stored_types(spark, path)[1])

    def __repr__(self) -> str:
        return json.dumps(self.types)


def _stored_types(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(number of the last version, its types); 0 if there is none. Parquet files of a registry of old are read too."""
    fs, make = filesystem(spark, path)
    versions = sorted(s.getPath().toString() for s in fs.globStatus(make(f"{path}/[0-9]*.json")) or [])
    if versions:
        return int(versions[-1].rsplit("/", 1)[1].removesuffix(".json")), json.loads(read_text(spark, versions[-1]))
    if fs.globStatus(make(f"{path}/*.parquet")):
        return 0, {r.FieldName: r.FieldType for r in spark.read.parquet(path).collect()}  # a row a field name
    return 0, {}


def logs_view(entries: DataFrame, registry: Registry, promoted: tuple[str, ...] = ()) -> DataFrame:
    """``entries`` with a column for each registered field, and ``<field>__raw`` with its text in any slot.

    Fields in ``promoted`` are columns of all of ``entries`` already; predicates on them reach the scan.
    Other fields that ``entries`` has a column for may lack it in some files, where Fields has them. The
    rest are higher-order functions over Fields, not read unless used.
    """
    there = {c.lower(): c for c in entries.columns}
    own = {there[n.lower()] for n in registry.types if n.lower() in there}
    columns = []
    for name, kind in registry.types.items():
        value = ff.value(name, kind)
        if name.lower() in there:
            column = F.col(there[name.lower()])
            value = column if name in promoted else F.coalesce(column, value)
        columns += [value.alias(name), ff.raw(name).alias(f"{name}__raw")]
    return entries.select(*[c for c in entries.columns if c not in own], *columns)


def open_logs(spark: SparkSession, root: str, registry: Registry) -> DataFrame:
    """The view over both zones of a store, also registered as ``logs``. The store knows which fields are columns."""
    from sawmill.sources.store import DAY, promotions, read_entries, read_zones

    every = promotions(spark, root)[1]
    full = tuple(n for n, kind in registry.types.items() if every.get(n) == kind)
    base = [*ENTRY.names, *DAY]
    zones = []
    for zone in read_zones(spark, root):
        known = [c for c in zone.columns if c in base or registry.types.get(c)]
        zones.append(logs_view(zone.select(*known), registry, full))
    out = zones[0] if zones else logs_view(read_entries(spark, root), registry)
    for more in zones[1:]:
        out = out.unionByName(more)
    out.createOrReplaceTempView("logs")
    return out


def between(logs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Entries from ``start`` (inclusive) to ``end`` (exclusive), with the day folders that can hold them
    named too: the planner doesn't derive partition predicates from timestamps."""
    start, end = (t if t.tzinfo else t.replace(tzinfo=timezone.utc) for t in (start, end))
    out = logs.where((F.col("Timestamp") >= F.lit(start)) & (F.col("Timestamp") < F.lit(end)))
    if {"year", "month", "day"} <= set(logs.columns):
        day = F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
        first, last = (int(t.astimezone(timezone.utc).strftime("%Y%m%d")) for t in (start, end))
        out = out.where((day >= first) & (day <= last))
    return out
