"""Keyed tables of a store that change: versioned changes as Parquet, the latest of each key counts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.sources.publish import filesystem, publish

STATE = "_state"
#: Files of changes from which on a reader's table is merged before the next change.
MERGE_FILES = 64


class StateTable:
    """A table ``name`` of the store at ``root``, a row a key at most.

    A change is a set of rows with a version: upserts, or deletes by key. Changes are appended, each published whole
    (``publish``), so writers don't wait for each other; of a key the row of the largest version counts, by a grouped
    maximum in Spark. ``vacuum`` merges what has gathered. Columns named ``_version`` and ``_deleted`` are the table's own.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, keys: tuple[str, ...], schema: str):
        self.spark, self.root, self.keys = spark, root, keys
        self.columns = T._parse_datatype_string(schema)
        self.stored = T.StructType([*self.columns, T.StructField("_version", T.StringType()), T.StructField("_deleted", T.BooleanType())])
        self.folder = f"{STATE}/{name}"

    def change(self, rows: DataFrame, deleted: bool = False) -> DataFrame:
        """``rows`` as a change that comes after all earlier ones; of deletes the key columns are enough."""
        there = set(rows.columns)
        columns = [(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.columns]
        return rows.select(*columns, F.lit(f"{time.time_ns():020d}").alias("_version"), F.lit(deleted).alias("_deleted"))

    def upsert(self, rows: DataFrame) -> None:
        """Put rows in, over earlier ones of their keys. Of rows with one key in ``rows`` any one counts."""
        publish(self.spark, self.root, {self.folder: self.change(rows)})

    def delete(self, keys: DataFrame) -> None:
        publish(self.spark, self.root, {self.folder: self.change(keys, deleted=True)})

    def files(self) -> list[str]:
        fs, make = filesystem(self.spark, self.root)
        return [s.getPath().toString() for s in fs.globStatus(make(f"{self.root}/{self.folder}/*.parquet")) or []]

    def _latest(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.stored)
        changes = self.spark.read.schema(self.stored).parquet(*files)
        rest = [c for c in self.stored.names if c not in self.keys]
        last = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_version").alias("_last")).where("not _last._deleted")
        return last.select(*[F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in self.stored.names])

    def current(self) -> DataFrame:
        """The rows that count now."""
        return self._latest(self.files()).select(*self.columns.names)

    def vacuum(self, least: int = 2) -> bool:
        """Merge the changes to one set of files, if there are ``least`` files of them. A reader meanwhile sees the changes,
        the merged rows or both, which come to the same."""
        files = self.files()
        if len(files) < least:
            return False
        publish(self.spark, self.root, {self.folder: self._latest(files)}, removed=files)
        return True
