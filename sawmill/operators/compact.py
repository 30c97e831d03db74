"""Compaction: a day's small landing files to few large ones, sorted by time."""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sawmill.functions import fields as ff
from sawmill.schema import ENTRY
from sawmill.sources.publish import filesystem, settle, write_text
from sawmill.sources.state import MERGE_FILES
from sawmill.sources.store import LANDING, MANIFESTS, MARKER, OPTIMIZED, file_table, index_replaced, manifests, note_promotions

TARGET_BYTES = 128 << 20
#: Days that are compacted at a time.
DAYS_AT_ONCE = 8


@dataclass(frozen=True)
class Candidate:
    day: str  # year=2025/month=08/day=18
    bytes: int
    files: tuple[str, ...]


def candidates(spark: SparkSession, root: str, older_than_s: float = 3600.0) -> list[Candidate]:
    """Days with landing files, all of them older than the threshold. A day that was compacted before and
    got late files is one again: the marker only tells that a compaction ended."""
    fs, make = filesystem(spark, root)
    days: dict[str, list] = {}
    for status in fs.globStatus(make(f"{root}/{LANDING}/year=*/month=*/day=*/*.parquet")) or []:
        path = status.getPath().toString()
        days.setdefault("/".join(path.split("/")[-4:-1]), []).append((path, status.getLen(), status.getModificationTime() / 1000))
    limit = time.time() - older_than_s
    return [Candidate(day, sum(f[1] for f in files), tuple(f[0] for f in files)) for day, files in sorted(days.items()) if all(f[2] <= limit for f in files)]


def compact_day(spark: SparkSession, root: str, what: Candidate, promote: dict[str, str] | None = None, target_bytes: int = TARGET_BYTES) -> None:
    """Rewrite one day: to a staging folder, then by renames to the optimized zone, then the landing files go."""
    note_promotions(spark, root, promote or {})
    _finish(spark, root, [_rewritten(spark, root, what, promote, target_bytes)])


def _rewritten(spark: SparkSession, root: str, what: Candidate, promote: dict[str, str] | None, target_bytes: int) -> tuple[str, list[str], list[str]]:
    """(manifest, landing files that gave way, new files) of a day, all published.

    The staged files are complete before anything is published, and a manifest names the old and the
    new files until the old ones are gone, so readers see every entry once and ``recover`` can end or
    undo an interrupted run. ``promote`` writes fields as columns of their own, by name and type,
    whose predicates then reach the scan.
    """
    fs, make = filesystem(spark, root)
    run = uuid.uuid4().hex
    staging, day = f"{root}/_staging/{run}", f"{root}/{OPTIMIZED}/{what.day}"
    entries = spark.read.schema(ENTRY).parquet(*what.files)
    for name, kind in (promote or {}).items():
        entries = entries.withColumn(name, ff.value(name, kind))
    parts = max(1, math.ceil(what.bytes / target_bytes))
    if parts > 1:
        entries = entries.repartitionByRange(parts, "Timestamp")
    else:
        entries = entries.coalesce(1)
    entries.sortWithinPartitions("Timestamp").write.parquet(staging)
    staged = [s.getPath() for s in fs.globStatus(make(f"{staging}/*.parquet"))]
    replaced = ["/".join(f.split("/")[-5:]) for f in what.files]
    manifest = {"replaced": replaced, "new": [f"{OPTIMIZED}/{what.day}/{p.getName()}" for p in staged]}
    write_text(spark, f"{root}/{MANIFESTS}/{run}.json", json.dumps(manifest))
    fs.mkdirs(make(day))
    for path in staged:
        if not fs.rename(path, make(f"{day}/{path.getName()}")):
            raise OSError(f"could not publish {path}")
    fs.delete(make(staging), True)
    return f"{root}/{MANIFESTS}/{run}.json", replaced, manifest["new"]


def _finish(spark: SparkSession, root: str, days: list[tuple[str, list[str], list[str]]]) -> None:
    """The index changes for all days at once, then the replaced files go."""
    if not days:
        return
    index_replaced(spark, root, [f for _, replaced, _ in days for f in replaced], [f for _, _, new in days for f in new])
    fs, make = filesystem(spark, root)
    for manifest, replaced, new in days:
        for path in replaced:
            fs.delete(make(f"{root}/{path}"), False)
        fs.create(make(f"{root}/{new[0].rsplit('/', 1)[0]}/{MARKER}"), True).close()
        fs.delete(make(manifest), False)


def recover(spark: SparkSession, root: str) -> None:
    """End interrupted compactions whose new files are all there; undo the others. Run while none is under way."""
    fs, make = filesystem(spark, root)
    for path, replaced, new in manifests(spark, root):
        if all(fs.exists(make(f"{root}/{f}")) for f in new):
            _finish(spark, root, [(path, replaced, new)])
        else:
            for f in new:
                fs.delete(make(f"{root}/{f}"), False)
            fs.delete(make(path), False)
    settle(spark, root)


def compact(spark: SparkSession, root: str, older_than_s: float = 3600.0, promote: dict[str, str] | None = None, target_bytes: int = TARGET_BYTES) -> list[str]:
    """Compact every candidate; the days done. Several days run at once, each a job of its own."""
    days = candidates(spark, root, older_than_s)
    if days:
        note_promotions(spark, root, promote or {})
    with ThreadPoolExecutor(DAYS_AT_ONCE) as pool:
        done = list(pool.map(lambda what: _rewritten(spark, root, what, promote, target_bytes), days))
    _finish(spark, root, done)
    file_table(spark, root).vacuum(MERGE_FILES)
    return [what.day for what in days]
