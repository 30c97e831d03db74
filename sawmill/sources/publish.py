"""Publication: what one step writes to several folders of a store appears whole, or is ended or undone later."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

STAGING, MOVES = "_staging", "_moves.json"
#: Renames under way at a time.
MOVERS = 16


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path class) for a path in any store that Spark reaches."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, on the driver."""
    fs, make = filesystem(spark, path)
    stream = fs.open(make(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there: written beside, then renamed."""
    fs, make = filesystem(spark, path)
    out = fs.create(make(f"{path}.part"), True)
    out.write(text.encode())
    out.close()
    fs.delete(make(path), False)
    if not fs.rename(make(f"{path}.part"), make(path)):
        raise OSError(f"could not write {path}")


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that no one else has written; False if it is there. Of two writers one succeeds where the file
    system's renames don't replace files, as HDFS's don't."""
    fs, make = filesystem(spark, path)
    mine = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(make(mine), False)
    out.write(text.encode())
    out.close()
    try:
        return not fs.exists(make(path)) and bool(fs.rename(make(mine), make(path)))
    finally:
        fs.delete(make(mine), False)


def staged_files(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files below a folder that was just written."""
    fs, make = filesystem(spark, folder)
    found, out = fs.listFiles(make(folder), True), []
    while found.hasNext():
        path = found.next().getPath().toString()
        if path.endswith(".parquet"):
            out.append(path)
    return out


def publish(spark: SparkSession, root: str, parts: dict[str, DataFrame], name: str | None = None, dated: tuple[str, ...] = (), removed: list[str] = (),
            also: Callable[[dict[str, list[tuple[str, str]]]], dict[str, DataFrame]] | None = None, note: tuple[str, str] | None = None) -> bool:
    """Write frames to folders of the store, all or none, and remove files that they stand for; whether this run wrote them,
    not an earlier one.

    Files are staged, then a list of what goes where is written: from there on the step counts as done, and ``settle``
    ends it if this run doesn't. A folder may be named more than once, with ``#`` and a word after it. ``dated`` columns make
    folders. ``also`` may give further frames that are made from the
    staged files, (staged, published) by folder; ``note`` is a small file, path and text, that says that the step is over. A step of the same ``name`` that was begun before is ended if it was
    staged whole, else done anew. No file of other steps is listed.
    """
    name = name or uuid.uuid4().hex
    staging = f"{root}/{STAGING}/{name}"
    fs, make = filesystem(spark, root)
    if fs.exists(make(f"{staging}/{MOVES}")):
        _end(spark, root, staging)
        return False
    fs.delete(make(staging), True)
    files: dict[str, list[tuple[str, str]]] = {}

    def stage(frames: dict[str, DataFrame]) -> None:
        for target, rows in frames.items():
            folder, place = target.split("#")[0], f"{staging}/{target}"
            days = [d for d in dated if d in rows.columns]
            (rows.write.partitionBy(*days) if days else rows.write).mode("overwrite").parquet(place)
            files[target] = []
            for path in staged_files(spark, place):
                *between, last = path.split(f"/{STAGING}/{name}/{target}/", 1)[1].split("/")
                files[target].append((path, "/".join([root, folder, *between, f"s{name}-{last}"])))

    stage(parts)
    if also is not None:
        stage(also(files))
    write_text(spark, f"{staging}/{MOVES}", json.dumps({"files": files, "removed": list(removed), "note": note}))
    _end(spark, root, staging)
    return True


def _end(spark: SparkSession, root: str, staging: str) -> None:
    fs, make = filesystem(spark, root)
    steps = json.loads(read_text(spark, f"{staging}/{MOVES}"))
    moves = [m for some in steps["files"].values() for m in some]
    for folder in {to.rsplit("/", 1)[0] for _, to in moves}:
        fs.mkdirs(make(folder))

    def move(step: list[str]) -> None:
        source, to = make(step[0]), make(step[1])
        if not fs.rename(source, to) and not fs.exists(to):
            raise OSError(f"could not publish {step[0]}")

    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(move, [m for m in moves if fs.exists(make(m[0]))]))
    lost = [to for _, to in moves if not fs.exists(make(to))]
    if lost:
        raise OSError(f"not published: {lost[:3]}")
    for path in steps["removed"]:
        fs.delete(make(path), False)
    if steps["note"]:
        write_text(spark, *steps["note"])
    fs.delete(make(staging), True)


def settle(spark: SparkSession, root: str, prefix: str = "") -> int:
    """End the steps of earlier runs, named from ``prefix`` on, that were staged whole, and drop the others; how many were
    ended. Run while no such step is under way."""
    fs, make = filesystem(spark, root)
    ended = 0
    for status in fs.globStatus(make(f"{root}/{STAGING}/{prefix}*")) or []:
        staging = status.getPath().toString()
        if fs.exists(make(f"{staging}/{MOVES}")):
            _end(spark, root, staging)
            ended += 1
        else:
            fs.delete(make(staging), True)
    return ended
