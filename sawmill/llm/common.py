"""What the training-data operators share: the shared folder, cut lineage, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent in a local session, as in tests, a temporary folder is used; a cluster must set it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-sawmill-")
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, so a lost executor costs a read only."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch where rows hold whole texts.
BATCH_ROWS = 1000


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``, its session giving Python at most ``rows`` rows at once: a batch of 10,000 texts, copied on
    either side, would be a large part of an executor's memory. The setting stays, as frames run later."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def lean() -> None:
    """Memory that this process frees goes back to the system: one arena of small blocks, and Arrow's from the same."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        for option, value in ((-8, 1), (-3, 32 << 20), (-1, 64 << 20)):  # arenas, own mappings from, trim from
            ctypes.CDLL(None).mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        pass


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and then the task's unused memory back to the system: Python workers live on, and an
    executor holds several of them."""
    lean()
    yield from batches
    give_back()


def give_back() -> None:
    """This process's unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields`` at its end; earlier columns of those names (in any case) give way."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema if f.name.lower() not in new] + list(fields))


def put_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``columns`` at its end, in the order of ``with_fields``."""
    new = {name.lower() for name in columns}
    kept = [name for name in batch.schema.names if name.lower() not in new]
    return pa.RecordBatch.from_arrays(
        [batch.column(name) for name in kept] + list(columns.values()), names=kept + list(columns)
    )


def complete_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys`` (no nulls); a group cut by a batch's end waits for the rest."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        cols = [now.column(k).to_numpy() for k in keys]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        last = tuple(c[-1] for c in cols)
        differs = np.zeros(len(cols[0]), bool)
        for c, v in zip(cols, last):
            differs |= c != v
        other = np.flatnonzero(differs)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append(now.slice(0, cut))
            yield pa.concat_tables(held).combine_chunks()
            held = []
        held.append(now.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys in sorted arrays: starts, then the length."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+counts[0]-1, starts[1] .. and so on, as one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of ``n`` nodes' component under links a-b."""
    root = np.arange(n, dtype=np.int64)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


#: Hot buckets whose table (a row each) is broadcast, at most.
FEW_HOT = 200_000


def split_pairs(df: DataFrame, keys: list[str], id_col: str, block: int, rows: int) -> DataFrame:
    """Deal a bucket of over ``block`` rows out to pairs of blocks, so that no task gets a bucket whole.

    Adds part_i <= part_j and blk: a row of block b goes to every pair with b in it; two rows of a
    bucket meet in just one pair (rows of one block in the pair b, b). Of at most ``rows`` rows no more than
    ``rows`` / ``block`` buckets can be hot; so few that their table is broadcast, ``df`` isn't shuffled for them.
    """
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > block)
        .select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_nb"))
    )
    out = df.join(F.broadcast(hot) if rows // block <= FEW_HOT else hot, keys, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    out = out.withColumn("blk", F.pmod(F.xxhash64(F.lit(7), id_col), F.col("_nb")).cast("int"))
    other = F.explode(F.when(F.col("_nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return (
        out.withColumn("_o", other)
        .withColumn("part_i", F.least("blk", "_o"))
        .withColumn("part_j", F.greatest("blk", "_o"))
        .drop("_nb", "_o")
    )
