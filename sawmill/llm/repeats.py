"""Which windows of documents occur twice: what exact substring dedup by bytes and by words shares.

A window is ``size`` consecutive items (bytes or words) of one document. Each operator gives every
window a *key* that depends on the window's content alone, so equal windows have equal keys.
Neighbouring windows of one key make a *segment*. Segments travel to the segments of the same key,
and only keys that occur twice go on:

* A segment whose whole content occurs twice repeats in all its windows.
* Of the other segments (at the edges of repeats) each operator compares the windows.

Keys and segments that a bounded sample of documents already shows many times are known to repeat;
they need not meet, so their rows are spread instead of filling one task. The sample changes where rows
go, not what is found. Which keys have too many pieces to compare in one task is counted over all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import FEW_HOT, materialize, ranges, released, small_batches

#: Windows of a segment, at most; also what is left for the count in a packed place.
LONGEST, SHIFT = 256, 10
#: Documents of the sample for known repeats, about; how often it must show one; how many are sent to the tasks.
SAMPLE_DOCS, OFTEN, MOST_KNOWN = 3000, 8, 100_000
#: Segments of a key that one task may take together, about (a few MB of text).
GROUP_ROWS = 10_000
#: Bytes of a piece of a long text, about.
LONG = 1 << 20
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, list[np.ndarray]] = {}

#: (row key of a document, packed start and count of windows, key, hash of the segment's content).
PLACED = "rk long, at long, key long, seg long"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Polynomial hashes (modulo 2^64) of ranges of a sequence of well-mixed 64-bit items."""

    def __init__(self, items: np.ndarray, base: int = BASE):
        n = len(items) + 1
        if base not in _POWERS or len(_POWERS[base][0]) < n:
            size = max(n, 1 << 16)
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
            _POWERS[base] = made
        self.power, inverse = _POWERS[base]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(items * inverse[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.power[start]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width and len(values) > size:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    if rest and len(values) > rest:
        values = np.minimum(values[:-rest], values[rest:])
    return values


#: Low bits of a value that hold its place; a batch has fewer items.
PLACE = 31


def placed(values: np.ndarray) -> np.ndarray:
    """Values whose low bits give way to their place: the least of some is the leftmost of the least ones, and says where it is."""
    if len(values) >> PLACE:
        raise ValueError("a text of over 2^31 items")
    return values >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(values), dtype=np.uint64)


def place_of(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def segments(keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of the runs of equal ``keys`` among valid windows, runs cut after LONGEST windows.

    ``keys`` tell occurrences apart, so a segment never holds one window's content twice: the two
    would have their least value at two places.
    """
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (keys[at[1:]] != keys[at[:-1]])
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(at)))
    pieces = -(-lengths // LONGEST)
    offset = ranges(np.zeros(len(first), np.int64), pieces) * LONGEST
    return at[np.repeat(first, pieces) + offset], np.minimum(LONGEST, np.repeat(lengths, pieces) - offset)


def keyed(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, text): ``rk`` tells rows apart by doc_id and text (rows alike in both have equal results)."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")


def texts(batch: pa.RecordBatch) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column("text").cast(pa.binary())]


def repeated_segments(
    docs: DataFrame, place: Callable[[list[bytes]], tuple[np.ndarray, ...]], cut: Callable[[bytes], Iterable[tuple[int, bytes]]], chunk_bytes: int = 1 << 19
) -> DataFrame:
    """(rk, at, key, seg, whole) of the segments whose key occurs twice; ``whole``: the whole segment does.

    ``cut`` gives a text's pieces as (items before it, piece), each window in just one of them, so that a
    very long text needs no more memory than others. ``place`` gets pieces and returns (index of the
    piece, start, count, key, seg) of their segments.
    """
    spark = small_batches(docs).sparkSession

    def chunks(rows: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
        """(rk, items before, piece) of the rows' pieces, by about ``chunk_bytes``."""
        held, size = [], 0
        for rk, text in rows:
            for before, piece in cut(text):
                held.append((rk, before, piece))
                size += len(piece)
                if size >= chunk_bytes:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(batch.column("rk").to_pylist(), texts(batch))):
                rks, before = (np.array(c, np.int64) for c in list(zip(*part))[:2])
                doc, start, count, key, seg = place([piece for _, _, piece in part])
                if not len(doc):
                    continue
                key, seg = key.view(np.int64), seg.view(np.int64)
                columns = [rks[doc], (start + before[doc]) << SHIFT | count, key, seg]
                if known is not None:
                    sure = np.where(np.isin(seg, known[1]), 2, np.where(np.isin(key, known[0]), 1, 0))
                    columns += [np.where(sure == 2, columns[0], np.where(sure == 1, seg, key)), sure.astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rk", "at", "key", "seg", "deal", "sure"][: len(columns)])

    every = max(1, docs.count() // SAMPLE_DOCS)
    sampled = docs.where(F.pmod(F.col("rk"), F.lit(every)) == 0).mapInArrow(lambda b: run(b, None), PLACED)
    counts = sampled.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"))

    def often(column: str) -> np.ndarray:
        """Values of the column that the sample shows often, sorted."""
        rows = counts.groupBy(column).agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), column).limit(MOST_KNOWN)
        return np.sort(np.array([r[0] for r in rows.collect()], np.int64))

    known = spark.sparkContext.broadcast((often("key"), often("seg")))
    rows = docs.mapInArrow(lambda b: released(run(b, known.value)), PLACED + ", deal long, sure tinyint")
    dealt = rows.repartition("deal").drop("deal").sortWithinPartitions("key", "seg")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal neighbours in sorted rows; the last row of a batch waits for the next one."""
        held, seen = None, (False, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, seg = now.column("key").to_numpy(), now.column("seg").to_numpy()
            same_key = key[1:] == key[:-1]
            same = np.stack([same_key, same_key & (seg[1:] == seg[:-1])], axis=1)
            before = np.concatenate([[seen], same])
            yield from emit(now.slice(0, len(key) - 1), before[:-1] | same)
            held, seen = now.slice(len(key) - 1), tuple(before[-1])
        if held is not None:
            yield from emit(held, np.array([seen]))

    def emit(rows: pa.Table, same: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            sure = rows.column("sure").to_numpy()
            keep = pa.array(same[:, 0] | (sure > 0))
            out = rows.drop_columns(["sure"]).append_column("whole", pa.array(same[:, 1] | (sure == 2))).filter(keep)
            yield from out.combine_chunks().to_batches()

    return materialize(dealt.mapInArrow(lambda b: released(meet(b)), PLACED + ", whole boolean"), "segments")


def wanted_pieces(found: DataFrame) -> DataFrame:
    """(rk, wanted: array of (at, key, hot, weight)): what windows must be compared, by document.

    Segments that aren't whole repeats, with weight 1, and for keys that have such a segment one
    representative of each whole repeat with weight 2: its windows repeat already, and others may equal
    them. ``hot``: the key has over GROUP_ROWS of these, counted over all, more than one task should hold;
    so few keys that their table is broadcast, the pieces aren't shuffled by key for them.
    """
    edges = found.where("not whole").select("rk", "at", "key", F.lit(1).alias("weight"))
    whole = found.where("whole").groupBy("key", "seg").agg(F.min(F.struct("rk", "at")).alias("one"))
    whole = whole.join(edges.select("key").distinct(), "key", "left_semi")
    pieces = edges.union(whole.select("one.rk", "one.at", "key", F.lit(2).alias("weight")))
    hot = pieces.groupBy("key").count().where(F.col("count") > GROUP_ROWS).select("key", F.lit(True).alias("hot"))
    few = found.count() // GROUP_ROWS <= FEW_HOT  # each piece is a row of ``found``, so more keys can't be hot
    pieces = pieces.join(F.broadcast(hot) if few else hot, "key", "left").select("rk", F.struct("at", "key", F.coalesce("hot", F.lit(False)).alias("hot"), "weight").alias("p"))
    return pieces.groupBy("rk").agg(F.collect_set("p").alias("wanted"))  # a text's own segments; rows alike have the same


def rows_once(batch: pa.RecordBatch, last: list[int]) -> pa.RecordBatch:
    """``batch`` without rows whose ``rk`` came before in it or was the last one: rows alike need not be compared again."""
    rks = batch.column("rk").to_numpy()
    first = np.sort(np.unique(rks, return_index=True)[1])
    first = first[rks[first] != last[0]] if last else first
    if len(rks):
        last[:] = [int(rks[-1])]
    return batch if len(first) == len(rks) else batch.take(pa.array(first))


WINDOWS = "h1 long, h2 long, weight tinyint, rk long, at long"


def hashed_windows(items: np.ndarray, wanted: list[dict], size: int, rk: int) -> tuple[np.ndarray, ...]:
    """Rows of WINDOWS for the windows of a document's wanted segments: two hashes of different base and items."""
    at = np.array([w["at"] for w in wanted], np.int64)
    count = at & ((1 << SHIFT) - 1)
    start = ranges(at >> SHIFT, count)
    weight = np.repeat(np.array([w["weight"] for w in wanted], np.int8), count)
    h1, h2 = Ranges(items).of(start, size), Ranges(mix(items), OTHER_BASE).of(start, size)
    return h1.view(np.int64), h2.view(np.int64), weight, np.full(len(start), rk, np.int64), start << SHIFT | 1


def cover(spans: list[int] | np.ndarray, size: int, n: int) -> np.ndarray:
    """A flag for each of ``n`` items: covered by a window of the packed (start, count) runs of windows."""
    marks = np.zeros(n + 1, np.int64)
    at = np.asarray(spans, np.int64)
    np.add.at(marks, at >> SHIFT, 1)
    np.add.at(marks, np.minimum((at >> SHIFT) + (at & ((1 << SHIFT) - 1)) - 1 + size, n), -1)
    return np.cumsum(marks[:-1]) > 0


def counted_windows(windows: DataFrame) -> DataFrame:
    """(rk, at) of the windows of weight 1 whose two hashes have a total weight of at least 2."""
    repeated = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n >= 2").select("h1", "h2")
    return windows.where("weight = 1").join(repeated, ["h1", "h2"], "left_semi").select("rk", "at")


def with_spans(docs: DataFrame, *spans: DataFrame) -> DataFrame:
    """``docs`` with ``spans``, the packed runs of repeated windows of each row (null: none)."""
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    return docs.join(every.groupBy("rk").agg(F.collect_set("at").alias("spans")), "rk", "left")
