"""Suffix-array dedup: long byte strings that occur twice, by interval expansion on a Burrows-Wheeler transform.

Windows of bytes travel with the least hash of their shorter substrings (see ``repeats``). Where whole
segments don't decide, their bytes go by key to shards; there a suffix array sorted to the minimum
length gives the Burrows-Wheeler transform, and intervals are extended backwards level by level:
level l finds the bounds between suffixes that share just l bytes. Bounds not found below the
minimum length lie inside classes of suffixes that share it.

Keys with more pieces than a task should hold, counted over all, are not sent to one shard; their windows
are counted by two 64-bit hashes instead, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm import repeats
from sawmill.llm.common import complete_groups, materialize, put_columns, ranges, released, small_batches, with_fields
from sawmill.llm.repeats import Ranges, mix

SIZE = 200
#: Bytes of the substrings whose least hash keys a window.
GRAM = 48
#: Bytes of a shard's text, about.
SHARD = 1 << 20
#: Parts between pieces; UTF-8 has no such byte.
BREAK = 0xFF

ITEMS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(repeats.BASE))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least, by doubling; settled ones aren't sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    head = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    sa = np.argsort(head)
    ordered = head[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del head, ordered
    rank = np.zeros(n + 1, np.int64)  # 0 beyond the end
    slots, known = np.arange(n), 8
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(slots)))
        rank[sa[slots]] = np.repeat(slots[first], size) + 1
        slots = slots[np.repeat(size > 1, size)]
        if known >= depth or not len(slots):
            return sa
        at = sa[slots]
        key = rank[at] << 32 | rank[np.minimum(at + known, n)]
        order = np.argsort(key)
        sa[slots], key = at[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        known *= 2


def bounds(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the suffix array whether it begins a new class of suffixes sharing ``depth`` bytes.

    Breadth first: the intervals of level l are those of strings of l bytes whose right bound level l
    found. Each extends by the bytes that precede its suffixes; the interval of a longer string comes
    from the first and last of its suffixes by last-to-first mapping, and its right bound, if no
    lower level found it, gets the common prefix l. Strings with BREAK are not extended to.
    """
    n = len(text)
    before = text[sa - 1]  # place 0 is preceded by the last byte, a BREAK
    order = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[order] = np.arange(n)
    same = before[order[1:]] == before[order[:-1]]
    previous, following = np.full(n, -1), np.full(n, n)
    previous[order[1:][same]], following[order[:-1][same]] = order[:-1][same], order[1:][same]
    inside = before != BREAK
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(low):
            break
        size = high - low
        place = ranges(low, size)
        first = place[inside[place] & (previous[place] < np.repeat(low, size))]
        last = place[inside[place] & (following[place] >= np.repeat(high, size))]
        low, high = np.sort(to[first]), np.sort(to[last]) + 1
        new = ~found[high]
        low, high = low[new], high[new]
        found[high] = True
    return found[:n]


def repeated_in_shard(pieces: list[bytes], count: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows of the pieces' first ``count`` that have a total weight of at least 2."""
    text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    own = np.zeros(len(text), np.int64)
    place = ranges(starts, count)
    own[place] = np.repeat(weight, count)
    piece = np.repeat(np.arange(len(pieces)), count)
    of = np.full(len(text), -1)
    of[place] = np.arange(len(place))
    sa = suffix_array(text, size)
    classes = np.flatnonzero(bounds(text, sa, size))
    total = np.add.reduceat(own[sa], classes)
    repeated = np.repeat(total >= 2, np.diff(np.append(classes, len(sa))))
    hit = of[sa[repeated]]
    hit = np.sort(hit[hit >= 0])
    return piece[hit], place[hit] - starts[piece[hit]]


def _cut(text: bytes, size: int, long: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(1, len(text) - size + 1), long):
        yield at, text[at : at + long + size - 1]


def _place(data: list[bytes], size: int, gram: int) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(t) for t in data], np.int64)
    starts = np.cumsum(lengths) - lengths
    n = int(lengths.sum())
    if n < size:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = Ranges(ITEMS[np.frombuffer(b"".join(data), np.uint8)])
    grams = mix(hashes.of(np.arange(n - gram + 1), gram))
    least = repeats.window_min(repeats.placed(grams), size - gram + 1)
    valid = np.zeros(len(least), bool)
    valid[ranges(starts, np.maximum(lengths - size + 1, 0))] = True
    at, count = repeats.segments(least, valid)
    doc = np.searchsorted(starts, at, "right") - 1
    seg = mix(hashes.of(at, count + size - 1) + count.astype(np.uint64))
    return doc, at - starts[doc], count, grams[repeats.place_of(least[at])], seg


def repeated_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard: int = SHARD, long: int = repeats.LONG) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``: packed runs of the windows of ``size`` bytes that start elsewhere too."""
    docs = repeats.keyed(docs)
    found = repeats.repeated_segments(docs, lambda data: _place(data, size, min(gram, size)), lambda text: _cut(text, size, long))
    compare = docs.join(repeats.wanted_pieces(found), "rk")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
        names = ["key", "rk", "at", "weight", "piece", "h1", "h2"]
        last: list[int] = []
        for batch in batches:
            batch, rows, windows = repeats.rows_once(batch, last), [], []
            for rk, text, wanted in zip(batch.column("rk").to_pylist(), repeats.texts(batch), batch.column("wanted").to_pylist()):
                if hot := [w for w in wanted if w["hot"]]:
                    windows.append(repeats.hashed_windows(ITEMS[np.frombuffer(text, np.uint8)], hot, size, rk))
                for w in wanted:
                    if not w["hot"]:
                        start, count = w["at"] >> repeats.SHIFT, w["at"] & ((1 << repeats.SHIFT) - 1)
                        rows.append((w["key"], rk, w["at"], w["weight"], text[start : start + count + size - 1]))
            if rows:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + [none, none], names=names)
            if windows:
                h1, h2, weight, rk, at = (pa.array(np.concatenate(c)) for c in zip(*windows))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), rk, at, weight, pa.nulls(len(at), pa.binary()), h1, h2], names=names)

    pieces = materialize(compare.mapInArrow(lambda b: released(cut(b)), "key long, rk long, at long, weight tinyint, piece binary, h1 long, h2 long"), "pieces")
    dealt = pieces.where("piece is not null").select("key", "rk", "at", "weight", "piece").repartition("key").sortWithinPartitions("key")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for groups in complete_groups(batches, ["key"]):
            held.append(groups)
            waiting += groups.column("piece").nbytes
            if waiting >= shard:
                yield from shards(pa.concat_tables(held))
                held, waiting = [], 0
        if held:
            yield from shards(pa.concat_tables(held))

    def shards(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Suffixes of up to about ``shard`` bytes at once; keys stay whole."""
        key, size_of = rows.column("key").to_numpy(), np.array([len(p.as_buffer()) for p in rows.column("piece")])
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        begin, total = 0, np.cumsum(size_of)
        while begin < len(key):
            limit = shard + (total[begin - 1] if begin else 0)
            fit = ends[(ends > begin) & (total[ends - 1] <= limit)]
            end = int(fit[-1]) if len(fit) else int(ends[ends > begin][0])
            part = rows.slice(begin, end - begin)
            begin = end
            at, rk, weight = (part.column(c).to_numpy() for c in ("at", "rk", "weight"))
            count = at & ((1 << repeats.SHIFT) - 1)
            piece, window = repeated_in_shard(part.column("piece").to_pylist(), count, weight, size)
            mine = weight[piece] == 1
            piece, window = piece[mine], window[mine]
            if len(piece):  # runs of neighbouring windows
                new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)])
                first = np.flatnonzero(new)
                run = np.diff(np.append(first, len(piece)))
                start = (at[piece[first]] >> repeats.SHIFT) + window[first]
                yield pa.RecordBatch.from_arrays([pa.array(rk[piece[first]]), pa.array(start << repeats.SHIFT | run)], names=["rk", "at"])

    edges = materialize(dealt.mapInArrow(lambda b: released(expand(b)), "rk long, at long"), "expanded")
    hot = repeats.counted_windows(pieces.where("piece is null").select("h1", "h2", "weight", "rk", "at"))
    return repeats.with_spans(docs, found.where("whole").select("rk", "at"), edges, hot)


def remove_repeats(docs: DataFrame, size: int = SIZE, long: int = repeats.LONG) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): the UTF-8 bytes of each text that no repeated string covers.

    A byte goes if a string of ``size`` bytes that covers it also starts anywhere else in the input, in
    the same document (overlaps included) or another; no string crosses documents. So all copies go.
    ``kept`` is binary, as cuts may fall inside a character. ``n_spans`` counts the maximal removed
    runs. Null and empty texts: no bytes. Rows that share a doc_id are documents of their own; a null
    doc_id is allowed. No rows: no rows.
    """
    found = repeated_bytes(docs, size, long=long).select("doc_id", "text", "spans")
    schema = with_fields(found.select("doc_id").schema, T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, runs = [], [], [], []
            for text, spans in zip(repeats.texts(batch), batch.column("spans").to_pylist()):
                sizes.append(len(text))
                if spans:
                    covered = repeats.cover(spans, size, len(text))
                    kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
                    gone.append(int(covered.sum()))
                    runs.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
                else:
                    kept.append(text)
                    gone.append(0)
                    runs.append(0)
            yield put_columns(batch.select(["doc_id"]), kept=pa.array(kept, pa.binary()), n_bytes=pa.array(sizes, pa.int64()), n_removed=pa.array(gone, pa.int64()), n_spans=pa.array(runs, pa.int64()))

    return small_batches(found).mapInArrow(run, schema)


def cut_texts(found: DataFrame, size: int = SIZE, spans_col: str = "spans") -> DataFrame:
    """``found`` (text, ``spans_col`` and other columns) with the covered bytes taken out of ``text`` and no
    ``spans_col``.

    Bytes of characters that a cut has split go too, so that the text stays valid. Null texts stay null.
    """
    schema = T.StructType([f for f in found.schema if f.name != spans_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, text, spans in zip(batch.column("text"), repeats.texts(batch), batch.column(spans_col).to_pylist()):
                if spans:
                    text = np.frombuffer(text, np.uint8)[~repeats.cover(spans, size, len(text))].tobytes()
                out.append(text.decode("utf-8", "ignore") if raw.is_valid else None)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string())).drop_columns([spans_col])

    return found.mapInArrow(run, schema)
