"""Substring dedup by recompression: runs and pairs of tokens get names until symbols stand for long stretches.

A round names every run of equal symbols and then every pair of a left and a right symbol, the sides
drawn by hash. A name is a hash of what it stands for, so all tasks and documents give the same name
to the same run or pair without meeting. Whether a symbol arises depends on the symbol and a stretch
around it, kept as its *reach*; equal word sequences therefore have equal symbols wherever the reach
lies inside. Each window is keyed by the least of its highest symbols, hashed with their reach;
shared keys reveal repeats, and the windows at their edges are verified by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm import repeats
from sawmill.llm.common import materialize, put_columns, ranges, with_fields
from sawmill.llm.repeats import Ranges, mix

WINDOW = 35
#: Rounds of naming; more make the symbols rarer, but their reach must fit into a window.
ROUNDS = 2
FAR = 1 << 40
NONE = np.uint64(2**64 - 1)


@dataclass
class Symbols:
    """Names in text order, and each one's reach in words (left, right end)."""

    name: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def runs(self) -> Symbols:
        """Every maximal run of a name becomes one symbol. Its neighbours tell where it ends, so their reach joins."""
        first = np.flatnonzero(np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        last = np.append(first[1:], len(self.name)) - 1
        count = last - first + 1
        name = np.where(count > 1, mix(self.name[first] ^ mix(count.astype(np.uint64))), self.name[first])
        return Symbols(name, self.left[np.maximum(first - 1, 0)], self.right[np.minimum(last + 1, len(self.name) - 1)])

    def pairs(self, fixed: np.ndarray, seed: int) -> Symbols:
        """Every left symbol before a right one joins it; ``fixed`` ones have no side. Who stays alone depends on a neighbour."""
        side = mix(self.name + np.uint64(seed)) & np.uint64(1) == 0
        starts = np.zeros(len(side), bool)
        starts[:-1] = (side & ~fixed)[:-1] & (~side & ~fixed)[1:]
        ends = np.concatenate([[False], starts[:-1]])
        name, left, right = self.name.copy(), self.left.copy(), self.right.copy()
        at = np.flatnonzero(starts)
        name[at] = mix(self.name[at] * np.uint64(3) + mix(self.name[at + 1]))
        right[at] = self.right[at + 1]
        alone = ~starts & ~ends
        to_right, to_left = np.flatnonzero(alone[:-1] & side[:-1]), np.flatnonzero(alone[1:] & ~side[1:]) + 1
        right[to_right] = np.maximum(right[to_right], self.right[to_right + 1])
        left[to_left] = np.minimum(left[to_left], self.left[to_left - 1])
        keep = ~ends
        return Symbols(name[keep], left[keep], right[keep])


def levels(words: np.ndarray, breaks: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """Symbols of each level, the words first. At ``breaks`` stand marks that end documents: their reach
    has no end, so nothing that depends on a document's edge is ever inside a window."""
    n = len(words)
    reach = np.arange(n)
    left, right = reach.copy(), reach + 1
    left[breaks], right[breaks] = -FAR, FAR
    now = Symbols(words, left, right)
    out = [now]
    for r in range(rounds):
        now = now.runs()
        now = now.pairs((now.left <= -FAR) & (now.right >= FAR), r + 1)
        out.append(now)
    return out


def window_keys(words: np.ndarray, breaks: np.ndarray, hashes: Ranges, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window, of the highest symbols whose reach lies in it the one of least hash: that hash
    (of its reach's words), and a number that tells its occurrence apart."""
    n = len(words)
    keys, which = np.full(n, NONE), np.full(n, -1)
    for level, symbols in reversed(list(enumerate(levels(words, breaks, rounds)))):
        open_ = np.flatnonzero(which < 0)
        if not len(open_):
            break
        fits = (symbols.left >= 0) & (symbols.right <= n) & (symbols.right - symbols.left <= size)
        left, right = symbols.left[fits], symbols.right[fits]
        value = mix(hashes.of(left, right - left) + np.uint64(level + 1))
        least = spread_min(n, np.maximum(right - size, 0), left, repeats.placed(value))[open_]
        open_, least = open_[least != NONE], repeats.place_of(least[least != NONE])
        keys[open_], which[open_] = value[least], level << repeats.PLACE | least
    return keys, which


def spread_min(n: int, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least value whose range first..last holds it, by ranges of powers of two."""
    if not len(first):
        return np.full(n, NONE)
    width = last - first + 1
    power = np.frexp(width.astype(float))[1] - 1
    above = np.full(n, NONE)
    for p in range(int(power.max()), -1, -1):
        own = power == p
        np.minimum.at(above, first[own], value[own])
        np.minimum.at(above, last[own] - (1 << p) + 1, value[own])
        if p:
            half = 1 << (p - 1)
            below = above.copy()
            np.minimum(below[half:], above[:-half], out=below[half:])
            above = below
    return above


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return mix(np.fromiter((digest(w) for w in words), np.uint64, len(words)))


def _lined_up(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words with a mark before, between and after the texts; where texts start, and their lengths."""
    split = [t.split() for t in data]
    lengths = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    out = mix(np.arange(int(lengths.sum()) + len(data) + 1, dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out[ranges(starts, lengths)] = word_hashes([w for words in split for w in words])
    return out, starts, lengths


def _cut(text: bytes, size: int, long: int) -> Iterator[tuple[int, bytes]]:
    """Words in pieces. What a window's symbols are doesn't depend on words outside it, so cuts change no key."""
    if len(text) <= long:
        yield 0, text
        return
    words, step = text.split(), max(1, long // 8)
    for at in range(0, max(1, len(words) - size + 1), step):
        yield at, b" ".join(words[at : at + step + size - 1])


def _place(data: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    words, starts, lengths = _lined_up(data)
    breaks = np.concatenate([[0], starts + lengths])
    hashes = Ranges(words)
    keys, which = window_keys(words, breaks, hashes, size)
    valid = np.zeros(len(words), bool)
    valid[ranges(starts, np.maximum(lengths - size + 1, 0))] = True
    at, count = repeats.segments(which, valid)
    doc = np.searchsorted(starts, at, "right") - 1
    seg = mix(hashes.of(at, count + size - 1) + count.astype(np.uint64))
    return doc, at - starts[doc], count, keys[at], seg


def repeated_words(docs: DataFrame, size: int = WINDOW, long: int = repeats.LONG) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``: packed runs of the windows of ``size`` words that start elsewhere too."""
    docs = repeats.keyed(docs)
    found = repeats.repeated_segments(docs, lambda data: _place(data, size), lambda text: _cut(text, size, long))
    compare = docs.join(repeats.wanted_pieces(found), "rk")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[int] = []
        for batch in batches:
            batch = repeats.rows_once(batch, last)
            rows = zip(batch.column("rk").to_pylist(), repeats.texts(batch), batch.column("wanted").to_pylist())
            made = [repeats.hashed_windows(word_hashes(text.split()), wanted, size, rk) for rk, text, wanted in rows]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=["h1", "h2", "weight", "rk", "at"])

    hashed = materialize(compare.mapInArrow(windows, repeats.WINDOWS), "windows")
    return repeats.with_spans(docs, found.where("whole").select("rk", "at"), repeats.counted_windows(hashed))


def remove_repeats(docs: DataFrame, size: int = WINDOW, long: int = repeats.LONG) -> DataFrame:
    """(doc_id, text, n_words, n_removed): texts without the words of repeated windows, kept words joined by a space.

    Words are what white space (space, \\t to \\r) parts, unchanged. A window is ``size`` words of one
    document; it goes if its word sequence also starts anywhere else, in the same document (overlaps
    included) or another, in the input. So all copies go. Null and empty texts: no words. Rows that
    share a doc_id are documents of their own; a null doc_id is allowed. No rows: no rows.
    """
    found = repeated_words(docs, size, long).select("doc_id", "text", "spans")
    schema = with_fields(found.select("doc_id").schema, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, gone = [], [], []
            for text, spans in zip(repeats.texts(batch), batch.column("spans").to_pylist()):
                words = text.split()
                covered = repeats.cover(spans, size, len(words)) if spans else np.zeros(len(words), bool)
                kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c]) if spans else b" ".join(words))
                counts.append(len(words))
                gone.append(int(covered.sum()))
            yield put_columns(batch.select(["doc_id"]), text=pa.array(kept, pa.binary()).cast(pa.string()), n_words=pa.array(counts, pa.int64()), n_removed=pa.array(gone, pa.int64()))

    return found.mapInArrow(run, schema)
