"""Token files: wavelet matrices of the ids, written and read through Spark.

Three steps. ``encode_units`` gives every document's ids where its text lies; texts aren't shuffled. The ids
are then dealt out by ranges of doc_id. Each task cuts its range into shards, one after another, so that
its memory is a shard's whatever its share. A shard is a row of a Parquet file: its place (``part``,
``seq``), its documents' ids and token counts, and ``payload``, the wavelet matrix as ``Wavelet.to_bytes``
lays it out. ``tokens_at``, ``count_tokens`` and ``find_token`` answer from the files.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from sawmill.llm.common import materialize, ranges, released, small_batches

MAGIC = b"WVM2"
#: Bits of a plane that are packed and counted together.
BLOCK = 1 << 16
#: Tokens of a shard, about; bytes of ids of a task, and tasks at most (beyond, each takes more shards).
SHARD_TOKENS, TASK_BYTES, MOST_TASKS = 2 << 20, 32 << 20, 100_000
#: Tokenizer files over this size are refused, as their content is broadcast.
MAX_TOKENIZER_BYTES = 64 << 20
#: Shards up to which their starts (a row each) are broadcast to the documents.
FEW_SHARDS = 200_000
#: Units whose ids a task remembers, at most, and words that the library gets as one text.
MAX_UNITS, ASKED = 500_000, 30_000
#: Texts in which units are looked up at once.
UNIT_ROWS = 4000
#: Tokens of a cell of the grid by which positions find their shards.
CELL = 1 << 21
#: White space besides tabs and line feeds, as RE2 reads it. Some right before a space or line feed is odd; a unit that
#: has any besides a line feed at its start, or marks, is not plain; see ``UnitEncoder``.
OTHER = r"\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD, NOT_PLAIN = rf"[\x09\x0a{OTHER}][ \n]", rf"(?s)^\n?$|<\||^[\x09{OTHER}]|.[\x09\x0a{OTHER}]"

SHARDS = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


class Wavelet:
    """Bit planes of a sequence, the highest bit first, each stably partitioned by the planes above it.

    A plane is kept in blocks of BLOCK bits, packed one by one, with the number of set bits before each.
    access, rank and select unpack just the blocks they touch, one or two a plane.
    """

    def __init__(self, n: int, bits: int, before: np.ndarray, starts: np.ndarray, data: bytes | memoryview):
        self.n, self.bits, self.before, self.starts, self.data = n, bits, before, starts, data
        self.zeros = [n - int(row[-1]) for row in before]
        self.unpacked: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> Wavelet:
        n, step = len(values), BLOCK // 8
        pack, packed = zstandard.ZstdCompressor(level=1), []
        before = np.zeros((bits, -(-n // BLOCK) + 1), np.int64)
        for level in range(bits):
            bit = (values & values.dtype.type(1 << (bits - 1 - level))) != 0
            plane = np.packbits(bit)
            for k in range(before.shape[1] - 1):
                part = plane[k * step : (k + 1) * step]
                before[level, k + 1] = before[level, k] + int(np.bitwise_count(part).sum())
                packed.append(pack.compress(part.tobytes()))
            values = np.concatenate([values[np.flatnonzero(~bit)], values[np.flatnonzero(bit)]])
        starts = np.cumsum([0, *map(len, packed)]).astype(np.int64)
        return cls(n, bits, before, starts, b"".join(packed))

    def to_bytes(self) -> bytes:
        """MAGIC, n, bits, the set bits before each block, where each packed block starts, the blocks (little-endian)."""
        return MAGIC + struct.pack("<QI", self.n, self.bits) + self.before.astype("<i8").tobytes() + self.starts.astype("<i8").tobytes() + bytes(self.data)

    @classmethod
    def from_bytes(cls, data: bytes) -> Wavelet:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        n, bits = struct.unpack_from("<QI", data, 4)
        blocks = -(-n // BLOCK)
        before = np.frombuffer(data, "<i8", bits * (blocks + 1), 16).reshape(bits, blocks + 1)
        at = 16 + 8 * before.size
        starts = np.frombuffer(data, "<i8", bits * blocks + 1, at)
        return cls(n, bits, before, starts, memoryview(data)[at + 8 * len(starts) :])

    def _block(self, level: int, k: int) -> np.ndarray:
        """The bytes of a plane's block."""
        if (level, k) not in self.unpacked:
            if len(self.unpacked) >= 4 * self.bits:
                self.unpacked.clear()
            i = level * (self.before.shape[1] - 1) + k
            data = zstandard.ZstdDecompressor().decompress(self.data[self.starts[i] : self.starts[i + 1]], max_output_size=BLOCK // 8)
            self.unpacked[level, k] = np.frombuffer(data, np.uint8)
        return self.unpacked[level, k]

    def _ones(self, level: int, at: int) -> int:
        """Set bits of a plane before position ``at``."""
        k, rest = divmod(at, BLOCK)
        total = int(self.before[level, k])
        if not rest:
            return total
        block = self._block(level, k)
        total += int(np.bitwise_count(block[: rest // 8]).sum())
        return total + (int(block[rest // 8]) >> (8 - rest % 8)).bit_count() if rest % 8 else total

    def _place(self, level: int, bit: int, k: int) -> int:
        """Where a plane's bit number ``k`` (from 0) of that value stands."""
        row = self.before[level]
        counts = row if bit else np.minimum(np.arange(len(row)) * BLOCK, self.n) - row
        block = int(np.searchsorted(counts, k, "right")) - 1
        size = min(BLOCK, self.n - block * BLOCK)
        found = np.flatnonzero(np.unpackbits(self._block(level, block), count=size) == bit)
        return block * BLOCK + int(found[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK // 8]) >> (7 - i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Bounds in the lowest plane's order of the occurrences of ``value`` before position ``i``."""
        if value < 0 or value >> self.bits:
            return 0, 0
        start, end = 0, min(i, self.n)
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` stands before position ``i``."""
        start, end = self._range(value, i)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``value``; IndexError if there are fewer."""
        start, end = self._range(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] * bit)
        return at

    def _plane(self, level: int) -> np.ndarray:
        """A whole plane, a flag each."""
        step, blocks, unpack = BLOCK // 8, self.before.shape[1] - 1, zstandard.ZstdDecompressor()
        out = np.zeros(-(-self.n // 8), np.uint8)
        for k in range(blocks):
            i = level * blocks + k
            part = unpack.decompress(self.data[self.starts[i] : self.starts[i + 1]], max_output_size=step)
            out[k * step : k * step + len(part)] = np.frombuffer(part, np.uint8)
        return np.unpackbits(out, count=self.n).view(bool)

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of ``value`` in order: its range is carried up plane by plane."""
        start, end = self._range(value, self.n)
        at = np.arange(start, end)
        for level in range(self.bits - 1, -1, -1):
            if not len(at):
                break
            bit, plane = value >> (self.bits - 1 - level) & 1, self._plane(level)
            at = np.flatnonzero(plane if bit else ~plane)[at - self.zeros[level] * bit]
        return at

    def decode(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = self._plane(level)
            above = np.empty_like(values)
            above[np.flatnonzero(~bit)], above[np.flatnonzero(bit)] = values[: self.zeros[level]], values[self.zeros[level] :]
            above |= bit.astype(values.dtype) << (self.bits - 1 - level)
            values = above
        return values


class UnitEncoder:
    """Ids of texts by the tokenizers library, asking it once for each unit that occurs.

    A unit starts at a space or line feed after a visible character. No match of the byte-level pattern
    crosses that place and the merges stay within a match, so the units' ids in a row are the text's.
    Units are named without their space; one that starts with a line feed has none before it.
    """

    def __init__(self, data: str):
        self.tokenizer = Tokenizer.from_str(data)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.bits = max(1, (size - 1).bit_length())
        names = map(self.tokenizer.id_to_token, range(size))
        self.begins = np.array([(name or "").startswith(("Ġ", "Ċ")) for name in names])  # byte-level for space, line feed
        self._remember(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, self.dtype))

    def _remember(self, units: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Units, and their ids one after another."""
        self.units, self.counts, self.ids = units, counts, ids

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in ``new`` in the order of asking, ids, how many each has) of units.

        Plain ones are asked as one text, whose ids are cut where a token starts with a space or line feed;
        those with white space or marks inside, one by one.
        """
        odd = pc.match_substring_regex(new, NOT_PLAIN).to_numpy(zero_copy_only=False)
        words, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), ASKED):
            some = new.take(pa.array(words[at : at + ASKED]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            found = self._ask([(" " + joined).replace(" \n", "\n")])[0]
            bounds = np.flatnonzero(self.begins[found])
            if len(bounds) == len(some) and not bounds[0]:
                ids.append(found)
                counts.append(np.diff(np.append(bounds, len(found))))
            else:
                self._each(some, ids, counts)
        self._each(new.take(pa.array(rest)), ids, counts)
        return np.concatenate([words, rest]), np.concatenate(ids), np.concatenate(counts)

    def _each(self, units: pa.Array, ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        found = self._ask([x if x[:1] == "\n" else " " + x for x in units.to_pylist()])
        ids += found
        counts.append(np.array([len(x) for x in found], np.int64))

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of texts, and how many each text has; the first has neither space nor line feed before it."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        flat, sizes = [], np.zeros(len(texts), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], odd[1:] != odd[:-1]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(odd))):
            if not odd[a]:
                parts = pc.split_pattern(pc.replace_substring(texts.slice(a, b - a), "\n", " \n"), " ")
                flat.append(parts.flatten())
                sizes[a:b] = parts.value_lengths().to_numpy()
                continue
            for i in range(a, b):
                joined: list[str] = []
                for part in texts[i].as_py().split(" "):
                    if joined and (not joined[-1] or joined[-1][-1].isspace() or part[:1] == "\n"):
                        joined[-1] += " " + part
                    else:
                        joined.append(part)
                flat.append(pa.array(joined, pa.string()))
                sizes[i] = len(joined)
        return pa.concat_arrays(flat), sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), each text's followed by ``end_id``; null: as empty."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        parts, sizes = self._parts(pc.fill_null(texts.cast(pa.string()), ""))
        begin = np.cumsum(sizes) - sizes
        first = np.zeros(len(parts), bool)
        first[begin] = True
        heads = self._ask(parts.take(pa.array(begin)).to_pylist())
        rest = parts.filter(pa.array(~first)).dictionary_encode()
        code, names = rest.indices.to_numpy(), rest.dictionary
        place = pc.index_in(names, value_set=self.units)
        is_new = place.is_null()
        asked, learnt, lengths = self._learn(names.filter(is_new))
        # all ids: remembered units, new ones, the texts' heads, the end
        pool = np.concatenate([self.ids, learnt, *heads, np.array([end_id], self.dtype)])
        count = np.concatenate([self.counts, lengths, [len(h) for h in heads], [1]]).astype(np.int64)
        start = np.cumsum(count) - count
        fresh = is_new.to_numpy(zero_copy_only=False)
        entry = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        entry[np.flatnonzero(fresh)[asked]] = len(self.units) + np.arange(len(asked))
        row = np.repeat(np.arange(len(sizes)), sizes)
        every = np.full(len(parts) + len(sizes), len(count) - 1)  # a text's last entry is the end
        at = np.arange(len(parts)) + row
        own = np.empty(len(parts), np.int64)
        own[first] = len(self.units) + len(lengths) + np.arange(len(sizes))
        own[~first] = entry[code]
        every[at] = own
        ids = pool[ranges(start[every], count[every])]
        total = np.add.reduceat(count[every], begin + np.arange(len(sizes)))
        if len(self.units) + len(asked) > MAX_UNITS:  # from these texts alone, those that they have twice
            again = np.flatnonzero(np.bincount(code, minlength=len(names)) > 1)[:MAX_UNITS]
            of = entry[again]
            self._remember(names.take(pa.array(again)), count[of], pool[ranges(start[of], count[of])])
        elif len(asked):
            units = names.filter(is_new).take(pa.array(asked))
            self._remember(pa.concat_arrays([self.units, units]), np.append(self.counts, lengths), np.append(self.ids, learnt))
        return ids, total


_MADE: dict[int, UnitEncoder] = {}


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} characters")
    return data


def _slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch's rows by about ``limit`` bytes of a column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, limit + (sizes[at - 1] if at else 0), "right")))
        yield batch.slice(at, upto - at)
        at = upto


def encode_units(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids): the ids of each text and ``end_id`` as little-endian integers of 2 bytes, or 4 for over 65,536 ids."""
    data = small_batches(docs, UNIT_ROWS).sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        key = hash(data.value)
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = UnitEncoder(data.value)
        enc = _MADE[key]
        for batch in batches:
            for some in _slices(batch, "text"):
                ids, total = enc.encode(some.column("text"), end_id)
                bounds = np.concatenate([[0], np.cumsum(total)]) * enc.dtype(0).itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(total), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), packed.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lambda b: released(run(b)), "doc_id long, ids binary")


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, task_bytes: int = TASK_BYTES) -> None:
    """Write the ids of every text, each followed by ``end_id``, to wavelet shards under ``path``.

    Shards are in ascending order of doc_id (null ids come first) by (part, seq): range partitions, each of
    which is cut after every ``shard_tokens`` tokens or so; a document is in one shard. Many rows of one
    doc_id are dealt out to several parts. Null and empty texts have the end id only. No documents: no shard.
    """
    spark = docs.sparkSession
    bits = max(1, (Tokenizer.from_str(tokenizer_json(tokenizer_file)).get_vocab_size() - 1).bit_length())
    dtype = np.uint16 if bits <= 16 else np.uint32
    encoded = materialize(encode_units(docs, tokenizer_file, end_id), "encoded")
    size = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            for some in _slices(batch, "ids", shard_tokens):
                held.append(some)
                waiting += pc.sum(pc.binary_length(some.column("ids"))).as_py() or 0
                if waiting >= shard_tokens * dtype(0).itemsize:
                    yield shard(held, part, seq)
                    held, waiting, seq = [], 0, seq + 1
        if held:
            yield shard(held, part, seq)

    def shard(held: list[pa.RecordBatch], part: int, seq: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        lengths = pc.divide(pc.binary_length(rows.column("ids")).cast(pa.int64()), dtype(0).itemsize).combine_chunks()
        ids = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("ids")), dtype)
        doc_ids = rows.column("doc_id").combine_chunks()
        one = pa.array([0, len(doc_ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(one, doc_ids), pa.ListArray.from_arrays(one, lengths), pa.array([Wavelet.build(ids, bits).to_bytes()], pa.binary())],
            names=["part", "seq", "n_tokens", "doc_ids", "lengths", "payload"],
        )

    parts = min(MOST_TASKS, max(1, -(-size // task_bytes)))
    order = ["doc_id", "_row"]
    dealt = small_batches(encoded).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.drop("_row").mapInArrow(lambda b: released(run(b)), SHARDS).write.option("compression", "uncompressed").parquet(path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids before each: running totals of the parts, then within each part."""
    files = spark.read.schema(SHARDS).parquet(path)
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # MOST_TASKS rows at most
    parts = parts.select("part", before(Window.orderBy("part")).alias("_before"))
    places = files.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("_own"))
    starts = places.join(F.broadcast(parts), "part").select("part", "seq", (F.col("_before") + F.col("_own")).alias("start"))
    return files.join(starts, ["part", "seq"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, token_ids (uint32 little-endian, with the end id)."""
    files = small_batches(spark.read.schema(SHARDS).parquet(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq = (batch.column(c)[k].as_py() for c in ("part", "seq"))
                ids = Wavelet.from_bytes(batch.column("payload")[k].as_buffer().to_pybytes()).decode()
                docs, lengths = batch.column("doc_ids")[k].values, batch.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths)
                for at in range(0, len(docs), 500):
                    some = slice(at, at + 500)
                    tokens = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[some], lengths[some])]
                    m = len(tokens)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * m, pa.int32()), pa.array([seq] * m, pa.int32()), docs.slice(at, m), pa.array(ends[some] - lengths[some]), pa.array(lengths[some]), pa.array(tokens, pa.binary())],
                        names=["part", "seq", "doc_id", "local", "n_tokens", "token_ids"],
                    )

    docs = files.mapInArrow(lambda b: released(run(b)), "part int, seq int, doc_id long, local long, n_tokens long, token_ids binary")
    starts = open_shards(spark, path).select("part", "seq", F.col("start").alias("before"))  # a row a shard
    few = spark.read.schema(SHARDS).parquet(path).select("part").count() <= FEW_SHARDS
    return docs.join(F.broadcast(starts) if few else starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "token_ids")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token_id) for the ``position``s (long, from 0) of all ids in order; beyond the end or null: no row.

    Positions meet shards by the cells of a grid; of a shard only the blocks on a position's way are unpacked.
    """
    files = open_shards(spark, path)
    end = F.col("start") + F.col("n_tokens")
    cells = F.sequence(F.floor(F.col("start") / CELL), F.floor((end - 1) / CELL))
    grid = files.where("n_tokens > 0").select("part", "seq", "start", end.alias("end"), F.explode(cells).alias("cell"))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").distinct()
    asked = asked.withColumn("cell", F.floor(F.col("position") / CELL)).join(grid, "cell").where("position >= start and position < end")
    asked = asked.groupBy("part", "seq").agg(F.collect_list(F.col("position") - F.col("start")).alias("local"))  # a shard's tokens at most
    rows = files.join(asked, ["part", "seq"]).select("start", "local", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Wavelet.from_bytes(batch.column("payload")[k].as_buffer().to_pybytes())
                local = np.sort(batch.column("local")[k].values.to_numpy())
                tokens = [shard.access(int(i)) for i in local]
                yield pa.RecordBatch.from_arrays([pa.array(local + batch.column("start")[k].as_py()), pa.array(tokens, pa.int64())], names=["position", "token_id"])

    return rows.mapInArrow(run, "position long, token_id long")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token_id, n) for each of a list of ids: each shard counts by rank, and the counts are summed."""
    tokens = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("payload"):
                shard = Wavelet.from_bytes(value.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token_id", "n"])

    files = spark.read.schema(SHARDS).parquet(path).select("payload")
    found = files.mapInArrow(run, "token_id long, n long").union(spark.createDataFrame([(t, 0) for t in tokens], "token_id long, n long"))
    return found.groupBy("token_id").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, place, position) of each occurrence of an id: its place in the document and among all ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = Wavelet.from_bytes(batch.column("payload")[k].as_buffer().to_pybytes()).occurrences(token)
                ends = np.cumsum(batch.column("lengths")[k].values.to_numpy())
                doc = np.searchsorted(ends, at, "right")
                begin = np.concatenate([[0], ends])[doc]
                docs = batch.column("doc_ids")[k].values.take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([docs, pa.array(at - begin), pa.array(at + batch.column("start")[k].as_py())], names=["doc_id", "place", "position"])

    return open_shards(spark, path).select("doc_ids", "lengths", "payload", "start").mapInArrow(run, "doc_id long, place long, position long")
