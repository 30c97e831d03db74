"""Vector code compression: product codes in integers, nearest entries by ball trees over each part's codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import materialize, released, small_batches
from sawmill.llm.vectors import by_length

#: Parts of a vector, entries of a part's codebook, rounds of improvement, integer steps of 1.0.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf of a tree, at most.
LEAF = 4
#: Largest integer component, and longest vector: up to there all sums of squares of a vector fit 63 bits.
LARGEST, LONGEST = 1 << 24, 8191
#: Labels up to which their sums are broadcast; beyond, only those of more than a part of HOT of the rows.
FEW_LABELS, HOT = 100_000, 1e-4


@dataclass
class Ball:
    """A node of a tree: an entry as centre, the entries of a leaf (else none), and the radius, not below the true one."""

    centre: int
    radius: float
    entries: np.ndarray
    below: tuple[Ball, ...] = ()


#: More than what rounding to doubles, square roots and a sum of two can be off, relatively.
SLACK = 2.0**-50


def _up(x: np.ndarray | int) -> np.ndarray:
    """Square roots of integers, above the true ones."""
    return np.sqrt(np.asarray(x, float)) * (1 + SLACK)


def _down(x: np.ndarray | int) -> np.ndarray:
    """Square roots of integers, below the true ones."""
    return np.sqrt(np.asarray(x, float)) * (1 - SLACK)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to one row, or to rows."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def ball_tree(book: np.ndarray, some: np.ndarray | None = None) -> Ball:
    """A tree over the rows of ``book`` (integers): the centre is the entry nearest to the mean, each half goes to
    the nearer of two entries far from each other."""
    some = np.arange(len(book)) if some is None else some
    rows = book[some]
    centre = int(some[_squares(rows, rows.sum(axis=0) // len(rows)).argmin()])
    away = _squares(rows, book[centre])
    radius = float(_up(away.max()))
    if len(some) <= LEAF or not away.max():
        return Ball(centre, radius, some)
    one = rows[away.argmax()]
    other = rows[_squares(rows, one).argmax()]
    near = _squares(rows, one) <= _squares(rows, other)
    if near.all() or not near.any():
        return Ball(centre, radius, some)
    return Ball(centre, radius, np.zeros(0, np.int64), (ball_tree(book, some[near]), ball_tree(book, some[~near])))


def nearest_entries(tree: Ball, book: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index; exact.

    Rows go down together: first each to the leaf whose centres are nearer, which gives a bound, then over
    the whole tree, where a node is left out for the rows whose distance to its centre is above their bound and
    its radius together. Distances are rounded so that no node is left out wrongly, equal ones are visited too,
    and only integers decide.
    """
    best, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)

    def look(at: np.ndarray, entries: np.ndarray) -> None:
        for e in entries.tolist():
            gap = _squares(rows[at], book[e])
            better = (gap < least[at]) | (gap == least[at]) & (e < best[at])
            best[at[better]], least[at[better]] = e, gap[better]

    def descend(node: Ball, at: np.ndarray) -> None:
        if not len(at):
            return
        if not node.below:
            look(at, node.entries)
            return
        first, second = node.below
        nearer = _squares(rows[at], book[first.centre]) <= _squares(rows[at], book[second.centre])
        descend(first, at[nearer])
        descend(second, at[~nearer])

    def bound(node: Ball, at: np.ndarray) -> None:
        meets = _down(_squares(rows[at], book[node.centre])) <= _up(least[at]) + node.radius
        at = at[meets]
        if not len(at):
            return
        if not node.below:
            look(at, node.entries)
        for child in node.below:
            bound(child, at)

    descend(tree, np.arange(len(rows)))
    bound(tree, np.arange(len(rows)))
    return best, least


Books = dict[int, np.ndarray]  # by vector length: (part, entry, position) in integers


def _integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, parts in integers: row, part, position) of the vectors of each length."""
    for at, rows in by_length(column):
        yield at, np.floor(rows * SCALE).astype(np.int64).reshape(len(rows), PARTS, -1)


def _assigned(books: Books, trees: dict[int, list[Ball]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) by row and part."""
    size = rows.shape[1] * rows.shape[2]
    if size not in trees:
        trees[size] = [ball_tree(book) for book in books[size]]
    found = [nearest_entries(trees[size][p], books[size][p], rows[:, p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def usable(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows that can be coded: no null, no null or non-finite components, a length that PARTS divides, integers in range."""
    v = F.col(vec_col)
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE <= LARGEST))
    return df.where(v.isNotNull()).where((F.size(v) > 0) & (F.size(v) <= LONGEST) & (F.size(v) % PARTS == 0) & fits)


def first_books(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Books:
    """Each length's codebooks to begin with: the parts of its ENTRIES smallest ids' vectors, ascending (equal ids by
    vector; null ids last)."""
    sizes = [r.n for r in df.select(F.size(vec_col).alias("n")).distinct().collect()]  # LONGEST / PARTS at most
    books = {}
    for size in sizes:
        least = df.where(F.size(vec_col) == size).orderBy(F.col(id_col).asc_nulls_last(), vec_col).limit(ENTRIES)
        column = least.select(vec_col).toArrow().column(0).combine_chunks()  # ENTRIES rows
        _, rows = next(_integers(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column))
        books[size] = np.ascontiguousarray(rows.transpose(1, 0, 2))
    return books


def improved(df: DataFrame, books: Books, vec_col: str = "embedding") -> Books:
    """The codebooks after a round: each entry becomes the floor of its parts' mean, unused ones stay.

    Each task adds up what it has read and sends one row an entry, so what is shuffled and collected is bounded by
    the codebooks, whatever the table's size.
    """
    sent = df.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(b.shape, np.int64) for n, b in sent.value.items()}
        counts = {n: np.zeros(b.shape[:2], np.int64) for n, b in sent.value.items()}
        trees: dict[int, list[Ball]] = {}
        for batch in batches:
            for _, rows in _integers(batch.column(0)):
                size = rows.shape[1] * rows.shape[2]
                index, _ = _assigned(sent.value, trees, rows)
                for p in range(PARTS):
                    np.add.at(sums[size][p], index[:, p], rows[:, p])
                    counts[size][p] += np.bincount(index[:, p], minlength=counts[size].shape[1])
        for size, count in counts.items():
            part, entry = np.nonzero(count)
            if len(part):
                rows = [pa.array(np.full(len(part), size, np.int32)), pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(sums[size][part, entry]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, names=["size", "part", "entry", "n", "sums"])

    partial = small_batches(df.select(vec_col)).mapInArrow(lambda b: released(add(b)), "size int, part int, entry int, n long, sums array<long>")
    each = partial.select("size", "part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    got = each.groupBy("size", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()  # a row a component of the codebooks
    out = {n: b.copy() for n, b in books.items()}
    size, part, entry, at, n, s = (got.column(c).to_numpy() for c in ("size", "part", "entry", "at", "n", "s"))
    for k, book in out.items():
        own = size == k
        book[part[own], entry[own], at[own]] = s[own] // n[own]
    return out


def digest(book: np.ndarray) -> str:
    """SHA-256 of a length's codebooks: all integers in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = ROUNDS) -> Books:
    """Codebooks of ``usable`` rows: the first ones, improved ``rounds`` times over all rows."""
    books = first_books(df, id_col, vec_col)
    for _ in range(rounds):
        books = improved(df, books, vec_col)
    return books


def encode(df: DataFrame, books: Books, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of ``usable`` rows: two hex digits a part, and the squared distances summed."""
    sent: Broadcast = df.sparkSession.sparkContext.broadcast(books)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, list[Ball]] = {}
        names = {n: digest(b) for n, b in sent.value.items()}
        for batch in batches:
            codes, error, sha = np.empty(batch.num_rows, object), np.zeros(batch.num_rows, np.int64), np.empty(batch.num_rows, object)
            for at, rows in _integers(batch.column(2)):
                index, gap = _assigned(sent.value, trees, rows)
                codes[at] = [bytes(r).hex() for r in index.astype(np.uint8)]
                error[at], sha[at] = gap.sum(axis=1), names[rows.shape[1] * rows.shape[2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error), pa.array(sha, pa.string())], names=["id", "label", "code", "error", "codebooks_sha256"])

    schema = f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long, codebooks_sha256 string"
    return small_batches(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec_col)).mapInArrow(lambda b: released(run(b)), schema)


def decode(codes: DataFrame, books: Books, size: int, code_col: str = "code") -> DataFrame:
    """``codes`` with ``decoded``, the vector of doubles that a code of vectors of length ``size`` stands for."""
    book = F.lit([[[float(x) / SCALE for x in e] for e in part] for part in books[size].tolist()])
    index = [F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    return codes.withColumn("decoded", F.flatten(F.array(*[F.get(F.get(book, F.lit(p)), i) for p, i in enumerate(index)])))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (label, error, …) with ``label_error``, the error summed over equal labels, nulls together; null if the
    sum leaves 64 bits.

    Sums are added up by task first. Few labels' sums are broadcast; of more only those that many rows share are, a
    bounded number, and all others meet their rows by a shuffle in which no label is hot.
    """
    sums = materialize(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label_errors")
    totals = sums.agg(F.count(F.lit(1)).alias("labels"), F.sum("_n").alias("rows")).first()
    sums = sums.withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.labels <= FEW_LABELS:
        return coded.join(F.broadcast(sums), same).drop("_label", "_n")
    hot = sums.where(F.col("_n") > HOT * totals.rows)  # 1 / HOT labels at most
    first = coded.join(F.broadcast(hot.select("_label", F.col("label_error").alias("_hot"))), same, "left").drop("_label")
    rest = first.where("_hot is null").drop("_hot").join(sums.where(F.col("_n") <= HOT * totals.rows), same).drop("_label", "_n")
    return first.where("_hot is not null").withColumnRenamed("_hot", "label_error").unionByName(rest)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors that can be coded, a row each.

    Left out: null vectors, those with null or non-finite components or components beyond LARGEST / SCALE,
    and lengths that PARTS doesn't divide (empty ones, too). Vectors of each length have codebooks of their own.
    Repeated ids are rows of their own; no rows: no rows.
    """
    rows = materialize(usable(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))), "vectors")
    coded = materialize(encode(rows, fit(rows)), "codes")
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
