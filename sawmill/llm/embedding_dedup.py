"""Embedding near-dedup: random-hyperplane sign hashing in tables, exact cosines, connected components.

Vectors don't travel to the tables' buckets, only ids with a sketch of 128 more signs. Those whose sketch has
another near enough in their bucket come again with their vectors, for exact cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import complete_groups, local_roots, materialize, released, runs, split_pairs
from sawmill.llm.components import connected_components
from sawmill.llm.vectors import by_length, unit, usable

#: Rows of a bucket that one task compares at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 2048
#: A pair right at the threshold is missed by all tables with at most this probability.
MISS = 5e-4
#: Signs of a sketch, and by how many standard deviations more than expected two at the threshold may differ (beyond: 1e-12).
SKETCH, SPREAD = 128, 8


def tables_for(n: int, threshold: float, per_bucket: int = 64, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits so that ``n`` spread vectors fill buckets of about ``per_bucket``, tables for ``miss``."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / per_bucket))))
    alike = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-alike)) if alike < 1 else 1


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits * tables))


def signatures(vectors: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """A row of bucket numbers for each vector, a column for each table."""
    signs = (vectors @ planes >= 0).reshape(len(vectors), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def sketch_radius(threshold: float) -> int:
    apart = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return math.ceil(SKETCH * apart + SPREAD * math.sqrt(SKETCH * apart * (1 - apart)))


def with_partner(sketch: np.ndarray, asks: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a bucket have another of the other side within ``radius`` signs."""
    near = np.zeros(len(sketch), bool)
    for at in range(0, len(asks), 512):
        some = asks[at : at + 512]
        apart = np.bitwise_count(sketch[some, None, :] ^ sketch[None, others, :]).sum(axis=2, dtype=np.uint16)
        x, y = np.nonzero((apart <= radius) & (some[:, None] != others[None, :]))
        near[some[x]] = near[others[y]] = True
    return near


def near_duplicates(df: DataFrame, threshold: float = 0.95, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``df`` (vec_id, embedding).

    Two rows link if a table's bucket holds both and their cosine in doubles is at least
    ``threshold``; vectors of different lengths have none. Equal vectors are compared once and count as
    often as they occur. Bits and tables follow the number of vectors (``tables_for``). A task gives a row
    of its bucket's local component for each vector and the number of links, never the pairs; a pair
    counts in the first table that holds it. Null, empty, zero and non-finite vectors link with nothing.
    Rows that share a vec_id but not a vector are one node: their links join. Null vec_id: the row takes
    no part and comes back with a null component. No rows: no rows.
    """
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable_rows = usable(ids.where("vec_id is not null"))
    same = usable_rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    same = materialize(same.withColumn("vec", F.xxhash64("embedding")), "vectors")
    n = same.count()
    bits, tables = tables_for(n, threshold)
    radius = sketch_radius(threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):  # each row leaves as many times as there are tables
                some = batch.slice(at, 2000)
                for index, vectors in by_length(some.column("embedding")):
                    dim = vectors.shape[1]
                    if dim not in planes:
                        planes[dim] = hyperplanes(dim, bits, tables, seed), hyperplanes(dim, SKETCH, 1, seed + 1)
                    sig = signatures(vectors, planes[dim][0], bits) | dim << 32
                    sketch = np.packbits(vectors @ planes[dim][1] >= 0, axis=1).view(np.int64)
                    every = np.repeat(index, tables)
                    cols = [np.tile(np.arange(tables, dtype=np.int32), len(sig)), sig.ravel(), *(np.repeat(sketch[:, k], tables) for k in (0, 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols] + [some.column("vec").take(pa.array(every))], names=["tab", "bucket", "s1", "s2", "vec"])

    rows = same.select("embedding", "vec").mapInArrow(lambda b: released(hashed(b)), "tab int, bucket long, s1 long, s2 long, vec long")
    rows = materialize(rows, "buckets")
    order = ["tab", "bucket", "part_i", "part_j"]
    dealt = split_pairs(rows, ["tab", "bucket"], "vec", block, n * tables).repartition(*order).sortWithinPartitions(*order)

    def sides(blk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a group's two blocks; both are all of them if there is one."""
        every = np.arange(len(blk))
        low, high = blk.min(), blk.max()
        return (every, every) if low == high else (every[blk == low], every[blk == high])  # pairs across only

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in complete_groups(batches, order):
            bounds = runs(*(groups.column(c).to_numpy() for c in order))
            blk = groups.column("blk").to_numpy()
            sketch = np.stack([groups.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")], axis=1)
            near = np.zeros(len(blk), bool)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a > 1:
                    near[a:b] = with_partner(sketch[a:b], *sides(blk[a:b]), radius)
            if near.any():
                yield from groups.select([*order, "blk", "vec"]).filter(pa.array(near)).combine_chunks().to_batches()

    met = materialize(dealt.mapInArrow(lambda b: released(meet(b)), "tab int, bucket long, part_i int, part_j int, blk int, vec long"), "met")
    again = met.join(same, "vec").select(*order, "blk", "rep", "w", "embedding").repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for groups in complete_groups(batches, order):
            for index, vectors in by_length(groups.column("embedding")):
                dim = vectors.shape[1]
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, bits, tables, seed)
                tab, blk, rep, w = (groups.column(c).to_numpy()[index] for c in ("tab", "blk", "rep", "w"))
                bounds = runs(*(groups.column(c).to_numpy()[index] for c in order))
                sig, vectors = signatures(vectors, planes[dim], bits), unit(vectors)
                out: list[np.ndarray] = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    left, right = (side + a for side in sides(blk[a:b]))
                    links, root = linked(vectors, sig[:, : int(tab[a])], w, left, right, a, b, threshold)
                    some = np.flatnonzero(links)
                    if len(some):
                        first = np.full(b - a, np.iinfo(np.int64).max)
                        np.minimum.at(first, root, rep[a:b])
                        out.append(np.stack([rep[a:b][some], links[some], first[root[some]]]))
                if out:
                    made = np.concatenate(out, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1]), pa.array(made[2])], names=["rep", "links", "root"])

    found = materialize(again.mapInArrow(lambda b: released(compare(b)), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = same.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = ids.join(reps, "embedding", "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component_id")), "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def linked(vectors: np.ndarray, before: np.ndarray, w: np.ndarray, left: np.ndarray, right: np.ndarray, a: int, b: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows a to b the links (each counted by its vector's number of rows) and the local components, over pairs of
    ``left`` and ``right`` that no table in ``before`` holds."""
    links, root = np.zeros(b - a, np.int64), np.arange(b - a)
    alone = left is right or np.array_equal(left, right)
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        x, y = np.nonzero(vectors[some] @ vectors[right].T >= threshold)
        x, y = some[x], right[y]
        x, y = (x[x < y], y[x < y]) if alone else (x, y)
        for part in range(0, len(x), 1 << 18):
            xs, ys = x[part : part + (1 << 18)], y[part : part + (1 << 18)]
            new = ~(before[xs] == before[ys]).any(axis=1)
            np.add.at(links, xs[new] - a, w[ys[new]])
            np.add.at(links, ys[new] - a, w[xs[new]])
            root = local_roots(b - a, np.concatenate([np.arange(b - a), xs[new] - a]), np.concatenate([root, ys[new] - a]))
    return links, root
