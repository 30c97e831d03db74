"""Approximate nearest neighbours: a hierarchical k-means tree, leaves visited best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sawmill.llm.common import materialize
from sawmill.llm.vectors import by_length, matrix, unit, usable

#: Rows of the sample that the trees are fitted on: a 16th of all between these bounds; every row is indexed.
SAMPLE, MOST_SAMPLE = 20_000, 200_000
#: Children of an inner node, and sampled rows of a leaf at which it isn't split again.
BRANCH, LEAF = 12, 60
#: Queries whose true neighbours set the number of leaves visited, and the recall asked of them.
PROBES, RECALL = 200, 0.95
#: Rows of a leaf, or queries to it, that one task holds; more are dealt out in blocks.
BLOCK = 4096


class Tree:
    """Nodes in order of making: ``centres`` (unit vectors), ``children`` (none: a leaf), leaves numbered."""

    def __init__(self, dim: int):
        self.centres, self.children, self.leaf_of = [np.zeros(dim)], [[]], {}

    @classmethod
    def fit(cls, rows: np.ndarray, seed: int = 5) -> Tree:
        rng, tree = np.random.default_rng(seed), cls(rows.shape[1])
        todo = [(0, rows)]
        while todo:
            node, part = todo.pop()
            groups = cls._kmeans(part, rng) if len(part) > LEAF else []
            if len(groups) < 2:
                tree.leaf_of[node] = len(tree.leaf_of)
                continue
            for centre, members in groups:
                tree.children[node].append(len(tree.centres))
                todo.append((len(tree.centres), members))
                tree.centres.append(centre)
                tree.children.append([])
        tree.centres = np.array(tree.centres)
        return tree

    @staticmethod
    def _kmeans(rows: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        """Spherical k-means of unit rows; empty clusters go."""
        centres = rows[rng.choice(len(rows), min(BRANCH, len(rows)), replace=False)]
        own = None
        for _ in range(12):
            now = np.argmax(rows @ centres.T, axis=1)
            if own is not None and np.array_equal(own, now):
                break
            own = now
            sums = np.array([rows[own == k].sum(axis=0) for k in range(len(centres)) if (own == k).any()])
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = sums / np.where(norms > 0, norms, 1)
        own = np.argmax(rows @ centres.T, axis=1)
        return [(centres[k], rows[own == k]) for k in range(len(centres)) if (own == k).any()]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit row: at each node on to the nearest child."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, index = todo.pop()
            kids = self.children[node]
            if not kids:
                out[index] = self.leaf_of[node]
                continue
            near = np.argmax(rows[index] @ self.centres[kids].T, axis=1)
            todo += [(kid, index[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, least: int = 0, first: int = 0) -> list[int]:
        """The first ``leaves`` leaves by best bin first: of all branches not yet entered, the one
        with the nearest centre is next; on the way down the siblings go to the queue. It goes on until
        the leaves hold ``least`` rows by ``sizes``, whose keys are the leaves' numbers from ``first`` on."""
        near = self.centres @ query
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or rows < least):
            node = heapq.heappop(queue)[1]
            while self.children[node]:
                kids = sorted(self.children[node], key=lambda k: -near[k])
                for kid in kids[1:]:
                    heapq.heappush(queue, (-near[kid], kid))
                node = kids[0]
            out.append(self.leaf_of[node])
            rows += sizes.get(first + out[-1], 0) if sizes else least
        return out


class Forest:
    """A tree for each length of vectors; leaves are numbered through. Lengths that the sample lacks have one leaf each."""

    def __init__(self, rows: list[np.ndarray]):
        self.trees = {r.shape[1]: Tree.fit(unit(r)) for r in rows}
        ends = np.cumsum([len(t.leaf_of) for t in self.trees.values()]).tolist()
        self.first = dict(zip(self.trees, [0, *ends]))

    def assign(self, rows: np.ndarray) -> np.ndarray:
        dim = rows.shape[1]
        return self.first[dim] + self.trees[dim].assign(rows) if dim in self.trees else np.full(len(rows), -dim)

    def visits(self, query: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        dim = len(query)
        if dim not in self.trees:
            return [-dim]
        first = self.first[dim]
        return [first + x for x in self.trees[dim].visits(query, leaves, sizes, least, first)]

    def __len__(self) -> int:
        return sum(len(t.leaf_of) for t in self.trees.values())


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` largest scores, the smaller id first among equal ones."""
    return np.lexsort((ids, -scores))[:k]


def _pairs(qid: np.ndarray, q_place: np.ndarray, query: np.ndarray, v_place: np.ndarray, vid: np.ndarray, vectors: np.ndarray, q_unit: np.ndarray, v_unit: np.ndarray, k: int) -> list[np.ndarray]:
    """(query's place, vector's place, score) of each query's ``k`` best among the vectors, its own id left out."""
    out = []
    for at in range(0, len(qid), 256):
        near = q_unit[at : at + 256] @ v_unit.T
        for i, row in enumerate(near):
            q = at + i
            row[vid == qid[q]] = -np.inf
            if len(row) > k:  # with all that rounding may have put behind the k-th
                limit = np.partition(row, len(row) - k)[len(row) - k] - 1e-9
                some = np.flatnonzero((row >= limit) & (vid != qid[q]))
            else:
                some = np.flatnonzero(vid != qid[q])
            a, b = query[q], vectors[some]
            scores = (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
            best = _best(vid[some], scores, k)
            out.append((np.full(len(best), q_place[q]), v_place[some][best], scores[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(df: DataFrame, queries: Column, k: int = 5, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where ``queries`` holds.

    Nearness is the cosine in doubles of the original vectors, ties to the smaller vec_id; vectors of
    another length have none and are no candidates. A tree for each length is fitted on the sampled rows
    of least hash; all rows are then put to the leaves. Queries go to as many leaves, best bin first, as
    let PROBES queries reach ``recall`` of their true neighbours, which one pass over all rows finds, and
    on until the leaves hold more than ``k`` rows. Leaves of over ``block`` rows or queries are dealt out in
    blocks. Null, empty, zero and non-finite vectors and null ids take no part; equal rows ask once, rows
    that share an id with different vectors have a ranking each, and candidates that share a vec_id are candidates of their own, but not the query's if it has that id; fewer candidates than ``k``: all of them.
    """
    spark = df.sparkSession
    rows = usable(df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("is_query")))
    size = min(MOST_SAMPLE, max(SAMPLE, df.count() // 16))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("embedding").toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if not picked.num_rows:
        return spark.createDataFrame([], schema)
    forest = spark.sparkContext.broadcast(Forest([m for _, m in by_length(picked.column("embedding"))]))
    vector = rows.schema["embedding"].dataType.simpleString()

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for at, vectors in by_length(batch.column("embedding")):
                leaf[at] = forest.value.assign(unit(vectors))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("vec_id"), batch.column("embedding"), batch.column("is_query")], names=["leaf", "vec_id", "embedding", "is_query"])

    indexed = materialize(rows.mapInArrow(to_leaves, f"leaf long, vec_id long, embedding {vector}, is_query boolean"), "leaves")
    probes = indexed.where("is_query").orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(PROBES).select("vec_id", "embedding").toArrow()
    if not probes.num_rows:
        return spark.createDataFrame([], schema)
    leaves = calibrate(indexed, forest.value, probes, k, recall)
    counts = indexed.groupBy("leaf").count()
    sizes = spark.sparkContext.broadcast({r.leaf: r["count"] for r in counts.collect()})  # a row a leaf

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                for index, vectors in by_length(some.column("embedding")):
                    to = [np.array(forest.value.visits(q, leaves, sizes.value, k + 1), np.int64) for q in unit(vectors)]
                    rows = pa.array(np.repeat(index, [len(x) for x in to]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), some.column("vec_id").take(rows), some.column("query").take(rows)], names=["leaf", "query_id", "query"])

    asking = indexed.where("is_query").select("vec_id", "embedding", F.xxhash64("vec_id", "embedding").alias("query")).dropDuplicates(["query"])
    routes = materialize(asking.mapInArrow(routed, "leaf long, query_id long, query long"), "routes")
    asked_by = routes.groupBy("leaf").count().withColumnRenamed("count", "asked")
    large = counts.join(asked_by, "leaf").where((F.col("count") > block) | (F.col("asked") > block))
    parts = large.select("leaf", F.ceil(F.col("count") / block).cast("int").alias("nb"), F.ceil(F.col("asked") / block).cast("int").alias("na"))
    parts = F.broadcast(parts)  # the trees have few leaves
    nb, na = F.coalesce("nb", F.lit(1)), F.coalesce("na", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = routes.join(parts, "leaf", "left").withColumn("blk", every(nb)).withColumn("ask", F.pmod("query", na).cast("int"))
    vectors = asking.select("query", F.col("embedding").alias("asks"))
    asked = asked.join(vectors, "query").select("leaf", "blk", "ask", "query_id", F.col("query").alias("row"), F.col("asks").alias("query"))
    held = indexed.join(parts, "leaf", "left").withColumn("ask", every(na)).withColumn("blk", F.pmod(F.xxhash64("vec_id"), nb).cast("int")).select("leaf", "blk", "ask", "vec_id", "embedding")

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        cols = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        if q.num_rows and v.num_rows:
            a, b = matrix(q.column("query")), matrix(v.column("embedding"))
            qid, vid = q.column("query_id").to_numpy(), v.column("vec_id").to_numpy()
            at, near, score = _pairs(qid, np.arange(len(qid)), a, vid, vid, b, unit(a), unit(b), k)
            cols = [pa.array(qid[at]), q.column("row").take(pa.array(at)).combine_chunks(), pa.array(near), pa.array(score)]
        return pa.table(cols, names=["query_id", "row", "vec_id", "score"])

    found = asked.groupBy("leaf", "blk", "ask").cogroup(held.groupBy("leaf", "blk", "ask")).applyInArrow(search, "query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(indexed: DataFrame, probes: pa.Table, k: int) -> pd.DataFrame:
    """Brute force: the ``k`` nearest of all rows for a bounded set of queries; each batch gives its own best."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {v.shape[1]: (probes.column("vec_id").to_numpy()[at], v) for at, v in by_length(probes.column("embedding"))}
        for batch in batches:
            for at, b in by_length(batch.column("embedding")):
                if b.shape[1] in asked and len(b):
                    ids, vectors = asked[b.shape[1]]
                    own = batch.column("vec_id").to_numpy()[at]
                    found = _pairs(ids, np.arange(len(ids)), vectors, np.arange(len(own)), own, b, unit(vectors), unit(b), k)
                    leaf = batch.column("leaf").to_numpy()[at][found[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(own[found[1]]), pa.array(found[2]), pa.array(leaf)], names=["query_id", "vec_id", "score", "leaf"])

    best = indexed.select("leaf", "vec_id", "embedding").mapInArrow(scan, "query_id long, vec_id long, score double, leaf long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toPandas()


def calibrate(indexed: DataFrame, forest: Forest, probes: pa.Table, k: int, recall: float) -> int:
    """How many leaves must be visited for ``recall`` of the probes' true neighbours: the true
    neighbours' leaves have places in the probe's order of visits, of which this is a quantile."""
    truth = exact_nearest(indexed, probes, k)
    if truth.empty:
        return 1
    ids, place = probes.column("vec_id").to_numpy(), {}
    for at, vectors in by_length(probes.column("embedding")):
        for i, q in zip(ids[at].tolist(), unit(vectors)):
            place[i] = {leaf: p for p, leaf in enumerate(forest.visits(q, len(forest)), 1)}
    need = np.sort([place[q].get(leaf, 1) for q, leaf in zip(truth.query_id, truth.leaf)])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])
