"""SimHash near-dedup: fingerprints of word shingles, bit-sliced comparison, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from sawmill.llm.common import FEW_HOT, complete_groups, local_roots, materialize, put_columns, ranges, released, runs, small_batches, split_pairs, with_fields
from sawmill.llm.components import connected_components
from sawmill.llm.repeats import mix

#: Seed of the shingles' XXH64.
SEED = 42
#: Fingerprints of a bucket that one task compares at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 4096
#: Pairs of a query and a word of 64 lanes that are compared at once.
CHUNK = 1 << 14
#: ``near_copies``: shingle sets of this Jaccard similarity and more link. Bits of the fingerprints of two such sets differ
#: with probability APART at most (four shingles and the same with a fifth; larger sets: 0.162), so that of 256 bits over
#: WIDE differ in one of 10,000 pairs.
SIMILARITY, APART, WIDE = 0.8, 3 / 16, 72
#: Tables in which fingerprints of shingle sets meet, whatever their number, and the minima of the sets' hashes that a key
#: is made of: two sets at SIMILARITY share no key with probability (1 - 0.8 ** 5) ** 18 = 0.0008.
TABLES, MINIMA = 18, 5
#: Odd factors that order the hashes of shingles anew for each minimum.
FACTORS = np.random.default_rng(23).integers(0, 1 << 63, TABLES * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingle sets, and shingles in them, that one task compares at once (twice as many where two blocks meet).
SETS, SHINGLES = 1024, 1 << 20
#: Members of groups whose table (two longs each) is broadcast, at most.
FEW_MEMBERS = 1_000_000


def fingerprint(text: bytes | None, shingle: int = 4, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits; a bit is set if it is in over half of the hashes of the text's word
    shingles, repeats counted. Later words are of hashes made from the first ones'. No words: 0."""
    return majority(shingle_hashes(text, shingle), words)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a text in order; fewer words than that are one shingle."""
    tokens = text.lower().split() if text else []  # of bytes: A-Z, and white space as in [^\x20\x09-\x0D]+
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), len(tokens)
    starts = [0, *accumulate(len(w) + 1 for w in tokens)]
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a : b - 1], SEED) for a, b in zip(starts, starts[min(shingle, n) :])], np.uint64)


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 bits, set where over half of the hashes have them."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    out = np.empty(words, np.uint64)
    for k in range(words):
        own = mix(hashes + np.uint64(k)) if k else hashes
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over = 2 * bits.sum(axis=0, dtype=np.uint32) > len(hashes)
        out[k] = np.packbits(over, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = 4, words: int = 1) -> DataFrame:
    """``docs`` without its text but with ``out_col``, the fingerprint as signed longs; null text: as empty."""
    schema = with_fields(T.StructType([f for f in docs.schema if f.name != text_col]), T.StructField(out_col, T.ArrayType(T.LongType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            made = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle, words) for t in texts]
            flat = pa.array(np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * words), flat)
            yield put_columns(batch.drop_columns([text_col]), **{out_col: column})

    return small_batches(docs).mapInArrow(lambda b: released(run(b)), schema)


def masks_for(n: int, radius: int, per_bucket: int = 64) -> list[tuple[int, ...]]:
    """Masks one of which must agree for any two 64-bit fingerprints that differ in at most ``radius`` bits.

    64 bits in radius + t blocks: at least t blocks agree, so each choice of t blocks is a table. The
    least t whose tables spread ``n`` fingerprints to about ``per_bucket`` a bucket; no choice loses a pair.
    """
    for t in range(1, 5):
        blocks = radius + t
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        if t == 4 or n <= per_bucket << min(sum(m.bit_count() for m in c) for c in combinations(parts, t)):
            return [(sum(c),) for c in combinations(parts, t)]
    raise AssertionError


def sampled_masks(n: int, words: int, radius: int, miss: float = 0.05, per_bucket: int = 16, seed: int = 23) -> list[tuple[int, ...]]:
    """Masks of randomly drawn bits for wide fingerprints, whose radius is too large for ``masks_for``.

    As many bits as spread ``n`` fingerprints to about ``per_bucket`` a bucket; as many tables as miss
    two fingerprints right at ``radius`` with probability ``miss`` (nearer ones far more rarely).
    """
    bits = min(40, max(8, math.ceil(math.log2(max(n, 2) / per_bucket))))
    alike = (1 - radius / (64 * words)) ** bits
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(math.ceil(math.log(miss) / math.log1p(-alike))):
        drawn = rng.choice(64 * words, bits, replace=False).tolist()
        out.append(tuple(sum(1 << (b % 64) for b in drawn if b // 64 == w) for w in range(words)))
    return out


def lanes(fps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertical planes of groups of fingerprints (rows of 64-bit words).

    Each group starts a new word of 64 lanes. Gives the planes (bits, words), the lane's row (or -1) as
    (words, 64), and each group's bounds in words.
    """
    sizes = np.diff(bounds)
    words = -(-sizes // 64)
    ends = np.concatenate([[0], np.cumsum(words)])
    row = np.full(int(ends[-1]) * 64, -1, np.int64)
    row[ranges(ends[:-1] * 64, sizes)] = np.arange(bounds[0], bounds[-1])
    row = row.reshape(-1, 64)
    planes = []
    for k in range(fps.shape[1]):
        held = np.where(row >= 0, fps[row, k], np.uint64(0))
        bits = np.unpackbits(held.view(np.uint8).reshape(len(row), 64, 8), axis=2, bitorder="little")  # word, lane, bit
        planes.append(np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0])
    return np.concatenate(planes), row, ends


def near(planes: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of ``word[i]`` within ``radius`` of ``query[i]``: the i that have some, and their lane bits.

    Carry-save planes, as many as ``radius`` has bits, count each lane's differences and a further one
    keeps what overflows. After every eighth plane the pairs whose lanes have all gone beyond the
    radius are abandoned.
    """
    alive = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(query), np.uint64)
    far, one = over, np.uint64(1)
    for b in range(len(planes)):
        carry = planes[b][word] ^ (np.uint64(0) - (query[:, b // 64] >> np.uint64(b % 64) & one))
        for i, held in enumerate(counters):
            counters[i], carry = held ^ carry, held & carry
        over = over | carry
        if b % 8 == 7:
            far, same = over, ~np.uint64(0)
            for i in range(len(counters) - 1, -1, -1):
                if radius >> i & 1:
                    same = same & counters[i]
                else:
                    far, same = far | (same & counters[i]), same & ~counters[i]
            left = np.flatnonzero(valid[word] & ~far)
            if len(left) < len(alive):
                alive, query, word, far, over = alive[left], query[left], word[left], far[left], over[left]
                counters = [c[left] for c in counters]
            if not len(alive):
                break
    return alive, valid[word] & ~far


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each of TABLES: MINIMA minima of the set's hashes in as many orders."""
    low = np.full(TABLES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, (hashes[at : at + 4096, None] * FACTORS).min(axis=0), out=low)
    keys = np.zeros(TABLES, np.uint64)
    for column in low.reshape(TABLES, MINIMA).T:
        keys = mix(keys ^ column)
    return keys


def least_ids(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The least id of each row's local component: the same in most buckets that hold it, so that links repeat and few are left."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return least[root]


def linked(fps: DataFrame, radius: int = 4, block: int = BLOCK, words: int = 1, keys: str | None = None) -> DataFrame:
    """(a, b) links of distinct fingerprints (fp: array of ``words`` longs, rep: long) that differ in at most ``radius`` bits.

    All of them for one word; for more, those that ``sampled_masks`` bring together. With ``keys``, a column of TABLES
    longs, those with a key in common. Links are local: each task gives for each fingerprint of its buckets a
    representative of those it reaches there, so components of the links are those of all near pairs, without the pairs.
    """
    n = fps.count()
    masks = [] if keys else masks_for(n, radius) if words == 1 else sampled_masks(n, words, radius)

    def key(i: int, mask: tuple[int, ...]) -> Column:
        parts = [F.col("fp")[k].bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for k, m in enumerate(mask) if m]
        return F.struct(F.lit(i).alias("tab"), F.xxhash64(*parts).alias("key"))

    if keys:
        rows = fps.select(F.posexplode(keys).alias("tab", "key"), "fp", "rep")
    else:
        rows = fps.select("fp", "rep", F.explode(F.array(*[key(i, m) for i, m in enumerate(masks)])).alias("k")).select("k.tab", "k.key", "fp", "rep")
    order = ["tab", "key", "part_i", "part_j"]
    dealt = split_pairs(rows, ["tab", "key"], "rep", block, n * (len(masks) or TABLES)).repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in complete_groups(batches, order):
            cols = [groups.column(c).to_numpy() for c in order]
            bounds = runs(*cols)
            size = np.repeat(np.diff(bounds), np.diff(bounds))
            index = np.flatnonzero(size > 1)
            if not len(index):
                continue
            cols = [c[index] for c in cols]
            rep, blk = (groups.column(c).to_numpy()[index] for c in ("rep", "blk"))
            values = groups.column("fp").combine_chunks().take(pa.array(index)).flatten().to_numpy().view(np.uint64).reshape(-1, words)
            bounds, n = runs(*cols), len(index)
            planes, row, ends = lanes(values, bounds)
            valid = np.packbits(row >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            asks = np.flatnonzero(blk == cols[2])  # of two blocks the first asks
            width = np.diff(ends)[group[asks]]
            root = np.arange(n)
            step = 0
            while step < len(asks):
                upto = step + max(1, int(np.searchsorted(np.cumsum(width[step:]), CHUNK)))
                some = asks[step:upto]
                query = np.repeat(some, width[step:upto])
                word = ranges(ends[group[some]], width[step:upto])
                hit, bits = near(planes, valid, values[query], word, radius)
                where, lane = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                x, y = query[hit[where]], row[word[hit[where]], lane]
                apart = root[x] != root[y]
                root = local_roots(n, np.concatenate([np.arange(n), x[apart]]), np.concatenate([root, y[apart]]))
                step = upto
            low = least_ids(rep, root)
            out = np.flatnonzero(rep != low)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(low[out])], names=["a", "b"])

    return dealt.mapInArrow(lambda b: released(compare(b)), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z), words are what white space (space, \\t to \\r) parts, and fingerprints
    (``words`` times 64 bits, signed longs) that differ in at most ``radius`` bits link: with one word all
    such pairs, whatever their number; with more all but few near the radius (``sampled_masks``). component_id is
    the smallest doc_id reachable. Equal fingerprints are compared once. Null and empty texts have
    fingerprint 0. Rows without doc_id get their component from the others, null if there are none.
    """
    prints = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle=shingle, words=words), "prints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    parts = connected_components(linked(reps.where("rep is not null"), radius, BLOCK, words))
    known = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, the 128-bit hash (k1, k2) and the size n of the text's set of shingles, the set's fingerprint fp and its ``table_keys``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else None, shingle)) for t in batch.column("text").cast(pa.binary())]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            flat = np.concatenate([majority(s, words) for s in sets] or [np.zeros(0, np.uint64)]).view(np.int64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * words), pa.array(flat))
            found = np.concatenate([table_keys(s) for s in sets] or [np.zeros(0, np.uint64)]).view(np.int64)
            tables = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TABLES), pa.array(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([len(s) for s in sets], pa.int32()), fp, tables],
                names=["doc_id", "k1", "k2", "n", "fp", "keys"])

    return small_batches(docs).mapInArrow(lambda b: released(run(b)), "doc_id long, k1 long, k2 long, n int, fp array<long>, keys array<long>")


def member_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """component, node, number n of shingles, and set, their sorted 64-bit hashes as bytes, of each of ``members``
    (node, component); texts of other documents are not shuffled while the members are few."""
    few = members.count() <= FEW_MEMBERS
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(F.broadcast(members) if few else members, "node")
    texts = texts.groupBy("node", "component").agg(F.min("text").alias("text"))  # rows alike come once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else None, shingle)) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("component"), batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["component", "node", "n", "set"])

    return materialize(small_batches(texts).mapInArrow(lambda b: released(run(b)), "component long, node long, n long, set binary"), "sets")


def jaccard_roots(values: np.ndarray, sizes: np.ndarray, asks: np.ndarray, similarity: float, root: np.ndarray) -> np.ndarray:
    """The least row of each row's component under links of the rows ``asks`` to any whose sets have that Jaccard
    similarity, and of ``root`` as known before; ``values`` holds the sets one after another. Shared shingles are
    counted by postings, for all rows."""
    m, root = len(sizes), root.copy()
    code = np.unique(values, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    rows = np.repeat(np.arange(m), sizes)[order]
    counts = np.bincount(code)
    starts = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    for x in asks:
        if (root == root[x]).all():
            continue
        own = code[ends[x] - sizes[x] : ends[x]]
        shared = np.bincount(rows[ranges(starts[own], counts[own])], minlength=m)
        met = np.unique(root[shared >= similarity * (sizes[x] + sizes - shared) - 1e-9])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    return root


def set_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links of the groups ``known`` whose sets reach each other within (component, part_i, part_j), rows
    with ``asks`` compared with all of there; links are local as in ``linked``."""
    order = ["component", "part_i", "part_j"]
    rows = rows.select(*order, "node", "known", "asks", "set").repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in complete_groups(batches, order):
            bounds = runs(*[groups.column(c).to_numpy() for c in order])
            known, asks = (groups.column(c).to_numpy() for c in ("known", "asks"))
            for a, b in zip(bounds, bounds[1:]):
                if b - a < 2:
                    continue
                sets = [s.as_py() for s in groups.column("set").slice(a, b - a)]
                sizes = np.array([len(s) // 8 for s in sets], np.int64)
                names, at, which = np.unique(known[a:b], return_index=True, return_inverse=True)
                values = np.frombuffer(b"".join(sets), np.uint64) if sizes.any() else np.zeros(0, np.uint64)
                root = jaccard_roots(values, sizes, np.flatnonzero(asks[a:b]), similarity, at[which])
                low = least_ids(known[a:b], root)[at]
                out = np.flatnonzero(names != low)
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(low[out])], names=["a", "b"])

    return rows.mapInArrow(lambda b: released(compare(b)), "a long, b long")


def verified(sets: DataFrame, similarity: float, block: int = SETS, shingles: int = SHINGLES) -> DataFrame:
    """(a, b) links of the nodes of ``sets`` (``member_sets``) that have a Jaccard similarity of ``similarity`` or more,
    by exact counts, between all nodes of a component, without the pairs.

    Components beyond ``block`` sets or ``shingles`` shingles are dealt out twice, each time a set to one block, by other
    hashes: what truly is alike has become one cluster by then. Only sets of different clusters are compared
    further, all of them: each large cluster in cells of its own, small ones in common cells, cells of one
    large cluster never with each other. A component that is one cluster is done, and its sets were sent twice.
    """
    def blocks(m: str, t: str) -> Column:
        return F.greatest(F.ceil(F.col(m) / block), F.ceil(F.col(t) / shingles)).cast("int")

    total = sets.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    few = total.m // block + total.t // shingles <= FEW_HOT  # components, and clusters, of more than one block at most
    small = F.broadcast if few else lambda df: df
    sums = (F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    heavy = materialize(sets.groupBy("component").agg(*sums).withColumn("nb", blocks("m", "t")).where("nb > 1").select("component", "nb"), "heavy")

    def dealt(rows: DataFrame, seed: int) -> DataFrame:
        blk = F.pmod(F.xxhash64(F.lit(seed), "node"), F.coalesce("nb", F.lit(1))).cast("int")
        return set_links(rows.select("component", blk.alias("part_i"), blk.alias("part_j"), "node", F.col("node").alias("known"), F.lit(1).alias("asks"), "set"), similarity)

    held = sets.join(small(heavy), "component")
    links = materialize(dealt(sets.join(small(heavy), "component", "left"), 1).union(dealt(held, 2)), "links")
    if heavy.isEmpty():
        return links
    clusters = connected_components(links).select("node", F.col("component").alias("known"))
    light = held.select("component", "node", "n").join(clusters, "node", "left").withColumn("known", F.coalesce("known", "node"))
    light = materialize(light, "clusters")
    large = light.groupBy("component", "known").agg(*sums).where(blocks("m", "t") > 1).select("component", "known", F.col("known").alias("own"))
    light = light.join(small(large), ["component", "known"], "left")  # own: the large cluster, null in small ones
    cells = light.groupBy("component", "own").agg(*sums).withColumn("i", F.explode(F.sequence(F.lit(1), blocks("m", "t"))))
    cells = cells.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("own", "i"))).alias("cells"))
    at = F.sequence(F.lit(0), F.size("cells") - 1)
    mine = F.filter(at, lambda p: F.col("cells")[p]["own"].eqNullSafe(F.col("own")))
    others = F.when(F.col("own").isNull(), at).otherwise(F.filter(at, lambda p: ~F.col("cells")[p]["own"].eqNullSafe(F.col("own"))))
    light = light.join(small(cells.where("size(cells) > 1 or cells[0].own is null")), "component").withColumn("mine", mine).withColumn("others", others)
    light = light.select("node", "known", F.col("mine")[F.pmod(F.xxhash64(F.lit(3), "node"), F.size("mine")).cast("int")].alias("cell"), "others")
    rest = held.join(light, "node").withColumn("o", F.explode("others"))
    rest = rest.withColumn("part_i", F.least("cell", "o")).withColumn("part_j", F.greatest("cell", "o"))
    return links.union(set_links(rest.withColumn("asks", (F.col("cell") == F.col("part_i")).cast("int")), similarity))


def near_copies(docs: DataFrame, shingle: int = 5, words: int = 4) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id: long and not null, text); rows of one doc_id have one text.

    Texts link if their sets of word shingles (words as in ``near_duplicates``, shingles by their 64-bit hashes) have
    a Jaccard similarity of SIMILARITY or more; component_id is the smallest doc_id reachable. Equal sets are compared
    once. Fingerprints of the sets only search: those with one of their ``table_keys`` in common and within WIDE bits make
    groups, in which ``verified`` counts shared shingles. A pair right at SIMILARITY is lost here with probability 0.001 at
    most, and less if others bring it into one group. Sets too small to reach SIMILARITY with another are not compared.
    """
    docs = docs.select("doc_id", "text")
    prints = materialize(shingle_sets(docs, shingle, words), "prints")
    key = ["k1", "k2"]
    reps = materialize(prints.groupBy(*key, "n", "fp", "keys").agg(F.min("doc_id").alias("rep")), "reps")
    some = reps.where(F.col("n") + 1e-9 >= SIMILARITY * (F.col("n") + 1))
    groups = connected_components(linked(some.select("fp", "rep", "keys"), WIDE, BLOCK, words, "keys"))
    parts = connected_components(verified(member_sets(docs, groups, shingle), SIMILARITY))
    known = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", *key).join(known, key).select("doc_id", "component_id")
