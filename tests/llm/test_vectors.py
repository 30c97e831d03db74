"""Embedding operators, components and SimHash against brute force."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sawmill.llm import ann, embedding_dedup, simhash
from sawmill.llm.components import connected_components

INF = float("inf")


def groups(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 24))
    near = np.repeat(base[:1], 90, axis=0) + 0.05 * rng.standard_normal((90, 24))
    more = base[10:30] + 0.1 * rng.standard_normal((20, 24))
    rows = np.concatenate([base, near, more, base[:1], base[:1], 3 * base[5:6]]).astype(np.float32)
    data = [(i, [float(x) for x in r], i % 4) for i, r in enumerate(rows)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [INF] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    data += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    return rows.astype(np.float64), spark.createDataFrame(data, "vec_id long, embedding array<float>, kept int")


def cosines(rows):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return unit @ unit.T


def test_vectors_of_several_lengths(spark):
    """Only vectors of one length are compared, however rare the length is; clashing columns are left alone."""
    rng = np.random.default_rng(21)
    data = [(i, [float(x) for x in rng.standard_normal(2)]) for i in range(30)] + [(i, [1.0, 2.0, 3.0]) for i in (40, 41)] + [(42, [3.0, 2.0, 1.0]), (50, [5.0]), (60, None), (50, [5.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("leaf", "score", "rank", "rep", "tab", "w", "vec")])
    rows = embedding_dedup.near_duplicates(df).collect()
    found = {r.vec_id: r for r in rows}
    assert len(rows) == len(data) and (found[40].n_links, found[41].component_id, found[42].n_links, found[60].n_links) == (1, 40, 0, 0)
    assert found[50].n_links == 1
    for i in range(30):
        near = [j for j in range(30) if j != i and np.dot(data[i][1], data[j][1]) >= 0.95 * np.linalg.norm(data[i][1]) * np.linalg.norm(data[j][1])]
        assert found[i].n_links == len(near)
    near = {}
    for r in ann.nearest(df, F.col("vec_id") >= 0).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(near[40]) == [(1, 41), (2, 42)] and 50 not in near and all(sorted(x for x, _ in near[i]) == [1, 2, 3, 4, 5] for i in range(30))


def test_few_leaves_are_searched(spark):
    """Where vectors have clusters, a quarter of the leaves is enough for nine tenths of the neighbours."""
    rng = np.random.default_rng(22)
    centres = rng.standard_normal((60, 32))
    rows = np.repeat(centres, 60, axis=0) + 0.35 * rng.standard_normal((3600, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    seen, calibrate = [], ann.calibrate
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ann, "calibrate", lambda indexed, forest, *a: seen.append((calibrate(indexed, forest, *a), len(forest))) or seen[-1][0])
        found = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    near = cosines(rows)
    np.fill_diagonal(near, -2)
    truth = {(q, int(v)) for q in range(0, 3600, 20) for v in np.argsort(-near[q])[:5]}
    assert len(found & truth) >= 0.9 * len(truth) and seen[0][0] <= 0.25 * seen[0][1]


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates(vectors, block):
    rows, df = vectors
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    link = cosines(rows) >= 0.95
    np.fill_diagonal(link, False)
    label = groups(len(rows), np.argwhere(link).tolist())
    assert len(found) == df.count()
    for i in range(len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (link[i].sum(), label[i], label[i] == i)
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(1000, 1007))
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [4096, 8])
def test_nearest(vectors, block):
    rows, df = vectors
    found = ann.nearest(df, F.col("vec_id") % 3 == 0, block=block).collect()
    near, hits = cosines(rows), 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in range(len(rows)) if i % 3 == 0}
    for q, got in by.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in got}
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(got, got[1:]))
        assert all(abs(r.score - near[q, r.vec_id]) < 1e-12 for r in got)
        others = [i for i in range(len(rows)) if i != q]
        best = sorted(others, key=lambda i: (-round(near[q, i], 12), i))[:5]
        hits += len(set(best) & {r.vec_id for r in got})
    assert hits >= 0.9 * 5 * len(by)
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == sorted((1, 2), key=lambda i: -near[0, i])
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


def test_rows_of_one_id_have_a_ranking_each(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, k=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(50, 1, 1), (50, 1, 2)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 1)], "a long, b long")
    label = groups(600, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in connected_components(df).collect()} == {(i, label[i]) for i in linked}
    assert connected_components(df.where("false")).count() == 0


def plain_fingerprint(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block, radius, size", [(4096, 4, 4), (2, 4, 4), (4096, 7, 5)])
def test_simhash(docs, texts, block, radius, size, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs, radius, size).collect()}
    prints = [plain_fingerprint(t, size) for t in texts]
    label = groups(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius])
    assert [(found[i].fp[0] % 2**64, found[i].component_id) for i in range(len(texts))] == list(zip(prints, label))
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**13])
def test_masks_lose_no_pair(n):
    rng = np.random.default_rng(5)
    for radius in (4, 7):
        masks = simhash.masks_for(n, radius)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not flips & m[0] for m in masks)


def test_linked_in_blocks(spark):
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 2**63, 12)
    fps = list(dict.fromkeys(int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(40)))
    df = spark.createDataFrame([([f], i) for i, f in enumerate(fps)], "fp array<long>, rep long")
    label = groups(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    for block in (4096, 10):
        got = {r.node: r.component for r in connected_components(simhash.linked(df, 4, block)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == label


def test_wide_fingerprints_link_similar_texts(spark):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(5000)]
    base = [list(rng.choice(words, 300)) for _ in range(40)]
    rows = []
    for i, text in enumerate(base):
        rows.append((i, " ".join(text)))
        for k, changes in ((1, 4), (2, 90)):  # one near copy, one that shares about two fifths of the words' places
            other = list(text)
            for at in rng.choice(300, changes, replace=False):
                other[at] = str(rng.choice(words))
            rows.append((i + 100 * k, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 44, 5, 4).collect()}
    assert sum(found[i + 100] == i for i in range(40)) >= 38
    assert all(found[i] == i and found[i + 200] == i + 200 for i in range(40))


def test_near_copies_are_those_of_jaccard(spark):
    """Pairs of exact similarity around 0.8, against brute force; a fingerprint radius alone gets these wrong."""
    rng = np.random.default_rng(14)
    rows = []
    for i in range(150):
        n = int(rng.integers(60, 300))
        text = [f"w{x}" for x in rng.integers(0, 20000, n)]
        gap = n * (0.05 + 0.2 * rng.random())  # words at the end that differ
        rows += [(i, " ".join(text)), (1000 + i, " ".join(text[: int(n - gap)] + [f"v{x}" for x in rng.integers(0, 20000, int(rng.integers(0, gap + 1)))]))]
    few = "a b c d e f g h i"
    rows += [(2000, None), (2001, ""), (2002, few[:-2]), (2003, few), (2004, "a b c d e f g"), (2005, "a b c d e f"), (2006, few.upper()), (2007, "A b"), (2008, "a  b")]
    rows += [(2003, few)] * 5 + [(3000 + i, " ".join(["line one of many", str(i)] * 200)) for i in range(3)]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    near = [(x, y) for x, i in enumerate(ids) for y, j in enumerate(ids[:x]) if like(sets[i], sets[j])]
    assert 30 < len(near) < 140
    want = [ids[r] for r in groups(len(ids), near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_copies(df).collect()
    assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == dict(zip(ids, want))


@pytest.mark.parametrize("block, shingles", [(4096, 1 << 20), (7, 1 << 20), (1, 1 << 20), (4096, 400)])
def test_jaccard_links_in_blocks(spark, block, shingles):
    """A chain of links, a large cluster with small ones beside it and single sets, all in one component, as all pairs give them."""
    rng = np.random.default_rng(16)
    text = [f"w{i}" for i in range(100)]
    sets = {i: text[: 100 - i] for i in range(40)} | {50: text[30:]}
    sets |= {100 + i: [*text[20:90], f"x{i}"] for i in range(30)}  # alike among themselves
    sets |= {200 + i: [f"y{i % 4}-{k}" for k in range(60)] + [f"z{x}" for x in rng.integers(0, 99, rng.integers(0, 30))] for i in range(24)}
    ids = [*sets]
    shingled = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in sets.values()]
    near = [(x, y) for x in range(len(ids)) for y in range(x) if len(shingled[x] & shingled[y]) >= 0.8 * len(shingled[x] | shingled[y]) - 1e-9]
    want = [ids[r] for r in groups(len(ids), near)]
    assert 3 < len(set(want)) < 40
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in sets.items()] + [(3, " ".join(text[:97]))], "doc_id long, text string")
    members = df.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("component")).distinct()
    links = simhash.verified(simhash.member_sets(df, members, 5), 0.8, block, shingles)
    parts = {r.node: r.component for r in connected_components(links).collect()}
    assert [parts.get(i, i) for i in ids] == want
    assert simhash.verified(simhash.member_sets(df, members.where("false"), 5), 0.8, block, shingles).count() == 0


def test_tables_miss_few():
    """The chance that a pair right at the similarity is lost: by the numbers and on sets."""
    beyond = sum(math.comb(256, d) * simhash.APART**d * (1 - simhash.APART) ** (256 - d) for d in range(simhash.WIDE + 1, 257))
    assert beyond + (1 - simhash.SIMILARITY**simhash.MINIMA) ** simhash.TABLES < 0.001
    rng = np.random.default_rng(15)
    lost, unlike = 0, 0
    for _ in range(3000):
        own = rng.integers(0, 2**63, 100, np.uint64)
        other = np.concatenate([own[:80], rng.integers(0, 2**63, 10, np.uint64)])
        ours = simhash.table_keys(own[:90])
        lost += not (ours == simhash.table_keys(other)).any()  # 80 shared of 100
        unlike += bool((ours == simhash.table_keys(np.concatenate([own[:20], other[80:]]))).any())
    assert lost <= 12 and unlike < 60
    long = rng.integers(0, 2**63, 10000, np.uint64)
    assert (simhash.table_keys(long) == simhash.table_keys(rng.permutation(long))).all()
