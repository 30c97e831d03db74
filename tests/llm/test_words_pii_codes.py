"""Spelling variants, personal data and vector codes against plain code."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sawmill.llm import pii, queries, spelling, vector_codes

# --- spelling variants ---------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def spelled(rng):
    stems = ["believe", "receive", "straße", "señorita", "Éclair", "across", "intern", "internet", "colour", "bbbbbbb"]
    out = []
    for _ in range(3000):
        word = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abeÿ") + word[at:], word[:at] + rng.choice("abe") + word[at + 1 :]])
        out.append(rng.choice([word, word.upper(), word.capitalize()]))
    return out


def test_spelling_query_against_all_pairs(spark, tmp_path):
    rng = random.Random(2)
    words = spelled(rng)
    rows = [(i, " ".join(words[i * 60 : i * 60 + 60]) + rng.choice([".", " x1y", "\n日本"])) for i in range(50)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (90, None), (91, ""), (92, "y" * 5000 + " " + "yy" * 3000), (92, "y" * 5000), (93, "y" * 5000 + "z " + "y" * 4999)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_spelling(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in out.collect()]
    expected = plain_variants(rows)
    assert len(found) == len(expected) and set(found) == expected and sum(r[1] is not None for r in expected) > 50


@pytest.mark.parametrize("together", [20_000, 20, 2])
def test_near_words_where_segments_are_hot(spark, together):
    """Words that share a half are halved again until each key has few; no pair gets lost or doubled."""
    rng = random.Random(5)
    words = {"inter" + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(250)}
    words |= {"".join(rng.choice("xy") for _ in range(rng.randrange(5, 9))) for _ in range(150)} | {"q" * k for k in range(5, 30)}
    rows = [(w, rng.randrange(3, 40)) for w in sorted(words)]
    found = [tuple(r) for r in spelling.near_words(spark.createDataFrame(rows, "word string, n long"), together=together, shard=2000).collect()]
    expected = {(a, b, n) for a, _ in rows for b, n in rows if one_edit(a, b)}
    assert len(found) == len(expected) and set(found) == expected


def test_spelling_of_nothing(docs, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(docs.select("doc_id", F.lit("ab cd 12").alias("text"))).count() == 0


# --- personal data -------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            fits = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and doubled % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15,
            }
            if fits[kind]():
                out.append((kind, *m.span()))
    return out


BITS = ["@", "a", ".", "-", "1", "22", "+", " ", "(", ")", "256", "é", "٣", "b.c", "4539 1488 0343 6467", "x@y.z", "+1 555 555 555", "1.2.3.4", "\n", "0001.2.3.4"]


def test_pii_base_by_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 12)))
        assert [s[:3] for s in pii.find(text) if s[4]] == plain_base(text), text


def test_pii_query_against_plain_code(docs, spark, tmp_path):
    rng = random.Random(3)
    more = ["".join(rng.choice(BITS) for _ in range(40)) for _ in range(40)] + ["pay to account DE89 3704 0044 0532 0130 00 now, 日本 a@b.co"]
    given = docs.select("doc_id", "text", F.upper("source").alias("pii"), F.upper("source").alias("spans"))
    given = given.unionByName(spark.createDataFrame([(1000 + i, t, "x", "y") for i, t in enumerate(more)] + [(None, more[0], None, None)] * 2, given.schema))
    given.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_pii(spark, str(tmp_path)).collect()
    texts = [(r.doc_id, r.text) for r in given.collect()]
    assert len(found) == len(texts)
    expected = Counter()
    for i, text in texts:
        base = plain_base(text)
        shown = ",".join(":".join(map(str, s)) for s in base)
        n = Counter(s[0] for s in base)
        expected[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(shown.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == expected
    last = next(r for r in found if r.doc_id == 1040)
    assert last.spans == "email:51:57,iban:15:42"
    redacted = {r.doc_id: r.text for r in pii.redact(given).where("doc_id is not null").collect()}
    assert redacted[1040] == "pay to account <iban> now, 日本 <email>" and redacted[0] is None


@pytest.mark.parametrize("text, spans", [
    ("iban GB82 WEST 1234 5698 7654 32.", [("iban", 5, 32, 1.0)]),
    ("iban GB82 WEST 1234 5698 7654 33.", []),  # the checksum is off
    ("ssn 123-45-6789", [("ssn", 4, 15, 0.75)]),
    ("part 123-45-6789", []),  # nothing nearby speaks for it
    ("ssn 666-45-6789", []),
    ("device 00:1a:2b:3c:4d:5e", [("mac", 7, 24, 0.75)]),
    ("sample device 00:1a:2b:3c:4d:5e", []),
])
def test_pii_checks_and_context(text, spans):
    assert [s[:4] for s in pii.find(text) if not s[4]] == spans


def test_pii_context_moves_base_scores():
    plain, near, doubted = (pii.find(t + "4539148803436467")[0][3] for t in ("x ", "visa card ", "test example "))
    assert doubted < plain < near <= 1.0


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 200_000, "+1" * 200_000, "a.b@" * 50_000, "AB12 " * 50_000, "1-" * 200_000, "+1 " + "(" * 300_000, "AB12" + "A1B2" * 50_000])
def test_pii_is_linear(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 3


def test_pii_of_nothing(empty):
    assert pii.summary(pii.annotate(empty)).count() == 0


# --- vector codes --------------------------------------------------------------------------------


def plain_codes(ids, vectors, rounds=2, entries=64):
    ints = [[int(np.floor(256 * float(x))) for x in v] for v in vectors]
    size = len(ints[0]) // 16
    parts = [[v[k * size : (k + 1) * size] for k in range(16)] for v in ints]
    first = sorted(range(len(ids)), key=lambda i: ids[i])[:entries]
    books = [[parts[i][k] for i in first] for k in range(16)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[k], e)), j) for j, e in enumerate(books[k])) for k in range(16)] for v in parts]

    for _ in range(rounds):
        now = assigned()
        for k in range(16):
            for j in range(len(books[k])):
                own = [v[k] for v, a in zip(parts, now) if a[k][1] == j]
                if own:
                    books[k][j] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{j:02x}" for _, j in row), sum(d for d, _ in row), sha) for row in assigned()]


def vectors(rng, n, size, spread=1.0):
    out = [[rng.gauss(0, spread) for _ in range(size)] for _ in range(n)]
    return out + out[: n // 5]  # repeated ones: ties


def test_vector_codes_against_plain_code(spark, tmp_path):
    rng = random.Random(9)
    wide, short = vectors(rng, 130, 32), vectors(rng, 20, 16, 300.0)
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(wide)] + [(1000 + i, v, 5) for i, v in enumerate(short)]
    bad = [(2000, None, 0), (2001, [], 0), (2002, [None] * 32, 0), (2003, [float("nan")] * 32, 0), (2004, [float("inf")] * 32, 0), (2005, [1.0] * 17, 0), (2006, [1e300] * 32, 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    expected = plain_codes(range(len(wide)), wide) + plain_codes(range(len(short)), short)
    by_label = Counter()
    for (_, _, label), (_, error, _) in zip(rows, expected):
        by_label[label] += error
    assert {tuple(r) for r in out.collect()} == {(i, code, error, by_label[label], sha) for (i, _, label), (code, error, sha) in zip(rows, expected)}


def test_nearest_entries_with_ties_and_huge_integers():
    rng = np.random.default_rng(4)
    for high, size in ((2, 3), (5, 1), (1 << 24, 8)):
        book = rng.integers(-high, high + 1, (64, size))
        book[40] = book[3]
        rows = np.concatenate([rng.integers(-high, high + 1, (500, size)), book])
        index, least = vector_codes.nearest_entries(vector_codes.ball_tree(book), book, rows)
        gaps = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == gaps.argmin(axis=1)).all() and (least == gaps.min(axis=1)).all()


def test_trees_leave_nodes_out():
    """On clustered entries most of a tree is not looked at."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (8, 4))
    book = (centres[:, None, :] + rng.integers(-9, 10, (8, 8, 4))).reshape(64, 4)
    seen, squares = 0, vector_codes._squares

    def counted(a, b):
        nonlocal seen
        seen += len(a)
        return squares(a, b)

    rows, tree = book + 1, vector_codes.ball_tree(book)
    vector_codes._squares = counted
    try:
        vector_codes.nearest_entries(tree, book, rows)
    finally:
        vector_codes._squares = squares
    assert seen < 0.6 * 64 * 64


def test_codes_of_few_none_and_many_labels(spark, monkeypatch):
    rows = [(i, [i / 10.0] * 16, i) for i in range(3)] + [(None, [9.0] * 16, None)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = vector_codes.compress(df)
    few = sorted(map(str, found.collect()))
    assert len(few) == 5 and vector_codes.compress(df.where("false")).count() == 0
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    monkeypatch.setattr(vector_codes, "HOT", 0.3)
    assert sorted(map(str, vector_codes.compress(df).collect())) == few
    rows = vector_codes.usable(df)
    books = vector_codes.fit(rows)
    back = vector_codes.decode(vector_codes.encode(rows, books), books, 16).where("id = 2").first().decoded
    assert np.allclose(back, 0.2, atol=1 / 256)
