"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, from a block-max inverted index.

Terms are all words of the examples and the first bytes of the longer ones (a term beside the word, as
spellings vary); texts are read whole. The index has two kinds of terms. The few that a large part of the
examples holds are rows of a matrix, and a batch of texts is multiplied with it. All others have postings in
blocks of examples with each block's largest weight: a block is opened if what the matrix gave its
examples, and those largest weights, could bring one among the nearest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import give_back, materialize, put_columns, ranges, released, runs, small_batches, with_fields

#: Labelled rows of each class that the examples are taken from, at most (those of least hash).
EXAMPLES = 2000
#: Nearest examples that vote, and the weight of the vote against that is always there.
NEIGHBOURS, AGAINST = 128, 0.5
#: Examples of a block of the index; a term in more than a part of HEAVY of the examples is in the matrix.
BLOCK, HEAVY = 64, 1 / 12
#: Texts that are multiplied with the matrix at once (always as many, so that each gets the same sums).
BATCH = 256
#: Texts of a batch, and their bytes, about, that words are looked up for at once.
LOOKUP_ROWS, LOOKUP_BYTES = 4000, 6 << 20
#: Bytes of a word that make its stem.
STEM = 4
#: Share of pairs of a toxic and a clean example that the others' votes must order right; a model of less tells nothing.
ORDERED = 0.6
THRESHOLD = 0.3

#: ASCII capitals to lower case, other ASCII but letters and digits to spaces; bytes of other characters stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def terms(text: bytes | None) -> Counter[bytes]:
    """Words of a text and, for words longer than that, their first STEM bytes (with a mark), counted."""
    words = Counter(text.translate(FOLD).split()) if text else Counter()
    stems: Counter[bytes] = Counter()
    for word, n in words.items():
        if len(word) > STEM:
            stems[b"^" + word[:STEM]] += n
    words.update(stems)
    return words


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts: whose each is, its code, and the distinct words by code."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]].tobytes().translate(FOLD)
    folded = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds - bounds[0]).astype(np.int32)), pa.py_buffer(data)])
    parts = pc.split_pattern(folded, " ")
    flat, doc = parts.flatten(), np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return doc[some.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(), coded.dictionary


def _stems(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which words are longer than their stem, and their stems."""
    long = np.flatnonzero(pc.greater(pc.binary_length(words), STEM).to_numpy(zero_copy_only=False))
    return long, pc.binary_slice(words.take(pa.array(long)), 0, STEM)


@dataclass
class Vocabulary:
    """Terms by number: words in order, then stems in order."""

    words: pa.Array
    stems: pa.Array

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def names(self) -> list[bytes]:
        return self.words.to_pylist() + [b"^" + s for s in self.stems.to_pylist()]

    @classmethod
    def of(cls, words: list[bytes]) -> Vocabulary:
        words = sorted(set(words))
        return cls(pa.array(words, pa.binary()), pa.array(sorted({w[:STEM] for w in words if len(w) > STEM}), pa.binary()))

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the known terms of texts, in order."""
        doc, code, names = _words(texts)
        if not len(doc) or not len(self):
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        long, stems = _stems(names)
        of_word = pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy().astype(np.int64)
        of_stem = np.full(len(names), -1)
        found = pc.fill_null(pc.index_in(stems, value_set=self.stems), -1).to_numpy().astype(np.int64)
        of_stem[long] = np.where(found < 0, -1, found + len(self.words))
        term = np.concatenate([of_word[code], of_stem[code]])
        doc = np.concatenate([doc, doc])[term >= 0]
        key, n = np.unique(doc * len(self) + term[term >= 0], return_counts=True)
        return key // len(self), key % len(self), n


class Index:
    """Unit TF-IDF vectors of the examples by term: postings in example order, and each term's blocks with the
    largest weight in them. Heavy terms' postings are also the rows of ``matrix``.

    Only postings are sent; blocks and matrix are made where they are used.
    """

    def __init__(self, labels: np.ndarray, ids: list, starts: np.ndarray, refs: np.ndarray, weights: np.ndarray):
        self.labels, self.ids = labels, ids
        self.starts, self.refs, self.weights = starts.astype(np.int32), refs.astype(np.int32), weights  # of a term's postings
        self.matrix: np.ndarray | None = None

    def __reduce__(self):
        return Index, (self.labels, self.ids, self.starts, self.refs, self.weights)

    def make(self) -> None:
        """``parts``: of a term's blocks in ``blocks``, ``bounds`` (of their postings) and ``most``; ``row`` of a heavy
        term in ``matrix``, else -1."""
        size = np.diff(self.starts)
        term = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.bounds = runs(term, self.refs // BLOCK).astype(np.int32)
        self.parts = np.searchsorted(self.bounds[:-1], self.starts).astype(np.int32)
        self.blocks = self.refs[self.bounds[:-1]] // BLOCK
        self.most = np.maximum.reduceat(self.weights, self.bounds[:-1]) if len(term) else np.zeros(0)
        self.row = np.full(len(size), -1, np.int32)
        heavy = np.flatnonzero(size > max(8, HEAVY * len(self.labels)))
        self.row[heavy] = np.arange(len(heavy))
        self.matrix = np.zeros((len(heavy), -(-len(self.labels) // BLOCK) * BLOCK))
        for term in heavy.tolist():
            some = slice(self.starts[term], self.starts[term + 1])
            self.matrix[self.row[term], self.refs[some]] = self.weights[some]

    def nearest(self, doc: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` unit queries, given as entries (query in order, term, weight), the ``k`` examples of
        largest cosine above zero, ties by place; exact."""
        if self.matrix is None:
            self.make()
        cuts, matrix = np.searchsorted(doc, np.arange(n + 1)), self.matrix
        for begin in range(0, n, BATCH):
            end = min(n, begin + BATCH)
            some = slice(cuts[begin], cuts[end])
            row = self.row[at[some]]
            heavy = row >= 0
            dense = np.zeros((BATCH, len(matrix)))
            dense[doc[some][heavy] - begin, row[heavy]] = weight[some][heavy]
            sums = dense @ matrix
            for i in range(begin, end):
                own = slice(cuts[i], cuts[i + 1])
                light = self.row[at[own]] < 0
                yield self._finish(sums[i - begin], at[own][light], weight[own][light], k)

    def _finish(self, sums: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Add what light terms give to ``sums``, but only in blocks whose bound reaches the k-th sum so far."""
        count = self.parts[at + 1] - self.parts[at]
        part, w = ranges(self.parts[at], count), np.repeat(weight, count)
        block = self.blocks[part]
        most = sums.reshape(-1, BLOCK).max(axis=1)
        bound = most + np.bincount(block, w * self.most[part], minlength=len(most))
        least = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0
        opened = bound >= least - 1e-12
        some = np.flatnonzero(opened[block])
        begin = self.bounds[part[some]]
        count = self.bounds[part[some] + 1] - begin
        posting = ranges(begin, count)
        sums = sums + np.bincount(self.refs[posting], np.repeat(w[some], count) * self.weights[posting], minlength=len(sums))
        if len(opened) and not opened.all():
            sums.reshape(-1, BLOCK)[~opened] = 0.0
        found = np.flatnonzero(sums > 0)
        if len(found) > k:
            limit = np.partition(sums[found], len(found) - k)[len(found) - k]
            found = found[sums[found] >= limit]
        best = found[np.lexsort((found, -sums[found]))[:k]]
        return best, sums[best]


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: Index
    slope: float
    offset: float
    usable: bool = True

    def votes(self, texts: pa.Array) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text the vote of its nearest examples, these, and their cosines."""
        entries = unit_vectors(*self.vocabulary.count(texts), self.idf)
        return self.votes_of(*entries, len(texts))

    def votes_of(self, doc: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, own: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Votes of texts given as entries; ``own``: each one's place among the examples, which then doesn't vote."""
        for i, (refs, cosines) in enumerate(self.index.nearest(doc, at, weight, n, NEIGHBOURS + (own is not None))):
            if own is not None:
                other = refs != own[i]
                refs, cosines = refs[other][:NEIGHBOURS], cosines[other][:NEIGHBOURS]
            yield float((cosines * self.index.labels[refs]).sum() / (cosines.sum() + AGAINST)), refs, cosines

    def probability(self, vote: float) -> float:
        if not self.usable:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -30, 30))))


def unit_vectors(doc: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (text, term, weight) of unit TF-IDF vectors; terms that all documents have weigh nothing."""
    weight = (1 + np.log(n)) * idf[term] if len(n) else np.zeros(0)
    norm = np.sqrt(np.bincount(doc, weight * weight)) if len(n) else np.zeros(0)
    keep = weight > 0
    return doc[keep], term[keep], weight[keep] / norm[doc[keep]]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches by about LOOKUP_BYTES of text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, LOOKUP_BYTES + (sizes[at - 1] if at else 0), "right")))
            yield batch.slice(at, upto - at)
            at = upto


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic") -> Model:
    """Learn from the labels of rows of ``labels`` (doc_id, label) where ``train`` holds.

    Examples are at most EXAMPLES rows of each class, those of least hash of doc_id (a bounded sample;
    several labels of a document: the largest). Terms are all of the examples', and their document
    frequencies are counted over all of ``docs``. The calibration is fitted on the votes that each example gets from
    all others, weighted to the classes' share of all training labels, so that none is lost to it. Of rows that
    share a doc_id one gives the vector. With fewer than two examples of a class, or where these votes don't order
    ORDERED of the pairs of either class right, nothing can be told apart: the model is not usable, and every text gets the score 0.
    """
    spark = small_batches(docs, LOOKUP_ROWS).sparkSession
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    least = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("y") == y).orderBy(*least).limit(EXAMPLES) for y in (0, 1)]
    picked = [r for part in picked for r in part.collect()]  # 2 * EXAMPLES ids at most
    chosen = spark.createDataFrame(picked, known.schema)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    examples = materialize(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "examples")  # a row an id, by partial sums

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_words(batch.column("text"))[2]], names=["term"])

    words = examples.mapInArrow(distinct, "term binary").distinct().toArrow().column("term").to_pylist()  # of bounded examples
    vocabulary = Vocabulary.of(words)
    sent = spark.sparkContext.broadcast(vocabulary)
    idf = _idf(docs, sent)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, n = sent.value.count(batch.column("text"))
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(rows), pa.array(term, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "at", "n"])

    got = examples.mapInArrow(counts, "doc_id long, at int, n int").toArrow()
    there = set(examples.select("doc_id").toArrow().column("doc_id").to_pylist())
    used = sorted((r for r in picked if r.doc_id in there), key=lambda r: r.doc_id)
    doc, at, n = (got.column(c).to_numpy() for c in ("doc_id", "at", "n"))
    doc = np.searchsorted([r.doc_id for r in used], doc)
    order = np.lexsort((at, doc))
    doc, at, weight = unit_vectors(doc[order], at[order], n[order], idf)
    del got, order, n
    y = np.array([r.y for r in used], np.int64)
    index, place = build_index([(r.doc_id, r.y) for r in used], doc, at, weight, len(vocabulary))
    model = Model(vocabulary, idf, index, 0.0, 0.0, min(int((y == k).sum()) for k in (0, 1)) > 1)
    if model.usable:
        votes = np.array([v for v, _, _ in model.votes_of(doc, at, weight, len(used), place)])
        model.slope, model.offset = _platt(votes, y, share)
        apart = votes[y == 1][:, None] - votes[y == 0][None, :]
        model.usable = model.slope > 0 and float((apart > 0).mean() + (apart == 0).mean() / 2) >= ORDERED
    model.index.matrix = None
    give_back()
    return model


def build_index(examples: list[tuple[int, int]], doc: np.ndarray, at: np.ndarray, weight: np.ndarray, n_terms: int) -> tuple[Index, np.ndarray]:
    """Postings of the examples (id, label) from entries (example in order, term, weight), and each example's place; examples
    with the same strongest term are put side by side, so that blocks' largest weights are close to their own."""
    strongest = np.full(len(examples), n_terms)
    order = np.lexsort((-weight, doc))
    first = runs(doc[order])[:-1]
    strongest[doc[order[first]]] = at[order[first]]
    chosen = np.argsort(strongest, kind="stable")
    place = np.empty(len(examples), np.int64)
    place[chosen] = np.arange(len(chosen))
    ref = place[doc]
    order = np.lexsort((ref, at))
    starts = np.searchsorted(at[order], np.arange(n_terms + 1))
    return Index(np.array([examples[i][1] for i in chosen], float), [examples[i][0] for i in chosen], starts, ref[order], weight[order]), place


def _idf(docs: DataFrame, sent: Broadcast) -> np.ndarray:
    """Inverse document frequencies over all of ``docs`` of a sent vocabulary, log of documents to those with the term,
    each and one more; each task sends one count a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(sent.value), np.int64), 0
        for batch in _batches(batches):
            total += np.bincount(sent.value.count(batch.column("text"))[1], minlength=len(total))
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["at", "n"])

    counts = docs.select("text").mapInArrow(lambda b: released(count(b)), "at long, n long")
    sums = counts.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a term at most
    seen = np.zeros(len(sent.value) + 1)  # the last: documents
    seen[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return np.log((1 + seen[-1]) / (1 + seen[:-1]))


def _platt(votes: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic slope (not below 0) and offset of the votes, classes weighted to ``share``, by damped Newton steps."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-2 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (double, 0 to 1), predicted (1 from ``threshold`` on) and evidence: the nearest
    examples as (doc_id, cosine, label), at most three.

    Whole texts; null and empty ones have no terms and get the score of an even absence of votes. The
    model (2 * EXAMPLES vectors at most and their terms) is broadcast; rows are not shuffled. Columns of
    the new ones' names give way.
    """
    sent = small_batches(docs, LOOKUP_ROWS).sparkSession.sparkContext.broadcast(model)
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
    schema = with_fields(docs.schema, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False), T.StructField("evidence", evidence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in _batches(batches):
            scores, shown = [], []
            for vote, refs, cosines in m.votes(batch.column("text")):
                scores.append(m.probability(vote))
                shown.append([{"doc_id": m.index.ids[r], "cosine": float(c), "label": int(m.index.labels[r])} for r, c in zip(refs[:3], cosines[:3])])
            predicted = [int(s >= threshold) for s in scores]
            yield put_columns(batch, score=pa.array(scores, pa.float64()), predicted=pa.array(predicted, pa.int32()), evidence=pa.array(shown, arrow))

    return docs.mapInArrow(lambda b: released(run(b)), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of doc_id as text leaves 2 by 4; null ids are among none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
