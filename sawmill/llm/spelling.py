"""Spelling variants: words one edit apart, found by automata over the halves of all words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress, count
from operator import ne

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import materialize, released, small_batches

#: Code points and occurrences that a word needs, at least; how much commoner a form must be than its variant.
SHORTEST, RAREST, COMMONER = 5, 3, 2
#: One run in so many, chosen by its checksum, loses a code point.
SLIPS = 97
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Code points of the segments that an automaton holds, about.
SHARD = 1_000_000
#: Words with one segment up to which a shard takes them together; beyond, the rest of these words is halved again.
TOGETHER = 20_000
#: Counts of hot segments up to which their table is broadcast.
FEW_HOT = 200_000


def words_of(text: bytes, doc_id: int | None) -> Iterator[str]:
    """The runs of letters of a text, A-Z in lower case; where SLIPS divides the checksum of ``<doc_id>:<run>``,
    a code point of the run is missing. Runs shorter than SHORTEST are left out, and so are those that become it."""
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for word in RUN.findall(text.lower().decode("utf-8", "replace")):
        h = zlib.crc32(word.encode(), start)
        if h % SLIPS:
            yield word
        elif len(word) > SHORTEST:
            at = h % len(word)
            yield word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words that all texts together hold at least ``rarest`` times; each task adds up before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                if text.is_valid:
                    found.update(words_of(text.as_py(), doc_id))
                if len(found) > COUNTED:
                    yield handed()
                    found.clear()
        yield handed()

    some = small_batches(docs.select(F.col(id_col).cast("long"), text_col)).mapInArrow(lambda b: released(count(b)), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    gap = len(b) - len(a)
    if gap > 1 or a == b:
        return False
    at = next(compress(count(), map(ne, a, b)), len(a))
    return a[at:] == b[at + 1 :] if gap else a[at + 1 :] == b[at + 1 :]


def _cuts(rest: Column, before: Column, after: Column) -> Column:
    """Both ways to hold a half of what is left of a word between its first ``before`` and last ``after`` code points."""
    half = F.floor(rest / 2).cast("int")
    return F.array(F.struct((before + half).alias("p"), after.cast("int").alias("q")), F.struct(before.cast("int").alias("p"), (after + rest - half).alias("q")))


def _keyed(rows: DataFrame, cuts: Column) -> DataFrame:
    """A row for each cut, with the key of its outer parts: the first p and the last q code points."""
    rows = rows.withColumn("_c", F.explode(F.array_distinct(cuts))).withColumns({"p": F.col("_c.p"), "q": F.col("_c.q")}).drop("_c")
    word = F.col("word")
    return rows.withColumn("key", F.xxhash64("p", "q", F.substring(word, F.lit(1), F.col("p")), F.substring(word, F.length(word) - F.col("q") + 1, F.col("q"))))


def _held(words: DataFrame, before: Column, after: Column) -> DataFrame:
    return _keyed(words, _cuts(F.length("word") - before - after, before, after))


def _scanned(words: DataFrame, before: Column, after: Column, shortest: int) -> DataFrame:
    """Cuts at which words of as many code points or one less are held: of two near words the longer one looks for the other."""
    rest = F.length("word") - before - after
    lengths = [F.greatest(rest + d, F.lit(shortest) - before - after, F.lit(1)) for d in (-1, 0)]
    return _keyed(words, F.flatten(F.array(*[_cuts(n, before, after) for n in lengths])))


def _dealt(words: DataFrame, shortest: int, together: int) -> DataFrame:
    """(kind, word, n, p, q, key): each word held by its two segments, and sent to where a near word's segment can be.

    Where over ``together`` words are held with one segment, they are held with a half of what is left of them as
    well, by either half, and so on: a near word has one of the halves unchanged. In the end a code point is
    left, and only the alphabet bounds how many words are alike but for it.
    """
    zero = F.lit(0)
    held, scanned, done = _held(words, zero, zero), _scanned(words, zero, zero, shortest), []
    while True:
        counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.length("word") - F.col("p") - F.col("q")).alias("_left"))
        hot = materialize(counts.where((F.col("_n") > together) & (F.col("_left") > 1)).select("key"), "hot")
        n_hot = hot.count()
        mark = F.broadcast(hot) if n_hot <= FEW_HOT else hot
        apart = (lambda rows: (rows, None)) if not n_hot else (lambda rows: (rows.join(mark, "key", "left_anti"), rows.join(mark, "key", "left_semi").drop("key")))
        (held, hot_held), (scanned, hot_scanned) = apart(held), apart(scanned)
        done += [held.withColumn("kind", F.lit(0)), scanned.withColumn("kind", F.lit(1))]
        if not n_hot:
            break
        before, after = F.col("p"), F.col("q")
        held = materialize(_held(hot_held, before, after), "held")
        scanned = materialize(_scanned(hot_scanned, before, after, shortest).distinct(), "scanned")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("kind", "word", "n", "p", "q", "key")


class Shard:
    """An automaton over segments; with each, the words that hold it by their other outer part and by the halves of their rest."""

    def __init__(self) -> None:
        self.segments: dict[str, dict[tuple[bool, int, int], dict]] = {}
        self.automaton = None

    def add(self, word: str, n: int, p: int, q: int) -> None:
        ahead = p >= q  # which outer part the automaton looks for
        segment, other = (word[:p], word[len(word) - q :]) if ahead else (word[len(word) - q :], word[:p])
        index = self.segments.setdefault(segment, {}).setdefault((ahead, p, q), {}).setdefault(other, {})
        rest = word[p : len(word) - q]
        half = len(rest) // 2
        index.setdefault((len(rest), True, rest[:half]), []).append((word, n))
        index.setdefault((len(rest), False, rest[half:]), []).append((word, n))

    def make(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for segment, held in self.segments.items():
            self.automaton.add_word(segment, held)
        if self.segments:
            self.automaton.make_automaton()

    def near(self, word: str) -> dict[str, int]:
        """The held words one edit away, with their counts, that share a segment at a place and length that fit, as far
        as they are shorter than the word, or as long and before it in order."""
        out: dict[str, int] = {}
        length = len(word)
        for end, held in self.automaton.iter(word) if self.segments else ():
            for (ahead, p, q), others in held.items():
                left = length - p - q
                if left < 0 or (end + 1 != p if ahead else end + 1 != length):
                    continue
                index = others.get(word[length - q :] if ahead else word[:p])
                if index is None:
                    continue
                rest = word[p : length - q]
                for m in (left - 1, left) if left > 1 else (left,):
                    half = m // 2
                    for key in ((m, True, rest[:half]), (m, False, rest[left - m + half :])):
                        for other, n in index.get(key, ()):
                            if (m < left or other < word) and other not in out and one_edit(word, other):
                                out[other] = n
        return out


def near_words(words: DataFrame, shortest: int = SHORTEST, together: int = TOGETHER, shard: int = SHARD) -> DataFrame:
    """(word, near, n) for each ordered pair of ``words`` (word, n) one edit apart, n being the near one's count.

    A word one edit from another has one of its halves unchanged, as its beginning or its end. Both segments of every
    word are held by the automaton of the shard that the segment's hash names, and every word is scanned by the
    shards of the few segments that could be of a word as long or shorter; pairs are given both ways. Shards grow with ``shard`` only, their number with the words.
    """
    words = materialize(words.select("word", "n"), "words")
    sizes = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars")).first()
    shards = max(words.sparkSession.sparkContext.defaultParallelism, -(-2 * (sizes.chars or 0) // shard))
    rows = _dealt(words, shortest, together).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, pairs = None, Shard(), set()
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for kind, word, n, p, q, number in zip(*[batch.column(c).to_pylist() for c in ("kind", "word", "n", "p", "q", "shard")]):
                if number != now:
                    now, automaton, pairs = number, Shard(), set()
                if kind == 0:
                    automaton.add(word, n, p, q)
                    continue
                if automaton.automaton is None:
                    automaton.make()
                if word not in pairs:
                    pairs.add(word)
                    for other, k in automaton.near(word).items():
                        out += [(word, other, k), (other, word, n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "n"])

    found = rows.mapInArrow(lambda b: released(run(b)), "word string, near string, n long")
    return found.repartition("word").dropDuplicates(["word", "near"])


def forms_of(words: DataFrame, near: DataFrame, commoner: float = COMMONER) -> DataFrame:
    """``words`` (word, n) with n_near, form and form_n: the commonest near word, ties to the first in code-point order,
    if it is ``commoner`` times as common."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("form"))).alias("_best"))
    out = words.join(best, "word", "left").withColumn("_takes", -F.col("_best.n") >= commoner * F.col("n"))
    form, form_n = F.when(F.col("_takes"), F.col("_best.form")), F.when(F.col("_takes"), -F.col("_best.n"))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), form_n.alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """``words`` (word, form, …) with ``root``, where following forms ends; a word without a form is its own.

    Each form is commoner than its word, so that there is no way round and a way's length is at most the logarithm of the
    largest count; each round doubles the step, over words that have a form only.
    """
    step = materialize(words.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = materialize(step.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        moved = further.where("_moved").limit(1).count()
        step = further.drop("_moved")
        if not moved:
            break
    return words.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts, grouped by spelling.

    Words are runs of letters of at least SHORTEST code points that occur RAREST times or more. Null and empty texts have
    none; a null id counts as an empty one. No words: no rows. Columns beside the two named are not read.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    out = materialize(forms_of(words, near_words(words)), "spelling")
    return with_roots(out).select("word", "form", "root", "n", "n_near", "form_n")
