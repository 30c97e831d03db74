"""Full-text search: Bloom filters of the words of each file, asked before any entry is read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.schema import ENTRY
from sawmill.sources.state import StateTable
from sawmill.sources.store import _key, file_table

#: Bits a distinct word, and bits set by each: about one in a hundred words that a file lacks seems to be in it.
BITS, HASHES = 10, 5
#: A word: what is between other characters than letters, digits and marks inside identifiers.
BETWEEN = r"[^\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, BETWEEN), lambda w: w != ""))


def word_table(spark: SparkSession, root: str) -> StateTable:
    """(path, slot, bits, size): the words' bits of a file, 64 in a slot, of ``size`` slots; empty slots are left out."""
    return StateTable(spark, root, "words", ("path", "slot"), "path string, slot int, bits long, size int")


def _bit(word: Column, k: int, size: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), word), size.cast("long") * 64)


def index_words(spark: SparkSession, root: str) -> int:
    """Make the filters of the files that have none yet, and drop those of files that went; how many were made.

    Distinct words of a file are counted first, which sets its filter's size; bits are gathered by (file, slot), so no
    task holds a file's words whole.
    """
    table, known = word_table(spark, root), file_table(spark, root).current()
    have = table.current()
    gone = have.join(known, "path", "left_anti")
    if gone.limit(1).count():
        table.delete(gone.select("path", "slot"))
    new = [r.path for r in known.join(have.select("path").distinct(), "path", "left_anti").select("path").collect()]
    if not new:
        return 0
    names = F.broadcast(spark.createDataFrame([(_key(f"{root}/{p}"), p) for p in new], "_now string, path string"))
    entries = spark.read.schema(ENTRY).parquet(*[f"{root}/{p}" for p in new])
    here = F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/")
    words = entries.select(here.alias("_now"), F.explode(words_of(F.col("Message"))).alias("word")).join(names, "_now").select("path", "word").distinct()
    sizes = words.groupBy("path").agg(F.ceil(F.count(F.lit(1)) * BITS / 64).cast("int").alias("size"))
    bits = words.join(F.broadcast(sizes), "path").select("path", "size", F.explode(F.array(*[_bit(F.col("word"), k, F.col("size")) for k in range(HASHES)])).alias("b"))
    slots = bits.groupBy("path", "size", F.floor(F.col("b") / 64).cast("int").alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("bits"))
    empty = names.join(sizes, "path", "left_anti").select("path", F.lit(0).alias("size"), F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("bits"))
    table.upsert(slots.unionByName(empty))
    return len(new)


def files_with(spark: SparkSession, root: str, words: list[str]) -> DataFrame:
    """(path) of the store's files that may hold all ``words``: those whose filters have all their bits, and those without a filter."""
    files, table = file_table(spark, root).current().select("path"), word_table(spark, root).current()
    if not words:
        return files
    sizes = table.groupBy("path").agg(F.max("size").alias("size"))
    bits = sizes.where("size > 0").withColumn("word", F.explode(F.array(*[F.lit(w) for w in sorted(set(words))])))
    bits = bits.select("path", F.explode(F.array(*[_bit(F.col("word"), k, F.col("size")) for k in range(HASHES)])).alias("b")).distinct()
    slots = bits.groupBy("path", F.floor(F.col("b") / 64).cast("int").alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("asked"))
    lacking = slots.join(table.select("path", "slot", "bits"), ["path", "slot"], "left").where((F.coalesce("bits", F.lit(0).cast("long")).bitwiseAND(F.col("asked"))) != F.col("asked"))
    none = sizes.where("size = 0").select("path")
    return files.join(lacking.select("path").union(none).distinct(), "path", "left_anti")


def search(spark: SparkSession, root: str, text: str, words: bool = True) -> DataFrame:
    """Entries whose message holds ``text``: as whole words, or anywhere (as LIKE '%text%') if ``words`` is false.

    Only files that may hold the words are opened: all words of ``text``, or those that it surely holds whole, as it
    may begin or end within others.
    """
    parts = [w for w in re.split(r"[^\w]+", text) if w]
    if not words:
        inner = re.split(r"[^\w]+", text)
        parts = [w for w in inner[1:-1] if w]
    paths = [f"{root}/{r.path}" for r in files_with(spark, root, parts).collect()]  # the files that may match
    if not paths:
        return spark.createDataFrame([], ENTRY)
    entries = spark.read.schema(ENTRY).parquet(*paths)
    found = F.col("Message").contains(text)
    if words:
        ask = F.array(*[F.lit(w) for w in parts]).cast("array<string>")
        found = found & (F.size(F.array_except(ask, words_of(F.col("Message")))) == 0)
    return entries.where(found)
