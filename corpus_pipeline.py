"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``: those of documents and
any others, whatever their names, with their own values. The last adds token_ids, n_tokens and round_trip;
columns of these names give way there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from sawmill.llm.common import materialize, table

#: The near-dedup stage links texts of a Jaccard similarity of simhash.SIMILARITY and more of five-word shingles;
#: fingerprints of 4 * 64 bits search for them.
SHINGLE, WORDS = 5, 4


#: What the stages know of documents; columns beside these keep out of their way.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """``stage``, the caller's further columns under names of no one else's meanwhile."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {f"_own{i}": c for i, c in enumerate(docs.columns) if c not in COLUMNS}
        names = [f"_own{i}" if c not in COLUMNS else c for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        new = {c.lower() for c in out.columns if c not in names}
        out = out.drop(*[c for c, name in own.items() if name.lower() in new])
        return out.toDF(*[own.get(c, c) for c in out.columns])

    return run


@apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; what the model learns comes from the table of labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, ~toxicity.held_out())
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


@apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of those that reach each other by links of a Jaccard similarity of 0.8 or more.

    Rows are told apart by doc_id and text, so rows alike in both are copies too, and null ids are allowed.
    """
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = simhash.near_copies(docs.select(F.col("_row").alias("doc_id"), "text"), SHINGLE, WORDS)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


@apart
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings; a character that a cut has split goes too. Documents stay."""
    columns = docs.columns
    found = suffix_dedup.repeated_bytes(docs.select("doc_id", "text")).where("spans is not null").select("rk", "spans").dropDuplicates(["rk"])
    keyed = docs.withColumn("rk", F.xxhash64("doc_id", "text")).join(found, "rk", "left")
    return suffix_dedup.cut_texts(keyed).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that calibrated sampling selects."""
    return mixing.mix(docs, {"topic": mixing.TOPIC_SHARES}).where("selected").select(*docs.columns)


@apart
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token ids, their number, and whether the decoded bytes are the text's."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.encode(docs, ranks, public_tokenizers.PATTERN, bytes_col="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return back.select(*docs.columns, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL: components, suffix arrays, raking and BPE are iterative. The tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
