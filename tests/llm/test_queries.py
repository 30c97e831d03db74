"""The registered queries' own columns and digests against plain code, and the pipeline beside clashing columns."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sawmill.llm import queries


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_queries_on_documents(docs, texts, tmp_path):
    spark, folder = docs.sparkSession, str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    data = [(t or "").encode() for t in texts]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = {r.doc_id: r for r in queries.op1_bpe(spark, folder).collect()}
    library, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    six = {r.doc_id: r for r in queries.op6_token_files(spark, folder).collect()}
    counts: dict[bytes, int] = {}
    for x in data:
        for i in range(len(x) - 199):
            counts[x[i : i + 200]] = counts.get(x[i : i + 200], 0) + 1
    four = {r.doc_id: r for r in queries.op4_suffix_dedup(spark, folder).collect()}
    eight = {r.doc_id: r for r in queries.op8_simhash(spark, folder).collect()}
    for i, (t, x) in enumerate(zip(texts, data)):
        ids = plain.encode_ordinary(t or "")
        assert (one[i].n_tokens, one[i].ids_sha256, one[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(x))
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (six[i].start, six[i].n_tokens, six[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if counts[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (four[i].n_bytes, four[i].n_removed, four[i].n_spans) == (len(x), gone.sum(), spans)
        assert four[i].kept_sha256 == sha(np.frombuffer(x, np.uint8)[~gone].tobytes())
        assert len(eight[i].fingerprint) == 16 and eight[i].component_id <= i


def test_pipeline_leaves_other_columns_alone(docs, tmp_path):
    spark, folder = docs.sparkSession, str(tmp_path)
    more = ["spans", "rk", "_row", "predicted", "evidence", "topic", "tokens", "probability", "selected", "fp", "component_id"]
    given = docs.select("*", *[F.col("doc_id").alias(c) for c in more], F.lit(1).alias("Token_Ids"))
    given.select("doc_id", F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, folder)
        assert out.columns[: len(given.columns) - 1] == given.columns[:-1], name
        rows = out.select("doc_id", "score", *more).collect()
        assert rows and all(r.score == "clash" and {r[c] for c in more} == {r.doc_id} for r in rows), name
    assert out.columns[-3:] == ["token_ids", "n_tokens", "round_trip"] and "Token_Ids" not in out.columns
