"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sawmill.llm.common import put_columns, released, small_batches, with_fields

#: Where a text can be cut without a change to the matches of PATTERN: no match of it holds a visible
#: character and a later space or line feed, nor an ASCII letter and an ASCII digit side by side.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Texts of over so many characters are split.
LONG = 16_384
#: Rank files over this size are refused, as their content is broadcast.
MAX_RANK_BYTES = 64 << 20

_MADE: dict[int, tiktoken.Encoding] = {}


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return data


def encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's content; made once in a process."""
    key = hash((data, pattern))
    if key not in _MADE:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        _MADE[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[key]


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of about ``long`` characters (longer where none is near)."""
    start = 0
    while len(text) - start > long:
        found = SAFE.search(text, start + long)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def encode_text(enc: tiktoken.Encoding, text: str | None, long: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, long) for i in enc.encode_ordinary(piece)]


def encode(
    docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str | None = None
) -> DataFrame:
    """``docs`` with the token ids of ``text_col`` as an array of int in ``ids_col``, and if ``bytes_col``
    is given the bytes decoded from them, by the same worker.

    One pass over the rows without a shuffle. Null and empty texts have no ids; other columns stay,
    a column of the new one's name gives way. The rank file is read on the driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank_bytes(rank_file))
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)]
    added += [T.StructField(bytes_col, T.BinaryType(), False)] if bytes_col else []
    schema = with_fields(docs.schema, *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(text_col)
            for at in range(0, batch.num_rows, 250):  # a list of ids takes ten times its text's memory
                some = [encode_text(enc, t) for t in texts.slice(at, 250).to_pylist()]
                made = {ids_col: pa.array(some, pa.list_(pa.int32()))}
                if bytes_col:
                    made[bytes_col] = pa.array([enc.decode_bytes(x) for x in some], pa.binary())
                yield put_columns(batch.slice(at, 250), **made)

    return small_batches(docs).mapInArrow(lambda b: released(run(b)), schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``tokens`` with the raw bytes that the ids stand for in ``bytes_col``; null ids give no bytes.

    Bytes, not text: a token may end inside a character. An id without a rank raises KeyError.
    """
    ranks = tokens.sparkSession.sparkContext.broadcast(rank_bytes(rank_file))
    schema = with_fields(tokens.schema, T.StructField(bytes_col, T.BinaryType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            ids = batch.column(ids_col)
            for at in range(0, batch.num_rows, 250):
                some = [enc.decode_bytes(x or []) for x in ids.slice(at, 250).to_pylist()]
                yield put_columns(batch.slice(at, 250), **{bytes_col: pa.array(some, pa.binary())})

    return small_batches(tokens).mapInArrow(lambda b: released(run(b)), schema)
