"""BPE, token files and chat formatting by exact round trips and the plain libraries."""

import base64
import json
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sawmill.llm import bpe, chat, token_files

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_decode(spark, docs, texts, plain):
    tokens = bpe.encode(docs.withColumn("TOKEN_IDS", F.lit(1)), RANKS, P.PATTERN)
    assert tokens.columns == [*docs.columns, "token_ids"]
    back = bpe.decode(tokens, RANKS, P.PATTERN)
    rows = {r.doc_id: r for r in back.collect()}
    for i, t in enumerate(texts):
        assert rows[i].token_ids == plain.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()
    both = bpe.encode(docs, RANKS, P.PATTERN, bytes_col="decoded")
    assert {(r.doc_id, tuple(r.token_ids), bytes(r.decoded)) for r in both.collect()} == {(i, tuple(r.token_ids), bytes(r.decoded)) for i, r in rows.items()}
    assert bpe.encode(docs.where("false"), RANKS, P.PATTERN).count() == 0


def test_pieces_are_safe(texts, plain):
    for t in filter(None, texts):
        for long in (1, 3, 50, 1000):
            assert "".join(bpe.pieces(t, long)) == t
            assert bpe.encode_text(plain, t, long) == plain.encode_ordinary(t)


def test_wavelet(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 128)
    values = np.random.default_rng(1).integers(0, 50, 1500).astype(np.uint16)
    w = token_files.Wavelet.from_bytes(token_files.Wavelet.build(values, 6).to_bytes())
    assert np.array_equal(w.decode(), values) and [w.access(i) for i in range(0, 1500, 37)] == values[::37].tolist()
    for v in (0, 7, 49, 63, 64):
        at = np.flatnonzero(values == v)
        assert w.count(v) == len(at) and w.rank(v, 700) == (values[:700] == v).sum()
        assert w.occurrences(v).tolist() == at.tolist() == [w.select(v, k) for k in range(len(at))]
    with pytest.raises(IndexError):
        w.select(7, w.count(7))
    nothing = token_files.Wavelet.from_bytes(token_files.Wavelet.build(values[:0], 6).to_bytes())
    assert nothing.count(3) == 0 and len(nothing.decode()) == 0 and len(nothing.occurrences(3)) == 0


def test_one_token_unpacks_few_blocks(monkeypatch):
    values = np.random.default_rng(2).integers(0, 50_000, 600_000).astype(np.uint16)
    w = token_files.Wavelet.from_bytes(token_files.Wavelet.build(values, 16).to_bytes())
    assert w.before.shape == (16, 11) and w.access(431_234) == values[431_234]
    assert len(w.unpacked) <= 2 * 16 < 160
    fresh = token_files.Wavelet.from_bytes(w.to_bytes())
    assert fresh.count(int(values[5])) == (values == values[5]).sum() and len(fresh.unpacked) <= 2 * 16


def test_token_files(spark, docs, texts, tmp_path):
    path, file = str(tmp_path / "t"), P.path("byte_bpe_50k.json")
    more = spark.createDataFrame([(None, "null id"), (3, "again"), *[(7, "same")] * 400], "doc_id long, text string")
    both = docs.select("doc_id", "text", F.lit(1).alias("ids")).union(more.select("doc_id", "text", F.lit(2)))
    token_files.write_shards(both, file, path, shard_tokens=2_000, task_bytes=20_000)
    rows = token_files.read_shards(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(file)
    given = sorted([(-1, "null id"), *enumerate(texts)], key=lambda x: x[0])
    start, order, every = 0, [], []
    assert len(rows) == len(given) + 401 and rows[0].doc_id is None
    by_id = {}
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        order.append(-1 if r.doc_id is None else r.doc_id)
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        every += ids
        by_id.setdefault(order[-1], []).append(ids)
    assert order == sorted(order)
    for i, t in given:
        assert [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] in by_id[i]
    shards = token_files.open_shards(spark, path).collect()
    assert len({r.part for r in shards}) > 3 and max(r.seq for r in shards) > 1
    ask = spark.createDataFrame([(p,) for p in [0, 5, 5, len(every) - 1, len(every), 1234, None, *range(3000, 3040)]], "position long")
    found = {r.position: r.token_id for r in token_files.tokens_at(spark, path, ask).collect()}
    assert found == {p: every[p] for p in [0, 5, len(every) - 1, 1234, *range(3000, 3040)]}
    some = [0, every[10], 49_999]
    assert {r.token_id: r.n for r in token_files.count_tokens(spark, path, some).collect()} == {t: every.count(t) for t in some}
    where = token_files.find_token(spark, path, every[10]).orderBy("position").collect()
    assert [r.position for r in where] == [i for i, t in enumerate(every) if t == every[10]]
    starts = {r.start: r.doc_id for r in rows}
    assert all(starts[r.position - r.place] == r.doc_id for r in where)
    token_files.write_shards(both.where("false"), file, path + "0")
    assert token_files.read_shards(spark, path + "0").count() == 0 == token_files.find_token(spark, path + "0", 3).count()


def test_units_are_the_texts(monkeypatch):
    """Ids by units against the library, with odd white space and marks, and when units are forgotten."""
    rng = random.Random(4)
    file = P.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(file), token_files.UnitEncoder(token_files.tokenizer_json(file))
    bits = ["a", "bc", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "<|endoftext|>", "<|", "1", "42", ".", "'s", "日本", "\u3000", "\r\n", "Word", "\x00", "!", "\u200b", "\U0001f600"]
    monkeypatch.setattr(token_files, "MAX_UNITS", 50)
    for _ in range(60):
        given = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(30)] + [None, ""]
        ids, total = own.encode(pa.array(given, pa.string()), 0)
        ends = np.cumsum(total)
        for t, a, b in zip(given, ends - total, ends):
            assert ids[a:b].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 0]


NASTY = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\b\\\\h\\l", "", "é<#:\\", "</turn>\n### assistant: "]


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", NASTY[0]), (1, 0, "user", NASTY[1]), (2, 0, "a:b#<\\", NASTY[2]), (2, None, None, None), (2, 1, "assistant", NASTY[4]), (2, 1, "assistant", NASTY[4]), (None, 0, "assistant", NASTY[5])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    out = chat.format_turns(chat.canonical_turns(df))
    out = out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    found = {r.conv_id: ([tuple(t) for t in r.back], r.loss) for r in out.collect()}
    assert found[1] == ([("user", NASTY[1]), ("assistant", NASTY[0])], [NASTY[0]])
    assert found[2] == ([("", ""), ("a:b#<\\", NASTY[2]), ("assistant", NASTY[4]), ("assistant", NASTY[4])], [NASTY[4]] * 2)
    assert found[None] == ([("assistant", NASTY[5])], [NASTY[5]])
    assert chat.format_turns(chat.canonical_turns(df.where("false"))).count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 512, 1500])
def test_chat_of_many_turns(spark, n):
    texts = [NASTY[i % len(NASTY)] + str(i) for i in range(n)]
    df = spark.range(1).select(F.col("id").alias("conv_id"), F.transform(F.array(*map(F.lit, texts)), lambda t, i: F.struct(
        F.when(i % 3 == 0, "user").otherwise("assistant").alias("role"), t.alias("text"))).alias("turns"))
    out = chat.format_turns(df).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t.text for t in out.back] == texts
    assert out.loss == [t for i, t in enumerate(texts) if i % 3]
    cut = [out.formatted[s.start : s.start + s.length] for s in out.loss_spans]
    assert len(cut) == len(out.loss) and all(out.formatted[s.start + s.length :].startswith(chat.END) for s in out.loss_spans)


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    layouts = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in turns]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "turns": {"turns": [{"role": r, "text": t} for r, t in turns]},
        "prompt_response": {"prompt": "q", "response": "a"},
        "question_answer": {"question": "q", "answer": "a"},
        "instruction_output": {"instruction": "q", "output": "a"},
        "instruction_input_output": {"instruction": "q", "input": "", "output": "a"},
    }
    rows = [(name, json.dumps(layout)) for name, layout in layouts.items()] + [("bad", "{"), ("none", None), ("other", '{"z": 1}')]
    df = spark.createDataFrame(rows, "conv_id string, json string")
    found = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_json(df).collect()}
    for name in layouts:
        assert found[name] == (name, turns), name
    assert [found[n] for n in ("bad", "none", "other")] == [(None, None)] * 3
    for name, layout in layouts.items():  # the same layouts as schemas, beside other columns
        typed = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": 1, "more": 2, **layout})]))
        assert [tuple(t) for t in chat.canonical_turns(typed).first().turns] == turns
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id int, z int"))


@pytest.mark.parametrize(("layout", "turns", "row"), [
    ("messages", [("user", "a"), ("assistant", "")], {"id": 1, "messages": [{"role": "user", "content": "a", "name": "x"}, {"role": "gpt", "content": None}]}),
    ("messages", [("user", "b")], {"messages": [{"role": "user", "content": "b", "meta": {"k": [1]}}], "text": "t"}),
    ("messages", [], {"messages": []}),
    ("messages", [], {"messages": None}),
    ("prompt_response", [("user", "p"), ("assistant", "r")], {"prompt": "p", "response": "r", "meta": {"x": {"y": 1}}}),
    ("prompt_response", [("assistant", "r")], {"prompt": None, "response": "r"}),
    ("instruction_output", [("user", "i"), ("assistant", "o")], {"instruction": "i", "output": "o", "messages": []}),
    ("system_instruction_input_output", [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")], {"instruction": "i", "input": "n", "output": "o", "system": "s"}),
    (None, None, {"messages": [{"role": "user", "content": "b"}, 5]}),
    (None, None, {"messages": "text", "prompt": "p", "response": "r"}),
    (None, None, {"prompt": "p", "response": "r", "question": "q"}),
    (None, None, {"turns": [], "messages": []}),
    (None, None, [1]),
])
def test_json_layouts(spark, layout, turns, row):
    df = spark.createDataFrame([(1, json.dumps(row))], "conv_id long, json string")
    found = chat.canonical_json(df).first()
    assert (found.layout, found.turns if found.turns is None else [tuple(t) for t in found.turns]) == (layout, turns)
