"""Parsing against hand-written lines and a sequential parser of plain Python."""

import random
import re

import duckdb
import pytest

from sawmill.config import FieldRule, ParserConfig
from sawmill.operators.extract import parse
from sawmill.queries import ORACLE_SQL, QUERIES
from sawmill.sources.lines import split_texts

CONFIG = ParserConfig(
    r"^\d{4}-\d{2}-\d{2}", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)", level_regex=r"\b(INFO|WARN|ERROR)\b",
    fields_regexes=(FieldRule("user_id", r"user_id=(\d+)", "long"), FieldRule("free_space", r"free=([\d.]+)", "double"), FieldRule("username", r'username="([^"]+)"')),
)
HEAD = "2025-08-18T16:00:01Z"


def entries_of(spark, text, config=CONFIG, block=None):
    df = spark.createDataFrame([("a.log", text)], "s string, t string")
    entries, rejects = parse(split_texts(df, "s", "t"), config)
    entries = entries.withColumn("Timestamp", entries.Timestamp.cast("string"))  # Python's local time doesn't reach year 1
    return [r.asDict(True) for r in entries.collect()], [r.asDict() for r in rejects.collect()]


def field(entry, name):
    found = [f for f in entry["Fields"] if f["Key"] == name]
    return found[0] if found else None


def test_one_line(spark):
    (e,), rejects = entries_of(spark, f'{HEAD} INFO User login succeeded user_id=101 username="alice"')
    assert (e["Level"], e["Source"], e["TemplateHash"], rejects) == ("INFO", "a.log", 0, [])
    assert e["Timestamp"] == "2025-08-18 16:00:01"
    assert [f["Key"] for f in e["Fields"]] == ["user_id", "username"]
    assert field(e, "user_id") == {"Key": "user_id", "StringValue": None, "LongValue": 101, "DoubleValue": None, "BoolValue": None}
    assert field(e, "username")["StringValue"] == "alice"


@pytest.mark.parametrize(
    "text, check",
    [
        (f"orphan\n{HEAD} INFO x", lambda e, r: len(e) == 1 and r[0]["Error"] == "Orphan log line" and r[0]["Text"] == "orphan"),
        (f"{HEAD} INFO x\n  at frame\n\n", lambda e, r: e[0]["Message"] == f"{HEAD} INFO x\n  at frame"),
        (f"{HEAD} INFO user_id=1\nuser_id=2", lambda e, r: field(e[0], "user_id")["LongValue"] == 2),
        (f"{HEAD} boo\nERROR", lambda e, r: e[0]["Level"] == "ERROR"),
        (f"{HEAD} boo", lambda e, r: e[0]["Level"] == "UNKNOWN" and e[0]["Fields"] == []),
        ("2025-08-18 no T or Z", lambda e, r: e[0]["Timestamp"] == "0001-01-01 00:00:00"),
        (f"{HEAD} user_id=99999999999999999999", lambda e, r: field(e[0], "user_id")["StringValue"] == "9" * 20 and field(e[0], "user_id")["LongValue"] is None),
        ("only\ncontinuation", lambda e, r: e == [] and len(r) == 2),
        ("", lambda e, r: e == []),
    ],
)
def test_edges(spark, text, check):
    assert check(*entries_of(spark, text))


def test_empty_start_regex_makes_every_line_an_entry(spark):
    assert len(entries_of(spark, "a\nb\nc", ParserConfig(""))[0]) == 3


def test_regex_without_group(spark):
    config = ParserConfig(r"^\d", r"^\S+Z", level_regex="INFO|WARN", fields_regexes=(FieldRule("n", r"\d+$", "long"),))
    (e,), _ = entries_of(spark, f"{HEAD} INFO 42", config)
    assert e["Timestamp"] == "2025-08-18 16:00:01" and e["Level"] == "INFO" and field(e, "n")["LongValue"] == 42


def test_rejects_without_timestamp(spark):
    config = ParserConfig(CONFIG.start_of_entry_regex, CONFIG.timestamp_regex, on_missing_timestamp="reject")
    entries, rejects = entries_of(spark, f"{HEAD} a\n2025-08-18 b", config)
    assert len(entries) == 1 and rejects[0]["Error"] == "No timestamp"


def test_many_entries_are_all_kept(spark):
    assert len(entries_of(spark, "\n".join(f"{HEAD} INFO {i}" for i in range(250)))[0]) == 250


def sequential(lines, config):
    """An entry at a time, as a loop over lines."""
    out, held = [], None
    start = re.compile(config.start_of_entry_regex)
    for line in lines:
        if start.search(line):
            if held is not None:
                out.append(held)
            held = [line]
        elif held is not None:
            held.append(line)
    if held is not None:
        out.append(held)
    result = []
    for entry in out:
        message = "\n".join(entry).rstrip("\r\n")
        level = re.search(config.level_regex, message)
        fields = {r.field_name: re.findall(r.regex, message)[-1] for r in config.fields_regexes if re.search(r.regex, message)}
        result.append((message, level.group(1) if level else "UNKNOWN", fields))
    return sorted(result, key=repr)


def test_against_a_sequential_parser_over_blocks(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for source in ("a", "b", "c"):
        lines = []
        for i in range(300):
            kind = rng.random()
            lines.append(f"{HEAD} {rng.choice(['INFO', 'WARN', 'odd'])} user_id={rng.randrange(9)}" if kind < 0.5 else rng.choice(["", "  at x user_id=7", 'username="bo b"', "free=1.5 ERROR"]))
        rows += [(source, i // 40 * 40, i, line) for i, line in enumerate(lines)]
        expected += sequential(lines, CONFIG)
    entries, _ = parse(spark.createDataFrame(rows, "source string, block long, pos long, value string").repartition(5), CONFIG)
    found = []
    for e in entries.collect():
        fields = {f.Key: next(str(v) for v in (f.StringValue, f.LongValue, f.DoubleValue) if v is not None) for f in e.Fields}
        found.append((e.Message, e.Level, fields))
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", ["multiline_documents", "entry_numbers"])
def test_documents_of_any_text_as_their_sql_says(spark, tmp_path, name):
    texts = [
        "a\nb", "a\nb\n", "a\r\n\n\r\n", "a\r", "a\n\nb\r\nc", "", "\n", "\r\n\r", None, f"{HEAD} INFO doc_id=3 lang=x\nb", f"a\n{HEAD}\n", "\ta\n\tb\n\t", "\n\t", " a ",
        "\u2028a\x85\n\U0001f469\u200d\U0001f52c\n",
    ]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(-20 - i, t, "de") for i, t in enumerate(texts)]
    rows += [(7, "a\nb\nc", "fr"), (7, "d\ne\nf\n", "fr"), (7, "d\ne\nf\n", "fr"), (None, "a\n", "en"), (None, None, None), (2**63 - 1, "a", "en"), (-(2**63), "a", "en")]
    rows += [(50 + i, t, lang) for i, lang in enumerate([None, "", "e n", "e+%41\n\r", "\u00e9", "\t"]) for t in ("a\nb\n", "", None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    found = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS FROM '{path}/*.parquet'")
        assert sorted(found, key=repr) == sorted(c.execute(ORACLE_SQL[name]).fetchall(), key=repr)
