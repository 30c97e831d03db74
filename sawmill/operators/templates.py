"""Templates: messages with the places of their values named, the stored table of them, and messages made from them again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.config import ParserConfig, Plugin, group_count
from sawmill.functions import fields as ff
from sawmill.sources.state import StateTable

#: Names in templates of what an entry has beside fields.
STAMP, LEVEL = "Timestamp", "Level"
ISO = "yyyy-MM-dd'T'HH:mm:ssX"


def _escaped(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")


def places(message: str, parser: ParserConfig) -> list[tuple[int, int, str]]:
    """(begin, end, name) of the values that the parser finds, in order: the matches that count, by their own spans.

    The timestamp's is the first of the first line, the level's the first, a field's the last (of rules for one name
    the last that matches); classes as \\w are of ASCII, as in the JVM's. What overlaps a place found before is left out: fields in the rules' order come last.
    """
    found: list[tuple[int, int, str]] = []

    def put(match: re.Match | None, regex: str, name: str) -> bool:
        if match is None:
            return False
        begin, end = match.span(min(1, group_count(regex)))
        if begin >= 0 and all(end <= b or begin >= e for b, e, _ in found):
            found.append((begin, end, name))
        return True

    def last(regex: str) -> re.Match | None:
        match = None
        for match in re.finditer(regex, message, re.ASCII):
            pass
        return match

    if parser.timestamp_regex:
        put(re.search(parser.timestamp_regex, message.split("\n", 1)[0], re.ASCII), parser.timestamp_regex, STAMP)
    if parser.level_regex:
        put(re.search(parser.level_regex, message, re.ASCII), parser.level_regex, LEVEL)
    by_name: dict[str, list[str]] = {}
    for rule in parser.fields_regexes:
        if rule.field_name and rule.regex:
            by_name.setdefault(rule.field_name, []).append(rule.regex)
    for name, regexes in by_name.items():
        any(put(last(regex), regex, name) for regex in reversed(regexes))
    return sorted(found)


def template(message: str, parser: ParserConfig) -> str:
    """``message`` with ``{name}`` for each value, and braces of its own doubled."""
    out, at = [], 0
    for begin, end, name in places(message, parser):
        out += [_escaped(message[at:begin]), "{", name, "}"]
        at = end
    return "".join(out) + _escaped(message[at:])


def template_of(message: Column, parser: ParserConfig) -> Column:
    """The template of a message, in batches of Arrow: the JVM's functions give what a group matched, but not where."""
    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else template(t, parser))

    return made(message)


def json_template_of(message: Column, fields: Column) -> Column:
    """The template of a JSON line's message: each field's value, where it is there as a whole word, by the field's name."""
    @F.pandas_udf("string")
    def made(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(text: str | None, some) -> str | None:
            if text is None:
                return None
            spans: list[tuple[int, int, str]] = []
            for f in some if some is not None else ():
                value = next((str(f[k]) for k in ("StringValue", "LongValue", "DoubleValue", "BoolValue") if f[k] is not None and f[k] == f[k]), "")
                for m in re.finditer(rf"(?<!\w){re.escape(value)}(?!\w)", text) if value else ():
                    if all(m.end() <= b or m.start() >= e for b, e, _ in spans):
                        spans.append((*m.span(), f["Key"]))
                        break
            out, at = [], 0
            for begin, end, name in sorted(spans):
                out += [_escaped(text[at:begin]), "{", name, "}"]
                at = end
            return "".join(out) + _escaped(text[at:])

        return pd.Series([one(t, f) for t, f in zip(texts, found)], dtype=object)

    return made(message, fields)


def made_by(plugin: Plugin) -> Column:
    """The template of an entry (Message, Fields) that the plugin has parsed."""
    return json_template_of(F.col("Message"), F.col("Fields")) if plugin.type == "json" else template_of(F.col("Message"), plugin.parser)


def parts_of(text: Column) -> Column:
    """A template cut into names in braces, doubled braces and what is between."""
    return F.regexp_extract_all(text, F.lit(r"(\{\{|\}\}|\{[^{}]+\}|[^{}]+)"), F.lit(1))


def rebuilt(text: Column | None = None, stamp_format: str | None = None, parts: Column | None = None) -> Column:
    """The message of an entry (Timestamp, Level, Fields) whose template is ``text``: what it was, if each value is
    written as its type is rendered. ``parts`` has the template cut already (``parts_of``), once for all its entries."""
    parts = parts_of(text) if parts is None else parts

    def one(part: Column) -> Column:
        name = F.substring(part, F.lit(2), F.length(part) - 2)
        named = F.when(name == STAMP, F.date_format("Timestamp", stamp_format or ISO)).when(name == LEVEL, F.col("Level")).otherwise(ff.raw(name))
        return F.when(part == "{{", F.lit("{")).when(part == "}}", F.lit("}")).when(part.startswith("{"), named).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def template_table(spark: SparkSession, root: str) -> StateTable:
    """The store's templates: (TemplateHash, template)."""
    return StateTable(spark, root, "templates", ("TemplateHash",), "TemplateHash long, template string")


def unknown_templates(entries: DataFrame, plugin: Plugin, root: str) -> DataFrame:
    """(TemplateHash, template) of ``entries`` whose hashes the store's table lacks: an anti-join, after which a template is
    made of one entry for each hash that is left. Entries without a hash (0) are left out."""
    known = template_table(entries.sparkSession, root).current().select("TemplateHash")
    one = entries.where("TemplateHash <> 0").groupBy("TemplateHash").agg(F.min_by(F.struct("Message", "Fields"), "Message").alias("_e"))
    new = one.join(known, "TemplateHash", "left_anti").select("TemplateHash", "_e.Message", "_e.Fields")
    return new.select("TemplateHash", made_by(plugin).alias("template"))
