"""Extraction: timestamp, level and typed fields of entry texts, by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.config import FieldRule, ParserConfig, group_count
from sawmill.operators.assemble import assemble, numbered, orphans
from sawmill.operators.templates import json_template_of, template_of
from sawmill.schema import ENTRY, FIELD, NO_TIMESTAMP, SLOTS, UNKNOWN_LEVEL

#: What counts as a number before it is cast: integers with an optional sign, and decimals that may have
#: thousands separators and an exponent; white space around.
LONG_TEXT = r"^\s*[+-]?\d+\s*$"
DOUBLE_TEXT = r"^\s*[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: Keys of JSON lines that hold an entry's own columns.
JSON_KEYS = {"timestamp": ("timestamp", "@timestamp", "time", "ts"), "level": ("level", "severity", "lvl"), "message": ("message", "msg")}


def _group(regex: str) -> int:
    """Group 1 if the regex has groups, else the whole match."""
    return min(1, group_count(regex))


def first_match(text: Column, regex: str) -> Column:
    """Group 1 of the first match; null where there is none."""
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, _group(regex)))


def last_match(text: Column, regex: str) -> Column:
    """Group 1 of the last match; null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(regex), F.lit(_group(regex))), F.lit(-1))


def timestamp_of(first_line: Column, parser: ParserConfig) -> Column:
    """The first line's timestamp in UTC, null if there is none that reads as one."""
    if not parser.timestamp_regex:
        return F.lit(None).cast("timestamp")
    text = F.regexp_extract(first_line, parser.timestamp_regex, _group(parser.timestamp_regex))  # empty, which reads as none, where none is
    read = F.try_to_timestamp(text, F.lit(parser.timestamp_format)) if parser.timestamp_format else F.try_to_timestamp(text)
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return read if parser.timestamp_zone == "UTC" else F.when(zoned, read).otherwise(F.to_utc_timestamp(read, parser.timestamp_zone))


def level_of(message: Column, parser: ParserConfig) -> Column:
    """The first level in the whole message."""
    if not parser.level_regex:
        return F.lit(UNKNOWN_LEVEL)
    return F.coalesce(first_match(message, parser.level_regex), F.lit(UNKNOWN_LEVEL))


def typed(key: str, value: Column, kind: str, fmt: str | None = None) -> Column:
    """A tagged value: one slot filled; text that doesn't read as its type stays text; null stays null."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in FIELD.fields[1:]}
    if kind == "long":
        empty["LongValue"] = F.when(value.rlike(LONG_TEXT), F.trim(value).try_cast("bigint"))
        text = F.when(empty["LongValue"].isNull(), value)
    elif kind == "double":
        empty["DoubleValue"] = F.when(value.rlike(DOUBLE_TEXT), F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double"))
        text = F.when(empty["DoubleValue"].isNull(), value)
    elif kind == "boolean":
        word = F.lower(F.trim(value))
        empty["BoolValue"] = F.when(word == "true", True).when(word == "false", False)
        text = F.when(empty["BoolValue"].isNull(), value)
    elif kind == "datetime":
        text = F.coalesce(F.date_format(F.try_to_timestamp(value, F.lit(fmt)), "yyyy-MM-dd'T'HH:mm:ss"), value)
    else:
        text = value
    empty["StringValue"] = text
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("Key"), *[c.alias(n) for n, c in empty.items()]))


def matches_of(message: Column, rules: tuple[FieldRule, ...]) -> dict[str, Column]:
    """The last match of each rule with a name and regex, by the column that ``fields_of`` and ``column_of`` read it from:
    as a column of its own it is searched once, however often its value is looked at, and only if it is used."""
    return {f"_match{i}": last_match(message, r.regex) for i, r in enumerate(rules) if r.field_name and r.regex}


def _field(rules: tuple[FieldRule, ...], name: str) -> Column | None:
    """A field's tagged value, of the last rule for it that matches."""
    same = [typed(name, F.col(f"_match{i}"), r.type, r.format) for i, r in enumerate(rules) if r.field_name == name and r.regex]
    return F.coalesce(*reversed(same)) if same else None


def fields_of(rules: tuple[FieldRule, ...]) -> Column:
    """All fields found by ``matches_of``, in the rules' order; of rules for one name the last that matches counts; rules
    without a name or regex are skipped."""
    found = [_field(rules, name) for name in dict.fromkeys(r.field_name for r in rules if r.field_name and r.regex)]
    kind = ENTRY["Fields"].dataType.simpleString()
    return F.array_compact(F.array(*found)).cast(kind) if found else F.array().cast(kind)


def column_of(rules: tuple[FieldRule, ...], name: str, kind: str) -> Column:
    """What ``value`` finds of a field in ``fields_of``, straight from its matches: only this field's regexes run."""
    field = _field(rules, name)
    if field is None:
        return F.lit(None).cast("timestamp" if kind == "datetime" else FIELD[SLOTS[kind]].dataType)
    found = field[SLOTS[kind]]
    return found.try_cast("timestamp") if kind == "datetime" else found


def parse_json(lines: DataFrame, parser: ParserConfig) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of lines that are JSON objects, an entry each.

    Timestamp, level and message come from the first of JSON_KEYS that the object has (message: else the
    line); a timestamp may be a number of seconds, milli- or microseconds since 1970. A rule's regex names the key of its field
    (empty: the field's own name). ``message_regex`` and template hashes are as in ``parse``. Lines that are no
    objects, or go on after one, are rejects; entries without a timestamp are as in ``parse``.
    """
    some = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<map<string,string>>", {"mode": "PERMISSIVE"})  # in a list nothing can follow unseen
    rows = lines.where(F.trim("value") != "").withColumn("_l", F.when(F.trim("value").rlike(r"(?s)^\{.*\}$"), some))
    rows = rows.withColumn("_o", F.when(F.size("_l") == 1, F.get("_l", F.lit(0))))
    key = lambda what: F.coalesce(*[F.element_at("_o", F.lit(k)) for k in JSON_KEYS[what]])
    good = F.col("_o").isNotNull() & (F.size("_o") > 0)
    read = F.try_to_timestamp(key("timestamp"), F.lit(parser.timestamp_format)) if parser.timestamp_format else F.try_to_timestamp(key("timestamp"))
    number = F.when(key("timestamp").rlike(r"^\d+(\.\d+)?$"), key("timestamp").try_cast("double"))
    micros = F.when(number < 1e11, number * 1e6).when(number < 1e14, number * 1e3).when(number < 1e17, number).cast("long")
    read = F.coalesce(F.timestamp_micros(micros), F.when(number.isNull(), read))
    dated = rows.where(good).withColumn("_stamp", read)
    strict = parser.on_missing_timestamp == "reject"
    found = [typed(r.field_name, F.element_at("_o", F.lit(r.regex or r.field_name)), r.type, r.format) for r in parser.fields_regexes if r.field_name]
    kind = ENTRY["Fields"].dataType.simpleString()
    message = F.coalesce(key("message"), F.col("value"))
    shown = message if parser.message_regex is None else F.coalesce(first_match(message, parser.message_regex), message)
    entries = (dated.where("_stamp is not null") if strict else dated).select(
        F.coalesce("_stamp", F.lit(NO_TIMESTAMP).cast("timestamp")).alias("Timestamp"), F.upper(F.coalesce(key("level"), F.lit(UNKNOWN_LEVEL))).alias("Level"),
        shown.alias("Message"), F.col("source").alias("Source"), F.lit(0).cast("long").alias("TemplateHash"),
        (F.array_compact(F.array(*found)) if found else F.array()).cast(kind).alias("Fields"),
    )
    if parser.template_hashes:
        entries = entries.withColumn("TemplateHash", F.xxhash64(json_template_of(F.col("Message"), F.col("Fields"))))
    rejects = rows.where(~F.coalesce(good, F.lit(False))).select(F.col("source").alias("Source"), F.lit("No JSON object").alias("Error"), F.col("value").alias("Text"))
    if strict:
        rejects = rejects.union(dated.where("_stamp is null").select("source", F.lit("No timestamp"), "value"))
    return entries, rejects


def parse(lines: DataFrame, parser: ParserConfig, templates: bool | None = None, columns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of ``lines``.

    Entries have the columns of an entry: level and fields come from the whole message, the timestamp
    from the first line; an unread timestamp gets the sentinel, or is a reject if the parser says so.
    TemplateHash, a 64-bit hash of the template, is 0 unless ``templates`` (default: as the parser says). ``columns`` adds fields, by name and type,
    as columns of their own, each read by its own regexes only if it is used. Rejects have Source, Error and Text: each orphan line, too.
    """
    templates = parser.template_hashes if templates is None else templates
    message = F.col("message")
    texts = assemble(lines, parser.start_of_entry_regex).withColumns({"_stamp": timestamp_of(F.col("first_line"), parser), **matches_of(message, parser.fields_regexes)})
    shown = message if parser.message_regex is None else F.coalesce(first_match(message, parser.message_regex), message)
    strict = parser.on_missing_timestamp == "reject"
    entries = (texts.where("_stamp is not null") if strict else texts).select(
        F.coalesce("_stamp", F.lit(NO_TIMESTAMP).cast("timestamp")).alias("Timestamp"),
        level_of(message, parser).alias("Level"),
        shown.alias("Message"),
        F.col("source").alias("Source"),
        (F.xxhash64(template_of(shown, parser)) if templates else F.lit(0).cast("long")).alias("TemplateHash"),
        fields_of(parser.fields_regexes).alias("Fields"),
        *[column_of(parser.fields_regexes, name, kind).alias(name) for name, kind in (columns or {}).items()],
    )
    rejects = orphans(numbered(lines, parser.start_of_entry_regex)).select(F.col("source").alias("Source"), F.lit("Orphan log line").alias("Error"), F.col("value").alias("Text"))
    if strict:
        undated = texts.where("_stamp is null")
        rejects = rejects.union(undated.select("source", F.lit("No timestamp"), "message"))
    return entries, rejects
