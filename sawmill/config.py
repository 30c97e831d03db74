"""Configuration: where logs are, how lines become entries, and what is checked before a run."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

TYPES = ("string", "long", "double", "boolean", "datetime")
#: Columns of an entry; no field may be named like one of them.
BASE_COLUMNS = ("Timestamp", "Level", "Message", "Source", "TemplateHash", "Fields", "year", "month", "day")


@dataclass(frozen=True)
class FieldRule:
    """A dynamic field: the last match of ``regex`` in the message, its group 1 (or whole match), as ``type``."""

    field_name: str = ""
    regex: str = ""
    type: str = "string"
    format: str | None = None


@dataclass(frozen=True)
class ParserConfig:
    """How lines of one kind of file become entries. An empty start regex makes every line an entry."""

    start_of_entry_regex: str | None = ""
    timestamp_regex: str = ""
    timestamp_format: str | None = None
    timestamp_zone: str = "UTC"
    level_regex: str = ""
    message_regex: str | None = None
    fields_regexes: tuple[FieldRule, ...] = ()
    on_missing_timestamp: str = "sentinel"
    template_hashes: bool = False


@dataclass(frozen=True)
class Plugin:
    """Which files a parser gets: glob patterns, excludes winning."""

    name: str = "default"
    type: str = "regex"
    include: tuple[str, ...] = ("*",)
    exclude: tuple[str, ...] = ()
    parser: ParserConfig = field(default_factory=ParserConfig)


@dataclass(frozen=True)
class Settings:
    log_paths: tuple[str, ...] = ()
    data_path: str = "data"
    plugins: tuple[Plugin, ...] = ()
    flush_seconds: int = 5
    max_bytes_per_batch: int = 64 << 20
    max_entries_per_batch: int = 0


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


#: Other spellings of settings that configuration files use.
ALIASES = {"name": "name", "field": "field_name", "fields": "fields_regexes", "include_patterns": "include", "exclude_patterns": "exclude", "data_directory": "data_path", "paths": "log_paths"}


def _build(kind: type, data: dict) -> object:
    names = {f.name for f in fields(kind)}
    given = {}
    for key, value in data.items():
        name = _snake(key)
        name = name if name in names else ALIASES.get(name, name)
        if name not in names:
            raise ValueError(f"unknown setting {key!r} for {kind.__name__}")
        nested = {"fields_regexes": FieldRule, "plugins": Plugin}.get(name)
        if nested:
            value = tuple(_build(nested, v) for v in value)
        elif name == "parser":
            value = _build(ParserConfig, value)
        elif isinstance(value, list):
            value = tuple(value)
        given[name] = value
    return kind(**given)


def load_config(source: str | dict) -> Settings:
    """Settings from a dict or a JSON file, keys in snake_case or PascalCase."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            source = json.load(f)
    return _build(Settings, source)


def group_count(regex: str) -> int:
    return re.compile(regex).groups


def validate_config(settings: Settings) -> list[str]:
    """What is wrong with the settings, in words; an empty list: nothing."""
    wrong = []
    for plugin in settings.plugins:
        p = plugin.parser
        named = [("start_of_entry_regex", p.start_of_entry_regex), ("timestamp_regex", p.timestamp_regex), ("level_regex", p.level_regex), ("message_regex", p.message_regex)]
        named += [(f"field {f.field_name!r}", f.regex) for f in p.fields_regexes]
        for what, regex in named:
            try:
                re.compile(regex or "")
            except re.error as e:
                wrong.append(f"{plugin.name}: {what} does not compile: {e}")
        types: dict[str, str] = {}
        for f in p.fields_regexes:
            if f.type not in TYPES:
                wrong.append(f"{plugin.name}: field {f.field_name!r} has the unknown type {f.type!r}")
            if f.type == "datetime" and not f.format:
                wrong.append(f"{plugin.name}: field {f.field_name!r} is a datetime without a format")
            if f.field_name.lower() in {c.lower() for c in BASE_COLUMNS}:
                wrong.append(f"{plugin.name}: field {f.field_name!r} is named like a column of every entry")
            if types.setdefault(f.field_name, f.type) != f.type:
                wrong.append(f"{plugin.name}: field {f.field_name!r} has two types")
        if p.on_missing_timestamp not in ("sentinel", "reject"):
            wrong.append(f"{plugin.name}: on_missing_timestamp is neither sentinel nor reject")
    return wrong
