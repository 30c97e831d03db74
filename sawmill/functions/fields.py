"""Dynamic fields as expressions: access, tests and rendering, without exploding rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sawmill.schema import SLOTS


def _column(fields: Column | str) -> Column:
    return F.col(fields) if isinstance(fields, str) else fields


def element(name: str | Column, fields: Column | str = "Fields") -> Column:
    """The tagged value of a field; null if the entry lacks it."""
    return F.get(F.filter(_column(fields), lambda f: f.Key == name), F.lit(0))


def value(name: str, kind: str, fields: Column | str = "Fields") -> Column:
    """The field in its type's slot; null if it is absent or was stored otherwise."""
    out = element(name, fields)[SLOTS[kind]]
    return out.try_cast("timestamp") if kind == "datetime" else out


def raw(name: str | Column, fields: Column | str = "Fields") -> Column:
    """The field as text whatever its slot, for values that didn't fit their type."""
    text = lambda e: F.coalesce(e.StringValue, e.LongValue.cast("string"), e.DoubleValue.cast("string"), e.BoolValue.cast("string"))
    return F.get(F.transform(F.filter(_column(fields), lambda f: f.Key == name), text), F.lit(0))  # the list is searched once for all slots


def has(name: str, test=None, fields: Column | str = "Fields") -> Column:
    """Whether the entry has the field (and ``test`` holds for its tagged value)."""
    return F.exists(_column(fields), lambda f: (f.Key == name) & (test(f) if test else F.lit(True)))


def render(fields: Column | str = "Fields") -> Column:
    """All fields as ``key=value`` in order, texts with spaces in single quotes, fields without a value left out;
    null if there are no fields."""
    fields = _column(fields)

    def one(f: Column) -> Column:
        text = F.when(f.StringValue.contains(" "), F.concat(F.lit("'"), f.StringValue, F.lit("'"))).otherwise(f.StringValue)
        shown = F.coalesce(text, f.LongValue.cast("string"), f.DoubleValue.cast("string"), f.BoolValue.cast("string"))
        return F.concat(f.Key, F.lit("="), shown)

    return F.when(F.size(fields) > 0, F.array_join(F.array_compact(F.transform(fields, one)), " "))
