"""Chat formatting: heterogeneous layouts to canonical turns, turns to one marked text and back.

Only DataFrame functions run here. A layout is known by its fingerprint, the SHA-256 of its nested
field paths, which selects a declarative mapping.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"

#: Marks of the template. Text and role hold none of ``#``, ``<``, ``:`` (role only) once escaped.
HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
#: Escapes, in the order of escaping; each backslash of an escaped text starts one of them.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: Turns, or spans, of a block.
WIDTH = 256


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: an array with role and text fields. ``single``: fixed (role, path) pairs, a null or
    empty path's turn left out. ``row``: the layout has a row for each turn: order, role and text.
    """

    name: str
    turns: tuple[str, str, str] | None = None
    single: tuple[tuple[str, str], ...] = ()
    row: tuple[str, str, str] | None = None

    def paths(self) -> list[str]:
        if self.turns:
            return [f"{self.turns[0]}[].{self.turns[1]}", f"{self.turns[0]}[].{self.turns[2]}"]
        return [path for _, path in self.single] if self.single else list(self.row or ())


MAPPINGS = (
    Mapping("rows", row=("turn", "role", "text")),
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("conversations", turns=("conversations", "from", "value")),
    Mapping("turns", turns=("turns", "role", "text")),
    Mapping("prompt_response", single=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", single=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", single=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction_output", single=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input_output", single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_prompt_response", single=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("system_instruction_input_output", single=(
        ("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction_output", single=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str]) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves, ``[]`` standing for an array's elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


BY_FINGERPRINT = {fingerprint(m.paths()): m for m in MAPPINGS}
KNOWN = {p for m in MAPPINGS for p in m.paths()}


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping whose fingerprint the known paths of ``schema`` have; of those with extra known
    paths the one with most paths of its own. Other columns don't count. ValueError: none fits."""
    paths = [p for p in field_paths(schema) if p in KNOWN]
    if found := BY_FINGERPRINT.get(fingerprint(paths)):
        return found
    fits = [m for m in MAPPINGS if set(m.paths()) <= set(paths)]
    if not fits:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(schema))}")
    return max(fits, key=lambda m: len(m.paths()))


def _role(role: Column) -> Column:
    named = reduce(lambda out, kv: out.when(F.lower(role) == kv[0], kv[1]), ROLES.items(), F.when(role.isNull(), ""))
    return named.otherwise(role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _reader(role: str, text: str):
    """The turn of an array's element."""
    return lambda x: _turn(x[role], x[text])


def _single(m: Mapping, get) -> Column:
    """Turns of one row; neighbours of one role (an instruction and its input) are joined by an empty line."""
    roles = list(dict.fromkeys(r for r, _ in m.single))
    turns = []
    for role in roles:
        texts = F.array_compact(F.array(*[F.nullif(get(p), F.lit("")) for r, p in m.single if r == role]))
        turns.append(F.when(F.size(texts) > 0, _turn(F.lit(role), F.array_join(texts, "\n\n"))))
    return F.array_compact(F.array(*turns))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turns) of any known layout, turns being an array of (role, text).

    With a row for each turn, rows of an id are ordered by turn (null first; ties by role and text),
    role names kept; repeated rows stay. Null text and role: empty.
    """
    m = mapping_of(df.schema)
    if m.row:
        order, role, text = (F.col(c) for c in m.row)
        given = F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in (("role", role), ("text", text))])
        rows = df.select(F.col(id_col), F.struct(order.alias("o"), given.alias("t")).alias("_r"))
        grouped = rows.groupBy(id_col).agg(F.array_sort(F.collect_list("_r")).alias("_r"))
        return grouped.select(id_col, F.transform("_r", lambda r: r.t).alias("turns"))
    if m.turns:
        array, role, text = m.turns
        turns = F.transform(F.coalesce(F.col(array), F.array()), _reader(role, text))
        return df.select(id_col, turns.alias("turns"))
    return df.select(id_col, _single(m, lambda p: F.col(p).cast("string")).alias("turns"))


def json_paths(variant: Column) -> Column:
    """The nested field paths of one row's JSON value (a variant) that mappings of whole rows know, as ``field_paths``
    names them, in order; an array's name with ``[]`` where it has no objects. A row whose only such field is an empty
    or null turn array has its mapping's paths."""
    none = F.array().cast("array<string>")
    top = F.coalesce(F.map_keys(F.try_variant_get(variant, "$", "map<string,variant>")), none)
    known, found, blank = {p for m in MAPPINGS if not m.row for p in m.paths()}, [top], []

    def inner(array: str):
        """The paths that an element has; one that is no object is a path itself."""
        def paths(x: Column) -> Column:
            keys = F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))
            named = F.transform(keys, lambda k: F.concat(F.lit(f"{array}[]."), k))
            return F.when(F.is_variant_null(x), none).otherwise(F.coalesce(named, F.array(F.lit(f"{array}[]"))))

        return paths

    for m in MAPPINGS:
        if not m.turns:
            continue
        array = m.turns[0]
        value = F.try_variant_get(variant, f"$.{array}", "variant")
        items = F.try_variant_get(variant, f"$.{array}", "array<variant>")
        is_blank = F.coalesce(F.is_variant_null(value) | (F.size(items) == 0), F.lit(False))
        blank.append(F.when(is_blank, F.array(*map(F.lit, m.paths()))).otherwise(none))
        found.append(F.coalesce(F.flatten(F.transform(items, inner(array))), none))
        found.append(F.when(value.isNotNull() & ~is_blank & items.isNull(), F.array(F.lit(f"{array}[]"))).otherwise(none))
        known.add(f"{array}[]")
    paths = F.array_sort(F.array_intersect(F.concat(*found), F.array(*map(F.lit, sorted(known)))))
    return F.when(F.size(paths) > 0, paths).otherwise(F.array_sort(F.concat(*blank)))


def canonical_json(df: DataFrame, json_col: str = "json", id_col: str = "conv_id") -> DataFrame:
    """(id_col, layout, turns) of JSON texts of mixed layouts in one column, a mapping for each row.

    The fingerprint of a row's known paths selects its mapping; other fields, in rows or turns, don't count.
    Empty and null turn arrays: no turns. Rows whose fingerprint no mapping has (known fields that no mapping
    takes together included, as one would be lost), invalid JSON and null: null layout and turns, kept for the
    caller to set aside.
    """
    df = df.select(id_col, F.try_parse_json(json_col).alias("_v"))
    df = df.select(id_col, "_v", F.sha2(F.array_join(json_paths(F.col("_v")), "\n"), 256).alias("_f"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if m.row:
            continue
        if m.turns:
            array, role, text = m.turns
            given = F.try_variant_get("_v", f"$.{array}", f"array<struct<{role}:string,{text}:string>>")
            found = F.coalesce(F.transform(given, _reader(role, text)), F.array().cast(TURNS))
        else:
            found = _single(m, lambda p: F.try_variant_get("_v", f"$.{p}", "string"))
        is_it = F.col("_f") == fingerprint(m.paths())
        layout, turns = F.when(is_it, m.name).otherwise(layout), F.when(is_it, found).otherwise(turns)
    return df.select(id_col, layout.alias("layout"), turns.alias("turns"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Exact inverse of ``escape``: the backslash's own code comes last, when no other is left."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def blocks(array: Column, width: int = WIDTH) -> Column:
    """An array in pieces of ``width`` elements, the last one shorter."""
    n = F.ceil(F.size(array) / width).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    return F.transform(numbers, lambda k: F.slice(array, k * width + 1, F.lit(width)))


def format_turns(df: DataFrame, id_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """(id_col, formatted, loss_spans) of (id_col, turns).

    ``formatted`` is HEAD role AFTER_ROLE text END for each turn, role and text escaped. ``loss_spans``
    holds (start, length) in code points of each text of ``loss_role``. No turns: an empty text. Spans are made
    by blocks of turns, whose starts are summed after, so that long conversations don't copy growing arrays.
    """
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(HEAD), escape(t.role, True), F.lit(AFTER_ROLE)).alias("head"),
        escape(t.text).alias("text"), (t.role == loss_role).alias("loss")))
    df = df.select(id_col, pieces.alias("_p"))
    size = lambda p: (F.length(p.head) + F.length(p.text)).cast("long") + len(END)
    whole = F.array_join(F.transform("_p", lambda p: F.concat(p.head, p.text, F.lit(END))), "")
    start = T.StructType([T.StructField("at", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])
    empty = F.from_json(F.lit('{"at": 0, "spans": []}'), start)

    def add(acc: Column, p: Column) -> Column:
        span = F.struct((acc.at + F.length(p.head)).alias("start"), F.length(p.text).cast("long").alias("length"))
        spans = F.when(p.loss, F.concat(acc.spans, F.array(span))).otherwise(acc.spans)
        return F.struct((acc.at + size(p)).alias("at"), spans.alias("spans"))

    starts = F.aggregate("_b", F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b.at)))
    df = df.select(id_col, whole.alias("formatted"), F.transform(blocks(F.col("_p")), lambda b: F.aggregate(b, empty, add)).alias("_b"))
    df = df.select(id_col, "formatted", "_b", starts.alias("_s"))
    placed = F.zip_with("_b", F.slice("_s", 1, F.size("_b")), lambda b, at: F.transform(b.spans, lambda s: F.struct((s.start + at).alias("start"), s.length.alias("length"))))
    return df.select(id_col, "formatted", F.flatten(placed).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: the inverse of ``format_turns``."""
    pieces = F.slice(F.split(formatted, END), 1, F.greatest(F.size(F.split(formatted, END)) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        cut = F.locate(AFTER_ROLE, p)
        return F.struct(
            unescape(F.substring(p, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(p, cut + len(AFTER_ROLE), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order. Spans are in order, as ``format_turns`` gives them: each
    block of them is cut from the text once, as finding a place in a text means going there from its beginning."""
    cut = lambda text, at, length: F.substring(text, (at + 1).cast("int"), length.cast("int"))

    def part(b: Column) -> Column:
        first, last = F.get(b, F.lit(0)).start, F.element_at(b, -1)
        return F.struct(first.alias("at"), cut(formatted, first, last.start + last.length - first).alias("text"), b.alias("spans"))

    texts = F.transform(F.transform(blocks(spans), part), lambda p: F.transform(p.spans, lambda s: unescape(cut(p.text, s.start - p["at"], s.length))))
    return F.flatten(texts)
