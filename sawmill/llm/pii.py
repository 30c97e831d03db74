"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import put_columns, released, small_batches, with_fields

#: Characters before and after a span whose words count as its context.
NEAR_BEFORE, NEAR_AFTER = 48, 24
#: What a context word adds to a score, and what a word that speaks against adds.
FOR, AGAINST = 0.35, -0.35
#: Spans of kinds beyond the base count from this score on.
THRESHOLD = 0.6


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others by Luhn's rule."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's first four characters, moved to its end, leave 1 by 97 (letters from 10 on)."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def no_checksum(text: str) -> bool:
    return True


def ip_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in text.split("."))


def card_number(text: str) -> bool:
    d = digits_of(text)
    return 13 <= len(d) <= 19 and luhn(d)


def phone_number(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


#: Fixed lengths of account numbers by country, a sample of large ones; other countries: 15 to 34.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return len(code) == IBAN_LENGTHS.get(code[:2], len(code)) and 15 <= len(code) <= 34 and mod97(code)


def social_number(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def link_address(text: str) -> bool:
    """Whether six octets can name one device: not a group, and not all the same."""
    octets = text.lower().split(":")
    return int(octets[0], 16) % 2 == 0 and len(set(octets)) > 1


@dataclass(frozen=True)
class Rule:
    """A kind of personal data.

    ``spans`` finds what the pattern matches, leftmost and without overlaps; ``valid`` confirms or drops a match, and
    it is not tried again shorter. A match has the score ``sure``, changed by words nearby. Base kinds stay whatever their score.
    """

    kind: str
    spans: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    sure: float
    words: frozenset[str] = frozenset()
    base: bool = False


DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @: a search by the pattern
    tries a long run of letters from each of its places."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            free = domain.end()
            yield begin, free
        at = text.find("@", max(free, at + 1))


def by_pattern(pattern: str, needs: str | None = None) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Matches of a pattern that no text makes slow; texts without the character ``needs`` are not searched."""
    compiled = re.compile(pattern)

    def spans(text: str) -> Iterator[tuple[int, int]]:
        if needs is None or needs in text:
            for m in compiled.finditer(text):
                yield m.span()

    return spans


#: The patterns of kinds of the base are fixed. A look-behind and possessive repeats keep them linear on long runs of
#: digits; they change no match, as a run of digits fails or matches from its first place.
RULES = (
    Rule("email", emails, no_checksum, 0.8, frozenset(("mail", "email", "contact", "write", "correo", "kontakt", "courriel")), True),
    Rule("ip", by_pattern(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."), ip_parts, 0.6, frozenset(("ip", "host", "address", "server", "login", "adresse")), True),
    Rule("card", by_pattern(r"[0-9](?:[\x20-]?[0-9])++"), card_number, 0.7, frozenset(("card", "visa", "credit", "payment", "tarjeta", "karte", "carte")), True),
    Rule("phone", by_pattern(r"\+[0-9][\x20().0-9-]+[0-9]", "+"), phone_number, 0.7, frozenset(("phone", "tel", "call", "mobile", "fax", "telefon", "telefono")), True),
    Rule("iban", by_pattern(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])"), iban, 0.9, frozenset(("iban", "account", "bank", "konto", "cuenta", "compte"))),
    Rule("ssn", by_pattern(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"), social_number, 0.4, frozenset(("ssn", "social", "security"))),
    Rule("mac", by_pattern(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])", ":"), link_address, 0.4, frozenset(("mac", "device", "ethernet", "wifi"))),
)
#: Words that speak against personal data: examples and placeholders.
DOUBTS = frozenset(("example", "sample", "dummy", "test", "fake", "placeholder", "version"))
WORD = re.compile(r"[a-z]+")


def score(text: str, begin: int, end: int, rule: Rule) -> float:
    """The rule's own score, moved once by words of its kind nearby and once by words that speak against it; 0 to 1."""
    near = {*WORD.findall(text[max(0, begin - NEAR_BEFORE) : begin].lower()), *WORD.findall(text[end : end + NEAR_AFTER].lower())}
    moved = rule.sure + FOR * bool(near & rule.words) + AGAINST * bool(near & DOUBTS)
    return round(min(1.0, max(0.0, moved)), 2)


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int, float, bool]]:
    """(kind, begin, end, score, base) of what a text holds, by kind in the rules' order, then place; end exclusive, in code points."""
    out = []
    for rule in rules if text else ():
        for begin, end in rule.spans(text):
            if rule.valid(text[begin:end]):
                sure = score(text, begin, end, rule)
                if rule.base or sure >= THRESHOLD:
                    out.append((rule.kind, begin, end, sure, rule.base))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("begin", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("base", T.BooleanType(), False)])


def annotate(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with the personal data of each text as an array of (kind, begin, end, score, base).

    One pass without a shuffle over whole texts; null and empty texts have none. Other columns stay, one of the
    new one's name gives way. Spans of one kind don't overlap; spans of different kinds may.
    """
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
    names = SPAN.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, s)) for s in find(t.as_py())] for t in batch.column(text_col)]
            yield put_columns(batch, **{out_col: pa.array(found, arrow)})

    return small_batches(docs).mapInArrow(lambda b: released(run(b)), with_fields(docs.schema, T.StructField(out_col, T.ArrayType(SPAN, False), False)))


def redact(docs: DataFrame, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span of at least that score replaced by its kind in angle brackets, of overlapping ones the
    earliest, then longest; null texts stay null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(text_col):
                text, parts, at = value.as_py(), [], 0
                for kind, begin, end, sure, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
                    if begin >= at and sure >= least:
                        parts += [text[at:begin], f"<{kind}>"]
                        at = end
                out.append(None if text is None else "".join(parts) + text[at:])
            place = batch.schema.get_field_index(text_col)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return small_batches(docs).mapInArrow(lambda b: released(run(b)), docs.schema)


BASE_KINDS = tuple(r.kind for r in RULES if r.base)


def summary(found: DataFrame, id_col: str = "doc_id", pii_col: str = "pii") -> DataFrame:
    """(doc_id, n_ of each base kind, base_sha256, spans): counts and digests of what ``annotate`` has found."""
    spans = F.col(pii_col)
    shown = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")
    of_kind = lambda kind: F.filter(spans, lambda s: s.base & (s.kind == kind))
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(shown(F.filter(spans, lambda s: s.base)).cast("binary"), 256).alias("base_sha256"), shown(spans).alias("spans"))
