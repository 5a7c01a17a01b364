"""Text primitives as Column functions, with Python's notions of white space and lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``\s`` and ``strip`` see it, for use inside a character class.
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S = f"[{WS}]"
_WS_CHARACTERS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Number token of the current rule set: not right after ``^``, with an optional fraction tail.
NUM = rf"(?<!\^)-?\$?\d[\d,]*\.?\d*(?:{S}*/{S}*\d+)?"
#: Number token of the older rule sets.
NUM_PLAIN = r"-?\$?\d[\d,]*\.?\d*"
#: A number that needs no cleaning, as most do.
_PLAIN = r"\A-?\d+(?:\.\d+)?\z"
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WS_CHARACTERS))


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(f"[^{WS}]"))


def first_paragraph(text: Column) -> Column:
    """The first piece between blank lines that is not blank, stripped; else empty."""
    pieces = F.filter(F.transform(F.split(text, rf"\n{S}*\n"), strip), lambda x: x != "")
    # most answers are one line, which needs no cutting
    return F.when(F.contains(text, F.lit("\n")) | text.isNull(), F.coalesce(F.try_element_at(pieces, F.lit(1)), F.lit(""))).otherwise(strip(text))


def lines(text: Column) -> Column:
    """All lines, without their ends."""
    return F.split(F.regexp_replace(text, rf"(?:{_LINE_ENDS})\z", ""), _LINE_ENDS)


def nonempty_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _LINE_ENDS), strip), lambda x: x != "")


def collapse(text: Column) -> Column:
    # visible ASCII is ruled out first, as most characters are
    return F.regexp_replace(text, f"[[^!-~]&&{S}]+", " ")


def collapse_str(text: str) -> str:
    """``collapse`` of a text in Python, by words, which takes a tenth of the pattern's time."""
    words = " ".join(text.split())
    if not words:
        return " " if text else ""
    return f"{' ' if text[0].isspace() else ''}{words}{' ' if text[-1].isspace() else ''}"


def bare_text(text: Column) -> Column:
    """Strips space, quotes, space and closing dots, in this order."""
    return F.rtrim(strip(F.btrim(strip(text), F.lit('"'))), F.lit("."))


def normalize_text(text: Column) -> Column:
    """Strips space, quotes, space and closing dots, in this order, collapses white space and lowers."""
    return F.lower(collapse(bare_text(text)))


def normalize_audit(text: Column) -> Column:
    """Lowers and collapses white space only."""
    return strip(collapse(F.lower(text)))


def _to_double(text: Column) -> Column:
    """As Python's float() reads plain and exponent notation; null for anything else."""
    plain = strip(text)
    return F.when(F.regexp_like(plain, F.lit(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")), plain.try_cast("double"))


def clean_number(token: Column) -> Column:
    """A number token without ``$``, ``,`` and closing dots as a double; null if it is none."""
    return F.when(F.regexp_like(token, F.lit(_PLAIN)), token.try_cast("double")).otherwise(_to_double(F.rtrim(F.translate(token, "$,", ""), F.lit("."))))


def parse_number(token: Column) -> Column:
    """As ``clean_number``, and ``a/b`` is a fraction; a zero divisor gives null."""
    bare = F.rtrim(strip(F.translate(token, "$,", "")), F.lit("."))
    top, bottom = F.substring_index(bare, "/", 1), F.regexp_replace(bare, r"\A[^/]*/", "")
    cleaned = F.when(bare.contains("/"), F.try_divide(_to_double(top), F.nullif(_to_double(bottom), F.lit(0.0)))).otherwise(_to_double(bare))
    return F.when(F.regexp_like(token, F.lit(_PLAIN)), token.try_cast("double")).otherwise(cleaned)


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUM), F.lit(0))


def quote_regex(text: Column) -> Column:
    r"""A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
