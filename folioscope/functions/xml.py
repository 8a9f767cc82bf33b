"""Markup text as columns: escaping, attributes, repeated elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four named entities the document formats rely on.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
UNESCAPES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]

TEXT_TAGS = ("a:t", "w:t", "t", "v")
NUMERIC_REFERENCE = r"&#(x[0-9A-Fa-f]+|[0-9]+);"


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _replace_all(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def substitute(text: Column, pattern: str, fn: Callable[[Column], Column], group: int = 0) -> Column:
    """Replace every match of ``pattern`` by ``fn(group)`` in one pass.

    The text between matches and the matches themselves are two arrays that
    are zipped back together, so a replacement value is never scanned again.
    """
    literals = F.split(text, pattern, -1)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), fn)
    glued = F.zip_with(literals, tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(glued, "")


def code_point(value: Column) -> Column:
    """The character with this code point, NULL outside Unicode scalar values."""
    valid = (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(value), 8, "0"))
    return F.when(valid, F.decode(utf32, "UTF-32"))


def _reference_number(raw: Column) -> Column:
    hexadecimal = F.regexp_replace(raw, "^x0*", "")
    decoded = F.when(F.length(hexadecimal) <= 8, F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10))
    return F.when(raw.startswith("x"), decoded).otherwise(raw).try_cast("bigint")


def decode_references(text: Column) -> Column:
    """Numeric character references; what names no character stays as written."""
    tokens = F.regexp_extract_all(text, F.lit(NUMERIC_REFERENCE), F.lit(1))
    chars = F.transform(F.transform(tokens, _reference_number), code_point)
    kept = F.zip_with(chars, tokens, lambda c, t: F.coalesce(c, F.concat(F.lit("&#"), t, F.lit(";"))))
    literals = F.split(text, NUMERIC_REFERENCE, -1)
    return F.array_join(F.zip_with(literals, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def xml_escape(value) -> Column:
    return _replace_all(as_column(value), ESCAPES)


def xml_unescape(value, numeric: bool = True) -> Column:
    """Named entities first (``&amp;`` last), then numeric references.

    Text without ``&`` is passed through untouched, which is the usual case.
    """
    raw = as_column(value)
    named = _replace_all(raw, UNESCAPES)
    if numeric:
        named = F.when(F.contains(raw, F.lit("#")), decode_references(named)).otherwise(named)
    return F.when(F.contains(raw, F.lit("&")), named).otherwise(raw)


def element_pattern(*tags: str) -> str:
    """Non-greedy element match; like the formats' own readers it ignores nesting."""
    names = "|".join(tags)
    return rf"(?s)<(?:{names})(?:\s[^>]*)?>(.*?)</(?:{names})>"


def elements(text, *tags: str, group: int = 1) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(element_pattern(*tags)), F.lit(group))


def matches(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(group))


def first_match(text, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or NULL when there is none; one pass over the text."""
    return F.try_element_at(F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(group)), F.lit(1))


def attribute(tag, name: str) -> Column:
    """Attribute value in either quote style; NULL when absent.

    The name is looked for before what may not stand in front of it: few places have the name, all have a character in front.
    """
    return first_match(tag, rf"""{name}(?<![\w:.-]{name})\s*=\s*(["'])(.*?)\1""", 2)


def not_blank(value) -> Column:
    return as_column(value).rlike(r"\S")
