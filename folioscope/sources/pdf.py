"""PDF bytes: literal text operators, syntax counts, compressed streams."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import object_id
from folioscope.functions.xml import as_column, matches, substitute

# Possessive quantifiers keep the matcher from recursing on long literals.
LITERAL = r"\([^\\)]*+(?:\\(?s:.)[^\\)]*+)*+\)"
SHOW = rf"({LITERAL})\s*(?:Tj|'|\")"
SHOW_ARRAY = r"(?s)\[([^\]]*)\]\s*TJ"


def unescape_literal(value) -> Column:
    """Backslash escapes of a literal string; an unknown escape keeps its letter."""
    named = F.create_map(*[F.lit(v) for pair in {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}.items() for v in pair])
    return substitute(as_column(value), r"(?s)\\(.|$)", lambda c: F.coalesce(F.try_element_at(named, c), c), 1)


def useful_text(value) -> Column:
    text = F.trim(as_column(value))
    visible = F.length(F.regexp_replace(text, r"\p{Cc}", ""))
    markers = ("%PDF", "stream", "xref")
    unwanted = F.contains(text, F.lit(markers[0]))
    for marker in markers[1:]:
        unwanted = unwanted | F.contains(text, F.lit(marker))
    return (visible >= 2) & ~unwanted


def _inner(literal: Column) -> Column:
    return unescape_literal(F.substr(literal, F.lit(2), F.length(literal) - 2))


@F.pandas_udf(T.ArrayType(T.StringType()))
def inflate_streams(content: pd.Series) -> pd.Series:
    """Text of deflated content streams; streams with other filters are skipped."""

    def one(data: bytes) -> list[str]:
        out = []
        for body in re.findall(rb"\b\d+\s+\d+\s+obj(.*?)endobj", data or b"", re.S):
            found = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S)
            named = re.search(rb"/Filter\s*(\[[^\]]+\]|/[A-Za-z0-9]+)", body)
            if not found or not named or re.findall(rb"/([A-Za-z0-9]+)", named.group(1)) != [b"FlateDecode"]:
                continue
            try:
                out.append(zlib.decompress(found.group(1)).decode("latin-1"))
            except zlib.error:
                continue
        return out

    return content.map(one)


def _strings(text: Column) -> Column:
    """All shown strings: single operators first, then arrays joined per operator."""
    single = F.transform(matches(text, SHOW, 1), _inner)
    arrays = F.transform(
        matches(text, SHOW_ARRAY, 1),
        lambda body: F.array_join(F.transform(matches(body, LITERAL, 0), _inner), ""),
    )
    return F.concat(single, arrays)


def pdf_text(packages: DataFrame, deflated: bool = False, charset: str = "ISO-8859-1") -> DataFrame:
    """Text objects of PDF packages. ``deflated`` also reads compressed streams."""
    raw = _strings(F.decode("content", charset))
    strings = raw
    if deflated:
        streams = F.flatten(F.transform(inflate_streams("content"), _strings))
        strings = F.concat(raw, streams)
    return (
        packages.filter(F.col("format") == "pdf")
        .select("doc_id", F.posexplode(F.filter(strings, useful_text)).alias("idx", "text"))
        .withColumn("page", F.lit(1))
        .withColumn("object_id", object_id(F.lit("pdf"), F.lit("page-1"), F.col("idx")))
    )
