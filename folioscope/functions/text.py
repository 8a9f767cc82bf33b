"""Small text functions: normalization, positional distance, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.xml import as_column

# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295


def normalize_text(value) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(as_column(value), r"\s+", " ")))


def string_distance(before, after) -> Column:
    """Share of positions that differ, 4 decimals; length difference counts as mismatch.

    Both strings become character arrays that are zipped once, so the cost is
    linear in the length. Lengths are code points.
    """
    a = F.coalesce(as_column(before), F.lit(""))
    b = F.coalesce(as_column(after), F.lit(""))
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    changed = F.aggregate(pairs, F.lit(0), lambda total, flag: total + flag)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") & (b == ""), F.lit(0.0)).when(
        (a == "") | (b == ""), F.lit(1.0)
    ).otherwise(F.round(changed / longest, 4))


def fnv1a(value) -> Column:
    """32-bit FNV-1a, one step per character with its first UTF-16 unit, as 8 hex digits."""
    units = F.split(as_column(value), "")
    folded = F.aggregate(
        units,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda acc, ch: (acc.bitwiseXOR(_code(ch)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK_32)),
    )
    number = F.when(as_column(value) == "", F.lit(FNV_OFFSET).cast("bigint")).otherwise(folded)
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def _code(ch: Column) -> Column:
    return F.conv(F.substring(F.hex(F.encode(ch, "UTF-16BE")), 1, 4), 16, 10).cast("bigint")


def round_half_up(value) -> Column:
    """Rounding towards positive infinity on ties, as in the source formats' tools."""
    return F.floor(as_column(value) + F.lit(0.5))


def nearest(value, digits: int) -> Column:
    """``round_half_up`` at a number of decimals."""
    return F.floor(as_column(value) * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def object_id(fmt: Column, part: Column, idx: Column) -> Column:
    """``format:`` + first 16 hex digits of sha256 over format, part and position."""
    digest = F.sha2(F.concat(fmt, part, idx.cast("string")), 256)
    return F.concat(fmt, F.lit(":"), F.substring(digest, 1, 16))
