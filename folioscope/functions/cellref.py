"""A1 references: letters to numbers and back, range bounds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.xml import as_column

CELL = r"^([A-Za-z]+)([0-9]+)$"


def letters_to_col(letters) -> Column:
    """Letters of either case; the low five bits of a letter are its number."""
    chars = F.split(as_column(letters), "")
    return F.aggregate(chars, F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch).bitwiseAND(31))


def ref_col(ref) -> Column:
    column = as_column(ref)
    return F.when(column.rlike(CELL), letters_to_col(F.regexp_extract(column, CELL, 1)))


def ref_row(ref) -> Column:
    column = as_column(ref)
    return F.when(column.rlike(CELL), F.regexp_extract(column, CELL, 2).try_cast("int"))


def col_to_letters(col) -> Column:
    """Up to three letters, which covers the largest sheet (XFD)."""
    n = as_column(col).cast("int")
    first = F.floor((n - 703) / 676).cast("int")
    second = F.pmod(F.floor((n - 27) / 26).cast("int"), F.lit(26))
    third = F.pmod(n - 1, F.lit(26))
    letter = lambda value: F.char((value + 65).cast("int"))
    return F.concat(
        F.when(n > 702, letter(first)).otherwise(""),
        F.when(n > 26, letter(second)).otherwise(""),
        letter(third),
    )


def make_ref(col, row) -> Column:
    return F.concat(col_to_letters(col), as_column(row).cast("string"))


def range_bounds(ref) -> Column:
    """Struct ``c0, r0, c1, r1`` of a cell or range, corners in any order; NULL if malformed."""
    text = F.replace(F.element_at(F.split(as_column(ref), "!"), -1), F.lit("$"), F.lit(""))
    start = F.split_part(text, F.lit(":"), F.lit(1))
    end = F.when(F.contains(text, F.lit(":")), F.split_part(text, F.lit(":"), F.lit(2))).otherwise(start)
    c0, r0, c1, r1 = ref_col(start), ref_row(start), ref_col(end), ref_row(end)
    bounds = F.struct(
        F.least(c0, c1).alias("c0"),
        F.least(r0, r1).alias("r0"),
        F.greatest(c0, c1).alias("c1"),
        F.greatest(r0, r1).alias("r1"),
    )
    return F.when(start.rlike(CELL) & end.rlike(CELL), bounds)


def parse_range(spec: str) -> tuple[int, int, int, int]:
    """Bounds of a range given as a parameter, for use as literal filters."""
    corners = [re.match(CELL, piece) for piece in spec.replace("$", "").split(":")]
    if not corners or any(c is None for c in corners) or len(corners) > 2:
        raise ValueError(f"not a cell range: {spec!r}")
    cols, rows = [], []
    for corner in corners:
        col = 0
        for ch in corner.group(1).upper():
            col = col * 26 + ord(ch) - 64
        cols.append(col)
        rows.append(int(corner.group(2)))
    return min(cols), min(rows), max(cols), max(rows)
