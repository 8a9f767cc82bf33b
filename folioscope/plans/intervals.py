"""Joins of overlapping intervals: plain ones in small scopes, levels of doubling width in crowded ones.

Where a scope has at most ``FEW`` rows on the right, each row of the left meets them as they are: no row is copied. In
other scopes an interval lives on the lowest level whose cells are at least as wide as it is, so it touches one or two cells
there, however long it is. Two overlapping intervals meet on the level of the longer one: that one
is at home there, the shorter one visits. Only levels on which the other side has someone at home are
visited; which these are is a small array that the same query works out, or all levels up to a known width. A visitor never
meets a visitor: what is at home on the right waits in two slots, for those at home on the left and for visitors from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 64


def crowded(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than ``FEW`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW).select(*keys)


def level_of(low: Column, high: Column, base: float) -> Column:
    """Lowest level with cells of ``base * 2**level`` that are no narrower than the interval."""
    wide = F.greatest(high - low, F.lit(0.0)) / F.lit(float(base))
    level = F.when(wide <= 1.0, F.lit(0)).otherwise(F.ceil(F.log2(wide))).cast("int")
    # The logarithm may round to either side of a power of two.
    return F.when(wide > F.pow(F.lit(2.0), level), level + 1).otherwise(level)


def cells(low: Column, high: Column, level: Column, base: float) -> Column:
    width = F.lit(float(base)) * F.pow(F.lit(2.0), level)
    first = F.floor(low / width)
    return F.sequence(first, F.greatest(first, F.floor(high / width)))


def _placed(df: DataFrame, span: tuple[str, str], base: float, levels: Column, home: list[int], visit: list[int]) -> DataFrame:
    """Rows with ``_level``, ``_cell`` and ``_slot``, of which those at home and those on a visit take the given ones."""
    low, high = map(F.col, span)
    own = df.filter(low.isNotNull() & high.isNotNull()).withColumn("_own", level_of(low, high, base)).withColumn("_levels", levels)
    levelled = own.withColumn("_level", F.explode(F.array_union("_levels", F.array("_own")))).filter(F.col("_level") >= F.col("_own"))
    celled = levelled.withColumn("_cell", F.explode(cells(low, high, F.col("_level"), base)))
    slots = F.when(F.col("_level") == F.col("_own"), F.array(*map(F.lit, home))).otherwise(F.array(*map(F.lit, visit)))
    return celled.withColumn("_slot", F.explode(slots)).drop("_own", "_levels")


def _levels(df: DataFrame, span: tuple[str, str], base: float, widest: float | None) -> Column:
    if widest is not None:
        return F.sequence(F.lit(0), level_of(F.lit(0.0), F.lit(float(widest)), base))
    low, high = map(F.col, span)
    return df.filter(low.isNotNull() & high.isNotNull()).agg(F.collect_set(level_of(low, high, base))).scalar()


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], base: float,
                widest: float | None = None) -> DataFrame:
    """Rows of both sides with equal ``keys`` whose closed intervals overlap, each pair once.

    Apart from the keys the sides have no column in common. An interval with its end before its start counts as its start. ``base``
    is the width of the narrowest cells, best near the usual length; the result does not depend on it. ``widest``, where given, is the longest
    interval there can be on the left, which saves reading that side for its levels.
    """
    start = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    touch = (start <= F.greatest(*map(F.col, left_span))) & (start <= F.greatest(*map(F.col, right_span)))
    known = lambda df, span: df.filter(F.col(span[0]).isNotNull() & F.col(span[1]).isNotNull())
    left, right = known(left, left_span), known(right, right_span)
    # Sides may come out of arrays, which Spark's estimate of their size leaves out: they are never sent whole.
    plain = lambda one, other: one.join(other.hint("merge"), keys).filter(touch)
    many = crowded(right, keys)
    if many.isEmpty():
        return plain(left, right)
    apart = [df.join(many, keys, "left_anti") for df in (left, right)]
    left, right = (df.join(many, keys, "left_semi") for df in (left, right))
    # A pair that shares two cells is kept where the overlap begins.
    once = F.col("_cell") == F.floor(start / (F.lit(float(base)) * F.pow(F.lit(2.0), F.col("_level"))))
    one = _placed(left, left_span, base, _levels(right, right_span, base, None), [0], [1])
    other = _placed(right, right_span, base, _levels(left, left_span, base, widest), [0, 1], [0])
    levelled = one.join(other.hint("merge"), [*keys, "_level", "_cell", "_slot"]).filter(once & touch).drop("_level", "_cell", "_slot")
    return plain(*apart).unionByName(levelled)
