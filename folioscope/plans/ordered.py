"""Ordered per-key numbering that does not put one key into one task.

A plain window over ``doc_id`` sorts a whole document in a single task. Here a
document is cut into chunks along its own position column. Rows are numbered
inside ``(key, chunk)``, the chunk sizes are summed per key (a table that is
smaller by the chunk width), and the two are joined on ``(key, chunk)``, which
adaptive execution may split further. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536


def chunk_of(position: Column, width: int = CHUNK) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    out: str = "rn",
) -> DataFrame:
    """``row_number()`` over ``keys``; ``chunk`` must be monotone in ``order``."""
    tagged = df.withColumn("_chunk", chunk)
    sizes = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    matched = F.col("_chunk").eqNullSafe(F.col("_k_chunk"))
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, matched, "left")
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_inside", "_before", "_k_chunk", *[f"_k_{k}" for k in keys])
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: dict[str, str],
) -> DataFrame:
    """``lag`` of each column in ``values`` (source -> output) over ``keys``.

    The first row of a chunk takes its neighbour from the last row of the
    nearest earlier chunk of the same key; those last rows form a small table.
    """
    tagged = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(f"v_{c}") for c in values])
    tails = tagged.groupBy(*keys, "_chunk").agg(
        F.max_by(packed, F.struct(*order)).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    heads = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        F.lag("_tail").over(across).alias("_carry"),
    )
    matched = F.col("_chunk") == F.col("_k_chunk")
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = (
        tagged.withColumn("_here", F.row_number().over(inside))
        .withColumn("_lag", F.lag(packed).over(inside))
        .join(heads, matched, "left")
        .withColumn("_prev", F.when(F.col("_here") > 1, F.col("_lag")).otherwise(F.col("_carry")))
    )
    for source, out in values.items():
        joined = joined.withColumn(out, F.col(f"_prev.v_{source}"))
    return joined.drop(
        "_chunk", "_here", "_lag", "_carry", "_prev", "_k_chunk", *[f"_k_{k}" for k in keys]
    )


def filled(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, out: str) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, over ``keys``.

    Inside a chunk this is a running window; what earlier chunks carry over
    is one value per chunk.
    """
    tagged = df.withColumn("_chunk", chunk)
    running = Window.partitionBy(*keys, "_chunk").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tails = tagged.filter(F.col(value).isNotNull()).groupBy(*keys, "_chunk").agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    # Chunks without a value of their own still need what earlier ones carry.
    spans = tagged.select(*keys, "_chunk").distinct().join(tails, [*keys, "_chunk"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"),
        F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    matched = F.col("_chunk") == F.col("_k_chunk")
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        tagged.withColumn("_here", F.last(value, ignorenulls=True).over(running))
        .join(carried, matched, "left")
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_chunk", "_here", "_carry", "_k_chunk", *[f"_k_{k}" for k in keys])
    )
