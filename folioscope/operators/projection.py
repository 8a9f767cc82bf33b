"""Field projection, sheet / range / page scopes, object windows and previews."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.cellref import parse_range


def project(df: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requested fields; an unknown field is NULL and gets a diagnostic row."""
    known = set(df.columns)
    projected = df.select(*[F.col(f) if f in known else F.lit(None).cast("string").alias(f) for f in fields])
    missing = [(f, "FIELD_NOT_AVAILABLE") for f in fields if f not in known]
    diagnostics = df.sparkSession.createDataFrame(missing, "field string, code string")
    return projected, diagnostics


def scope_sheet(cells: DataFrame, sheet: str) -> DataFrame:
    """Sheet by 1-based index, part name, or name without regard to case."""
    wanted = sheet.strip()
    if wanted.isdigit():
        return cells.filter(F.col("sheet_idx") == int(wanted))
    hit = F.lower("sheet_name") == wanted.lower()
    if "part" in cells.columns:
        hit = hit | F.col("part").endswith(f"{wanted}.xml")
    return cells.filter(hit)


def scope_range(cells: DataFrame, spec: str) -> DataFrame:
    """Cells inside a range; bounds are literals, so they reach the Parquet scan."""
    c0, r0, c1, r1 = parse_range(spec)
    return cells.filter(F.col("col").between(c0, c1) & F.col("row").between(r0, r1))


def page_filter(column: str, spec: str) -> Column:
    """Predicate for a selection list such as ``1,3-5``."""
    singles: list[int] = []
    hit = F.lit(False)
    for piece in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = piece.partition("-")
        if dash:
            first, last = sorted((int(low), int(high)))
            hit = hit | F.col(column).between(first, last)
        else:
            singles.append(int(low))
    return hit | F.col(column).isin(singles) if singles else hit


def scope_pages(objects: DataFrame, spec: str, column: str = "slide") -> DataFrame:
    return objects.filter(page_filter(column, spec))


def page_objects(objects: DataFrame, offset: int, limit: int, order: str = "idx") -> DataFrame:
    """Window of a document's objects with original, returned and omitted counts.

    The rank filter lets Spark cut each document before the shuffle; counts
    come from a partial aggregate, so no document is sorted whole.
    """
    total = objects.groupBy("doc_id").agg(F.count(F.lit(1)).alias("original_count"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    window = objects.withColumn("rn", rank).filter(F.col("rn") <= offset + limit).filter(F.col("rn") > offset)
    returned = F.greatest(F.least(F.col("original_count") - offset, F.lit(limit)), F.lit(0)).cast("bigint")
    more = F.col("original_count") > offset + limit
    return (
        window.join(total, "doc_id")
        .withColumn("returned_count", returned)
        .withColumn("omitted_count", F.col("original_count") - F.col("returned_count"))
        .withColumn("next_offset", F.when(more, F.lit(offset + limit).cast("bigint")))
    )


def preview(objects: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """First ``n`` characters of a document's texts joined by blanks.

    Every text adds at least one character and one blank, so the first
    ``n / 2 + 1`` objects decide the result; only those are gathered.
    """
    needed = math.ceil(n / 2) + 1
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    head = objects.withColumn("rn", rank).filter(F.col("rn") <= needed)
    piece = F.struct("rn", F.substring("text", 1, n).alias("text"))
    ordered = F.array_sort(F.collect_list(piece))
    joined = F.array_join(F.transform(ordered, lambda p: p["text"]), " ")
    return head.groupBy("doc_id").agg(F.substring(joined, 1, n).alias("preview"))
