"""Titles and heading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.ordered import chunk_of, previous


def doc_titles(ir: DataFrame, fallback: str = "Untitled") -> DataFrame:
    """Explicit title, then metadata title, then the fallback; ``ir`` is JSON text."""
    parsed = F.try_parse_json("ir")
    pick = lambda path: F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING",
                               F.try_variant_get(parsed, path, "string"))
    return ir.select("doc_id", F.coalesce(pick("$.title"), pick("$.metadata.title"), F.lit(fallback)).alias("title"))


def slide_titles(objects: DataFrame) -> DataFrame:
    """Title placeholder of a slide, else the topmost text, else the first object."""
    is_title = F.coalesce(F.col("placeholder").isin("title", "ctrTitle"), F.lit(False))
    order = F.struct(F.when(is_title, 0).otherwise(1).alias("a"), F.coalesce(F.when(~is_title, F.col("y")), F.lit(0)).alias("b"), F.col("pos").alias("c"))
    return objects.groupBy("doc_id", "slide").agg(F.min_by("text", order).alias("title"))


def _with_previous(headings: DataFrame, order: str, width: int) -> DataFrame:
    return previous(headings, ["doc_id"], [order], chunk_of(F.col(order), width), {"text": "prev_text", "level": "prev_level"})


def repeated_headings(headings: DataFrame, order: str = "idx", width: int = 65536) -> DataFrame:
    """Headings equal to the one before (level and text)."""
    rows = _with_previous(headings, order, width)
    same = (F.col("text") == F.col("prev_text")) & F.col("level").eqNullSafe(F.col("prev_level"))
    return rows.filter(same).select("doc_id", order, "level", "text")


def heading_jumps(headings: DataFrame, order: str = "idx", width: int = 65536) -> DataFrame:
    """Headings more than one level below the one before."""
    leveled = headings.filter(F.col("level") > 0)
    return _with_previous(leveled, order, width).filter(F.col("level") - F.col("prev_level") > 1).select(
        "doc_id", order, "prev_level", "level")


def top_object(order: list[Column], keys: list[str], objects: DataFrame) -> DataFrame:
    """First object per key by the given order, cut before the shuffle."""
    return objects.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") == 1).drop("rn")
