"""Critique: rules as data over one row of metrics per document."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.xml import not_blank
from folioscope.operators import headings, inventory, verification
from folioscope.operators.integrity import explode_issues, issue
from folioscope.session import cut
from folioscope.sources import textnodes

COMPARISONS = {"=": operator.eq, ">": operator.gt, "<": operator.lt}


@dataclass(frozen=True)
class Rule:
    """``code`` is reported where all comparisons hold and the profile, if the rule names one, fits."""

    code: str
    severity: str
    tests: tuple[tuple[str, str, float], ...]
    profile: str | None = None


# Rules per format, with the profiles they belong to.
RULES = {
    "pptx": [
        Rule("PPTX_ASSETS_NONE", "warning", (("slides", ">", 1), ("assets", "=", 0))),
        Rule("PPTX_CHARTS_NONE", "warning", (("charts", "=", 0),), "kpi|dashboard|board|sales|business"),
        Rule("PPTX_TEXT_DENSITY_HIGH", "warning", (("texts_per_slide", ">", 18),)),
        Rule("PPTX_DUPLICATE_TITLES", "warning", (("repeated_titles", ">", 0),)),
        Rule("PPTX_BLANK_LIKE_SLIDES", "warning", (("slides", ">", 0), ("text_objects", "=", 0), ("charts", "=", 0), ("assets", "=", 0))),
        Rule("PPTX_VISUAL_ANCHOR_LOW", "warning", (("slides", ">", 2), ("assets", "=", 0), ("charts", "=", 0))),
        Rule("PPTX_FONT_TOO_SMALL", "warning", (("tiny", ">", 0),)),
        Rule("PPTX_FONT_FAMILY_FRAGMENTED", "warning", (("mixed", ">", 0),)),
        Rule("PPTX_STRAY_ITALIC_TEXT", "info", (("italic", ">", 0),)),
        Rule("PPTX_BULLET_TOO_LONG", "warning", (("long_bullets", ">", 0),)),
        Rule("PPTX_BULLET_DEPTH_HIGH", "warning", (("deep_bullets", ">", 0),)),
        Rule("PPTX_EXPLICIT_LINE_BREAKS_HIGH", "info", (("line_breaks", ">", 0),)),
        Rule("PPTX_TEXT_OVERFLOW_ESTIMATE", "warning", (("overflows", ">", 0),)),
        Rule("PPTX_OBJECT_OFF_SLIDE", "warning", (("off_slide", ">", 0),)),
        Rule("PPTX_SLIDE_DENSITY_HIGH", "warning", (("dense_slides", ">", 0),)),
        Rule("PPTX_FONT_INVENTORY_FRAGMENTED", "warning", (("fonts", ">", 4),)),
    ],
    "xlsx": [
        Rule("XLSX_DASHBOARD_CHARTS_NONE", "warning", (("charts", "=", 0),), "dashboard|kpi|business"),
        Rule("XLSX_TABLES_NONE", "warning", (("tables", "=", 0),)),
        Rule("XLSX_FORMULAS_NONE", "info", (("formulas", "=", 0),)),
        Rule("XLSX_WIDE_SHEET_READABILITY_RISK", "warning", (("cells", ">", 250),)),
    ],
    "docx": [
        Rule("DOCX_REPEATED_HEADINGS", "warning", (("repeated_headings", ">", 0),)),
        Rule("DOCX_HEADERS_NONE", "info", (("headers", "=", 0),), "proposal|report|business"),
        Rule("DOCX_EMPTY_SECTION", "warning", (("paragraphs", "=", 0),)),
        Rule("DOCX_HEADING_HIERARCHY_GAP", "warning", (("heading_jumps", ">", 0),)),
        # Every placed cell is wider than the limit of the rule, so any cell of a table is one.
        Rule("DOCX_TABLE_WIDTH_RISK", "warning", (("table_cells", ">", 0),)),
        Rule("DOCX_STYLE_VARIETY_LOW", "info", (("styles", "=", 1),)),
    ],
}


def critique(metrics: DataFrame, fmt: str, profile: str = "business") -> DataFrame:
    """``(doc_id, code, severity)`` of the rules of a format that hold; a NULL metric fails its test."""
    def holds(rule: Rule) -> Column:
        return reduce(lambda a, b: a & b, [COMPARISONS[sign](F.col(name), value) for name, sign, value in rule.tests])

    fitting = [r for r in RULES[fmt] if r.profile is None or re.search(r.profile, profile, re.IGNORECASE)]
    return explode_issues(metrics, ["doc_id"], [issue(holds(r), r.code, r.severity) for r in fitting])


def from_diagnosis(diagnosed: DataFrame) -> DataFrame:
    """Findings that come from diagnosis issues: overflow and repair risks."""
    taken = (F.col("code") == "TEXT_OVERFLOW_RISK") | F.col("code").startswith("OFFICE_REPAIR_RISK")
    return diagnosed.filter(taken).select("doc_id", "code", "severity")


def _joined(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "doc_id", "left"), others, first).na.fill(0)


def deck_metrics(parts: DataFrame) -> DataFrame:
    """One row per presentation. Titles are objects whose placeholder, or else name, says so."""
    # Both are read by several aggregates; slides are parsed once for each.
    runs, objects = cut(textnodes.runs(parts)), cut(inventory.slide_objects(parts))
    titled = F.coalesce("placeholder", "name").rlike("(?i)title") & (F.col("kind") == "shape") & not_blank("text")
    texts = F.count_if(not_blank("text"))
    slides = objects.groupBy("doc_id").agg(
        F.count_distinct("slide").alias("slides"), texts.alias("text_objects"), (texts / F.count_distinct("slide")).alias("texts_per_slide"),
        (F.count_if(titled) - F.count_distinct(F.when(titled, F.trim("text")))).alias("repeated_titles"))
    media = parts.groupBy("doc_id").agg(F.count_if(F.col("part").contains("/media/")).alias("assets"), F.count_if(F.col("part").contains("/charts/")).alias("charts"))
    shapes = verification.shape_runs(runs).groupBy("doc_id").agg(
        F.count_if(F.col("smallest_pt") < 9).alias("tiny"), F.count_if(F.col("italic") & (F.col("characters") > 24)).alias("italic"),
        F.count_if(F.col("deepest_level") >= 3).alias("deep_bullets"), F.count_if(F.col("line_breaks") > 0).alias("line_breaks"))
    families = verification.font_families(runs).groupBy("doc_id").agg(F.count_if(F.col("families") > 2).alias("mixed"))
    paragraphs = runs.filter(F.col("bullet").isNotNull()).groupBy("doc_id", "part", "shape", "para").agg(F.sum(F.length("text")).alias("characters"))
    bullets = paragraphs.groupBy("doc_id").agg(F.count_if(F.col("characters") > 80).alias("long_bullets"))
    fonts = inventory.style_inventory(runs).filter(F.col("kind").isin("latin", "ea", "cs")).groupBy("doc_id").agg(F.count_distinct("value").alias("fonts"))
    layout = verification.layout_lint(objects, runs).groupBy("doc_id").agg(
        F.count_if(F.col("code") == "PPTX_TEXT_OVERFLOW_ESTIMATE").alias("overflows"), F.count_if(F.col("code") == "PPTX_OBJECT_OFF_SLIDE").alias("off_slide"))
    dense = verification.slide_density(objects, objects.select("doc_id", "slide").distinct()).groupBy("doc_id").agg(
        F.count_if(F.col("code") == "PPTX_SLIDE_DENSITY_HIGH").alias("dense_slides"))
    return _joined(slides, media, shapes, families, bullets, fonts, layout, dense)


def document_metrics(parts: DataFrame) -> DataFrame:
    """One row per word-processing file, from its structure, headings and tables."""
    tree = inventory.heading_tree(parts)
    many = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    cells = textnodes.table_cells(parts.filter(F.col("part") == "word/document.xml"), textnodes.TABLE_TAGS["docx"])
    return _joined(inventory.docx_structure(parts), many(headings.repeated_headings(tree), "repeated_headings"),
                   many(headings.heading_jumps(tree), "heading_jumps"), many(cells, "table_cells"))
