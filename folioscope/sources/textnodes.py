"""Text nodes, tables and slide paragraphs read from markup parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import object_id
from folioscope.functions.tree import table_tree
from folioscope.functions.xml import (
    TEXT_TAGS,
    as_column,
    attribute,
    element_pattern,
    elements,
    first_match,
    matches,
    not_blank,
    xml_unescape,
)

# Table, row and cell tags per format.
TABLE_TAGS = {"pptx": ("a:tbl", "a:tr", "a:tc"), "docx": ("w:tbl", "w:tr", "w:tc")}


def semantic_part() -> Column:
    """In a presentation only slide parts carry document text."""
    return F.col("part").endswith(".xml") & (
        (F.col("format") != "pptx") | F.col("part").startswith("ppt/slides/slide")
    )


def readable_part() -> Column:
    """Of a presentation only its slides are read: layouts, masters and notes hold no text of the document."""
    return (F.col("format") != "pptx") | semantic_part()


def text_objects(parts: DataFrame, tags: tuple[str, ...] = TEXT_TAGS) -> DataFrame:
    """Text nodes with their position among all nodes of the part.

    Positions are assigned before blank nodes drop, so an id survives a text
    edit. Everything is one explode per part: no shuffle.
    """
    return (
        parts.filter(F.col("xml").isNotNull() & readable_part())
        .select("doc_id", "format", "part", F.posexplode(elements("xml", *tags)).alias("idx", "raw"))
        .select("doc_id", "format", "part", "idx", xml_unescape("raw").alias("text"))
        .filter(not_blank("text"))
        .withColumn("object_id", object_id(F.col("format"), F.col("part"), F.col("idx")))
    )


def tables(parts: DataFrame, tags: tuple[str, str, str], text_tags: tuple[str, ...] = TEXT_TAGS) -> DataFrame:
    """Table objects with row and column counts; ragged rows are kept.

    A table inside a cell is a table of its own: ``parent`` is the number of the table around it, ``parent_row`` and ``parent_col`` the
    cell; the text of that cell is the cell's own. Tables without rows and rows without cells drop before they are numbered.
    """
    own = lambda cell: F.array_join(F.transform(
        matches(cell, element_pattern(*text_tags), 1), lambda t: xml_unescape(t, numeric=False)), " ")
    found = parts.filter(F.col("xml").isNotNull() & readable_part() & F.contains("xml", F.lit(f"<{tags[0]}"))).select(
        "doc_id", "format", "part", F.posexplode(table_tree("xml", *tags)).alias("table", "t"))
    cells = found.select("*", "t.parent", "t.parent_row", "t.parent_col", F.transform("t.rows", lambda r: F.transform(r, own)).alias("rows"))
    return cells.select(
        "doc_id", "part", "table",
        object_id(F.col("format"), F.concat("part", F.lit(":table")), F.col("table")).alias("object_id"),
        F.size("rows").alias("row_count"),
        F.array_max(F.transform("rows", F.size)).alias("column_count"),
        "rows", "parent", "parent_row", "parent_col")


def table_cells(parts: DataFrame, tags: tuple[str, str, str], text_tags: tuple[str, ...] = TEXT_TAGS) -> DataFrame:
    """Cell rows ``(table, row, col, text)``, all 0-based."""
    rows = tables(parts, tags, text_tags).select("doc_id", "part", "table", F.posexplode("rows").alias("row", "cells"))
    return rows.select("doc_id", "part", "table", "row", F.posexplode("cells").alias("col", "text"))


# --- slide paragraphs and runs ----------------------------------------------


def _flag(attrs: str, name: str) -> Column:
    return attribute(attrs, name).isin("1", "true")


def _face(body: str, kind: str) -> Column:
    tag = first_match(body, rf"<a:{kind}\b([^>]*)/?>", 1)
    return F.nullif(xml_unescape(attribute(tag, "typeface")), F.lit(""))


def _property_attrs(block: str, name: str) -> Column:
    """Attributes of a run-property element; the self-closing form wins."""
    return F.coalesce(first_match(block, rf"<a:{name}\b([^>]*)/>", 1), first_match(block, rf"<a:{name}\b([^>]*)>", 1))


def _property_body(block: str, name: str) -> Column:
    closed = F.col(block).rlike(rf"<a:{name}\b[^>]*/>")
    return F.when(~closed, first_match(block, rf"(?s)<a:{name}\b[^>]*>(.*?)</a:{name}>", 1))


def _formats(attrs: str, body: str) -> dict[str, Column]:
    return {
        "bold": _flag(attrs, "b"),
        "italic": _flag(attrs, "i"),
        "font_pt": attribute(attrs, "sz").try_cast("double") / 100,
        "font_latin": _face(body, "latin"),
        "font_ea": _face(body, "ea"),
        "font_cs": _face(body, "cs"),
        "lang": F.nullif(xml_unescape(attribute(attrs, "lang")), F.lit("")),
        "no_proof": _flag(attrs, "noProof"),
    }


def paragraph_blocks(xml) -> Column:
    return matches(as_column(xml), r"(?s)<a:p(?:\s[^>]*)?>.*?</a:p>", 0)


def runs(parts: DataFrame) -> DataFrame:
    """Runs of a slide's text bodies, one row each, with inherited formats.

    ``shape`` and ``para`` count text bodies and paragraphs in document order; a
    line break is a run of one newline. Properties missing on a run come from
    the paragraph's default run properties.
    """
    bodies = parts.filter(F.col("xml").isNotNull() & semantic_part()).select(
        "doc_id", "part",
        F.posexplode(matches("xml", r"(?s)<p:txBody(?:\s[^>]*)?>.*?</p:txBody>", 0)).alias("shape", "body"),
    )
    paragraphs = bodies.select("doc_id", "part", "shape", F.posexplode(paragraph_blocks("body")).alias("para", "block"))
    # Each property tag is cut out once per paragraph or run, then read attribute by attribute.
    described = (
        paragraphs.withColumn("ppr", _properties_of_paragraph("block", "attrs"))
        .withColumn("ppr_body", _properties_of_paragraph("block", "body"))
        .withColumn("d_attrs", _property_attrs("ppr_body", "defRPr"))
        .withColumn("d_body", _property_body("ppr_body", "defRPr"))
        .withColumn("bu_char", first_match("ppr_body", r"<a:buChar\b([^>]*)/>", 1))
        .withColumn("bu_num", first_match("ppr_body", r"<a:buAutoNum\b([^>]*)/>", 1))
        .select(
            "doc_id", "part", "shape", "para",
            attribute("ppr", "lvl").try_cast("int").alias("level"),
            F.nullif(xml_unescape(attribute("bu_char", "char")), F.lit("")).alias("bullet"),
            attribute("bu_num", "type").alias("numbering"),
            *[value.alias(f"d_{name}") for name, value in _formats("d_attrs", "d_body").items()],
            F.posexplode(matches("block", r"(?s)<a:r\b.*?</a:r>|<a:fld\b.*?</a:fld>|<a:br\b.*?/>", 0)).alias("pos", "run"),
        )
        .withColumn("is_break", F.col("run").startswith("<a:br"))
        .withColumn("r_attrs", _property_attrs("run", "rPr"))
        .withColumn("r_body", _property_body("run", "rPr"))
    )
    pieces = F.transform(matches("run", r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>", 1), lambda t: xml_unescape(t))
    return described.select(
        "doc_id", "part", "shape", "para", "pos", "level", "bullet", "numbering",
        F.when(F.col("is_break"), F.lit("\n")).otherwise(F.array_join(pieces, "")).alias("text"),
        *[
            F.when(~F.col("is_break"), F.coalesce(value, F.col(f"d_{name}"))).alias(name)
            for name, value in _formats("r_attrs", "r_body").items()
        ],
    ).filter(F.col("text") != "")


def _properties_of_paragraph(block: str, side: str) -> Column:
    column = F.col(block)
    opened = r"(?s)<a:pPr\b([^>]*[^>/])?>(.*?)</a:pPr>"
    closed = r"<a:pPr\b([^>]*)/>"
    if side == "attrs":
        return F.coalesce(first_match(column, opened, 1), first_match(column, closed, 1))
    return first_match(column, opened, 2)


def text_semantics(parts: DataFrame) -> DataFrame:
    """One row per paragraph: text, level, bullet, numbering, runs as structs.

    A paragraph is part of one slide part, whose size the shred limits bound.
    """
    fields = ["pos", "text", "bold", "italic", "font_pt", "font_latin", "font_ea", "font_cs", "lang", "no_proof"]
    return (
        runs(parts)
        .groupBy("doc_id", "part", "shape", "para", "level", "bullet", "numbering")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("runs"))
        .withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
        .withColumn("line_breaks", F.size(F.filter("runs", lambda r: r["text"] == "\n")))
    )
