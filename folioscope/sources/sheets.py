"""Worksheet parts as cells, with shared strings and shared formulas resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.cellref import ref_col, ref_row
from folioscope.functions.xml import attribute, elements, first_match, matches, xml_unescape
from folioscope.plans.ordered import chunk_of, filled
from folioscope.sources.relationships import targets

CELL_ELEMENT = r"(?s)<c\b[^>]*+(?:(?<=/)>|>.*?</c>)"
SHEET_PART = r"(?i)^xl/worksheets/sheet\d+\.xml$"


def _items(xml) -> Column:
    """Strings of a shared-string part in order; rich-text pieces of one item are joined."""
    return F.transform(matches(xml, r"(?s)<si\b.*?</si>", 0), lambda si: F.array_join(
        F.transform(elements(si, "t"), lambda t: xml_unescape(t)), ""))


def shared_strings(parts: DataFrame) -> DataFrame:
    """``(doc_id, idx, string)``; rich-text pieces of one item are joined."""
    return parts.filter(F.col("part") == "xl/sharedStrings.xml").select("doc_id", F.posexplode(_items("xml")).alias("idx", "string"))


def _books(parts: DataFrame) -> DataFrame:
    """One row per workbook: its shared strings, sheet tags and links.

    The three parts that hold them are one row each, so all is read inside the row; what is
    grouped by workbook is one array per part.
    """
    part = F.col("part")
    # Attributes are bound first: inside a lambda an expression is evaluated once per mention.
    read = F.transform(matches("xml", r"<sheet\b[^>]*>", 0), lambda tag: F.struct(
        attribute(tag, "name").alias("name"), attribute(tag, "state").alias("state"), attribute(tag, "r:id").alias("rel_id")))
    tags = F.transform(read, lambda tag, i: F.struct(
        (i + 1).alias("sheet_idx"), xml_unescape(tag["name"]).alias("sheet_name"),
        F.coalesce(tag["state"], F.lit("visible")).alias("state"), tag["rel_id"].alias("rel_id")))
    links = targets("xml", "xl/workbook.xml")
    rows = parts.filter(part.isin("xl/sharedStrings.xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels")).select(
        "doc_id", F.when(part == "xl/sharedStrings.xml", _items("xml")).alias("strings"),
        F.when(part == "xl/workbook.xml", tags).alias("tags"), F.when(part == "xl/_rels/workbook.xml.rels", links).alias("links"))
    one = rows.groupBy("doc_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("strings", "tags", "links")])
    return one.select("doc_id", "strings", "tags", "links")


def _named(tags="tags") -> Column:
    """Sheets of a workbook with their parts."""
    target = lambda tag: F.try_element_at(F.filter("links", lambda link: link["rel_id"] == tag["rel_id"]), F.lit(1))["resolved"]
    return F.transform(tags, lambda tag: F.struct(
        tag["sheet_idx"].alias("sheet_idx"), tag["sheet_name"].alias("sheet_name"), tag["state"].alias("state"), target(tag).alias("part")))


def books(parts: DataFrame) -> DataFrame:
    """One row per workbook: its shared strings and its sheets in order."""
    return _books(parts).select("doc_id", "strings", _named().alias("sheets"))


def sheets(parts: DataFrame) -> DataFrame:
    """Sheet order, name, visibility and part, through the workbook relationships."""
    # The array is exploded as an expression: of a column Spark would infer a filter on its size, and build it twice.
    return _books(parts).select("doc_id", F.inline(_named()))


def _shared_definitions(cells: Column) -> Column:
    """Definitions of shared formulas of a sheet with their cell positions."""
    spots = F.transform(cells, lambda c, i: F.struct(
        i.alias("at"),
        attribute(F.regexp_extract(c, r"<f\b([^>]*)", 1), "si").alias("si"),
        xml_unescape(F.regexp_extract(c, r"(?s)<f\b[^>]*[^/]>(.*?)</f>", 1)).alias("formula")))
    return F.filter(spots, lambda s: s["si"].isNotNull() & (s["formula"] != ""))


def _cell_fields(strings: Column | None) -> Column:
    """Cells of a sheet with what their tags say; with ``strings`` the shared string of a cell too.

    All of it is read inside the row of the sheet, each step binding what the next one mentions, and patterns are tried only
    on cells that hold their first characters. Strings of the workbook are looked up here, so that they do not travel with each cell.
    """
    has = lambda text, piece: F.contains(text, F.lit(piece))
    heads = F.transform(matches("xml", CELL_ELEMENT, 0), lambda c: F.struct(
        c.alias("cell"), F.regexp_extract(c, r"^<c\b([^>]*)", 1).alias("head"), F.when(has(c, "<f"), first_match(c, r"<f\b([^>]*)", 1)).alias("f_head")))
    fields = F.transform(heads, lambda c: F.struct(
        attribute(c["head"], "r").alias("ref"), F.coalesce(F.when(has(c["head"], "t"), attribute(c["head"], "t")), F.lit("n")).alias("cell_type"),
        F.when(has(c["cell"], "<v"), first_match(c["cell"], r"(?s)<v(?:\s[^>]*)?>(.*?)</v>", 1)).alias("v_body"),
        c["f_head"].alias("f_head"), F.when(c["f_head"].isNotNull(), first_match(c["cell"], r"(?s)<f(?:\s[^>]*)?>(.*?)</f>", 1)).alias("f_body"),
        F.when(has(c["f_head"], "shared"), attribute(c["f_head"], "si")).alias("shared_idx"),
        F.when(has(c["head"], "inlineStr"), F.array_join(F.transform(elements(c["cell"], "t"), lambda t: xml_unescape(t)), "")).alias("inline")))
    if strings is None:
        return fields

    def string(c: Column) -> Column:
        index = F.when(c["cell_type"] == "s", xml_unescape(c["v_body"]).try_cast("int"))
        return F.when(index >= 0, F.try_element_at(strings, index + 1))

    return F.transform(fields, lambda c: F.struct(
        *[c[f].alias(f) for f in ("ref", "cell_type", "v_body", "f_head", "f_body", "shared_idx", "inline")], string(c).alias("string")))


def raw_cells(parts: DataFrame, strings: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of worksheet parts: type, raw value, formula with shared ones filled in.

    A sheet is one row, so its shared formulas are resolved inside the row: the
    few definitions ride along with each cell and nothing is shuffled. With ``strings``, an array column of ``parts``, cells
    have their shared ``string``.
    """
    none = F.array().cast("array<struct<at:int,si:string,formula:string>>")
    shared = F.when(F.contains("xml", F.lit("shared")), _shared_definitions(matches("xml", CELL_ELEMENT, 0))).otherwise(none)
    held = [strings] if strings else []
    cells = (
        parts.filter(F.col("part").rlike(SHEET_PART))
        .select("doc_id", "part", *keep, *held, "xml", shared.alias("shared"))
        # Exploded as an expression: of a column Spark would infer a filter on its size, and read the sheet twice.
        .select("doc_id", "part", *keep, "shared", F.posexplode(_cell_fields(F.col(strings) if strings else None)).alias("pos", "c"))
        .filter(F.col("c.ref").isNotNull())
        .select("doc_id", "part", *keep, "shared", "pos", "c.*")
    )
    earlier = F.filter("shared", lambda d: (d["si"] == F.col("shared_idx")) & (d["at"] <= F.col("pos")))
    inherited = F.when(F.col("shared_idx").isNotNull(), F.try_element_at(earlier, F.lit(-1))["formula"])
    plain = F.col("ref").rlike("^[A-Z0-9]*$")
    return cells.select(
        "doc_id", "part", *keep, "pos",
        F.when(plain, F.col("ref")).otherwise(F.upper("ref")).alias("ref"),
        "cell_type",
        xml_unescape("v_body").alias("raw"),
        F.when(F.col("cell_type") == "inlineStr", F.col("inline")).alias("inline"),
        F.coalesce(xml_unescape(F.nullif("f_body", F.lit(""))), inherited).alias("formula"),
        F.col("f_head").isNotNull().alias("is_formula"), *(["string"] if strings else []),
    )


def resolve_shared(cells: DataFrame, keys: tuple[str, ...], order: str = "pos") -> DataFrame:
    """Fill members of a shared formula from the last definition before them.

    Only cells of shared formulas take part; all others pass through. The fill
    runs in chunks of the position, so a huge sheet is not sorted in one task.
    """
    shared = cells.filter(F.col("shared_idx").isNotNull())
    filled_in = filled(shared, [*keys, "shared_idx"], [order], chunk_of(F.col(order)), "formula", "_filled")
    members = filled_in.withColumn("formula", F.coalesce("formula", "_filled")).select(cells.columns)
    return cells.filter(F.col("shared_idx").isNull()).unionByName(members)


def cell_value() -> Column:
    truth = F.when((F.col("raw") == "1") | (F.lower("raw") == "true"), "TRUE").otherwise("FALSE")
    return (
        F.when(F.col("cell_type") == "s", F.coalesce("string", "raw"))
        .when(F.col("cell_type") == "inlineStr", F.col("inline"))
        .when(F.col("cell_type") == "b", truth)
        .otherwise(F.coalesce("raw", F.lit("")))
    )


def sheet_cells(parts: DataFrame) -> DataFrame:
    """Cells of every worksheet with resolved values, formulas and sheet names.

    Sheets meet their workbook, not their cells: one row a sheet is sent.
    """
    sheet = F.try_element_at(F.filter("sheets", lambda s: s["part"] == F.col("part")), F.lit(1))
    placed = parts.filter(F.col("part").rlike(SHEET_PART)).join(books(parts), "doc_id", "left").select(
        "doc_id", "part", "xml", "strings", sheet.alias("sheet"))
    return raw_cells(placed, "strings", ("sheet",)).select(
        "doc_id", "part", F.col("sheet.sheet_idx"), F.col("sheet.sheet_name"), "ref",
        ref_col("ref").alias("col"), ref_row("ref").alias("row"),
        cell_value().alias("value"), "is_formula", "formula",
    )
