"""Inventories and summaries of packages, workbooks, media, styles and PDFs."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pandas as pd

from folioscope.functions.cellref import col_to_letters, letters_to_col
from folioscope.functions.text import fnv1a, round_half_up
from folioscope.functions.tree import element_tree
from folioscope.functions.xml import as_column, attribute, element_pattern, first_match, matches, xml_unescape
from folioscope.sources.relationships import relationships
from folioscope.sources.sheets import SHEET_PART, sheets
from folioscope.sources.textnodes import semantic_part


DIGITS, LETTERS = string.digits, string.ascii_letters


def summarize(parts: DataFrame, objects: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Per document: parts, text objects, characters, tables, images, charts, presence flags."""
    media = F.col("part").contains("/media/").cast("int")
    charts = F.col("part").contains("/charts/").cast("int")
    inside = semantic_part() & F.col("xml").isNotNull()
    seen = lambda pattern: F.when(inside, F.regexp_count("xml", F.lit(pattern))).otherwise(0)
    per_part = parts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum(media + seen(r"<a:blip") + seen(r"\[Image:")).alias("images"),
        F.sum(charts + seen(r"<c:chart") + seen(r"\[Chart:")).alias("charts"),
    )
    per_text = objects.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("text_objects"), F.sum(F.length("text")).cast("bigint").alias("characters")
    )
    out = per_part.join(per_text, "doc_id", "left")
    if tables is not None:
        out = out.join(tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables")), "doc_id", "left")
    else:
        out = out.withColumn("tables", F.lit(0).cast("bigint"))
    out = out.na.fill(0, ["text_objects", "characters", "tables"])
    return out.withColumn("has_text", F.col("text_objects") > 0)


def sheet_map(parts: DataFrame) -> DataFrame:
    """Per sheet: cells, formulas, used range, validations, protection and role.

    Counts and bounds are read inside each worksheet row, without exploding
    cells; references are cut out in one pass, and column letters are reduced to distinct ones before they are decoded.
    """
    counted = lambda start, pattern: F.when(F.contains("xml", F.lit(start)), F.regexp_count("xml", F.lit(pattern))).otherwise(0)
    local = parts.filter(F.col("part").rlike(SHEET_PART)).select(
        "doc_id", "part", matches("xml", r'<c\b[^>]*\br="([A-Za-z]+[0-9]+)"', 1).alias("refs"),
        counted("<f", r"<f\b").alias("f"), counted("<dataValidation", r"<dataValidation\b").alias("d"),
        F.col("xml").rlike(r"(?i)<sheetProtection\b").alias("p")).select(
        "doc_id", "part", F.size("refs").alias("n"),
        F.transform(F.array_distinct(F.transform("refs", lambda r: F.rtrim(r, F.lit(DIGITS)))), letters_to_col).alias("columns"),
        F.transform(F.array_distinct(F.transform("refs", lambda r: F.ltrim(r, F.lit(LETTERS)))), lambda r: r.try_cast("int")).alias("rows"),
        "f", "d", "p")
    used = local.groupBy("doc_id", "part").agg(
        F.sum("n").alias("cells"), F.sum("f").alias("formulas"), F.sum("d").alias("validations"), F.bool_or("p").alias("protected"),
        F.min(F.array_min("columns")).alias("c0"), F.min(F.array_min("rows")).alias("r0"),
        F.max(F.array_max("columns")).alias("c1"), F.max(F.array_max("rows")).alias("r1"))
    role = (
        F.when(F.col("formulas") > 20, "model").when(F.col("validations") > 0, "input")
        .when(F.col("sheet_idx") == 1, "primary").otherwise("support")
    )
    reach = F.concat(col_to_letters("c0"), F.col("r0").cast("string"), F.lit(":"),
                     col_to_letters("c1"), F.col("r1").cast("string"))
    named = sheets(parts).select("doc_id", "part", "sheet_idx", "sheet_name")
    return used.join(named, ["doc_id", "part"], "left").select(
        "doc_id", "sheet_idx", "sheet_name", "cells", "formulas", "validations", "protected",
        role.alias("role"), reach.alias("used_range"),
    )


def workbook_map(parts: DataFrame) -> DataFrame:
    """Per workbook: sheets by state, defined names, cells, formulas, validations, protected sheets, and object parts by folder.

    The role is that of the workbook as a whole: a model has over 20 formulas, an input form has validations.
    """
    folder = lambda pattern: F.count_if(F.col("part").rlike(pattern))
    book = F.when(F.col("part") == "xl/workbook.xml", F.col("xml"))
    counted = lambda pattern: F.sum(F.coalesce(F.regexp_count(book, F.lit(pattern)), F.lit(0))).cast("bigint")
    sheet = F.when(F.col("part").rlike(SHEET_PART), F.col("xml"))
    inside = lambda pattern: F.sum(F.coalesce(F.regexp_count(sheet, F.lit(pattern)), F.lit(0))).cast("bigint")
    books = parts.filter(F.col("format") == "xlsx").groupBy("doc_id").agg(
        inside(r"<c[\s>/]").alias("cells"), inside(r"<f\b").alias("formulas"), inside(r"<dataValidation\b").alias("validations"),
        F.count_if(sheet.rlike(r"(?i)<sheetProtection\b")).alias("protected_sheets"),
        counted(r"<sheet\b").alias("sheets"),
        counted(r'(?i)\bstate="hidden"').alias("hidden"),
        counted(r'(?i)\bstate="veryHidden"').alias("very_hidden"),
        counted(r"<definedName\b").alias("defined_names"),
        folder(r"(?i)^xl/tables/").alias("tables"),
        folder(r"(?i)^xl/charts/").alias("charts"),
        folder(r"(?i)^xl/pivotTables/").alias("pivots"),
        folder(r"(?i)^xl/(slicers|slicerCaches)/").alias("slicers"),
        folder(r"(?i)^xl/externalLinks/").alias("external_links"),
        folder(r"(?i)vbaProject\.bin$").alias("macros"),
    )
    return books.withColumn("role", F.when(F.col("formulas") > 20, "model").when(F.col("validations") > 0, "input").otherwise("support"))


# --- media -------------------------------------------------------------------


def media_type(content) -> Column:
    column = as_column(content)
    lead = F.hex(F.substring(column, 1, 6))
    head = F.decode(F.substring(column, 1, 120), "ISO-8859-1")
    return (
        F.when(lead.startswith("89504E47"), "image/png")
        .when(lead.startswith("FFD8"), "image/jpeg")
        .when(F.contains(head, F.lit("<svg")), "image/svg+xml")
        .when(lead.isin("474946383761", "474946383961"), "image/gif")
        .otherwise("application/octet-stream")
    )


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Frame size from the first start-of-frame marker."""

    def one(data):
        at = 2
        while data is not None and at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xC3:
                return int.from_bytes(data[at + 7:at + 9], "big"), int.from_bytes(data[at + 5:at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2:at + 4], "big")
        return None, None

    frame = pd.DataFrame([one(d) for d in content], columns=["width", "height"])
    return frame.astype("Int32")


def _big_endian(content: str, at: int) -> Column:
    return F.conv(F.hex(F.substring(F.col(content), at, 4)), 16, 10).cast("bigint")


def assets(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """Media and embedded parts: type, size, digest, dimensions, usage, orphan flag."""
    found = parts.filter(F.col("part").rlike(r"^(ppt|word|xl)/(media|embeddings)/"))
    usage = (
        rels.filter(~F.col("external") & F.col("resolved").rlike(r"^(ppt|word|xl)/(media|embeddings)/"))
        .groupBy("doc_id", F.col("resolved").alias("part"))
        .agg(
            F.count(F.lit(1)).alias("usage_count"),
            F.min(F.regexp_extract("owner", r"^ppt/slides/slide(\d+)\.xml$", 1).try_cast("int")).alias("first_slide"),
            F.bool_or(F.col("owner").startswith("ppt/charts/")).alias("from_chart"),
        )
    )
    embedding = F.when(
        F.col("part").contains("/embeddings/"),
        F.when(F.coalesce("from_chart", F.lit(False)), "chartEmbeddedWorkbook").otherwise("embeddedObject"),
    )
    described = found.select(
        "doc_id", "part",
        media_type("content").alias("media_type"),
        F.octet_length("content").cast("bigint").alias("byte_len"),
        F.sha2("content", 256).alias("sha256"),
        "content",
    )
    is_png = (F.col("media_type") == "image/png") & (F.col("byte_len") >= 24)
    png = described.filter(F.col("media_type") != "image/jpeg").select(
        "doc_id", "part", "media_type", "byte_len", "sha256",
        F.when(is_png, _big_endian("content", 17)).alias("width"),
        F.when(is_png, _big_endian("content", 21)).alias("height"),
    )
    # Only JPEG rows pay for the trip to Python.
    jpeg = described.filter(F.col("media_type") == "image/jpeg").withColumn("s", jpeg_size("content")).select(
        "doc_id", "part", "media_type", "byte_len", "sha256",
        F.col("s.width").cast("bigint").alias("width"), F.col("s.height").cast("bigint").alias("height"),
    )
    return (
        png.unionByName(jpeg)
        .join(usage, ["doc_id", "part"], "left")
        .withColumn("usage_count", F.coalesce("usage_count", F.lit(0).cast("bigint")))
        .withColumn("orphaned", F.col("usage_count") == 0)
        .withColumn("embedding_kind", embedding)
        .drop("from_chart")
    )


def extract_media(parts: DataFrame) -> DataFrame:
    """Media parts as ``(doc_id, name, content)`` rows, ready to write as a table."""
    return parts.filter(F.col("part").contains("/media/")).select(
        "doc_id", F.element_at(F.split("part", "/"), -1).alias("name"), "content"
    )


def duplicate_content(df: DataFrame, content: str = "text") -> DataFrame:
    """Members of every group of equal contents, with the number of copies.

    Only digests are shuffled. Group sizes come from a partial aggregate and
    are joined back, so a digest shared by many rows is never gathered.
    """
    digests = df.select("doc_id", F.sha2(F.col(content), 256).alias("sha256"))
    groups = (
        digests.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("copies") > 1)
    )
    return digests.join(groups, "sha256")


# --- styles, PDF syntax, structure ------------------------------------------------


def style_inventory(runs: DataFrame) -> DataFrame:
    """Long form: how many runs of a document use each font, size and language."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    used = F.array(
        pair("latin", F.col("font_latin")), pair("ea", F.col("font_ea")), pair("cs", F.col("font_cs")),
        pair("lang", F.col("lang")), pair("size_pt", F.when(F.col("font_pt") > 0, F.col("font_pt"))),
        pair("bold", F.when(F.col("bold"), F.lit("true"))), pair("italic", F.when(F.col("italic"), F.lit("true"))),
        pair("no_proof", F.when(F.col("no_proof"), F.lit("true"))),
    )
    return (
        runs.select("doc_id", F.inline(F.filter(used, lambda u: u["value"].isNotNull())))
        .groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("runs"))
    )


def mixed_fonts(runs: DataFrame) -> DataFrame:
    """Text objects that use more than two explicit font families."""
    fonts = F.array_compact(F.array("font_latin", "font_ea", "font_cs"))
    return (
        runs.select("doc_id", "part", "shape", F.explode(fonts).alias("font"))
        .groupBy("doc_id", "part", "shape").agg(F.count_distinct("font").alias("fonts"))
        .filter(F.col("fonts") > 2)
    )


# What to count in PDF syntax, and which stream filters can be read.
PDF_COUNTS = {
    "objects": r"\b\d+\s+\d+\s+obj\b",
    "streams": r"\bstream\r?\n",
    "images": r"/Subtype\s*/Image\b",
    "annotations": r"/Annots\b|/Type\s*/Annot\b",
    "metadata": r"/Metadata\b|/Type\s*/Metadata\b",
    "embedded_files": r"/EmbeddedFiles\b|/EmbeddedFile\b|/Filespec\b",
    "object_streams": r"/Type\s*/ObjStm\b",
    "xref_streams": r"/Type\s*/XRef\b",
}
PDF_FLAGS = {
    "encrypted": r"/Encrypt\b",
    "acro_form": r"/AcroForm\b",
    "javascript": r"/JavaScript\b|/OpenAction\b|/AA\b|/JS\b",
    "redaction": r"/Subtype\s*/Redact\b",
}
PDF_READABLE_FILTERS = ("FlateDecode",)


def pdf_scan(packages: DataFrame) -> DataFrame:
    """Syntax counts and flags per PDF; one pass over the bytes per document row."""
    raw = packages.filter(F.col("format") == "pdf").select("doc_id", F.decode("content", "ISO-8859-1").alias("raw"))
    filters = F.flatten(F.transform(
        matches("raw", r"/Filter\s*(\[[^\]]+\]|/[A-Za-z0-9]+)", 1), lambda f: matches(f, r"/([A-Za-z0-9]+)", 1)
    ))
    unsupported = F.array_sort(F.array_distinct(F.filter(filters, lambda f: ~f.isin(*PDF_READABLE_FILTERS))))
    return raw.select(
        "doc_id",
        *[F.regexp_count("raw", F.lit(p)).cast("bigint").alias(n) for n, p in PDF_COUNTS.items()],
        *[F.col("raw").rlike(p).alias(n) for n, p in PDF_FLAGS.items()],
        F.greatest(F.regexp_count("raw", F.lit("%%EOF")) - 1, F.lit(0)).cast("bigint").alias("incremental_updates"),
        F.array_join(unsupported, ",").alias("unsupported_filters"),
    )


def pdf_risks(scan: DataFrame, text: DataFrame) -> DataFrame:
    """Risk flags of a scanned PDF as issue rows."""
    has_text = text.select("doc_id").distinct().withColumn("has_text", F.lit(True))
    flag = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    texty = F.coalesce("has_text", F.lit(False))
    rules = F.array_compact(F.array(
        flag(~texty, "PDF_TEXT_BLOCKS_ZERO", "warning"),
        flag(F.col("encrypted"), "PDF_ENCRYPTED", "warning"),
        flag((F.col("object_streams") > 0) | (F.col("xref_streams") > 0), "PDF_COMPRESSED_OBJECT_GRAPH", "info"),
        flag(F.col("unsupported_filters") != "", "PDF_UNSUPPORTED_FILTERS", "warning"),
        flag(F.col("embedded_files") > 0, "PDF_EMBEDDED_FILES", "warning"),
        flag(F.col("acro_form"), "PDF_ACROFORM", "info"),
        flag(F.col("javascript"), "PDF_ACTIVE_CONTENT", "warning"),
        flag(F.col("incremental_updates") > 0, "PDF_INCREMENTAL_UPDATES", "info"),
        flag(F.col("redaction"), "PDF_REDACTION_ANNOTATIONS", "warning"),
        flag(texty, "PDF_EXTRACTABLE_TEXT_PRESENT", "info"),
    ))
    return scan.join(has_text, "doc_id", "left").select("doc_id", F.inline(rules))


def docx_structure(parts: DataFrame) -> DataFrame:
    """Counts of sections, fields, controls, comments, revisions and styles."""
    body = F.when(F.col("part") == "word/document.xml", F.col("xml"))
    comments = F.when(F.col("part") == "word/comments.xml", F.col("xml"))
    styles = F.when(F.col("part") == "word/styles.xml", F.col("xml"))
    total = lambda source, pattern: F.sum(F.coalesce(F.regexp_count(source, F.lit(pattern)), F.lit(0))).cast("bigint")
    return parts.filter(F.col("format") == "docx").groupBy("doc_id").agg(
        total(body, r"<w:p(?=[\s>])").alias("paragraphs"),
        total(body, r"<w:sectPr\b").alias("sections"),
        total(body, r"<w:tbl\b").alias("tables"),
        total(body, r"<w:fldChar\b|<w:instrText\b").alias("fields"),
        total(body, r"<w:sdt\b").alias("content_controls"),
        total(comments, r"<w:comment(?=[\s>])").alias("comments"),
        total(body, r"<w:(ins|del)\b").alias("tracked_changes"),
        total(styles, r'<w:style\b[^>]*\bw:styleId="').alias("styles"),
        F.count_if(F.col("part").rlike(r"(?i)^word/header\d+\.xml$")).alias("headers"),
        F.count_if(F.col("part").rlike(r"(?i)^word/footer\d+\.xml$")).alias("footers"),
    )


def heading_tree(parts: DataFrame) -> DataFrame:
    """Headings of a document in order, with style, level and text."""
    blocks = parts.filter(F.col("part") == "word/document.xml").select(
        "doc_id", F.posexplode(matches("xml", r"(?s)<w:p\b.*?</w:p>", 0)).alias("pos", "block")
    )
    style = first_match("block", r'<w:pStyle\b[^>]*\bw:val="([^"]+)"', 1)
    text = F.array_join(F.transform(matches("block", r"(?s)<w:t\b[^>]*>(.*?)</w:t>", 1),
                                    lambda t: xml_unescape(t, numeric=False)), "")
    return blocks.withColumn("style", style).filter(F.col("style").rlike("(?i)^Heading")).select(
        "doc_id", (F.col("pos") + 1).alias("idx"), "style",
        first_match("style", r"(\d+)$", 1).try_cast("int").alias("level"),
        F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"),
    )


def markup_headings(parts: DataFrame, tags: tuple[str, ...] = ("h1", "h2", "h3")) -> DataFrame:
    """Headings of markup parts; the level is the digit of the tag."""
    pattern = "(?s)<(?:" + "|".join(tags) + r")(?:\s[^>]*)?>.*?</(?:" + "|".join(tags) + ")>"
    blocks = parts.select("doc_id", F.posexplode(matches("xml", pattern, 0)).alias("idx", "block"))
    return blocks.select(
        "doc_id", "idx", first_match("block", r"^<h(\d)", 1).cast("int").alias("level"),
        xml_unescape(F.regexp_extract("block", element_pattern(*tags), 1)).alias("text"),
    )


# --- slides ------------------------------------------------------------------------


def slide_order(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """Slides in presentation order: ``sldId`` entries joined to relationships."""
    listed = parts.filter(F.col("part") == "ppt/presentation.xml").select(
        "doc_id", F.posexplode(matches("xml", r"<p:sldId\b[^>]*>", 0)).alias("pos", "tag")
    )
    targets = rels.filter(F.col("rels_part") == "ppt/_rels/presentation.xml.rels").select(
        "doc_id", "rel_id", F.col("resolved").alias("part")
    )
    return (
        listed.select("doc_id", (F.col("pos") + 1).alias("slide"), attribute("tag", "r:id").alias("rel_id"))
        .join(targets, ["doc_id", "rel_id"])
        .select("doc_id", "slide", "part")
    )


def emu_to_px(value: Column) -> Column:
    return round_half_up(value / 914400 * 96).cast("bigint")


SLIDE_PART = r"^ppt/slides/slide\d+\.xml$"
# Slide element -> object kind.
SLIDE_ELEMENTS = {"p:sp": "shape", "p:pic": "picture", "p:grpSp": "group", "p:cxnSp": "connector",
                  "p:graphicFrame": "frame"}


def slide_numbers(parts: DataFrame) -> DataFrame:
    """``(doc_id, slide, part)``: presentation order; without one the order of the numbers in the part names."""
    head = parts.filter(F.col("part").isin("ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"))
    slides = parts.filter(F.col("part").rlike(SLIDE_PART)).select("doc_id", "part").distinct()
    listed = slide_order(head, relationships(head)).join(slides, ["doc_id", "part"], "left_semi")
    plain = slides.join(listed.select("doc_id").distinct(), "doc_id", "left_anti")
    by_name = Window.partitionBy("doc_id").orderBy(F.regexp_extract("part", r"(\d+)\.xml$", 1).try_cast("bigint"), "part")  # slides of one package
    ranked = plain.withColumn("slide", F.row_number().over(by_name))
    return listed.select("doc_id", "slide", "part").unionByName(ranked.select("doc_id", "slide", "part"))


def _on_slide(frames: Column, path: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box in its group's coordinates brought to those of the slide, from the innermost group outwards."""
    def out(box: Column, at: Column) -> Column:
        group = F.get(frames, at)
        wide = F.when(group["inner_w"] > 0, group["w"] / group["inner_w"]).otherwise(1.0)
        tall = F.when(group["inner_h"] > 0, group["h"] / group["inner_h"]).otherwise(1.0)
        moved = F.struct((group["x"] + (box["x"] - group["inner_x"]) * wide).alias("x"), (group["y"] + (box["y"] - group["inner_y"]) * tall).alias("y"),
                         (box["w"] * wide).alias("w"), (box["h"] * tall).alias("h"))
        return F.when(group["inner_x"].isNull() | group["x"].isNull(), box).otherwise(moved)

    return F.aggregate(F.reverse(path), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")), out)


def slide_objects(parts: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Shapes, pictures, groups, connectors and frames with name, placeholder, bounds, text.

    Elements inside groups are objects of their own: ``parent_id`` is the shape id of the group that
    holds one, ``depth`` the number of groups around it. Bounds are those on the slide, with the offsets and scales of all groups around;
    ``local_x`` and ``local_y`` are as written. ``pos`` counts elements, ``text_body`` the text bodies of the slide
    as ``textnodes.runs`` does; it is NULL where an element has none of its own. With ``numbers`` (``slide_numbers``) slides are
    numbered in presentation order and slides that it does not list drop out, else by the part name.
    """
    kinds = F.create_map(*[F.lit(v) for pair in SLIDE_ELEMENTS.items() for v in pair])
    number = lambda tag, name: attribute(tag, name).try_cast("double")

    def frame(own: Column) -> dict[str, Column]:
        """Offset and size of an element, in its group's coordinates."""
        off, ext = first_match(own, r"<a:off\b([^>]*)>", 1), first_match(own, r"<a:ext\b([^>]*cx=[^>]*)>", 1)
        return {"x": number(off, "x"), "y": number(off, "y"), "w": number(ext, "cx"), "h": number(ext, "cy")}

    def group_frame(node: Column) -> Column:
        off, ext = first_match(node["own"], r"<a:chOff\b([^>]*)>", 1), first_match(node["own"], r"<a:chExt\b([^>]*)>", 1)
        inner = {"inner_x": number(off, "x"), "inner_y": number(off, "y"), "inner_w": number(ext, "cx"), "inner_h": number(ext, "cy")}
        fields = F.struct(*[c.alias(k) for k, c in {**frame(node["own"]), **inner}.items()])
        return F.when(node["tag"] == "p:grpSp", fields)

    shape_id = lambda own: attribute(first_match(own, r"<p:cNvPr\b([^>]*)>", 1), "id")
    slides = parts.filter(F.col("part").rlike(SLIDE_PART))
    if numbers is None:
        slides = slides.withColumn("slide", F.regexp_extract("part", r"slide(\d+)\.xml$", 1).try_cast("int"))
    else:
        slides = slides.join(numbers, ["doc_id", "part"])
    blocks = (
        slides.select("doc_id", "part", "slide", element_tree("xml", *SLIDE_ELEMENTS).alias("all"))
        .withColumn("grouped", F.exists("all", lambda n: n["tag"] == "p:grpSp"))
        # Only slides with groups need these.
        .withColumn("frames", F.when(F.col("grouped"), F.transform("all", group_frame)))
        .withColumn("ids", F.when(F.col("grouped"), F.transform("all", lambda n: shape_id(n["own"]))))
        .withColumn("bodies", F.transform("all", lambda n: F.regexp_count(n["own"], F.lit(r"<p:txBody[\s>]"))))
        .withColumn("paths", F.when(F.col("grouped"), F.col("all.path")))
        .select("doc_id", "part", "slide", "bodies", "frames", "ids", "paths", F.posexplode("all").alias("pos", "node"))
        .select("*", F.col("node.own").alias("block"), F.col("node.path").alias("path"), F.element_at(kinds, F.col("node.tag")).alias("kind"))
        .withColumn("props", first_match("block", r"<p:cNvPr\b([^>]*)>", 1))
    )
    before = F.aggregate(F.slice("bodies", F.lit(1), F.col("pos")), F.lit(0), lambda a, b: a + b)
    texts = F.transform(matches("block", r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>", 1), lambda t: xml_unescape(t))
    linked = lambda end: attribute(first_match("block", rf"<a:{end}Cxn\b([^>]*)>", 1), "id")
    inside = F.filter(F.arrays_zip(F.col("ids").alias("id"), F.col("paths").alias("path")), lambda n: F.array_contains(n["path"], F.col("pos")))
    kind = F.col("kind")
    boxed = blocks.withColumns({f"local_{k}": c for k, c in frame(F.col("block")).items()})
    here = [F.col(f"local_{k}") for k in "xywh"]
    placed = boxed.withColumn("box", F.when(F.size("path") > 0, _on_slide(F.col("frames"), F.col("path"), *here)).otherwise(
        F.struct(*[c.alias(k) for k, c in zip("xywh", here)])))
    return placed.select(
        "doc_id", "part", "slide", "pos", "kind",
        F.when((kind != "group") & (F.get("bodies", F.col("pos")) > 0), before).alias("text_body"),
        attribute("props", "id").alias("shape_id"),
        xml_unescape(attribute("props", "name")).alias("name"),
        attribute(first_match("block", r"<p:ph\b([^>]*)>", 1), "type").alias("placeholder"),
        *[emu_to_px(F.col(f"box.{k}")).alias(k) for k in "xywh"],
        F.array_join(texts, " ").alias("text"),
        F.when(kind == "group", F.array_join(F.transform(inside, lambda n: n["id"]), ",")).alias("child_ids"),
        F.when(kind == "connector", linked("st")).alias("from_shape"),
        F.when(kind == "connector", linked("end")).alias("to_shape"),
        F.get("ids", F.get("path", F.size("path") - 1)).alias("parent_id"), F.size("path").alias("depth"),
        emu_to_px(F.col("local_x")).alias("local_x"), emu_to_px(F.col("local_y")).alias("local_y"),
        F.when(kind == "picture", attribute(first_match("block", r"<a:blip\b([^>]*)>", 1), "r:embed")).alias("embed"),
    )


def picture_media(objects: DataFrame, rels: DataFrame) -> DataFrame:
    """Which media part each picture of a slide shows, by the relationships of its slide."""
    shown = objects.filter(F.col("embed").isNotNull()).select("doc_id", "part", "slide", "pos", "shape_id", F.col("embed").alias("rel_id"))
    media = rels.select("doc_id", F.col("owner").alias("part"), "rel_id", F.col("resolved").alias("media_part"), "external")
    return shown.join(media, ["doc_id", "part", "rel_id"], "left")


def diagram_nodes(parts: DataFrame) -> DataFrame:
    """SmartArt points of diagram data parts with their text."""
    points = parts.filter(F.col("part").rlike(r"^ppt/diagrams/data\d*\.xml$")).select(
        "doc_id", "part", F.posexplode(matches("xml", r"(?s)<dgm:pt\b.*?</dgm:pt>", 0)).alias("pos", "pt")
    )
    texts = F.transform(matches("pt", r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>", 1), lambda t: xml_unescape(t))
    return points.select("doc_id", "part", "pos", attribute(first_match("pt", r"^<dgm:pt\b([^>]*)", 1), "modelId").alias("model_id"),
                         F.array_join(texts, " ").alias("text")).filter(F.col("text") != "")


def chart_series(parts: DataFrame) -> DataFrame:
    """Series of chart parts: index, order, name, category and value references."""
    series = parts.filter(F.col("part").rlike(r"/charts/chart\d*\.xml$")).select(
        "doc_id", "part", F.posexplode(matches("xml", r"(?s)<c:ser\b.*?</c:ser>", 0)).alias("pos", "ser")
    )
    value = lambda tag: attribute(first_match("ser", rf"<c:{tag}\b([^>]*)>", 1), "val").try_cast("int")
    reference = lambda tag: xml_unescape(first_match(
        first_match("ser", rf"(?s)<c:{tag}\b[^>]*>(.*?)</c:{tag}>", 1), r"(?s)<c:f>(.*?)</c:f>", 1))
    name = first_match(first_match("ser", r"(?s)<c:tx\b[^>]*>(.*?)</c:tx>", 1), r"(?s)<c:v>(.*?)</c:v>", 1)
    return series.select(
        "doc_id", "part", "pos", value("idx").alias("series_idx"), value("order").alias("series_order"),
        xml_unescape(name).alias("name"), reference("cat").alias("category_ref"), reference("val").alias("value_ref"),
    )


def fingerprints(objects: DataFrame) -> DataFrame:
    """Text hash, and hash of the rounded position where the object has a box."""
    out = objects.withColumn("text_hash", fnv1a("text"))
    if {"x", "y", "w", "h"} <= set(objects.columns):
        whole = [round_half_up(c).cast("string") for c in ("x", "y", "w", "h")]
        out = out.withColumn("position_hash", fnv1a(F.concat_ws(":", *whole)))
    return out


# --- document metadata and story graph ------------------------------------------------


def metadata(parts: DataFrame) -> DataFrame:
    """Title, creator and dates of the core-properties part."""
    core = parts.filter(F.col("part") == "docProps/core.xml")
    field = lambda tag: xml_unescape(first_match("xml", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))
    return core.select(
        "doc_id", field("dc:title").alias("title"), field("dc:creator").alias("creator"),
        F.try_to_timestamp(field("dcterms:created")).alias("created"),
        F.try_to_timestamp(field("dcterms:modified")).alias("modified"),
    )


def page_metadata(parts: DataFrame) -> DataFrame:
    """Title and language of markup pages."""
    return parts.select(
        "doc_id", xml_unescape(first_match("xml", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        attribute(first_match("xml", r"<html\b([^>]*)>", 1), "lang").alias("lang"),
    )


def pdf_metadata(packages: DataFrame) -> DataFrame:
    """Literal strings of the PDF information dictionary."""
    raw = packages.filter(F.col("format") == "pdf").select("doc_id", F.decode("content", "ISO-8859-1").alias("raw"))
    field = lambda name: first_match("raw", rf"/{name}\s*\(([^()]*)\)", 1)
    return raw.select("doc_id", field("Title").alias("title"), field("Author").alias("author"),
                      field("CreationDate").alias("created"), field("ModDate").alias("modified"))
