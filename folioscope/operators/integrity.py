"""Integrity and safety checks. Every check returns issue rows."""

from __future__ import annotations

from xml.parsers.expat import ExpatError, ParserCreate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.xml import matches
from folioscope.plans.search import contained
from folioscope.sources.packages import ARCHIVE_NAME, Limits

# Parts each format must hold; a star stands for any name.
COMMON_PARTS = ["[Content_Types].xml", "_rels/.rels"]
REQUIRED_PARTS = {
    "docx": ["word/document.xml"],
    "pptx": ["ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "ppt/slides/slide*.xml"],
    "xlsx": ["xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/sheet*.xml"],
}

# Tokens a formula must not contain.
FORMULA_TOKENS = [
    "webservice(", "hyperlink(", "cmd|", "powershell|", "dde(", "shell(",
    "http://", "https://", "ftp://", "file://", "]!",
]


def issue(when: Column, code: str, severity: str) -> Column:
    """An issue struct where the predicate holds, else NULL."""
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def explode_issues(df: DataFrame, keep: list[str], issues: list[Column]) -> DataFrame:
    """One row per issue that applies; rows without issues disappear."""
    return df.select(*keep, F.inline(F.array_compact(F.array(*issues))))


def required_parts(parts: DataFrame, packages: DataFrame) -> DataFrame:
    """Required parts that are missing, by equi-anti-join on ``(doc_id, label)``.

    Wildcard requirements become labels on the parts that satisfy them, so no
    pattern join is needed.
    """
    wanted = F.lit(None).cast("array<string>")
    for fmt, names in REQUIRED_PARTS.items():
        wanted = F.when(F.col("format") == fmt, F.array(*[F.lit(n) for n in COMMON_PARTS + names])).otherwise(wanted)
    expected = packages.select("doc_id", F.explode(wanted).alias("part"))
    labels = [F.col("part")]
    for names in REQUIRED_PARTS.values():
        for name in names:
            prefix, star, suffix = name.partition("*")
            if star:
                fits = F.col("part").startswith(prefix) & F.col("part").endswith(suffix)
                labels.append(F.when(fits, F.lit(name)))
    present = parts.select("doc_id", F.explode(F.array_compact(F.array(*labels))).alias("part"))
    return expected.join(present, ["doc_id", "part"], "left_anti").select(
        "doc_id", "part", F.lit("OPC_REQUIRED_PART_MISSING").alias("code"), F.lit("error").alias("severity"))


def unsafe_names(parts: DataFrame) -> DataFrame:
    name = F.replace("part", F.lit("\\"), F.lit("/"))
    return explode_issues(parts, ["doc_id", "part"], [
        issue(name == "", "ZIP_EMPTY_ENTRY", "error"),
        issue(name.startswith("/"), "ZIP_ABSOLUTE_ENTRY", "error"),
        issue(name.rlike("^[A-Za-z]:"), "ZIP_WINDOWS_DRIVE_ENTRY", "error"),
        issue(name.rlike(r"(^|/)\.\.(/|$)"), "ZIP_SLIP_ENTRY", "error"),
    ])


def broken_targets(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Internal relationships whose target part does not exist."""
    internal = rels.filter(~F.col("external")).withColumnRenamed("resolved", "part")
    return internal.join(parts.select("doc_id", "part"), ["doc_id", "part"], "left_anti").select(
        "doc_id", "rels_part", "rel_id", F.col("part").alias("target"),
        F.lit("OFFICE_REPAIR_RISK_BROKEN_RELATIONSHIP").alias("code"), F.lit("warning").alias("severity"))


def duplicates(df: DataFrame, keys: list[str], code: str = "ZIP_DUPLICATE_ENTRY") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
        .withColumn("code", F.lit(code)).withColumn("severity", F.lit("error"))
    )


def external_targets(rels: DataFrame, severity: str = "error") -> DataFrame:
    return rels.filter("external").select(
        "doc_id", "rel_id", "target", F.lit("ZIP_EXTERNAL_RELATIONSHIP").alias("code"), F.lit(severity).alias("severity"))


def risky_parts(parts: DataFrame) -> DataFrame:
    """Macro projects and embedded objects."""
    name = F.lower(F.replace("part", F.lit("\\"), F.lit("/")))
    embedded = name.contains("/embeddings/")
    workbook = embedded & name.endswith(".xlsx")
    return explode_issues(parts, ["doc_id", "part"], [
        issue(name.contains("vbaproject.bin"), "ZIP_MACRO_PART", "error"),
        issue(workbook, "ZIP_EMBEDDED_WORKBOOK", "info"),
        issue(embedded & ~workbook, "ZIP_EMBEDDED_OBJECT", "warning"),
    ])


def volume_limits(parts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Limits on entries, bytes, ratio, XML part size, encryption, nesting, relationships.

    One partial aggregate per document; ``flags``, ``xml`` and ``depth`` (of the archive that holds the part) are optional
    columns. With the parts of inner archives (``shred(inner=True)``) all is counted through the tree.
    """
    has = set(parts.columns)
    xml_like = F.col("part").rlike(r"(?i)\.(xml|rels)$")
    depth = F.col("depth") if "depth" in has else F.lit(0)
    nested = F.col("part").rlike(ARCHIVE_NAME) & (depth >= limits.nested_depth)
    encrypted = (F.col("flags").bitwiseAND(1) == 1) if "flags" in has else F.lit(False)
    zip64 = (F.col("size") >= 4294967295) | (F.col("comp_size") >= 4294967295)
    relationships = F.regexp_count("xml", F.lit(r"<Relationship\b")) if "xml" in has else F.lit(0)
    ratio = F.when(F.col("comp_size") > 0, F.col("size") / F.col("comp_size"))
    totals = parts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("size").alias("expanded"), F.max(ratio).alias("ratio"),
        F.max(F.when(xml_like, F.col("size"))).alias("largest_xml"), F.bool_or(nested).alias("nested"),
        F.bool_or(encrypted).alias("encrypted"), F.bool_or(zip64).alias("zip64"), F.sum(relationships).alias("rels"),
    )
    return explode_issues(totals, ["doc_id"], [
        issue(F.col("entries") > limits.entries, "ZIP_ENTRY_LIMIT_EXCEEDED", "error"),
        issue(F.col("expanded") > limits.expanded_bytes, "ZIP_EXPANDED_BYTES_EXCEEDED", "error"),
        issue(F.col("largest_xml") > limits.xml_part_bytes, "ZIP_XML_PART_TOO_LARGE", "error"),
        issue(F.col("ratio") > limits.ratio, "ZIP_COMPRESSION_RATIO_EXCEEDED", "error"),
        issue(F.col("nested"), "ZIP_NESTED_ZIP_DETECTED", "error"),
        issue(F.col("encrypted"), "ZIP_ENCRYPTED_ENTRY", "error"),
        issue(F.col("zip64"), "ZIP64_UNSUPPORTED", "error"),
        issue(F.col("rels") > limits.relationships, "ZIP_RELATIONSHIP_LIMIT_EXCEEDED", "error"),
    ])


def entity_declarations(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("xml").rlike("(?i)<!DOCTYPE|<!ENTITY")).select(
        "doc_id", "part", F.lit("ZIP_XML_ENTITY_DENIED").alias("code"), F.lit("error").alias("severity"))


@F.pandas_udf(T.BooleanType())
def well_formed(text: pd.Series) -> pd.Series:
    def one(value: str) -> bool:
        parser = ParserCreate("utf-8")
        try:
            parser.Parse(value.encode("utf-8", "surrogatepass"), True)
            return True
        except ExpatError:
            return False

    return text.map(one)


# Keeps the optimizer from moving the check into the branches that build the text.
well_formed = well_formed.asNondeterministic()


def malformed_xml(parts: DataFrame) -> DataFrame:
    """XML parts that do not parse. Parts that declare entities are refused unread."""
    safe = parts.filter(F.col("xml").isNotNull() & ~F.col("xml").rlike("(?i)<!DOCTYPE|<!ENTITY"))
    return safe.filter(~well_formed("xml")).select(
        "doc_id", "part", F.lit("OOXML_XML_NOT_WELL_FORMED").alias("code"), F.lit("error").alias("severity"))


def pdf_markers(packages: DataFrame) -> DataFrame:
    raw = packages.filter(F.col("format") == "pdf").select("doc_id", F.decode("content", "ISO-8859-1").alias("raw"))
    return explode_issues(raw, ["doc_id"], [
        issue(~F.col("raw").startswith("%PDF-"), "PDF_HEADER_MISSING", "error"),
        issue(~F.col("raw").contains("startxref"), "PDF_XREF_MISSING", "warning"),
        issue(~F.col("raw").contains("%%EOF"), "PDF_EOF_MISSING", "warning"),
    ])


def unsafe_formula(formula: str | Column = "formula") -> Column:
    formula = F.col(formula) if isinstance(formula, str) else formula
    bare = F.lower(F.regexp_replace(F.trim(formula), "^=+", ""))
    hit = F.lit(False)
    for token in FORMULA_TOKENS:
        hit = hit | F.contains(bare, F.lit(token))
    return hit | formula.rlike(r"\[[^\]]+\][^!]*!")


def unsafe_formulas(cells: DataFrame) -> DataFrame:
    """Formulas that reach for the network, a command or another workbook."""
    return cells.filter(F.col("formula").isNotNull() & unsafe_formula()).withColumn(
        "code", F.lit("XLSX_FORMULA_UNSAFE")).withColumn("severity", F.lit("error"))


def workbook_flags(summary: DataFrame, formulas: bool = True, named_ranges: bool = True,
                   external_links: bool = True, protected_sheets: bool = True) -> DataFrame:
    """Review flags of a workbook summary; each check can be switched off."""
    return explode_issues(summary, ["doc_id"], [
        issue((F.col("formulas") == 0) & F.lit(formulas), "XLSX_FORMULAS_NONE", "warning"),
        issue((F.col("defined_names") == 0) & F.lit(named_ranges), "XLSX_NAMED_RANGES_NONE", "warning"),
        issue((F.col("external_links") > 0) & F.lit(external_links), "XLSX_EXTERNAL_LINKS_PRESENT", "error"),
        issue((F.col("protected_sheets") > 0) & F.lit(protected_sheets), "XLSX_PROTECTED_SHEETS_PRESENT", "warning"),
    ])


# --- forbidden and required text ------------------------------------------------------


def text_hits(objects: DataFrame, patterns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, object_id, pattern_id)`` for every pattern a text contains, ignoring case.

    ``keep`` adds columns of the matching object. Patterns are looked up by their rarest key (``plans/search.py``).
    """
    wanted = patterns.select("pattern_id", F.lower("pattern").alias("needle"))
    columns = [c for c in objects.columns if c in keep]
    texts = objects.select("doc_id", "object_id", F.lower("text").alias("text"), *[F.col(c).alias(f"_{c}") for c in columns])
    found = contained(texts, wanted, ["doc_id", "object_id"], [f"_{c}" for c in columns])
    return found.withColumnsRenamed({f"_{c}": c for c in columns}).select("doc_id", "object_id", "pattern_id", *keep)


def forbidden_text(objects: DataFrame, patterns: DataFrame, margin: int = 24) -> DataFrame:
    """Forbidden patterns found, with a sample of ``margin`` characters on both sides."""
    hits = text_hits(objects, patterns, keep=("text",))
    at = F.instr(F.lower("text"), F.lower("pattern"))
    sample = F.substr("text", F.greatest(at - margin, F.lit(1)),
                      F.length("pattern") + margin + F.least(F.lit(margin), at - 1))
    return (
        hits.join(patterns, "pattern_id")
        .select("doc_id", "object_id", "pattern_id", F.regexp_replace(sample, r"\s+", " ").alias("sample"))
    )


def missing_text(objects: DataFrame, patterns: DataFrame, required: DataFrame) -> DataFrame:
    """``required`` holds ``(doc_id, pattern_id)``; rows not found in the document are returned."""
    hits = text_hits(objects, patterns).select("doc_id", "pattern_id").distinct()
    return required.join(hits, ["doc_id", "pattern_id"], "left_anti")
