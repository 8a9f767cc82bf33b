"""Story graph of word-processing parts: story, paragraph, run and token nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.xml import matches, xml_unescape

STORY_PART = r"(?i)^word/(document|header\d+|footer\d+|comments)\.xml$"
# Marker name -> element that carries it.
MARKERS = {
    "hyperlink": r"<w:hyperlink\b", "field": r"<w:fldSimple\b|<w:fldChar\b|<w:instrText\b",
    "bookmark": r"<w:bookmarkStart\b", "comment": r"<w:commentReference\b", "insertion": r"<w:ins\b",
    "deletion": r"<w:del\b", "content_control": r"<w:sdt\b",
}


def _paragraphs(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("part").rlike(STORY_PART)).select(
        "doc_id", "part", F.posexplode(matches("xml", r"(?s)<w:p(?=[\s>]).*?</w:p>", 0)).alias("p", "block")
    )


def _runs(parts: DataFrame) -> DataFrame:
    return _paragraphs(parts).select(
        "doc_id", "part", "p", F.posexplode(matches("block", r"(?s)<w:r(?=[\s>]).*?</w:r>", 0)).alias("r", "run")
    )


def _tokens(parts: DataFrame) -> DataFrame:
    token = r"(?s)<w:(?:t|delText|instrText)(?:\s[^>]*)?>.*?</w:(?:t|delText|instrText)>"
    return _runs(parts).select("doc_id", "part", "p", "r", F.posexplode(matches("run", token, 0)).alias("t", "token"))


def _ident(*steps: str) -> Column:
    """Position path of a node; positions are 1-based."""
    numbers = [(F.col(s) + 1).cast("string") for s in steps]
    return F.concat(F.col("part"), F.lit("#"), F.concat_ws(".", *numbers)) if numbers else F.col("part")


def _text(block: str) -> Column:
    pieces = matches(block, r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t>", 1)
    return F.array_join(F.transform(pieces, lambda t: xml_unescape(t, numeric=False)), "")


def nodes(parts: DataFrame) -> DataFrame:
    """Nodes of all stories; each comes from its own part row, without a shuffle."""
    stories = parts.filter(F.col("part").rlike(STORY_PART)).select(
        "doc_id", _ident().alias("node_id"), F.lit("story").alias("type"), F.lit(0).alias("idx"), F.lit("").alias("text"))
    paragraphs = _paragraphs(parts).select(
        "doc_id", _ident("p").alias("node_id"), F.lit("paragraph").alias("type"), (F.col("p") + 1).alias("idx"), _text("block").alias("text"))
    runs = _runs(parts).select(
        "doc_id", _ident("p", "r").alias("node_id"), F.lit("run").alias("type"), (F.col("r") + 1).alias("idx"), _text("run").alias("text"))
    tokens = _tokens(parts).select(
        "doc_id", _ident("p", "r", "t").alias("node_id"),
        F.when(F.col("token").startswith("<w:instrText"), "field_code").when(F.col("token").startswith("<w:delText"), "deleted_text")
        .otherwise("text").alias("type"),
        (F.col("t") + 1).alias("idx"),
        xml_unescape(F.regexp_extract("token", r"(?s)^<[^>]*>(.*)</[^>]*>$", 1), numeric=False).alias("text"),
    )
    return stories.unionByName(paragraphs).unionByName(runs).unionByName(tokens)


def edges(parts: DataFrame) -> DataFrame:
    """``contains`` edges down the tree and ``next`` edges between runs of a paragraph.

    A run's predecessor is known from its position, so no window is needed.
    """
    edge = lambda source, target, relation: (source.alias("from_id"), target.alias("to_id"), F.lit(relation).alias("relation"))
    paragraphs, runs, tokens = _paragraphs(parts), _runs(parts), _tokens(parts)
    before = F.concat(F.col("part"), F.lit("#"), (F.col("p") + 1).cast("string"), F.lit("."), F.col("r").cast("string"))
    return (
        paragraphs.select("doc_id", *edge(_ident(), _ident("p"), "contains"))
        .unionByName(runs.select("doc_id", *edge(_ident("p"), _ident("p", "r"), "contains")))
        .unionByName(tokens.select("doc_id", *edge(_ident("p", "r"), _ident("p", "r", "t"), "contains")))
        .unionByName(runs.filter(F.col("r") > 0).select("doc_id", *edge(before, _ident("p", "r"), "next")))
    )


def markers(parts: DataFrame) -> DataFrame:
    """Marker counts per story: links, fields, bookmarks, comments, revisions, controls."""
    return parts.filter(F.col("part").rlike(STORY_PART)).select(
        "doc_id", "part",
        *[F.regexp_count("xml", F.lit(pattern)).cast("bigint").alias(name) for name, pattern in MARKERS.items()],
    )
