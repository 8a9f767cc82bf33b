"""Comparison of two snapshots: parts, objects, geometry, text semantics, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import string_distance
from folioscope.session import cut

# Part path pattern -> kind, first match wins.
PART_KINDS = [
    (r"(?i)^ppt/slides/slide\d+\.xml$", "slideXml"),
    (r"(?i)^ppt/slideLayouts/slideLayout\d+\.xml$", "slideLayout"),
    (r"(?i)^ppt/slideMasters/slideMaster\d+\.xml$", "slideMaster"),
    (r"(?i)^word/document\.xml$", "documentXml"),
    (r"(?i)^word/(header|footer)\d+\.xml$", "headerFooter"),
    (r"(?i)^xl/worksheets/sheet\d+\.xml$", "worksheetXml"),
    (r"(?i)\.rels$", "relationships"),
    (r"^\[Content_Types\]\.xml$", "contentTypes"),
    (r"(?i)/charts/", "chartXml"),
    (r"(?i)/embeddings/", "embeddedWorkbook"),
    (r"(?i)/theme/", "theme"),
    (r"(?i)/tables/", "table"),
    (r"(?i)/media/", "imageOrMedia"),
    (r"(?i)/comments", "comments"),
    (r"(?i)/styles\.xml$", "styles"),
]


def part_kind(part: str = "part") -> Column:
    kind = F.lit("packagePart")
    for pattern, name in reversed(PART_KINDS):
        kind = F.when(F.col(part).rlike(pattern), name).otherwise(kind)
    return kind


def _outer(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join with both sides' columns as ``b_*`` and ``a_*`` structs of presence."""
    left = before.select(*keys, F.lit(True).alias("in_before"), *[F.col(c).alias(f"b_{c}") for c in columns])
    right = after.select(*keys, F.lit(True).alias("in_after"), *[F.col(c).alias(f"a_{c}") for c in columns])
    return left.join(right, keys, "full_outer")


def _status(changed: Column) -> Column:
    return (
        F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed")
        .when(changed, "changed").otherwise("unchanged")
    )


def part_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every part of either snapshot with status, kind, digests and byte delta.

    Digests and sizes travel through the join, never the part contents.
    """
    joined = _outer(before, after, ["doc_id", "part"], ["sha256", "size"])
    return joined.select(
        "doc_id", "part",
        part_kind().alias("kind"),
        _status(~F.col("b_sha256").eqNullSafe(F.col("a_sha256"))).alias("status"),
        (F.coalesce("a_size", F.lit(0)) - F.coalesce("b_size", F.lit(0))).cast("bigint").alias("byte_delta"),
        F.col("b_sha256").alias("before_sha256"),
        F.col("a_sha256").alias("after_sha256"),
    )


def diff_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts per document of added, removed, changed and unchanged parts."""
    count = lambda status: F.count_if(F.col("status") == status).alias(status)
    return part_changes(before, after).groupBy("doc_id").agg(
        count("added"), count("removed"), count("changed"), count("unchanged"),
        F.sum("byte_delta").alias("byte_delta"),
    )


def touched_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a patch touches: created, modified and deleted parts with both digests."""
    names = F.create_map(*[F.lit(v) for pair in (("added", "created"), ("changed", "modified"), ("removed", "deleted")) for v in pair])
    return part_changes(before, after).filter(F.col("status") != "unchanged").select(
        "doc_id", "part", names[F.col("status")].alias("action"), "before_sha256", "after_sha256"
    )


def _digests(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    return rows.select(*keys, *[F.sha2(c, 256).alias(name) for name, c in columns.items()])


def _texts(rows: DataFrame, keys: list[str], wanted: DataFrame, name: str) -> DataFrame:
    """The texts of the wanted keys; the few keys travel to the texts where Spark finds them few."""
    return rows.select(*keys, F.col("text").alias(name)).join(wanted.select(*keys), keys, "left_semi")


def diff_objects(before: DataFrame, after: DataFrame) -> DataFrame:
    """Objects that were added, removed, or whose text changed.

    Digests are compared first; texts are read for the objects that differ.
    """
    keys = ["doc_id", "object_id"]
    digest = {"digest": F.col("text")}
    joined = _outer(_digests(before, keys, digest), _digests(after, keys, digest), keys, ["digest"])
    status = _status(~F.col("b_digest").eqNullSafe(F.col("a_digest")))
    differ = cut(joined.select(*keys, status.alias("status")).filter(F.col("status") != "unchanged"))
    return differ.join(_texts(before, keys, differ, "before_text"), keys, "left").join(_texts(after, keys, differ, "after_text"), keys, "left")


def diff_geometry(before: DataFrame, after: DataFrame) -> DataFrame:
    """Boxes moved or resized by at least 0.01, and boxes of added objects."""
    sides = ["x", "y", "w", "h"]
    joined = _outer(before, after, ["doc_id", "object_id"], sides).filter(F.col("in_after").isNotNull())
    had = F.col("b_x").isNotNull()
    has = F.col("a_x").isNotNull()
    moved = F.lit(False)
    for side in sides:
        moved = moved | (F.abs(F.col(f"a_{side}") - F.col(f"b_{side}")) >= 0.01)
    delta = lambda s: F.round(F.coalesce(f"a_{s}", F.lit(0.0)) - F.coalesce(f"b_{s}", F.lit(0.0)), 2).alias(f"d{s}")
    return joined.filter((had | has) & (~(had & has) | moved)).select(
        "doc_id", "object_id",
        F.when(F.col("in_before").isNull(), "added").otherwise("changed").alias("status"),
        *[delta(s) for s in sides],
    )


def _run_formats(runs: str) -> Column:
    kept = ["pos", "bold", "italic", "font_pt", "font_latin", "font_ea", "font_cs", "lang", "no_proof"]
    formats = F.transform(F.col(runs), lambda r: F.struct(*[r[k].alias(k) for k in kept]))
    return F.coalesce(F.to_json(formats), F.lit("[]"))


def diff_semantics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Kinds of text changes per shape: paragraph, bullet, numbering, run-format.

    Paragraphs are compared one by one and the flags are aggregated, so the
    text of a shape is never gathered. Shapes on one side only are not changes.
    """
    keys = ["doc_id", "part", "shape"]
    both = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_semi")
    # Paragraphs meet as digests of their text and formats.
    side = lambda rows: rows.select(*keys, "para", F.sha2("text", 256).alias("text"), "bullet", "numbering", "line_breaks",
                                    F.sha2(_run_formats("runs"), 256).alias("formats"))
    joined = _outer(side(before), side(after), [*keys, "para"], ["text", "bullet", "numbering", "formats", "line_breaks"])
    none = F.sha2(F.lit("[]"), 256)
    differs = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    flags = joined.groupBy(*keys).agg(
        F.bool_or(differs("text") | differs("line_breaks") | F.col("in_before").isNull() | F.col("in_after").isNull()).alias("paragraph"),
        F.bool_or(differs("bullet")).alias("bullet"),
        F.bool_or(differs("numbering")).alias("numbering"),
        F.bool_or(F.coalesce("b_formats", none) != F.coalesce("a_formats", none)).alias("run_format"),
    )
    named = F.array_compact(F.array(
        F.when(F.col("paragraph"), "paragraph"), F.when(F.col("bullet"), "bullet"),
        F.when(F.col("numbering"), "numbering"), F.when(F.col("run_format"), "run-format"),
    ))
    return flags.join(both, keys, "left_semi").select(*keys, F.array_join(named, ",").alias("changes")).filter(F.col("changes") != "")


def page_scores(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positional distance of each page's text between two snapshots; texts are read for pages that differ."""
    keys = ["doc_id", "page"]
    digest = {"digest": F.coalesce("text", F.lit(""))}
    joined = _outer(_digests(before, keys, digest), _digests(after, keys, digest), keys, ["digest"])
    marked = cut(joined.select(*keys, (F.col("b_digest").eqNullSafe(F.col("a_digest"))).alias("same")))
    same = marked.filter("same").select(*keys, F.lit(0.0).alias("score"))
    differ = marked.filter(~F.col("same")).select(*keys)
    texts = differ.join(_texts(before, keys, differ, "b_text"), keys, "left").join(_texts(after, keys, differ, "a_text"), keys, "left")
    return same.unionByName(texts.select(*keys, string_distance("b_text", "a_text").alias("score")))


def diff_summary(parts: DataFrame, objects: DataFrame, scores: DataFrame) -> DataFrame:
    """Per document: changed parts, object changes and the mean page distance."""
    part_counts = parts.groupBy("doc_id").agg(F.count_if(F.col("status") != "unchanged").alias("changed_parts"))
    object_counts = objects.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "added").alias("added_objects"),
        F.count_if(F.col("status") == "removed").alias("removed_objects"),
        F.count_if(F.col("status") == "changed").alias("changed_text_objects"),
    )
    pages = scores.groupBy("doc_id").agg(F.round(F.avg("score"), 4).alias("regression_score"))
    out = part_counts.join(object_counts, "doc_id", "full_outer").join(pages, "doc_id", "full_outer")
    counts = ["changed_parts", "added_objects", "removed_objects", "changed_text_objects"]
    out = out.na.fill(0, counts)
    changed = F.coalesce("regression_score", F.lit(0.0)) > 0
    for name in counts:
        changed = changed | (F.col(name) > 0)
    return out.withColumn("changed", changed)


# --- stale plans ------------------------------------------------------------------


def object_map_digest(objects: DataFrame, width: int = 4096) -> DataFrame:
    """Order-stable digest of a document's object map.

    Rows are digested in chunks of ``width`` positions and the chunk digests
    once more per document, so no group holds more than a chunk of rows.
    """
    row = F.struct("idx", F.concat("object_id", F.lit(":"), F.sha2("text", 256)).alias("line"))
    chunks = objects.withColumn("chunk", F.floor(F.col("idx") / width)).groupBy("doc_id", "chunk").agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    ).select("doc_id", "chunk", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), ","), 256).alias("digest"))
    # A chunk digest stands for thousands of rows; even the largest document keeps few.
    return chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "digest"))).alias("chunks")
    ).select("doc_id", F.sha2(F.array_join(F.transform("chunks", lambda c: c["digest"]), ","), 256).alias("map_sha256"))


def stale_plans(plans: DataFrame, current: DataFrame) -> DataFrame:
    """Plans whose expected digests no longer match. NULL expectations are not checked.

    ``plans`` has ``plan_id, doc_id, expected_sha256, expected_map_sha256``;
    ``current`` has ``doc_id, sha256, map_sha256``. Digests match with or
    without the ``sha256:`` prefix.
    """
    bare = lambda c: F.regexp_replace(c, "^sha256:", "")
    joined = plans.join(current.withColumn("found", F.lit(True)), "doc_id", "left")
    reason = (
        F.when(F.col("found").isNull(), "INPUT_MISSING")
        .when(bare("expected_sha256") != bare("sha256"), "INPUT_CHANGED")
        .when(bare("expected_map_sha256") != bare("map_sha256"), "OBJECT_MAP_CHANGED")
    )
    return joined.select("plan_id", "doc_id", F.coalesce(reason, F.lit("CURRENT")).alias("status"))


