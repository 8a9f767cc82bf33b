"""Design statistics: colours, text sizes, slide types, box patterns, field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import nearest, round_half_up
from folioscope.functions.xml import as_column, first_match, matches

# Field-name tokens that decide the type of a template field.
NUMBER_TOKENS = ["amount", "price", "revenue", "sales", "count", "number", "score", "rate", "ratio", "percent", "total", "qty", "quantity"]
DATE_TOKENS = ["date", "day", "month", "year", "deadline"]
NAME_TOKENS = ["title", "name", "headline"]


COLOR = r'<a:srgbClr\b[^>]*\bval="([0-9a-fA-F]{6})"'


def _color_hits(parts: DataFrame, pattern: str) -> DataFrame:
    return parts.select("doc_id", "part", F.explode(matches("xml", pattern, 1)).alias("hex")).select(
        "doc_id", "part", F.concat(F.lit("#"), F.upper("hex")).alias("color"))


def color_counts(parts: DataFrame, pattern: str = COLOR) -> DataFrame:
    """How often a document uses each colour."""
    return _color_hits(parts, pattern).groupBy("doc_id", "color").agg(F.count(F.lit(1)).alias("uses"))


def colors(parts: DataFrame, pattern: str = COLOR, shown: int = 6) -> DataFrame:
    """Colour counts per document with up to ``shown`` source parts."""
    per_part = _color_hits(parts, pattern).groupBy("doc_id", "color", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = per_part.groupBy("doc_id", "color").agg(F.sum("n").alias("uses"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "color").orderBy("part"))
    sources = per_part.withColumn("rn", rank).filter(F.col("rn") <= shown).groupBy("doc_id", "color").agg(
        F.array_join(F.array_sort(F.collect_list("part")), ",").alias("sources"))
    return counts.join(sources, ["doc_id", "color"])


def color_roles(counts: DataFrame, background: DataFrame, text: DataFrame, accents: int = 3) -> DataFrame:
    """Background, text and up to ``accents`` accent colours per document.

    The background is the most used explicit background colour, else the most
    used colour; accents exclude both.
    """
    explicit = _top(background).withColumn("confidence", F.lit(0.82))
    guessed = _top(counts).join(explicit, "doc_id", "left_anti").withColumn("confidence", F.lit(0.45))
    back = explicit.unionByName(guessed).select("doc_id", "color", "confidence", F.lit("background").alias("role"))
    front = _top(text).select("doc_id", "color", F.lit(0.72).alias("confidence"), F.lit("text").alias("role"))
    used = back.select("doc_id", "color").unionByName(front.select("doc_id", "color"))
    rest = counts.select("doc_id", "color", "uses").join(used, ["doc_id", "color"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("uses").desc(), "color"))
    chosen = rest.withColumn("rn", rank).filter(F.col("rn") <= accents).select(
        "doc_id", "color", F.lit(0.55).alias("confidence"), F.lit("accent").alias("role"))
    return back.unionByName(front).unionByName(chosen)


def _top(counts: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("uses").desc(), "color"))
    return counts.select("doc_id", "color", "uses").withColumn("rn", rank).filter(F.col("rn") == 1).select("doc_id", "color")


def size_buckets(sizes: DataFrame) -> DataFrame:
    """Histogram of text sizes in buckets of four points; sizes are rounded first."""
    low = (F.floor(round_half_up("size_pt") / 4) * 4).cast("int")
    return sizes.filter(F.col("size_pt") > 0).groupBy("doc_id", low.alias("min_pt")).agg(F.count(F.lit(1)).alias("uses")).withColumn(
        "max_pt", F.col("min_pt") + 3)


def classify_slides(objects: DataFrame) -> DataFrame:
    """Density score and type per slide.

    Boxes are shares of the slide; ``kind`` is text, picture, chart or diagram;
    an object without a box counts as 0.03 of the area.
    """
    area = F.coalesce(F.greatest(F.lit(0.0), F.col("w")) * F.greatest(F.lit(0.0), F.col("h")), F.lit(0.03))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    slides = objects.groupBy("doc_id", "slide").agg(
        F.sum(area).alias("area"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"),
        F.count_if((F.col("kind") == "text") & F.col("text").rlike(r"\S")).alias("texts"),
        count("picture").alias("pictures"), count("chart").alias("charts"), count("diagram").alias("diagrams"),
        F.bool_or(F.coalesce("is_title", F.lit(False))).alias("titled"),
    )
    score = nearest(F.least(F.lit(1.0), F.round(F.col("area") * 0.7 + F.least(F.lit(1.0), F.col("chars") / 1200) * 0.3, 9)), 3)
    kind = (
        F.when(F.col("charts") > 0, "chart").when(F.col("diagrams") > 0, "diagram")
        .when((F.col("pictures") > 0) & (F.col("texts") <= 1), "image")
        .when((F.col("texts") == 0) & (F.col("pictures") == 0), "blank")
        .when(F.col("titled") & (F.col("texts") == 1), "title").when(F.col("titled") & (F.col("texts") >= 2), "title-body")
        .when(F.col("density") < 0.2, "section").otherwise("mixed")
    )
    return slides.withColumn("density", score).select("doc_id", "slide", "density", kind.alias("type"))


def bbox_patterns(objects: DataFrame) -> DataFrame:
    """Average box of the title, the largest other object and the images, per document."""
    boxed = objects.select("doc_id", "slide", "object_id", "kind", "x", "y", "w", "h")
    spot = F.struct("x", "y", "w", "h")
    titles = boxed.groupBy("doc_id", "slide").agg(
        F.min_by(F.struct("object_id", "x", "y", "w", "h"), F.struct(
            F.when(F.col("kind") == "title", 0).otherwise(1).alias("a"), F.when(F.col("kind") == "title", F.lit(0.0)).otherwise(F.col("y")).alias("b"),
            F.col("object_id").alias("c"))).alias("t"))
    rest = boxed.join(titles.select("doc_id", "slide", F.col("t.object_id").alias("object_id")), ["doc_id", "slide", "object_id"], "left_anti")
    bodies = rest.groupBy("doc_id", "slide").agg(F.min_by(spot, F.struct((-F.col("w") * F.col("h")).alias("a"), F.col("object_id").alias("b"))).alias("b"))
    box = lambda d, source, role: d.select("doc_id", "slide", F.lit(role).alias("role"), *[F.col(f"{source}.{c}").alias(c) for c in "xywh"])
    images = boxed.filter(F.col("kind") == "image").select("doc_id", "slide", F.lit("image").alias("role"), "x", "y", "w", "h")
    rows = box(titles, "t", "title").unionByName(box(bodies, "b", "body")).unionByName(images)
    return rows.groupBy("doc_id", "role").agg(
        F.count(F.lit(1)).alias("boxes"), *[nearest(F.avg(c), 3).alias(c) for c in "xywh"])


# --- template fields from labels -----------------------------------------------------------


def snake(value) -> Column:
    spaced = F.regexp_replace(F.lower(as_column(value)), "[^a-z0-9]+", "_")
    return F.regexp_replace(spaced, "^_+|_+$", "")


def field_name(text: str = "text") -> Column:
    """Name from a placeholder in the text, else from a short label; NULL if neither fits."""
    placeholder = snake(first_match(text, r"\{\{\s*([A-Za-z][\w.-]*)\s*\}\}", 1))
    label = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "[:：]$", "")
    usable = F.length(F.trim(F.regexp_replace(text, r"\s+", " "))).between(2, 80)
    named = F.when(usable & snake(label).rlike("^[a-z]"), snake(label))
    return F.coalesce(placeholder, named)


def field_confidence(text: str = "text") -> Column:
    t = F.col(text)
    return (
        F.when(t.rlike(r"\{\{[^}]+\}\}"), 0.9).when(t.rlike(r"[:：]\s*$"), 0.75)
        .when(F.length(t) <= 32, 0.6).otherwise(0.35)
    )


def field_type(name: str = "field", confidence: str = "confidence", kind: str | None = None) -> Column:
    n = F.col(name)
    tokens = F.split(n, "_")
    any_of = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    object_kind = F.col(kind) if kind else F.lit(None).cast("string")
    return (
        F.when(object_kind == "picture", "image").when((object_kind == "chart") | n.rlike(r"\bchart\b"), "chartData")
        .when(n.rlike(r"\b(table|rows|matrix)\b"), "table").when(n.rlike("^(is|has|can|should|enabled|active)(_|$)"), "boolean")
        .when(any_of(NUMBER_TOKENS), "number")
        .when((F.col(confidence) >= 0.7) & any_of(DATE_TOKENS) & ~any_of(NAME_TOKENS), "date")
        .when(any_of(["created", "modified", "updated"]) & any_of(["at"]), "date").otherwise("string")
    )


def infer_fields(objects: DataFrame, limit: int = 24) -> DataFrame:
    """Template fields suggested by a document's labels: best confidence per name, top ``limit``."""
    named = objects.select("doc_id", "text").withColumn("field", field_name()).withColumn("confidence", field_confidence()).filter(
        F.col("field").isNotNull() & (F.col("field") != ""))
    best = named.groupBy("doc_id", "field").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "field"))
    return best.withColumn("rn", rank).filter(F.col("rn") <= limit).select(
        "doc_id", "field", field_type().alias("type"), (F.col("confidence") >= 0.7).alias("required"), "confidence")
