"""Relationship parts: owner, target mode and resolved target path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.xml import as_column, attribute, matches, xml_unescape


def fold_path(path) -> Column:
    """Drop empty and ``.`` segments and apply ``..``."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), acc)
            .when(segment == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(segment)))
        )

    column = as_column(path)
    folded = F.array_join(F.aggregate(F.split(column, "/"), empty, step), "/")
    # Most targets have nothing to fold and skip the array work.
    return F.when(column.rlike(r"(?:^|/)(?:\.\.?)?(?:/|$)"), folded).otherwise(column)


def owner_of(rels_part) -> Column:
    part = as_column(rels_part)
    nested = F.regexp_replace(part, r"^(.*)/_rels/([^/]+)\.rels$", "$1/$2")
    return F.when(part.rlike(r"^.*/_rels/[^/]+\.rels$"), nested).otherwise("")


def _clean(target) -> Column:
    return F.regexp_replace(F.replace(as_column(target), F.lit("\\"), F.lit("/")), r"[#?](?s:.*)$", "")


def _resolve(owner, clean: Column) -> Column:
    folder = F.regexp_replace(as_column(owner), r"[^/]*$", "")
    relative = fold_path(F.concat(folder, clean))
    return F.when(clean == "", F.lit(None)).when(
        clean.startswith("/"), F.substr(clean, F.lit(2))
    ).otherwise(relative)


def resolve_target(owner, target) -> Column:
    """Target relative to the owner's folder; fragment and query are cut off."""
    return _resolve(owner, _clean(target))


def is_external(target, mode) -> Column:
    by_mode = F.coalesce(F.lower(as_column(mode)) == "external", F.lit(False))
    return by_mode | as_column(target).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def relationships(parts: DataFrame) -> DataFrame:
    """One row per relationship; rows without id or target are dropped."""
    tags = (
        parts.filter(F.col("part").endswith(".rels"))
        .select("doc_id", F.col("part").alias("rels_part"),
                F.posexplode(matches("xml", r"<Relationship\b[^>]*>")).alias("pos", "tag"))
    )
    # Attributes become columns first, so that later steps do not read the tag again.
    read = tags.filter(F.col("tag").contains("Target")).select(
        "doc_id", "rels_part", "pos", attribute("tag", "Id").alias("rel_id"), attribute("tag", "Type").alias("type"),
        attribute("tag", "Target").alias("raw"), attribute("tag", "TargetMode").alias("target_mode"))
    named = read.select(
        "doc_id", "rels_part", owner_of("rels_part").alias("owner"), "pos", "rel_id", F.coalesce("type", F.lit("")).alias("type"),
        xml_unescape("raw").alias("target"), "target_mode")
    out = named.withColumn("external", is_external("target", "target_mode")).withColumn(
        "resolved", F.when(~F.col("external"), resolve_target("owner", "target")))
    return out.filter((F.col("rel_id") != "") & (F.col("target") != ""))


def targets(xml, owner: str) -> Column:
    """Relationships of one part as an array of ``(rel_id, resolved)``, for joins inside a row; external ones resolve to NULL."""
    # Inside a lambda Spark evaluates an expression once per mention: each step binds what the next one mentions.
    read = F.transform(matches(xml, r"<Relationship\b[^>]*>"), lambda tag: F.struct(
        attribute(tag, "Id").alias("rel_id"), attribute(tag, "Target").alias("raw"), attribute(tag, "TargetMode").alias("mode")))
    named = F.transform(read, lambda r: F.struct(r["rel_id"].alias("rel_id"), xml_unescape(r["raw"]).alias("target"), r["mode"].alias("mode")))
    clean = F.transform(named, lambda r: F.struct(
        r["rel_id"].alias("rel_id"), F.when(~is_external(r["target"], r["mode"]), _clean(r["target"])).alias("clean")))
    return F.transform(clean, lambda r: F.struct(r["rel_id"].alias("rel_id"), F.when(r["clean"].isNotNull(), _resolve(F.lit(owner), r["clean"])).alias("resolved")))
