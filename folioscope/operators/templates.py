"""Templates: placeholders, mail merge, value checks, ranking, field mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.xml import as_column, matches, xml_escape, xml_unescape
from folioscope.operators.integrity import explode_issues, issue, text_hits, unsafe_formula

PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"

# Weights of the template ranking.
QUERY_WEIGHT, TAG_WEIGHT, FIELD_WEIGHT, SOURCE_WEIGHT = 5, 3, 2, 1


def placeholders(text) -> Column:
    """Distinct placeholder names in first-seen order, over the whole text."""
    return F.array_distinct(matches(as_column(text), PLACEHOLDER, 1))


def _value(data: Column, name: Column) -> Column:
    """Value at a dotted path of a JSON document; NULL counts as missing."""
    path = F.concat(F.lit("$['"), F.replace(name, F.lit("."), F.lit("']['")), F.lit("']"))
    return F.call_function("get_json_object", data, path)


def fill(templates: DataFrame, data: DataFrame) -> DataFrame:
    """Templates merged with data records.

    ``templates``: ``template_id, xml``; ``data``: ``record_id, template_id,
    json``. Tokens are replaced between literals, so a value that looks like a
    placeholder is not expanded again. A record with a missing field is blocked.
    """
    joined = data.join(templates, "template_id").withColumn("names", matches("xml", PLACEHOLDER, 1))
    values = F.transform("names", lambda n: _value(F.col("json"), n))
    valued = joined.withColumn("values", values)
    literals = F.split("xml", PLACEHOLDER, -1)
    tokens = F.transform("values", lambda v: xml_escape(v))
    filled = F.array_join(F.zip_with(literals, tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    gaps = F.zip_with("names", "values", lambda n, v: F.when(v.isNull(), n))
    missing = F.array_sort(F.array_distinct(F.array_compact(gaps)))
    out = valued.withColumn("missing", missing).withColumn("done", filled)
    replaced = F.size(F.filter("values", lambda v: v.isNotNull()))
    # A value may turn a harmless formula into one that reaches out: the filled formulas are tested.
    formulas = F.transform(matches("done", r"(?s)<f(?:\s[^>]*)?>(.*?)</f>", 1), lambda f: xml_unescape(f))
    unsafe = F.coalesce(F.exists(formulas, unsafe_formula), F.lit(False))
    return out.withColumn("unsafe", unsafe).select(
        "record_id", "template_id", F.when((F.size("missing") == 0) & ~F.col("unsafe"), F.col("done")).alias("filled"), replaced.alias("replacements"), "unsafe",
        F.array_join("missing", ",").alias("missing"), F.col("xml").alias("template_xml"))


def fill_report(filled: DataFrame) -> DataFrame:
    """Outcome per record: blocked, changed, or why nothing changed."""
    unchanged = F.col("filled") == F.col("template_xml")
    code = (
        F.when(F.col("missing") != "", "TEMPLATE_FIELD_MISSING").when(F.col("unsafe"), "XLSX_FORMULA_UNSAFE")
        .when(unchanged & (F.col("replacements") == 0), "NO_PLACEHOLDERS_FOUND").when(unchanged, "TEMPLATE_NO_EFFECT")
    )
    changed = (F.col("missing") == "") & ~F.col("unsafe") & ~unchanged
    readiness = F.when((F.col("missing") != "") | F.col("unsafe"), "blocked").when(changed, "pass").otherwise("warning")
    return filled.select("record_id", "template_id", "replacements", "missing", F.coalesce(changed, F.lit(False)).alias("changed"),
                         code.alias("code"), readiness.alias("readiness"))


def _json_kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def validate_values(fields: DataFrame, data: DataFrame) -> DataFrame:
    """Missing required fields and values of the wrong type.

    ``fields``: ``template_id, name, type, required, default_json``; ``data``:
    ``record_id, template_id, json``. The default applies where the value is absent.
    """
    joined = data.join(fields, "template_id")
    picked = F.try_parse_json(F.coalesce(_quoted("json", "name"), F.col("default_json")))
    valued = joined.withColumn("v", picked)
    kind, text = _json_kind(F.col("v")), F.try_variant_get("v", "$", "string")
    fits = (
        F.when(F.col("type") == "date", (kind == "string") & F.try_to_timestamp(text).isNotNull())
        .when(F.col("type") == "image", kind == "string")
        .when(F.col("type") == "chartData", (kind == "object") & F.coalesce(
            F.schema_of_variant(F.try_variant_get("v", "$.values", "variant")).startswith("ARRAY"), F.lit(False)))
        .when(F.col("type").isin("table", "list"), kind == "array").when(F.col("type") == "json", True)
        .otherwise(kind == F.col("type"))
    )
    return explode_issues(valued, ["record_id", "template_id", "name"], [
        issue(F.col("v").isNull() & F.col("required"), "FIELD_MISSING", "error"),
        issue(F.col("v").isNotNull() & ~fits, "FIELD_TYPE", "error"),
    ])


def _quoted(json: str, name: str) -> Column:
    """JSON text of a top-level member, strings kept in quotes."""
    member = F.call_function("get_json_object", F.col(json), F.concat(F.lit("$['"), F.col(name), F.lit("']")))
    wrapped = F.call_function("get_json_object", F.concat(F.lit("["), F.col(json), F.lit("]")), F.concat(F.lit("$[*]['"), F.col(name), F.lit("']")))
    return F.when(member.isNotNull(), F.coalesce(wrapped, member))


def rank_templates(templates: DataFrame, tags: DataFrame, fields: DataFrame, requests: DataFrame, request_tags: DataFrame,
                   request_fields: DataFrame, source_fields: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Templates scored per request; zero scores drop out, ties go by id; the best ``limit``, or all.

    ``templates``: ``template_id, search_text``; ``tags`` / ``fields``: one row
    per value; ``requests``: ``request_id, query``. Query texts are searched as in ``text_hits``.

    Templates with the same asked tags and fields score alike for every request: these profiles are scored, not templates. What
    query texts and sources add is never negative, so the best are among the first ``limit`` ids of each profile, and the first of
    those in it with the same addition to a request; no other pair of request and template is made.
    """
    trait = lambda df, key, kind: df.select(key, F.lit(kind).alias("kind"), F.lower(kind).alias("value"))
    asked = trait(request_tags, "request_id", "tag").unionByName(trait(request_fields, "request_id", "field")).distinct()
    given = trait(tags, "template_id", "tag").unionByName(trait(fields, "template_id", "field"))
    counted = given.join(asked.select("kind", "value").distinct(), ["kind", "value"], "left_semi").groupBy("template_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    profiles = counted.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "n"))).alias("profile"))

    def first_ids(df: DataFrame, *alike: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*alike).orderBy("template_id"))
        return df if limit is None else df.withColumn("place", place).filter(F.col("place") <= limit).drop("place")

    first = first_ids(profiles, "profile")
    weight = F.when(F.col("kind") == "tag", TAG_WEIGHT).otherwise(FIELD_WEIGHT)
    by_profile = first.select("profile").distinct().select("profile", F.inline("profile")).join(asked, ["kind", "value"]).groupBy(
        "request_id", "profile").agg(F.sum(F.col("n") * weight).alias("score"))

    texts = templates.select(F.col("template_id").alias("doc_id"), F.lit("text").alias("object_id"), F.col("search_text").alias("text"))
    queries = requests.select(F.col("request_id").alias("pattern_id"), F.trim("query").alias("pattern"))
    added = text_hits(texts, queries).select(
        F.col("pattern_id").alias("request_id"), F.col("doc_id").alias("template_id"), F.lit(QUERY_WEIGHT).cast("bigint").alias("score"))
    if source_fields is not None:
        mapped = source_fields.groupBy("request_id", "template_id").agg((F.count(F.lit(1)) + SOURCE_WEIGHT).alias("score"))
        added = added.unionByName(mapped)
    pair = ["request_id", "template_id"]
    base = by_profile.join(first, "profile").select(*pair, "score")
    more = first_ids(added.groupBy(*pair).agg(F.sum("score").alias("more")).join(profiles, "template_id", "left"), "request_id", "profile", "more")
    raised = more.join(by_profile, ["request_id", "profile"], "left").select(*pair, (F.coalesce("score", F.lit(0)) + F.col("more")).alias("score"))
    totals = base.unionByName(raised).groupBy(*pair).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("score").desc(), "template_id"))
    ranked = totals.withColumn("rank", rank)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def normalize_field(name) -> Column:
    return F.regexp_replace(F.lower(as_column(name)), "[^a-z0-9]+", "")


def map_fields(fields: DataFrame, candidates: DataFrame, limit: int = 8) -> DataFrame:
    """Candidates whose name contains, or is contained in, a template field.

    ``fields``: ``template_id, field``; ``candidates``: ``template_id,
    candidate, position``. Both are names within one template.
    """
    left = candidates.withColumn("c", normalize_field("candidate")).filter(F.col("c") != "").alias("x")
    right = fields.select("template_id", normalize_field("field").alias("f")).filter(F.col("f") != "").distinct().alias("y")
    hit = F.contains(F.col("x.c"), F.col("y.f")) | F.contains(F.col("y.f"), F.col("x.c"))
    pairs = left.join(right, (F.col("x.template_id") == F.col("y.template_id")) & hit, "left_semi")
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy("position"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit).select("template_id", "candidate", "rank")
