"""JSON documents: schema checks, nearest schema branch, document trees as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.redaction import json_leaves

# --- schema checks -------------------------------------------------------------------------

VIOLATION = "array<struct<path:string,message:string>>"


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _violation(when: Column, path: Column, message) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    one = F.array(F.struct(path.alias("path"), text.alias("message")))
    return F.when(when, one).otherwise(_none())


KINDS = {"VOID": "null", "BOOLEAN": "boolean", "BIGINT": "integer", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}


def json_type(value: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)), F.lit("number"))


def _accepts(expected, kind: Column) -> Column:
    names = expected if isinstance(expected, list) else [expected]
    allowed = list(names) + (["integer"] if "number" in names else [])
    return kind.isin(allowed)


def _equals(value: Column, kind: Column, literal) -> Column:
    if literal is None:
        return kind == "null"
    if isinstance(literal, bool):
        return (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == literal)
    if isinstance(literal, (int, float)):
        return kind.isin("integer", "number") & (F.try_variant_get(value, "$", "double") == float(literal))
    return (kind == "string") & (F.try_variant_get(value, "$", "string") == literal)


def compile_schema(schema: dict, path: Column, value: Column) -> Column:
    """Checks of a JSON-Schema subset as one column of violations.

    Supports ``anyOf, const, type, enum, minItems, minLength, maxLength,
    pattern, minimum, maximum, properties, additionalProperties: false,
    required, items``.
    """
    # The node is bound once; every rule then reads its type and value from it.
    node = F.struct(value.alias("v"), json_type(value).alias("kind"))
    return F.flatten(F.transform(F.array(node), lambda n: _rules(schema, path, n["v"], n["kind"])))


def _rules(schema: dict, path: Column, value: Column, kind: Column) -> Column:
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number = kind == "string", kind.isin("integer", "number")
    found: list[Column] = []
    if "anyOf" in schema:
        fits = F.lit(False)
        for branch in schema["anyOf"]:
            fits = fits | (F.size(compile_schema(branch, path, value)) == 0)
        found.append(_violation(~fits, path, "expected value to match at least one anyOf schema"))
    if "const" in schema:
        found.append(_violation(~_equals(value, kind, schema["const"]), path, f"expected const {schema['const']}"))
    if "type" in schema:
        label = schema["type"] if isinstance(schema["type"], str) else "|".join(schema["type"])
        found.append(_violation(~_accepts(schema["type"], kind), path, F.concat(F.lit(f"expected type {label}, got "), kind)))
    if "enum" in schema:
        hit = F.lit(False)
        for allowed in schema["enum"]:
            hit = hit | _equals(value, kind, allowed)
        found.append(_violation(~hit, path, "expected one of the listed values"))
    if "minItems" in schema:
        size = F.size(F.try_variant_get(value, "$", "array<variant>"))
        found.append(_violation((kind == "array") & (size < schema["minItems"]), path, f"expected at least {schema['minItems']} item(s)"))
    if "minLength" in schema:
        found.append(_violation(is_text & (F.length(text) < schema["minLength"]), path, f"expected string length at least {schema['minLength']}"))
    if "maxLength" in schema:
        found.append(_violation(is_text & (F.length(text) > schema["maxLength"]), path, f"expected string length at most {schema['maxLength']}"))
    if "pattern" in schema:
        found.append(_violation(is_text & ~text.rlike(schema["pattern"]), path, f"expected string matching pattern {schema['pattern']}"))
    if "minimum" in schema:
        found.append(_violation(is_number & (number < schema["minimum"]), path, f"expected number >= {schema['minimum']}"))
    if "maximum" in schema:
        found.append(_violation(is_number & (number > schema["maximum"]), path, f"expected number <= {schema['maximum']}"))
    if {"properties", "required", "additionalProperties"} & set(schema):
        found.append(F.when(kind == "object", _members(schema, path, value)).otherwise(_none()))
    if "items" in schema:
        each = F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda item, i: compile_schema(schema["items"], F.concat(path, F.lit("/"), i.cast("string")), item))
        found.append(F.when(kind == "array", F.flatten(each)).otherwise(_none()))
    return F.concat(*found) if found else _none()


def _members(schema: dict, path: Column, value: Column) -> Column:
    members = F.try_variant_get(value, "$", "map<string,variant>")
    names = F.map_keys(members)
    properties = schema.get("properties", {})
    found = [_none()]
    for name, inner in properties.items():
        child = F.try_element_at(members, F.lit(name))
        checked = compile_schema(inner, F.concat(path, F.lit(f"/{name}")), child)
        found.append(F.when(F.array_contains(names, name), checked).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(names, F.array(*[F.lit(n) for n in properties]).cast("array<string>"))
        found.append(F.transform(extra, lambda n: F.struct(
            F.concat(path, F.lit("/"), n).alias("path"), F.concat(F.lit("additional property is not allowed: "), n).alias("message"))))
    for name in schema.get("required", []):
        found.append(_violation(~F.array_contains(names, name), F.concat(path, F.lit(f"/{name}")), f"missing required field: {name}"))
    return F.concat(*found)


def validate_json(df: DataFrame, keys: list[str], column: str, schema: dict) -> DataFrame:
    """One row per violation with the instance path; text that is no JSON is one violation."""
    parsed = df.select(*keys, F.try_parse_json(column).alias("v"))
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("not valid JSON").alias("message")))
    checks = F.when(F.col("v").isNull(), broken).otherwise(compile_schema(schema, F.lit(""), F.col("v")))
    return parsed.select(*keys, F.inline(checks))


def _branch_score(branch: dict, members: Column) -> dict[str, Column]:
    properties, required = branch.get("properties", {}), branch.get("required", [])
    names = F.map_keys(members)
    has = lambda n: F.array_contains(names, n)
    score = F.lit(0)
    op = properties.get("op", {}).get("const")
    if op is not None:
        given = F.try_variant_get(F.try_element_at(members, F.lit("op")), "$", "string")
        score = score + F.when(given == op, 100).otherwise(-10)
    for name in required:
        score = score + F.when(has(name), 4).otherwise(-6)
    wrong = []
    for name, inner in properties.items():
        child = F.try_element_at(members, F.lit(name))
        ok = _accepts_value(inner, child)
        score = score + F.when(has(name), F.when(ok, 5 if name == "op" else 2).otherwise(-4)).otherwise(0)
        wrong.append(F.when((has(name) & ~ok) | (~has(name) & F.lit(name in required)), F.lit(name)))
    extra = F.array().cast("array<string>")
    if branch.get("additionalProperties") is False:
        extra = F.array_except(names, F.array(*[F.lit(n) for n in properties]).cast("array<string>"))
        score = score - F.size(extra) * 3
    missing = F.array_compact(F.array(*[F.when(~has(n), F.lit(n)) for n in required]).cast("array<string>"))
    return {"score": score, "missing": F.array_join(missing, ","), "unexpected": F.array_join(F.array_sort(extra), ","),
            "expected_types": F.array_join(F.array_compact(F.array(*wrong)), ",")}


def _accepts_value(schema: dict, value: Column) -> Column:
    kind = json_type(value)
    if "const" in schema:
        return _equals(value, kind, schema["const"])
    if "enum" in schema:
        hit = F.lit(False)
        for allowed in schema["enum"]:
            hit = hit | _equals(value, kind, allowed)
        return hit
    for word in ("oneOf", "anyOf"):
        if word in schema:
            hit = F.lit(False)
            for branch in schema[word]:
                hit = hit | _accepts_value(branch, value)
            return hit
    return _accepts(schema["type"], kind) if "type" in schema else F.lit(True)


def nearest_branch(df: DataFrame, keys: list[str], column: str, branches: list[dict]) -> DataFrame:
    """The schema branch a rejected object comes closest to; ties go to the first.

    All branches are scored in the same row, so no row is multiplied.
    """
    parsed = df.select(*keys, F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>").alias("m")).filter(F.col("m").isNotNull())
    scored = []
    for index, branch in enumerate(branches):
        parts = _branch_score(branch, F.col("m"))
        op = branch.get("properties", {}).get("op", {}).get("const")
        scored.append(F.struct(
            parts["score"].cast("int").alias("score"), F.lit(-index).alias("order"), F.lit(op).cast("string").alias("op"), parts["missing"].alias("missing"),
            parts["unexpected"].alias("unexpected"), parts["expected_types"].alias("expected_types")))
    best = parsed.select(*keys, F.array_max(F.array(*scored)).alias("b"))
    return best.select(*keys, (-F.col("b.order")).alias("branch"), "b.score", "b.op", "b.missing", "b.unexpected", "b.expected_types")


# --- document trees --------------------------------------------------------------------------

# Keys that carry text and keys that hold children, in reading order.
TEXT_KEYS = ["title", "heading", "subtitle", "text", "caption", "label"]
CHILD_KEYS = ["sections", "slides", "blocks", "items", "bullets", "rows", "cells", "tables"]

BLOCK = "struct<type:string,text:string,title:string,heading:string,items:array<string>,bullets:array<string>,rows:array<array<string>>>"
TREE = (
    f"title string, sections array<struct<heading:string,title:string,blocks:array<{BLOCK}>>>, blocks array<{BLOCK}>, "
    f"slides array<struct<title:string,blocks:array<{BLOCK}>>>, "
    "sheets array<struct<name:string,rows:array<array<string>>,formulas:array<struct<cell:string,formula:string>>>>"
)


def ir_text(ir: DataFrame) -> DataFrame:
    """All text of a document tree in reading order.

    Leaves are found level by level; each path becomes a list of ranks (text
    keys before children, arrays by index) that sorts them.
    """
    leaves = json_leaves(ir, ["doc_id"], "ir").filter(F.col("kind") == "STRING")
    steps = F.regexp_extract_all("location", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    ranks = F.create_map(*[F.lit(v) for i, k in enumerate(TEXT_KEYS) for v in (k, i)], *[F.lit(v) for i, k in enumerate(CHILD_KEYS) for v in (k, 100 + i)])
    numbered = F.transform(steps, lambda s: F.coalesce(F.try_element_at(ranks, s), s.try_cast("int")))
    ordered = leaves.withColumn("steps", steps).withColumn("order", numbered)
    inner = F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0)))
    child_only = F.forall(inner, lambda s: s.isin(CHILD_KEYS) | s.rlike("^[0-9]+$"))
    kept = ordered.filter(child_only & F.forall("order", lambda o: o.isNotNull()))
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", "value"))).alias("t")).select(
        "doc_id", F.array_join(F.transform("t", lambda t: t["value"]), " ").alias("text"))


def _parsed(ir: DataFrame) -> DataFrame:
    return ir.select("doc_id", F.from_json("ir", TREE).alias("t")).select("doc_id", "t.*")


def ir_blocks(ir: DataFrame) -> DataFrame:
    """Blocks of a document: section headings and blocks, then root blocks; text as fallback."""
    empty = F.array().cast(f"array<{BLOCK}>")
    null = F.lit(None)

    def heading(text: Column) -> Column:
        return F.struct(F.lit("heading").alias("type"), text.alias("text"), null.cast("string").alias("title"), null.cast("string").alias("heading"),
                        null.cast("array<string>").alias("items"), null.cast("array<string>").alias("bullets"), null.cast("array<array<string>>").alias("rows"))

    per_section = F.transform("sections", lambda s: F.concat(
        F.when(F.coalesce(s["heading"], s["title"]).isNotNull(), F.array(heading(F.coalesce(s["heading"], s["title"])))).otherwise(empty),
        F.coalesce(s["blocks"], empty)))
    blocks = F.concat(F.coalesce(F.flatten(per_section), empty), F.coalesce("blocks", empty))
    listed = _parsed(ir).select("doc_id", blocks.alias("all"))
    rows = listed.select("doc_id", F.posexplode("all").alias("idx", "b")).select("doc_id", "idx", "b.*")
    bare = listed.filter(F.size("all") == 0).select("doc_id").join(ir_text(ir), "doc_id", "left")
    fallback = bare.select("doc_id", F.lit(0).alias("idx"), F.lit("paragraph").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.unionByName(fallback, allowMissingColumns=True)


def block_items(blocks: DataFrame) -> DataFrame:
    """List items of blocks; a block without a list is its own single item."""
    own = F.array(F.coalesce("text", "title", "heading", F.lit("")))
    return blocks.select("doc_id", "idx", "type", F.posexplode(F.coalesce("items", "bullets", own)).alias("item", "text"))


def block_rows(blocks: DataFrame) -> DataFrame:
    """Table cells of blocks."""
    lines = blocks.select("doc_id", "idx", F.posexplode("rows").alias("row", "cells"))
    return lines.select("doc_id", "idx", "row", F.posexplode("cells").alias("col", "text"))


def ir_slides(ir: DataFrame) -> DataFrame:
    """Slides: listed ones, else one per section, else one for the whole document."""
    shape = f"array<struct<title:string,blocks:array<{BLOCK}>>>"
    from_sections = F.transform("sections", lambda s: F.struct(
        F.coalesce(s["title"], s["heading"], F.lit("Section")).alias("title"), s["blocks"].alias("blocks")))
    whole = F.array(F.struct(F.coalesce("title", F.lit("Untitled")).alias("title"), F.col("blocks").alias("blocks")))
    chosen = F.when(F.size("slides") > 0, F.col("slides")).when(F.size("sections") > 0, from_sections).otherwise(whole)
    return _parsed(ir).select("doc_id", F.posexplode(chosen.cast(shape)).alias("idx", "s")).select(
        "doc_id", (F.col("idx") + 1).alias("slide"), "s.title", F.greatest(F.size(F.coalesce("s.blocks", F.array().cast(f"array<{BLOCK}>"))), F.lit(0)).alias("blocks"))


def ir_sheets(ir: DataFrame) -> DataFrame:
    """Cells of the sheets of a workbook tree."""
    sheets = _parsed(ir).select("doc_id", F.posexplode("sheets").alias("pos", "s"))
    lines = sheets.select("doc_id", (F.col("pos") + 1).alias("sheet_idx"), "s.name", F.posexplode("s.rows").alias("r", "cells"))
    return lines.select("doc_id", "sheet_idx", "name", (F.col("r") + 1).alias("row"), F.posexplode("cells").alias("c", "value")).select(
        "doc_id", "sheet_idx", "name", "row", (F.col("c") + 1).alias("col"), "value")
