"""Bulk edits: validation, text and cell changes, batches, media, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.cellref import col_to_letters, make_ref, range_bounds, ref_col, ref_row
from folioscope.functions.text import object_id
from folioscope.functions.xml import (
    TEXT_TAGS,
    as_column,
    first_match,
    not_blank,
    substitute,
    xml_escape,
)
from folioscope.operators.integrity import explode_issues, issue, unsafe_formula
from folioscope.sources.packages import MAX_XML_PART_BYTES
from folioscope.sources.relationships import resolve_target

# Operations the supported runtime accepts.
OPERATIONS = [
    "setText", "set", "pptx.setText", "docx.setText", "setTableCell", "pptx.setTableCell", "docx.setTableCell", "xlsx.setCell",
    "xlsx.setRange", "xlsx.setFormula", "xlsx.addSheet", "xlsx.renameSheet", "xlsx.addTable", "xlsx.setNamedRange",
    "xlsx.setDataValidation", "xlsx.addChart", "pdf.annotate", "pdf.textOverlay",
]
TEXT_OPERATIONS = ["setText", "pptx.setText", "docx.setText"]
FORMATS = ["pptx", "docx", "xlsx", "pdf"]


def validate_ops(ops: DataFrame, packages: DataFrame) -> DataFrame:
    """Issues of operations: unknown or missing op, wrong format, missing selector.

    ``ops``: ``op_id, doc_id, op, object_id, contains``.
    """
    op = F.coalesce("op", F.lit(""))
    prefix = F.when(F.contains(op, F.lit(".")), F.split_part(op, F.lit("."), F.lit(1)))
    joined = ops.join(packages.select("doc_id", "format"), "doc_id", "left")
    untargeted = F.col("object_id").isNull() & F.col("contains").isNull()
    return explode_issues(joined, ["op_id", "doc_id"], [
        issue(F.col("format").isNull(), "INPUT_NOT_FOUND", "error"),
        issue(op == "", "SCHEMA_INVALID", "error"),
        issue((op != "") & ~op.isin(OPERATIONS), "FEATURE_NOT_IMPLEMENTED", "error"),
        issue((op == "set") & (F.col("format") != "xlsx"), "FORMAT_UNSUPPORTED", "error"),
        issue(prefix.isin(FORMATS) & (prefix != F.col("format")), "FORMAT_UNSUPPORTED", "error"),
        issue(op.isin(TEXT_OPERATIONS) & untargeted, "SELECTOR_MISSING", "error"),
    ])


def conflicting_arrays(batches: DataFrame) -> DataFrame:
    """Batches that carry two different operation arrays."""
    both = F.col("operations").isNotNull() & F.col("ops").isNotNull() & (F.col("operations") != F.col("ops"))
    return batches.filter(both).select("batch_id", F.lit("SCHEMA_INVALID").alias("code"))


def set_text_outcomes(ops: DataFrame, resolved: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Outcome per text operation: applied, or why it fails.

    ``resolved``: ``selector_id, status, object_id`` and optionally ``confidence``.
    """
    outcome = F.when(F.col("status") == "not_found", "SELECTOR_NOT_FOUND").when(F.col("status") == "ambiguous", "SELECTOR_AMBIGUOUS")
    if min_confidence is not None:
        outcome = outcome.when(F.col("confidence") < min_confidence, "SELECTOR_LOW_CONFIDENCE")
    extra = ["confidence"] if min_confidence is not None else []
    joined = ops.drop("object_id").join(
        resolved.select(F.col("selector_id").alias("op_id"), "status", F.col("object_id"), *extra), "op_id", "left")
    return joined.withColumn("outcome", F.coalesce(outcome, F.lit("applied")))


def apply_set_text(objects: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Objects after the applied operations; the last operation on an object wins."""
    last = outcomes.filter(F.col("outcome") == "applied").groupBy("doc_id", "object_id").agg(
        F.max_by("new_text", "op_idx").alias("new_text"))
    return objects.join(last, ["doc_id", "object_id"], "left").withColumn("edited", F.col("new_text").isNotNull()).withColumn(
        "text", F.coalesce("new_text", "text")).drop("new_text")


def apply_table_cell(cells: DataFrame, ops: DataFrame, one_based: bool = False) -> DataFrame:
    """Cell texts after table operations; the last operation on a cell wins."""
    shift = 1 if one_based else 0
    keyed = ops.select("doc_id", *[(F.col(c) - shift).alias(c) for c in ("table", "row", "col")], "op_idx", "new_text")
    last = keyed.groupBy("doc_id", "table", "row", "col").agg(F.max_by("new_text", "op_idx").alias("new_text"))
    return cells.join(last, ["doc_id", "table", "row", "col"], "left").withColumn(
        "edited", F.col("new_text").isNotNull()).withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def missing_table_cells(cells: DataFrame, ops: DataFrame, one_based: bool = False) -> DataFrame:
    """Table operations whose cell does not exist."""
    shift = 1 if one_based else 0
    keyed = ops.select("op_idx", "doc_id", *[(F.col(c) - shift).alias(c) for c in ("table", "row", "col")])
    return keyed.join(cells, ["doc_id", "table", "row", "col"], "left_anti")


# --- worksheet cells -----------------------------------------------------------------------


def cell_ops(ops: DataFrame) -> DataFrame:
    """Cell operations as one row per written cell.

    ``ops``: ``op_idx, doc_id, op, sheet, cell, value, formula, grid`` where
    ``cell`` may be ``cell://Sheet!A1`` and ``grid`` is an array of rows.
    """
    uri = r"^cell://(?:(.*)!)?([^!]+)$"
    is_uri = F.col("cell").startswith("cell://")
    sheet = F.when(is_uri, F.nullif(F.trim(F.regexp_extract("cell", uri, 1)), F.lit("")))
    start = F.upper(F.when(is_uri, F.trim(F.regexp_extract("cell", uri, 2))).otherwise(F.col("cell")))
    placed = ops.select(
        "op_idx", "doc_id", "op", F.coalesce(sheet, "sheet").alias("sheet"), start.alias("ref"), "value", "formula", "grid")
    single = placed.filter(F.col("op") != "xlsx.setRange").select(
        "op_idx", "doc_id", "sheet", ref_col("ref").alias("col"), ref_row("ref").alias("row"),
        F.when(F.col("op") != "xlsx.setFormula", F.col("value")).alias("value"),
        F.when(F.col("op") == "xlsx.setFormula", F.regexp_replace("formula", "^=", "")).alias("formula"))
    rows = placed.filter(F.col("op") == "xlsx.setRange").select(
        "op_idx", "doc_id", "sheet", ref_col("ref").alias("c0"), ref_row("ref").alias("r0"), F.posexplode("grid").alias("dr", "line"))
    many = rows.select("op_idx", "doc_id", "sheet", "c0", "r0", "dr", F.posexplode("line").alias("dc", "value")).select(
        "op_idx", "doc_id", "sheet", (F.col("c0") + F.col("dc")).alias("col"), (F.col("r0") + F.col("dr")).alias("row"), "value",
        F.lit(None).cast("string").alias("formula"))
    return single.unionByName(many).withColumn("ref", make_ref("col", "row"))


def upsert_cells(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells after the changes; the last change of a cell replaces it.

    Only the changes are aggregated. Old cells pass through an anti-join, so
    an edit of few cells does not reshuffle the workbook when the changes are small.
    """
    keys = ["doc_id", "sheet", "col", "row"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("value", "formula"), "op_idx").alias("cell")).select(*keys, "cell.value", "cell.formula")
    kept = cells.select(*keys, "value", "formula").join(last.select(*keys), keys, "left_anti").withColumn("edited", F.lit(False))
    return kept.unionByName(last.withColumn("edited", F.lit(True))).withColumn("ref", make_ref("col", "row"))


def unsafe_changes(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("formula").isNotNull() & unsafe_formula()).select(
        "op_idx", "doc_id", F.lit("SCHEMA_INVALID").alias("code"))


def shift_formula(formula, at: Column, count: Column) -> Column:
    """Row numbers of references at or below ``at`` moved by ``count``; anchors are kept."""
    pattern = r"(\$?[A-Z]{1,3}\$?[0-9]+)"

    def moved(token: Column) -> Column:
        head, row = F.regexp_extract(token, r"^(\D+)", 1), F.regexp_extract(token, r"(\d+)$", 1).try_cast("bigint")
        return F.when(row >= at, F.concat(head, (row + count).cast("string"))).otherwise(token)

    return substitute(as_column(formula), pattern, moved, 1)


def insert_rows(cells: DataFrame, inserts: DataFrame) -> DataFrame:
    """Existing rows and formula references moved down, new rows added.

    ``inserts`` has one row per sheet: ``doc_id, sheet, at, grid``; see
    ``append_position`` for appending.
    """
    places = inserts.select("doc_id", "sheet", "at", F.size("grid").alias("count"))
    joined = cells.join(places, ["doc_id", "sheet"], "left")
    moves = F.col("at").isNotNull()
    shifted = joined.select(
        "doc_id", "sheet", "col",
        F.when(moves & (F.col("row") >= F.col("at")), F.col("row") + F.col("count")).otherwise(F.col("row")).cast("int").alias("row"),
        "value",
        F.when(moves & F.col("formula").isNotNull(), shift_formula("formula", F.col("at"), F.col("count"))).otherwise(F.col("formula")).alias("formula"))
    rows = inserts.select("doc_id", "sheet", "at", F.posexplode("grid").alias("dr", "line"))
    added = rows.select("doc_id", "sheet", "at", "dr", F.posexplode("line").alias("dc", "value")).select(
        "doc_id", "sheet", (F.col("dc") + 1).alias("col"), (F.col("at") + F.col("dr")).cast("int").alias("row"), "value",
        F.lit(None).cast("string").alias("formula"))
    return shifted.unionByName(added).withColumn("ref", make_ref("col", "row"))


def append_position(cells: DataFrame) -> DataFrame:
    """First free row per sheet."""
    return cells.groupBy("doc_id", "sheet").agg((F.max("row") + 1).alias("at"))


def clean_sheet_name(name) -> Column:
    cleaned = F.substring(F.regexp_replace(as_column(name), r"[:\\/?*\[\]]", "_"), 1, 31)
    return F.when(not_blank(cleaned), cleaned).otherwise("Sheet")


def clean_table_name(name) -> Column:
    cleaned = F.regexp_replace(as_column(name), "[^A-Za-z0-9_]", "")
    return F.when(cleaned == "", "Table").otherwise(cleaned)


def upsert_workbook_objects(meta: DataFrame, ops: DataFrame) -> DataFrame:
    """Sheets, tables, names, validations and charts after keyed changes.

    ``meta``: ``doc_id, kind, name, definition``; ``ops`` adds ``op_idx`` and
    nullable ``new_name`` (renames). Names are cleaned by kind.
    """
    tidy = lambda name: F.when(F.col("kind") == "sheet", clean_sheet_name(name)).when(
        F.col("kind") == "table", clean_table_name(name)).otherwise(as_column(name))
    renames = ops.filter(F.col("new_name").isNotNull()).groupBy("doc_id", "kind", "name").agg(F.max_by("new_name", "op_idx").alias("new_name"))
    renamed = meta.join(renames, ["doc_id", "kind", "name"], "left").select(
        "doc_id", "kind", F.when(F.col("new_name").isNull(), F.col("name")).otherwise(tidy("new_name")).alias("name"), "definition",
        F.lit(-1).cast("bigint").alias("op_idx"))
    written = ops.filter(F.col("new_name").isNull()).select("doc_id", "kind", tidy("name").alias("name"), "definition", F.col("op_idx").cast("bigint").alias("op_idx"))
    return renamed.unionByName(written).groupBy("doc_id", "kind", "name").agg(F.max_by("definition", "op_idx").alias("definition"))


def chart_to_cells(charts: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cell changes behind a chart's data and its grown references.

    ``charts``: ``doc_id, chart, category_ref, value_ref``; ``points``:
    ``doc_id, chart, idx, category, value`` and ``series``. Returns the cell
    changes and the new references.
    """
    parsed = charts.select("doc_id", "chart", "category_ref", range_bounds("category_ref").alias("c"), range_bounds("value_ref").alias("v"),
                           F.regexp_replace(F.split_part("category_ref", F.lit("!"), F.lit(1)), "^'|'$", "").alias("sheet"))
    joined = points.join(parsed, ["doc_id", "chart"])
    number = F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))
    put = lambda d, col, row, value: d.select("doc_id", "sheet", col.alias("col"), row.cast("int").alias("row"), value.cast("string").alias("value"))
    categories = put(joined, F.col("c.c0"), F.col("c.r0") + F.col("idx"), F.col("category"))
    values = put(joined, F.col("v.c0"), F.col("v.r0") + F.col("idx"), number)
    heads = joined.groupBy("doc_id", "chart").agg(F.first("sheet").alias("sheet"), F.first("v").alias("v"), F.max("series").alias("series"))
    header = put(heads, F.col("v.c0"), F.greatest(F.lit(1), F.col("v.r0") - 1), F.col("series"))
    sizes = points.groupBy("doc_id", "chart").agg(F.count(F.lit(1)).alias("n"))
    grown = lambda b: F.concat(F.lit("$"), col_to_letters(f"{b}.c0"), F.lit("$"), F.col(f"{b}.r0").cast("string"), F.lit(":$"),
                               col_to_letters(f"{b}.c1"), F.lit("$"), (F.col(f"{b}.r0") + F.col("n") - 1).cast("string"))
    plain = F.col("sheet").rlike("^[A-Za-z_][A-Za-z0-9_.]*$")
    quoted = F.when(plain, F.col("sheet")).otherwise(F.concat(F.lit("'"), F.replace("sheet", F.lit("'"), F.lit("''")), F.lit("'")))
    refs = parsed.join(sizes, ["doc_id", "chart"]).select(
        "doc_id", "chart", F.concat(quoted, F.lit("!"), grown("c")).alias("category_ref"), F.concat(quoted, F.lit("!"), grown("v")).alias("value_ref"))
    return categories.unionByName(values).unionByName(header), refs


# --- batches ---------------------------------------------------------------------------------


def apply_batch(outcomes: DataFrame, atomic: bool = True, dry_run: bool = False, continue_on_error: bool = False, allow_partial: bool = False) -> DataFrame:
    """Final status per operation of a batch.

    ``outcomes``: ``batch_id, doc_id, op_idx, required, failed``. The first
    required failure of a document skips every later operation, unless
    ``continue_on_error``. Nothing of such a document is written: what had
    succeeded is rolled back, unless the batch is not atomic and ``allow_partial``
    asks for what there is. ``dry_run`` reports what would change.
    """
    stop = outcomes.filter(F.col("failed") & F.col("required")).groupBy("batch_id", "doc_id").agg(F.min("op_idx").alias("stop_at"))
    joined = outcomes.join(stop, ["batch_id", "doc_id"], "left")
    stopped = F.col("stop_at").isNotNull()
    done = "would_change" if dry_run else "applied"
    status = (
        F.when(stopped & (F.col("op_idx") > F.col("stop_at")) & F.lit(not continue_on_error), "skipped-after-error").when(F.col("failed"), "failed")
        .when(stopped & F.lit(atomic or not allow_partial), "rolled_back").otherwise(done)
    )
    return joined.select("batch_id", "doc_id", "op_idx", status.alias("status"))


def skip_replays(ops: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations still to run and those whose ``(doc_id, batch_key)`` was applied before."""
    keys = applied.select("doc_id", "batch_key").distinct()
    return ops.join(keys, ["doc_id", "batch_key"], "left_anti"), ops.join(keys, ["doc_id", "batch_key"], "left_semi")


def apply_format(objects: DataFrame, ops: DataFrame, fields: list[str]) -> DataFrame:
    """Formatting fields after the applied operations.

    ``ops``: ``doc_id, object_id, op_idx`` and nullable new values per field; an
    operation without ``object_id`` and with ``all_titles`` set applies to every
    title. The last non-NULL value of each field wins. Style XML is not written.
    """
    direct = ops.filter(F.col("object_id").isNotNull()).select("doc_id", "object_id", "op_idx", *fields)
    titles = objects.filter(F.col("placeholder").isin("title", "ctrTitle")).select("doc_id", "object_id")
    spread = titles.join(ops.filter(F.col("all_titles")).drop("object_id"), "doc_id").select("doc_id", "object_id", "op_idx", *fields)
    last = direct.unionByName(spread).groupBy("doc_id", "object_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("op_idx"))).alias(f"new_{f}") for f in fields])
    out = objects.join(last, ["doc_id", "object_id"], "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(F.col(f)))
    out = out.withColumn("formatted", changed)
    return out.select(*[F.coalesce(f"new_{f}", f).alias(f) if f in fields else F.col(f) for f in objects.columns], "formatted")


def replace_media(parts: DataFrame, rels: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media contents swapped by path, with new names in parts and relationship targets.

    ``replacements``: ``doc_id, part, new_content, extension``.
    """
    renamed = replacements.select(
        "doc_id", "part", "new_content",
        F.concat(F.regexp_replace("part", r"\.[^/.]+$", ""), F.lit("."), F.col("extension")).alias("new_part"))
    new_parts = parts.join(renamed, ["doc_id", "part"], "left").select(
        "doc_id", F.coalesce("new_part", "part").alias("part"), F.coalesce("new_content", "content").alias("content"),
        F.col("new_content").isNotNull().alias("replaced"))
    name = F.element_at(F.split("new_part", "/"), -1)
    targets = rels.withColumn("_resolved", resolve_target("owner", "target")).join(
        renamed.select("doc_id", F.col("part").alias("_resolved"), "new_part"), ["doc_id", "_resolved"], "left")
    rewritten = F.concat(F.regexp_extract("target", r"^(.*[/\\])?", 0), name)
    new_rels = targets.withColumn("target", F.when(F.col("new_part").isNotNull(), rewritten).otherwise(F.col("target"))).select(*rels.columns)
    return new_parts, new_rels


# Full-width digits and the quote characters of goal texts.
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
QUOTE = "[\"'“”「]"
CLOSE = "[\"'“”」]"


def plan_ops(goals: DataFrame, text: str = "goal") -> DataFrame:
    """Candidate operations read from a goal sentence: title size and literal replacement."""
    goal = F.col(text)
    title = r"(?iu)(?:スライド|slide)\s*([0-9０-９]+)\s*(?:の)?\s*(?:タイトル|title)\s*(?:を|to|=|:)?\s*([0-9０-９]+)\s*(?:pt|ポイント)?"
    quoted = rf"(?i)(?:replace|置換)\s+{QUOTE}(.+?){CLOSE}\s+(?:with|to|を|=>)\s+{QUOTE}(.+?){CLOSE}"
    japanese = "(.+?)を(.+?)に置換"
    ascii_number = lambda c: F.translate(c, WIDE_DIGITS, DIGITS).try_cast("int")
    old = F.coalesce(first_match(goal, quoted, 1), F.trim(first_match(goal, japanese, 1)))
    new = F.coalesce(first_match(goal, quoted, 2), F.trim(first_match(goal, japanese, 2)))
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    row = lambda op, slide, size, bold, a, b: F.struct(
        F.lit(op).alias("op"), slide.alias("slide"), size.alias("font_size"), bold.alias("bold"), a.alias("old"), b.alias("new"))
    format_op = F.when(first_match(goal, title, 1).isNotNull(), row(
        "pptx.formatTitle", ascii_number(first_match(goal, title, 1)), ascii_number(first_match(goal, title, 2)),
        goal.rlike("(?iu)bold|太字|ボールド"), none_s, none_s))
    replace_op = F.when((old != "") & (new != ""), row("replaceText", none_i, none_i, F.lit(None).cast("boolean"), old, new))
    return goals.select(*[c for c in goals.columns if c != text], F.inline(F.array_compact(F.array(format_op, replace_op))))


# --- write-back ------------------------------------------------------------------------------


def write_back(parts: DataFrame, edits: DataFrame, tags: tuple[str, ...] = TEXT_TAGS) -> DataFrame:
    """Part XML rebuilt from its literals and the new texts of edited nodes.

    ``edits``: ``doc_id, part, idx, text`` with the positions ``text_objects``
    assigns, and ``op_idx`` where a node may be edited more than once: the last
    edit counts (without it the greatest text). The edits of one part become a
    map; a part is one row whose size the shred limits bound.
    """
    names = "|".join(tags)
    node = rf"(?s)<(?:{names})(?:\s[^>]*)?>.*?</(?:{names})>"
    order = F.struct("op_idx", "text") if "op_idx" in edits.columns else F.col("text")
    last = edits.groupBy("doc_id", "part", "idx").agg(F.max_by("text", order).alias("text"))
    maps = last.groupBy("doc_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("idx", "text"))).alias("edits"))
    joined = parts.join(maps, ["doc_id", "part"], "left")

    def rebuilt(token: Column, i: Column) -> Column:
        opening, closing = F.regexp_extract(token, r"(?s)^<[^>]*>", 0), F.regexp_extract(token, r"(?s)</[^<>]*>$", 0)
        new = F.try_element_at(F.col("edits"), i)
        return F.when(new.isNotNull(), F.concat(opening, xml_escape(new), closing)).otherwise(token)

    tokens = F.transform(F.regexp_extract_all("xml", F.lit(node), F.lit(0)), rebuilt)
    literals = F.split("xml", node, -1)
    xml = F.array_join(F.zip_with(literals, tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.withColumn("changed", F.col("edits").isNotNull()).withColumn(
        "xml", F.when(F.col("edits").isNotNull(), xml).otherwise(F.col("xml"))).drop("edits")


def cell_xml(ref: str = "ref", value: str = "value", formula: str = "formula") -> Column:
    """Cell element: formula, number or inline string."""
    # A failed cast costs an exception: what has no digit and names no special value is not tried.
    number = F.when(F.col(value).rlike("[0-9]|(?i:inf|nan)"), F.col(value).try_cast("double").isNotNull()).otherwise(False)
    return (
        F.when(F.col(formula).isNotNull(), F.concat(F.lit('<c r="'), ref, F.lit('"><f>'), xml_escape(formula), F.lit("</f></c>")))
        .when(number, F.concat(F.lit('<c r="'), ref, F.lit('"><v>'), value, F.lit("</v></c>")))
        .otherwise(F.concat(F.lit('<c r="'), ref, F.lit('" t="inlineStr"><is><t>'), xml_escape(F.coalesce(value, F.lit(""))), F.lit("</t></is></c>")))
    )


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Row elements of every sheet in column order, one table row per worksheet row."""
    piece = F.struct("col", cell_xml().alias("xml"))
    body = F.array_join(F.sort_array(F.collect_list(piece))["xml"], "")
    return cells.groupBy("doc_id", "sheet", "row").agg(body.alias("body")).withColumn(
        "row_xml", F.concat(F.lit('<row r="'), F.col("row").cast("string"), F.lit('">'), "body", F.lit("</row>"))).drop("body")


def sheet_data(cells: DataFrame, max_bytes: int = MAX_XML_PART_BYTES) -> DataFrame:
    """``sheetData`` elements ready to be packed. A sheet is one part and so one value.

    A sheet above ``max_bytes``, the limit for one part, could not be read again; it is
    returned with ``blocked`` set and stays available through ``sheet_rows``.
    """
    lined = sheet_rows(cells)
    sizes = lined.groupBy("doc_id", "sheet").agg(F.sum(F.octet_length("row_xml")).alias("n"))
    small = lined.join(sizes.filter(F.col("n") <= max_bytes).select("doc_id", "sheet"), ["doc_id", "sheet"], "left_semi")
    lines = F.array_join(F.sort_array(F.collect_list(F.struct("row", "row_xml")))["row_xml"], "")
    built = small.groupBy("doc_id", "sheet").agg(F.concat(F.lit("<sheetData>"), lines, F.lit("</sheetData>")).alias("xml"))
    refused = sizes.filter(F.col("n") > max_bytes).select("doc_id", "sheet", F.lit(None).cast("string").alias("xml"), F.lit("PART_TOO_LARGE").alias("blocked"))
    return built.withColumn("blocked", F.lit(None).cast("string")).unionByName(refused)


def cell_object_id(part, ref) -> Column:
    return object_id(F.lit("xlsx"), F.concat(as_column(part), F.lit(":"), F.upper(as_column(ref))), F.lit(0))
