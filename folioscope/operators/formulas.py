"""Spreadsheet lineage: formula dependencies, flags, related objects; chart and diagram data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.cellref import range_bounds
from folioscope.functions.formula import AFTER_WORD, AFTER_WORD_BREAK, split_formula
from folioscope.functions.xml import first_match, matches, xml_unescape
from folioscope.operators.integrity import explode_issues, issue
from folioscope.plans.intervals import crowded, overlapping
from folioscope.session import cut

# Functions that recalculate on every change.
VOLATILE = ["CELL", "INDIRECT", "INFO", "NOW", "OFFSET", "RAND", "RANDBETWEEN", "TODAY"]

# The grammar of cell references and names; strings and table references are cut out before.
# A reference must not follow an identifier (that would be a function name), nor one and white space.
REFERENCE = (
    rf"(?<![A-Za-z0-9_.{AFTER_WORD}{AFTER_WORD_BREAK}])(?:\[[^\]]+\])?(?:(?:'[^']+'|[A-Za-z_][\w .{AFTER_WORD}]*)!)?"
    r"\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?"
)
NAME = r"[A-Za-z0-9_.]+"
# What a formula refers to by itself.
KINDS = ["tableStructuredRef", "threeD", "range", "cell"]
FEW_FORMULAS = 1000  # so many parsed formulas are sent whole


def _names_by_document(names: DataFrame, tables: DataFrame) -> DataFrame:
    """Defined names of a workbook that are not names of its tables, as one small map; they all sit in bounded parts.

    Names and tables are sent once, by their workbook.
    """
    word = F.lower("name").alias("word")
    both = names.select("doc_id", word, "name").unionByName(tables.select("doc_id", word, F.lit(None).cast("string").alias("name")))
    found = both.filter(F.col("word").isNotNull()).repartition("doc_id").groupBy("doc_id", "word").agg(F.min("name").alias("name"), F.count_if(F.col("name").isNull()).alias("tables"))
    unique = found.filter(F.col("tables") == 0)
    return unique.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "name"))).alias("names"), F.collect_list(F.when(~F.col("word").rlike(f"^{NAME}$"), F.col("word"))).alias("odd_names"))


def _blanks(token: Column) -> Column:
    return F.replace(token, F.lit(AFTER_WORD), F.lit(" "))


def formula_deps(cells: DataFrame, names: DataFrame, tables: DataFrame) -> DataFrame:
    """Dependencies of every formula cell, without repeats inside a cell.

    ``cells``: ``doc_id, sheet_idx, ref, formula``; ``names``: ``doc_id, name``;
    ``tables``: ``doc_id, name``. Equal formulas are read once, and meet the names of their workbooks in
    one join; strings, brackets of any depth and words before blanks are told apart in one pass over the formula.
    """
    met = _met(cells, names, tables)
    token = lambda w: F.struct(F.lit("namedRange").alias("dep_kind"), *[F.lit(None).cast("string").alias(c) for c in ("dep_ref", "dep_sheet", "dep_book")],
                               F.try_element_at("names", w).alias("dep_name"), F.try_element_at("names", w).alias("source_text"))
    tokens = F.when(F.col("names").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.transform(_words_that_name(), token)))
    return met.select("doc_id", "sheet_idx", "ref", F.inline(tokens))


def _formula_rows(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("formula").isNotNull() & (F.col("formula") != "")).select("doc_id", "sheet_idx", "ref", "formula")


def _met(cells: DataFrame, names: DataFrame, tables: DataFrame, send: bool = False) -> DataFrame:
    """Formula cells with the names of their workbook and what their formula says; ``send`` where formulas are known to be few."""
    rows = _formula_rows(cells)
    named = rows.join(_names_by_document(names, tables), "doc_id", "left")
    parsed = _parsed(rows.select("formula").distinct())
    return named.join(F.broadcast(parsed) if send else parsed, "formula")


def _words_that_name() -> Column:
    """Words of a formula that are names of its workbook."""
    plain = F.filter("words", lambda w: F.map_contains_key("names", w))
    # Names with other characters are searched for; word characters must not touch them.
    edge = r"[^A-Za-z0-9_.]"
    odd = F.filter("odd_names", lambda n: F.contains(F.lower("clean"), n) & F.regexp_like(
        F.col("clean"), F.concat(F.lit(rf"(?i)(^|{edge})\Q"), n, F.lit(rf"\E($|{edge})"))))
    return F.when(F.size("odd_names") > 0, F.concat(plain, odd)).otherwise(plain)


def _parsed(formulas: DataFrame) -> DataFrame:
    """What a formula says by itself: its references, the words that may be names, and its text without strings. Equal formulas are read once."""
    tagged = lambda tag: lambda t: F.struct(F.lit(tag).alias("tag"), t.alias("token"))
    split = formulas.select("formula", split_formula("formula").alias("split")).select("formula", "split.*")
    tokens = F.concat(F.transform("tables", tagged("s")), F.transform(F.transform(matches("clean", REFERENCE, 0), _blanks), tagged("r")))
    words = F.array_distinct(F.transform(matches("clean", f"({NAME})", 1), F.lower))
    found = split.select("formula", "clean", words.alias("words"), F.posexplode_outer(F.array_distinct(tokens)).alias("at", "t")).select("formula", "clean", "words", "at", "t.*")
    reference = F.col("tag") == "r"
    cell = F.when(reference, F.regexp_extract("token", r"(\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?)$", 1))
    elsewhere = F.contains("token", F.lit("!")) | F.col("token").startswith("[")
    sheet = F.coalesce(first_match("token", r"'([^']+)'!", 1), first_match("token", r"(?:^|\])([A-Za-z_][\w .]*)!", 1))
    placed = found.withColumns({
        "dep_ref": F.upper(F.replace(cell, F.lit("$"), F.lit(""))),
        "raw_sheet": F.when(reference & elsewhere, sheet), "raw_book": F.when(reference & elsewhere, first_match("token", r"^\[([^\]]+)\]", 1)),
        "dep_name": F.when(F.col("tag") == "s", F.regexp_extract("token", r"^([A-Za-z_][A-Za-z0-9_.]*)", 1))})
    kind = (
        F.when(F.col("tag") == "s", "tableStructuredRef").when(elsewhere, "threeD")
        .when(F.contains("dep_ref", F.lit(":")), "range").otherwise("cell"))
    dep = F.struct(kind.alias("dep_kind"), "dep_ref", xml_unescape("raw_sheet", numeric=False).alias("dep_sheet"),
                   xml_unescape("raw_book", numeric=False).alias("dep_book"), "dep_name", F.col("token").alias("source_text"))
    parsed = placed.groupBy("formula").agg(F.first("clean").alias("clean"), F.first("words").alias("words"), F.collect_list(F.when(F.col("tag").isNotNull(), dep)).alias("tokens"))
    of_kind = lambda kind: F.transform(F.filter("tokens", lambda t: t["dep_kind"] == kind), lambda t: t["source_text"])
    return parsed.withColumn("by_kind", F.array(*map(of_kind, KINDS)))


def with_bounds(deps: DataFrame, ref: str = "dep_ref") -> DataFrame:
    return deps.withColumn("b", range_bounds(ref)).select("*", *[F.col(f"b.{c}").alias(c) for c in ("c0", "r0", "c1", "r1")]).drop("b")


def formula_flags(cells: DataFrame, external_links: bool = False) -> DataFrame:
    """Volatile functions and external / indirect / unsupported flags per formula."""
    formula = F.col("formula")
    used = F.array_compact(F.array(*[F.when(formula.rlike(rf"(?i)\b{name}\s*\("), F.lit(name)) for name in VOLATILE]))
    flagged = cells.filter(formula.isNotNull()).withColumn("volatile", used)
    external = formula.rlike(r"\[[^\]]+\]") | (F.lit(external_links) & F.contains(formula, F.lit("!")))
    unsupported = (formula == "") | formula.rlike(r"(?i)_xlfn\.|GET\.CELL\s*\(")
    flags = F.array_compact(F.array(
        F.when(external, "external"), F.when(F.array_contains("volatile", "INDIRECT"), "indirect"),
        F.when(unsupported, "unsupported"), F.when(F.size("volatile") > 0, "volatile")))
    return flagged.withColumn("unsafe_flags", F.array_join(flags, ",")).withColumn("volatile", F.array_join("volatile", ","))


# Fixed value: columns of a sheet.
MOST_COLUMNS = 16384


def related_objects(deps: DataFrame, objects: DataFrame, size: float = 8.0) -> DataFrame:
    """Tables, charts and pivots a formula touches, and slicers of touched tables.

    ``deps`` carry bounds (``with_bounds``); ``objects``: ``doc_id, kind, name,
    path, sheet_idx, sheet_name, table_name, c0, r0, c1, r1``. Overlaps join on
    the document, in crowded ones on column bands; structured references on ``(doc, table name)``.
    """
    keys = ["doc_id", "sheet_idx", "ref"]
    tables = objects.filter(F.col("kind") == "table")
    named = deps.filter(F.col("dep_kind") == "tableStructuredRef").select(*keys, F.lower("dep_name").alias("key")).join(
        tables.select("doc_id", F.lower("name").alias("key"), "kind", "name", "path"), ["doc_id", "key"]).select(
        *keys, "kind", "name", "path", F.lit("structured-ref").alias("reason"))
    left = deps.filter(F.col("c0").isNotNull()).select(*keys, "dep_sheet", "c0", "r0", "c1", "r1")
    right = objects.filter(F.col("c0").isNotNull() & (F.col("kind") != "slicer")).select(
        "doc_id", "kind", "name", "path", F.col("sheet_idx").alias("o_sheet"), "sheet_name",
        *[F.col(c).alias(f"o_{c}") for c in ("c0", "r0", "c1", "r1")])
    c = F.col
    rows_too = (c("r0") <= c("o_r1")) & (c("r1") >= c("o_r0"))
    same_place = (
        F.when(c("kind") == "table", c("dep_sheet").isNotNull() | (c("sheet_idx") == c("o_sheet")))
        .otherwise(c("dep_sheet").isNull() | c("sheet_name").isNull() | (F.lower("dep_sheet") == F.lower("sheet_name"))))
    ranged = overlapping(left, right, ["doc_id"], ("c0", "c1"), ("o_c0", "o_c1"), size, MOST_COLUMNS).filter(rows_too & F.coalesce(same_place, F.lit(True))).select(
        *keys, "kind", "name", "path", F.when(c("kind") == "pivotTable", "source-overlap").otherwise("range-overlap").alias("reason"))
    # A table named by a structured reference is not listed again as an overlap.
    ranged = ranged.join(named.select(*keys, "path"), [*keys, "path"], "left_anti").select(*named.columns)
    direct = cut(named.unionByName(ranged).distinct())  # read twice below; formulas are parsed once for it
    slicers = objects.filter(c("kind") == "slicer").select("doc_id", F.lower("table_name").alias("key"), "kind", "name", "path")
    touched = direct.filter(c("kind") == "table").select(*keys, F.lower("name").alias("key")).distinct()
    linked = touched.join(slicers, ["doc_id", "key"]).select(*keys, "kind", "name", "path", F.lit("table-slicer").alias("reason"))
    return direct.unionByName(linked).distinct()


def formula_graph(deps: DataFrame) -> DataFrame:
    """Distinct dependencies and formula cells per sheet and kind."""
    parts = ["dep_ref", "dep_sheet", "dep_book", "dep_name", "source_text"]
    ident = F.struct(F.lit(False).alias("is_cell"), *[F.coalesce(c, F.lit("")).alias(c) for c in parts])
    cell = F.struct(F.lit(True).alias("is_cell"), F.col("ref").alias("dep_ref"), *[F.lit("").alias(c) for c in parts[1:]])
    # Counted in two plain steps, which need no exchange where rows lie by document.
    keys = ["doc_id", "sheet_idx", "dep_kind"]
    each = deps.select(*keys, F.inline(F.array(ident, cell))).select(*keys, "is_cell", *parts).distinct()
    return each.groupBy(*keys).agg(F.count_if(~F.col("is_cell")).alias("dependencies"), F.count_if(F.col("is_cell") & F.col("dep_ref").isNotNull()).alias("formula_cells"))


def sheet_graph(cells: DataFrame, names: DataFrame, tables: DataFrame) -> DataFrame:
    """``formula_graph`` of the dependencies of ``cells``, which may hold repeats.

    The tokens of a formula, which tell its dependencies of a kind apart, are put by kind once for equal formulas. A sheet gathers
    those of its cells; only dependencies of crowded sheets become rows of their own.
    """
    keys = ["doc_id", "sheet_idx"]
    many = crowded(_formula_rows(cells), keys)
    if many.isEmpty():
        return _gathered_graph(cells, names, tables)
    few, rest = (cells.join(many, keys, how) for how in ("left_anti", "left_semi"))
    return _gathered_graph(few, names, tables).unionByName(formula_graph(formula_deps(rest, names, tables)))


def _gathered_graph(cells: DataFrame, names: DataFrame, tables: DataFrame) -> DataFrame:
    named = F.when(F.col("names").isNotNull(), _words_that_name()).otherwise(F.array().cast("array<string>"))
    # Asked before the plan is made: left to run time, cells may be sent by formula before these are counted.
    few = _formula_rows(cells).select("formula").distinct().limit(FEW_FORMULAS + 1).count() <= FEW_FORMULAS
    met = _met(cells, names, tables, few).select("doc_id", "sheet_idx", "ref", F.concat("by_kind", F.array(named)).alias("by_kind"))
    sheets = met.groupBy("doc_id", "sheet_idx").agg(F.collect_list(F.struct("ref", "by_kind")).alias("cells"))
    of = lambda kind: F.struct(
        F.lit(([*KINDS, "namedRange"])[kind]).alias("dep_kind"),
        F.size(F.array_distinct(F.flatten(F.transform("cells", lambda c: c["by_kind"][kind])))).cast("long").alias("dependencies"),
        F.size(F.array_distinct(F.filter(F.transform("cells", lambda c: F.when(F.size(c["by_kind"][kind]) > 0, c["ref"])), F.isnotnull))).cast("long").alias("formula_cells"))
    counts = F.filter(F.array(*map(of, range(len(KINDS) + 1))), lambda k: k["dependencies"] > 0)
    return sheets.select("doc_id", "sheet_idx", F.inline(counts))


# --- chart and diagram specifications ---------------------------------------------------------


def _json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def chart_points(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of chart specifications in any accepted shape, and issues.

    Shapes: ``labels`` / ``values``, rows of objects, rows of pairs, or the
    first nested under ``data``. Only bar, column and line charts are accepted.
    """
    head = specs.select("doc_id", _json(F.col("spec"), "labels array<string>, values array<double>, chartType string, type string, data string").alias("s"))
    flat = head.select("doc_id", "s.labels", "s.values", F.lower(F.coalesce("s.chartType", "s.type", F.lit("bar"))).alias("raw_kind"), "s.data")
    parsed = flat.select(
        "doc_id", "labels", "values", "raw_kind",
        _json(F.col("data"), "array<struct<label:string,value:double>>").alias("objects"),
        _json(F.col("data"), "array<array<string>>").alias("pairs"),
        _json(F.col("data"), "labels array<string>, values array<double>").alias("inner"))
    objects = F.filter("objects", lambda o: o["label"].isNotNull())
    pairs = F.filter("pairs", lambda p: F.size(p) == 2)
    pick = lambda top, of_objects, of_pairs, nested: (
        F.when(F.col("labels").isNotNull() & F.col("values").isNotNull(), top)
        .when(F.size(objects) > 0, of_objects).when(F.size(pairs) > 0, of_pairs).otherwise(nested))
    shaped = parsed.select(
        "doc_id", "raw_kind",
        pick(F.col("labels"), F.transform(objects, lambda o: o["label"]), F.transform(pairs, lambda p: p[0]), F.col("inner.labels")).alias("names"),
        pick(F.col("values"), F.transform(objects, lambda o: o["value"]), F.transform(pairs, lambda p: p[1].try_cast("double")), F.col("inner.values")).alias("numbers"))
    kind = F.when(F.col("raw_kind").isin("bar", "column"), "bar").when(F.col("raw_kind") == "line", "line")
    bad_number = F.exists("numbers", lambda v: v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")))
    unusable = F.col("names").isNull() | F.col("numbers").isNull() | (F.size("names") == 0)
    uneven = ~unusable & (F.size("names") != F.size("numbers"))
    issues = explode_issues(shaped, ["doc_id"], [
        issue(kind.isNull(), "CHART_TYPE_UNSUPPORTED", "error"), issue(unusable, "CHART_DATA_MISSING", "error"),
        issue(uneven, "CHART_LENGTH_MISMATCH", "error"), issue(~unusable & bad_number, "CHART_VALUE_NOT_FINITE", "error")])
    fine = shaped.filter(kind.isNotNull() & ~unusable & ~uneven & ~bad_number)
    points = fine.select("doc_id", kind.alias("kind"), F.posexplode(F.arrays_zip("names", "numbers")).alias("idx", "p")).select(
        "doc_id", "kind", "idx", F.col("p.names").alias("label"), F.col("p.numbers").alias("value"))
    return points, issues


# Words of the diagram language that are not nodes.
DIAGRAM_WORDS = ["graph", "flowchart", "TD", "TB", "BT", "LR", "RL"]
DIAGRAM_NODE = r"([A-Za-z0-9_]+)(?:\[([^\]]+)\])?"
DIAGRAM_EDGE = r"([A-Za-z0-9_]+)(?:\[[^\]]+\])?\s*[-=.]*>\s*([A-Za-z0-9_]+)(?:\[[^\]]+\])?"
DIAGRAM_JSON = "nodes array<string>, edges array<struct<`from`:string,`to`:string>>"


def diagram_nodes(specs: DataFrame, text: str = "spec") -> DataFrame:
    """Nodes of diagram texts: first mention decides position and label."""
    spec = F.col(text)
    is_json = F.try_parse_json(spec).isNotNull() & F.trim(spec).rlike(r"^\{")
    words = specs.filter(~is_json).select("doc_id", F.posexplode(matches(spec, DIAGRAM_NODE, 0)).alias("pos", "token")).select(
        "doc_id", "pos", F.regexp_extract("token", DIAGRAM_NODE, 1).alias("node_id"), F.nullif(F.regexp_extract("token", DIAGRAM_NODE, 2), F.lit("")).alias("label"))
    listed = specs.filter(is_json).select("doc_id", F.posexplode(_json(spec, DIAGRAM_JSON)["nodes"]).alias("pos", "raw")).select(
        "doc_id", "pos", F.when(F.col("raw").startswith("{"), F.get_json_object("raw", "$.id")).otherwise(F.col("raw")).alias("node_id"),
        F.when(F.col("raw").startswith("{"), F.get_json_object("raw", "$.label")).alias("label"))
    rows = words.filter(~F.col("node_id").isin(DIAGRAM_WORDS)).unionByName(listed.filter(F.col("node_id").isNotNull()))
    first = rows.groupBy("doc_id", "node_id").agg(F.min(F.struct("pos", "label")).alias("f"))
    return first.select("doc_id", "node_id", F.col("f.pos").alias("pos"), F.coalesce("f.label", "node_id").alias("label"))


def diagram_edges(specs: DataFrame, text: str = "spec") -> DataFrame:
    spec = F.col(text)
    is_json = F.try_parse_json(spec).isNotNull() & F.trim(spec).rlike(r"^\{")
    arrows = specs.filter(~is_json).select("doc_id", F.posexplode(matches(spec, DIAGRAM_EDGE, 0)).alias("pos", "token")).select(
        "doc_id", "pos", F.regexp_extract("token", DIAGRAM_EDGE, 1).alias("from_id"), F.regexp_extract("token", DIAGRAM_EDGE, 2).alias("to_id"))
    listed = specs.filter(is_json).select("doc_id", F.posexplode(_json(spec, DIAGRAM_JSON)["edges"]).alias("pos", "e")).select(
        "doc_id", "pos", F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"))
    return arrows.unionByName(listed.filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull()))

