"""Catalogue: spreadsheet lineage, JSON documents, run logs and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.operators import documents, formulas, runs
from folioscope.session import shared_folder
from folioscope.sources import corpus, sheets
from folioscope.streaming import traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# --- X: spreadsheet lineage -----------------------------------------------------------


@query("shared_formulas", r"""
WITH c AS (SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS pos, l_partkey % 3 AS si,
                  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_orderkey * 10 + l_linenumber END AS d FROM lineitem)
SELECT doc_id, pos, CAST(si AS VARCHAR) AS shared_idx, 'A' || max(d) OVER (PARTITION BY doc_id, si ORDER BY pos RANGE UNBOUNDED PRECEDING) AS formula FROM c""")
def _(spark, sf):
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    defines = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    cells = corpus.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), pos.alias("pos"), (F.col("l_partkey") % 3).cast("string").alias("shared_idx"),
        F.when(defines, F.concat(F.lit("A"), pos.cast("string"))).alias("formula"))
    return sheets.resolve_shared(cells, ("doc_id",))


def _formula_cells(spark, sf, repeats=False):
    """One formula per order, line number and row; equal cells are dropped on their narrow keys, unless they may repeat."""
    row = (F.col("l_suppkey") % 50 + 1).cast("string")
    places = corpus.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sheet_idx"), row.alias("r"))
    places = places if repeats else places.distinct()
    r = F.col("r")
    formula = F.concat(
        F.lit("SUM(A"), r, F.lit(":$B"), r, F.lit(")+'Line 2'!C"), r,
        F.lit('*TaxRate+[Book9]Sheet1!D4&"A9"&Sales[Qty]+LOG10(E'), r, F.lit(")+Table1[[#All],[Net]]"))
    return places.select("doc_id", "sheet_idx", F.concat(F.lit("Z"), r).alias("ref"), formula.alias("formula"))


def _names(spark, sf):
    orders = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    each = lambda *values: orders.select("doc_id", F.explode(F.array(*[F.lit(v) for v in values])).alias("name"))
    return each("TaxRate", "sales", "Unused"), each("Sales", "Table1")


DEPS = r"""
c AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS sheet_idx, l_suppkey % 50 + 1 AS r FROM lineitem),
deps AS (SELECT doc_id, sheet_idx, 'Z' || r AS ref, u.k AS dep_kind, u.f AS dep_ref, u.s AS dep_sheet, u.b AS dep_book, u.n AS dep_name, u.t AS source_text FROM (
  SELECT *, unnest([
    {'k': 'tableStructuredRef', 'f': NULL, 's': NULL, 'b': NULL, 'n': 'Sales', 't': 'Sales[Qty]'},
    {'k': 'tableStructuredRef', 'f': NULL, 's': NULL, 'b': NULL, 'n': 'Table1', 't': 'Table1[[#All],[Net]]'},
    {'k': 'range', 'f': 'A' || r || ':B' || r, 's': NULL, 'b': NULL, 'n': NULL, 't': 'A' || r || ':$B' || r},
    {'k': 'threeD', 'f': 'C' || r, 's': 'Line 2', 'b': NULL, 'n': NULL, 't': '''Line 2''!C' || r},
    {'k': 'threeD', 'f': 'D4', 's': 'Sheet1', 'b': 'Book9', 'n': NULL, 't': '[Book9]Sheet1!D4'},
    {'k': 'cell', 'f': 'LOG10', 's': NULL, 'b': NULL, 'n': NULL, 't': 'LOG10'},
    {'k': 'cell', 'f': 'E' || r, 's': NULL, 'b': NULL, 'n': NULL, 't': 'E' || r}]) AS u FROM c)
  UNION ALL SELECT doc_id, sheet_idx, 'Z' || r, 'namedRange', NULL, NULL, NULL, 'TaxRate', 'TaxRate' FROM c WHERE doc_id IN (SELECT o_orderkey FROM orders))"""


def _deps(spark, sf):
    return formulas.formula_deps(_formula_cells(spark, sf), *_names(spark, sf))


@query("formula_dependencies", "WITH " + DEPS + " SELECT * FROM deps")
def _(spark, sf):
    return _deps(spark, sf)


@query("formula_brackets", r"""
WITH c AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS sheet_idx, l_suppkey % 50 + 1 AS r FROM lineitem)
SELECT doc_id, sheet_idx, 'Z' || r AS ref, u.k AS dep_kind, u.f AS dep_ref, u.s AS dep_sheet, u.n AS dep_name, u.t AS source_text FROM (
  SELECT *, unnest([
    {'k': 'tableStructuredRef', 'f': NULL, 's': NULL, 'n': 'Sales', 't': 'Sales[[#Data],[a[b[c' || r || ']]]]'},
    {'k': 'cell', 'f': 'B' || r, 's': NULL, 'n': NULL, 't': 'B' || r},
    {'k': 'threeD', 'f': 'C' || r, 's': 'My Own Sheet', 'n': NULL, 't': 'My Own Sheet!C' || r}]) AS u FROM c)""")
def _(spark, sf):
    """Brackets three levels deep, a name of over 18 characters before a blank, a string with brackets."""
    r = F.col("r")
    cells = _formula_cells(spark, sf).withColumn("r", F.substring("ref", 2, 9)).withColumn("formula", F.concat(
        F.lit("Sales[[#Data],[a[b[c"), r, F.lit("]]]]+AVeryLongFunctionNameIndeed A"), r, F.lit('+"Sales[x"&B'), r, F.lit("*(My Own Sheet!C"), r, F.lit(")")))
    return formulas.formula_deps(cells.drop("r"), *_names(spark, sf)).drop("dep_book")


@query("formula_graph", "WITH " + DEPS + r"""
SELECT doc_id, sheet_idx, dep_kind, count(DISTINCT (coalesce(dep_ref, ''), coalesce(dep_sheet, ''), coalesce(dep_book, ''), coalesce(dep_name, ''), source_text)) AS dependencies,
       count(DISTINCT ref) AS formula_cells FROM deps GROUP BY 1, 2, 3""")
def _(spark, sf):
    return formulas.sheet_graph(_formula_cells(spark, sf, repeats=True), *_names(spark, sf))


FORMULAS = ["NOW()+A1", 'INDIRECT("A1")', "[Book1]S!A1", "_xlfn.X(A1)", "SUM(A1)", "RandBetween(1,2)+OFFSET(A1,1,1)"]


@query("formula_flags", r"""
SELECT l_orderkey AS doc_id, l_linenumber AS sheet_idx, l_partkey % 6 AS k, ['NOW', 'INDIRECT', '', '', '', 'OFFSET,RANDBETWEEN'][CAST(l_partkey % 6 AS INT) + 1] AS volatile,
       ['volatile', 'indirect,volatile', 'external', 'unsupported', '', 'volatile'][CAST(l_partkey % 6 AS INT) + 1] AS unsafe_flags FROM lineitem""")
def _(spark, sf):
    texts = F.array(*[F.lit(f) for f in FORMULAS])
    cells = corpus.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sheet_idx"), (F.col("l_partkey") % 6).alias("k"),
        F.element_at(texts, (F.col("l_partkey") % 6 + 1).cast("int")).alias("formula"))
    return formulas.formula_flags(cells).drop("formula")


@query("related_objects", r"""
WITH d AS (SELECT l_orderkey AS doc_id, l_linenumber AS sheet_idx, 'Z' || l_suppkey AS ref, CASE WHEN l_returnflag = 'R' THEN 'Line 1' END AS dep_sheet,
                  CAST(l_quantity AS INT) AS c0, CAST(l_quantity AS INT) + 3 AS c1, CAST(l_partkey % 40 AS INT) + 1 AS r0, CAST(l_partkey % 40 AS INT) + 6 AS r1, l_linestatus = 'F' AND l_returnflag = 'A' AS named FROM lineitem),
o AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 30 AS INT) + 1 AS a FROM orders),
t AS (SELECT d.doc_id, d.sheet_idx, ref, CASE WHEN named THEN 'structured-ref' ELSE 'range-overlap' END AS reason FROM d JOIN o USING (doc_id)
      WHERE named OR ((dep_sheet IS NOT NULL OR sheet_idx = 1) AND c0 <= a + 10 AND c1 >= a AND r0 <= 25 AND r1 >= 1))
SELECT DISTINCT doc_id, sheet_idx, ref, 'table' AS kind, 'Sales' AS name, 'xl/tables/table1.xml' AS path, reason FROM t t1
WHERE reason = 'structured-ref' OR NOT EXISTS (SELECT 1 FROM t t2 WHERE t2.doc_id = t1.doc_id AND t2.sheet_idx = t1.sheet_idx AND t2.ref = t1.ref AND t2.reason = 'structured-ref')
UNION ALL SELECT DISTINCT doc_id, sheet_idx, ref, 'slicer', 'Slice', 'xl/slicers/slicer1.xml', 'table-slicer' FROM t
UNION ALL SELECT DISTINCT d.doc_id, sheet_idx, ref, 'pivotTable', 'Pivot', 'xl/pivotTables/pivot1.xml', 'source-overlap' FROM d JOIN o USING (doc_id)
WHERE NOT named AND (dep_sheet IS NULL OR dep_sheet = 'Line 1') AND c0 <= 12 AND c1 >= 5 AND r0 <= 30 AND r1 >= a""")
def _(spark, sf):
    li = corpus.table(spark, sf, "lineitem")
    named = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    q, p = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 40).cast("int")
    where = lambda value: F.when(~named, value)
    deps = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sheet_idx"), F.concat(F.lit("Z"), F.col("l_suppkey").cast("string")).alias("ref"),
        F.when(named, "tableStructuredRef").otherwise("range").alias("dep_kind"), F.when(named, F.lit("SALES")).alias("dep_name"),
        F.when(F.col("l_returnflag") == "R", "Line 1").alias("dep_sheet"),
        where(q).alias("c0"), where(p + 1).alias("r0"), where(q + 3).alias("c1"), where(p + 6).alias("r1"))
    a = (F.col("o_custkey") % 30).cast("int") + 1
    obj = lambda kind, name, path, sheet, sheet_name, table, c0, r0, c1, r1: F.struct(
        F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(sheet).cast("int").alias("sheet_idx"),
        F.lit(sheet_name).cast("string").alias("sheet_name"), F.lit(table).cast("string").alias("table_name"),
        c0.cast("int").alias("c0"), r0.cast("int").alias("r0"), c1.cast("int").alias("c1"), r1.cast("int").alias("r1"))
    null = F.lit(None)
    objects = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(
        obj("table", "Sales", "xl/tables/table1.xml", 1, None, None, a, F.lit(1), a + 10, F.lit(25)),
        obj("pivotTable", "Pivot", "xl/pivotTables/pivot1.xml", None, "line 1", None, F.lit(5), a, F.lit(12), F.lit(30)),
        obj("slicer", "Slice", "xl/slicers/slicer1.xml", None, None, "sales", null, null, null, null))))
    return formulas.related_objects(deps, objects)


def _chart_specs(spark, sf):
    value, label = F.col("value"), F.col("event_type")
    kind = F.col("event_id") % 5
    point = F.array(F.struct(label.alias("label"), value.alias("value")))
    spec = (
        F.when(kind == 0, F.to_json(F.struct(F.array(label, F.lit("b")).alias("labels"),
                                             F.when(F.col("event_id") % 10 == 0, F.array(value)).otherwise(F.array(value, F.lit(2.5))).alias("values"))))
        .when(kind == 1, F.to_json(F.struct(point.alias("data"))))
        .when(kind == 2, F.concat(F.lit('{"chartType":"column","data":[["'), label, F.lit('",'), value.cast("string"), F.lit("]]}")))
        .when(kind == 3, F.to_json(F.struct(F.lit("Line").alias("type"), F.struct(F.array(label).alias("labels"), F.array(value).alias("values")).alias("data"))))
        .otherwise(F.to_json(F.struct(F.lit("pie").alias("type"), point.alias("data")))))
    return corpus.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), spec.alias("spec"))


@query("chart_points", r"""
SELECT event_id AS doc_id, CASE WHEN event_id % 5 = 3 THEN 'line' ELSE 'bar' END AS kind, 0 AS idx, event_type AS label, value FROM events WHERE event_id % 5 <> 4 AND event_id % 10 <> 0
UNION ALL SELECT event_id, 'bar', 1, 'b', 2.5 FROM events WHERE event_id % 5 = 0 AND event_id % 10 <> 0""")
def _(spark, sf):
    return formulas.chart_points(_chart_specs(spark, sf))[0]


@query("chart_issues", r"""
SELECT event_id AS doc_id, CASE WHEN event_id % 5 = 4 THEN 'CHART_TYPE_UNSUPPORTED' ELSE 'CHART_LENGTH_MISMATCH' END AS code, 'error' AS severity
FROM events WHERE event_id % 5 = 4 OR event_id % 10 = 0""")
def _(spark, sf):
    return formulas.chart_points(_chart_specs(spark, sf))[1]


def _diagrams(spark, sf):
    turn = F.col("turn").cast("string")
    text = F.concat(F.lit("graph TD\n  T"), turn, F.lit("["), "role", F.lit("] --> U"), turn, F.lit("[next step]\n  U"), turn, F.lit(" -.-> V\n  V ==> T"), turn, F.lit("[again]"))
    node = lambda ident, label: F.struct(ident.alias("id"), label.alias("label"))
    edge = F.array(F.struct(F.lit("a").alias("from"), F.concat(F.lit("b"), turn).alias("to")))
    spec = F.to_json(F.struct(F.array(node(F.lit("a"), F.col("role")), node(F.concat(F.lit("b"), turn), F.lit(None).cast("string"))).alias("nodes"), edge.alias("edges")))
    return corpus.table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc_id"), F.when(F.col("turn") % 2 == 1, spec).otherwise(text).alias("spec"))


@query("diagram_nodes", r"""
SELECT conv_id || '/' || turn AS doc_id, u.n AS node_id, u.l AS label FROM (SELECT conv_id, turn, unnest([
  {'n': 'T' || turn, 'l': role}, {'n': 'U' || turn, 'l': 'next step'}, {'n': 'V', 'l': 'V'}]) AS u FROM conversations WHERE turn % 2 = 0)
UNION ALL SELECT conv_id || '/' || turn, 'a', role FROM conversations WHERE turn % 2 = 1
UNION ALL SELECT conv_id || '/' || turn, 'b' || turn, 'b' || turn FROM conversations WHERE turn % 2 = 1""")
def _(spark, sf):
    return formulas.diagram_nodes(_diagrams(spark, sf)).drop("pos")


@query("diagram_edges", r"""
SELECT conv_id || '/' || turn AS doc_id, u.f AS from_id, u.t AS to_id FROM (SELECT conv_id, turn, unnest([
  {'f': 'T' || turn, 't': 'U' || turn}, {'f': 'U' || turn, 't': 'V'}, {'f': 'V', 't': 'T' || turn}]) AS u FROM conversations WHERE turn % 2 = 0)
UNION ALL SELECT conv_id || '/' || turn, 'a', 'b' || turn FROM conversations WHERE turn % 2 = 1""")
def _(spark, sf):
    return formulas.diagram_edges(_diagrams(spark, sf)).drop("pos")


# --- F3, F4, Q: JSON documents ------------------------------------------------------------


def _trees(spark, sf):
    line = F.col("text")
    block = lambda kind, text, items: F.struct(F.lit(kind).alias("type"), text.alias("text"), items.alias("items"))
    items = F.array(F.lit("x"), F.concat(F.lit("y"), F.col("doc_id").cast("string")))
    full = F.struct(
        F.array(F.struct(F.array(block("paragraph", line, F.lit(None).cast("array<string>")), block("list", F.lit(None).cast("string"), items)).alias("blocks"),
                         F.col("lang").alias("heading"))).alias("sections"),
        F.col("source").alias("title"))
    bare = F.to_json(F.struct(F.col("source").alias("title"), F.lit("ignored").alias("note")))
    return corpus.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 3, bare).otherwise(F.to_json(full)).alias("ir"))


TREE_LINE = "text"


@query("ir_text", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN source ELSE source || ' ' || lang || ' ' || {TREE_LINE} || ' x y' || doc_id END AS text FROM documents""")
def _(spark, sf):
    return documents.ir_text(_trees(spark, sf))


@query("ir_blocks", f"""
SELECT doc_id, 0 AS idx, 'heading' AS type, lang AS text FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 1, 'paragraph', {TREE_LINE} FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 2, 'list', NULL FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 0, 'paragraph', source FROM documents WHERE doc_id % 4 = 3""")
def _(spark, sf):
    return documents.ir_blocks(_trees(spark, sf)).select("doc_id", "idx", "type", "text")


@query("ir_list_items", f"""
SELECT doc_id, 0 AS idx, 0 AS item, lang AS text FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 1, 0, {TREE_LINE} FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 2, 0, 'x' FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 2, 1, 'y' || doc_id FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 0, 0, source FROM documents WHERE doc_id % 4 = 3""")
def _(spark, sf):
    return documents.block_items(documents.ir_blocks(_trees(spark, sf))).select("doc_id", "idx", "item", "text")


@query("ir_slides", """
SELECT doc_id, 1 AS slide, CASE WHEN doc_id % 4 = 3 THEN source ELSE lang END AS title, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 2 END AS blocks FROM documents""")
def _(spark, sf):
    return documents.ir_slides(_trees(spark, sf))


SCHEMA = {
    "type": "object", "required": ["k", "user"], "additionalProperties": False,
    "properties": {
        "k": {"type": "integer", "minimum": 10, "maximum": 90},
        "user": {"type": "string", "pattern": "^u[0-9]+$", "maxLength": 3},
        "tags": {"type": "array", "minItems": 2, "items": {"enum": ["view", "click", "error", "x"]}},
    },
}


def _payloads(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.struct(
        k.alias("k"), F.when(F.col("event_id") % 4 != 0, F.concat(F.when(F.col("event_id") % 7 == 0, "v").otherwise("u"), F.col("user_id").cast("string"))).alias("user"),
        F.when(F.col("event_id") % 11 == 0, F.array(F.col("event_type"))).otherwise(F.array("event_type", F.lit("x"))).alias("tags"),
        F.when(F.col("event_id") % 3 == 0, F.lit(1)).alias("extra"))
    text = F.when(F.col("event_id") % 101 == 0, F.lit("{broken")).otherwise(F.to_json(body))
    return corpus.by_key(corpus.table(spark, sf, "events"), "event_id").select("event_id", text.alias("payload"))


@query("validate_json", r"""
WITH e AS (SELECT *, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INT) AS k, CASE WHEN event_id % 7 = 0 THEN 'v' ELSE 'u' END || user_id AS u FROM events WHERE event_id % 101 <> 0)
SELECT event_id, '/k' AS path, 'expected number >= 10' AS message FROM e WHERE k < 10
UNION ALL SELECT event_id, '/k', 'expected number <= 90' FROM e WHERE k > 90
UNION ALL SELECT event_id, '/user', 'missing required field: user' FROM e WHERE event_id % 4 = 0
UNION ALL SELECT event_id, '/user', 'expected string matching pattern ^u[0-9]+$' FROM e WHERE event_id % 4 <> 0 AND event_id % 7 = 0
UNION ALL SELECT event_id, '/user', 'expected string length at most 3' FROM e WHERE event_id % 4 <> 0 AND length(u) > 3
UNION ALL SELECT event_id, '/tags', 'expected at least 2 item(s)' FROM e WHERE event_id % 11 = 0
UNION ALL SELECT event_id, '/tags/0', 'expected one of the listed values' FROM e WHERE event_type NOT IN ('view', 'click', 'error')
UNION ALL SELECT event_id, '/extra', 'additional property is not allowed: extra' FROM e WHERE event_id % 3 = 0
UNION ALL SELECT event_id, '', 'not valid JSON' FROM events WHERE event_id % 101 = 0""")
def _(spark, sf):
    return documents.validate_json(_payloads(spark, sf), ["event_id"], "payload", SCHEMA)


BRANCHES = [
    {"properties": {"op": {"const": "click"}, "k": {"type": "integer"}, "value": {"type": "number"}}, "required": ["op", "k", "value"], "additionalProperties": False},
    {"properties": {"op": {"const": "view"}, "k": {"type": "string"}, "note": {"type": "string"}}, "required": ["op", "note"], "additionalProperties": False},
]


@query("nearest_branch", r"""
SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS INT) AS branch, CAST(CASE event_type WHEN 'click' THEN 100 + 4 + 4 - 6 + 5 + 2 - 3
         WHEN 'view' THEN 100 + 4 - 6 + 5 - 4 - 3 ELSE -10 + 4 + 4 - 6 - 4 + 2 - 3 END AS INT) AS score,
       CASE WHEN event_type = 'view' THEN 'view' ELSE 'click' END AS op, CASE WHEN event_type = 'view' THEN 'note' ELSE 'value' END AS missing, 'zone' AS unexpected,
       CASE event_type WHEN 'click' THEN 'value' WHEN 'view' THEN 'k,note' ELSE 'op,value' END AS expected_types
FROM events""")
def _(spark, sf):
    body = F.struct(F.col("event_type").alias("op"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.lit("a").alias("zone"))
    rejects = corpus.table(spark, sf, "events").select("event_id", F.to_json(body).alias("payload"))
    return documents.nearest_branch(rejects, ["event_id"], "payload", BRANCHES)


# --- W: run logs ------------------------------------------------------------------------------


def trace(spark, sf, events=None):
    """Events as a run log: user = run, event = step, expensive errors fail."""
    e = events if events is not None else corpus.table(spark, sf, "events")
    # The column has no time zone; counting from the epoch keeps the session's zone out of it.
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    name = F.concat(F.col("event_id").cast("string"), F.lit(".docx"))
    out = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.lit("edit"), F.lit("--out"), F.concat(F.lit("out\\"), name)))).otherwise(F.lit('["inspect"]'))
    artifact = F.array(F.struct(name.alias("path"), F.lit("office").alias("kind"), F.lit("docx").alias("format"), F.col("event_id").alias("bytes")))
    envelope = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(artifact.alias("artifacts"), F.lit("changed").alias("mutationStatus")))).when(
        F.col("event_id") % 5 == 1, F.to_json(F.struct(F.struct(artifact.alias("artifacts"), (F.col("event_id") % 3 == 0).alias("changed")).alias("result"))))
    return e.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("step_idx"), F.concat(F.lit("step-"), F.col("event_id").cast("string")).alias("step_id"),
        F.col("event_type").alias("command"), F.when((F.col("event_type") == "error") & (F.col("value") > 80), "fail").otherwise("pass").alias("status"),
        F.lit(0).alias("exit_code"), ms.alias("started_ms"), (ms + F.col("event_id") % 1000).alias("finished_ms"), out.alias("args"), envelope.alias("envelope"))


TRACE = r"""
tr AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS step_idx, 'step-' || event_id AS step_id, CASE WHEN event_type = 'error' AND value > 80 THEN 'fail' ELSE 'pass' END AS status,
              epoch_us(ts) // 1000 AS started_ms, epoch_us(ts) // 1000 + event_id % 1000 AS finished_ms FROM events),
st AS (SELECT *, min(step_idx) FILTER (status = 'fail') OVER (PARTITION BY run_id) AS stop_at FROM tr)"""


@query("run_summary", "WITH " + TRACE + r"""
SELECT run_id, count(*) AS steps, count(*) FILTER (status = 'pass') AS completed_steps, arg_min(step_id, step_idx) FILTER (status = 'fail') AS failed_step,
       CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS status, max(finished_ms) - min(started_ms) AS duration_ms
FROM st WHERE stop_at IS NULL OR step_idx <= stop_at GROUP BY 1""")
def _(spark, sf):
    return runs.run_summary(trace(spark, sf))


@query("run_summary_stream", SQL["run_summary"])
def _(spark, sf):
    """The events file read as a stream: the same answer as the batch."""
    schema = corpus.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = f"{shared_folder(spark)}/run-summaries-{uuid.uuid4().hex}"
    traces.start_summaries(trace(spark, sf, events), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return traces.latest(spark, f"{folder}/table")


@query("run_changed", r"""
SELECT CAST(user_id AS VARCHAR) AS run_id, bool_or(NOT (event_type = 'error' AND value > 80) AND (event_id % 5 = 0 OR (event_id % 5 = 1 AND event_id % 3 = 0))) AS document_changed FROM events GROUP BY 1""")
def _(spark, sf):
    return runs.run_changed(trace(spark, sf))


@query("build_manifest", r"""
SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(event_id AS INT) AS step_idx, CASE WHEN event_id % 2 = 0 THEN 'out/' ELSE '' END || event_id || '.docx' AS path, 'office' AS kind, 'docx' AS format,
       NULL::VARCHAR AS sha256, event_id AS bytes FROM events WHERE event_id % 5 IN (0, 1)""")
def _(spark, sf):
    return runs.build_manifest(trace(spark, sf))


def _artifacts(spark, sf, which):
    return corpus.snapshot(spark, sf, which).select(
        F.concat(F.when(F.col("doc_id") % 13 == 0, "tmp/").otherwise("out/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))


PATHS = r"""
b AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'tmp/' ELSE 'out/' END || doc_id AS path, doc_id FROM documents WHERE doc_id % 7 <> 0),
a AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'tmp/' ELSE 'out/' END || doc_id AS path, doc_id FROM documents WHERE doc_id % 11 <> 0)"""


@query("verify_manifest", "WITH " + PATHS + r"""
SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'unchecked' WHEN doc_id % 5 = 0 THEN 'digest_mismatch' ELSE 'ok' END AS status FROM b""")
def _(spark, sf):
    ident = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint")
    digest = F.when(ident % 17 == 0, F.lit(None)).when(ident % 2 == 0, F.concat(F.lit("sha256:"), "sha256")).otherwise(F.col("sha256"))
    return runs.verify_manifest(_artifacts(spark, sf, "before").withColumn("sha256", digest), _artifacts(spark, sf, "after"))


@query("artifact_delta", "WITH " + PATHS + r""",
e AS (SELECT path FROM b WHERE doc_id % 2 = 0)
SELECT path, 'ARTIFACT_MISSING' AS code FROM e WHERE path NOT IN (SELECT path FROM a)
UNION ALL SELECT path, 'ARTIFACT_UNEXPECTED' FROM a WHERE path NOT IN (SELECT path FROM b) AND path NOT IN (SELECT path FROM e)
UNION ALL SELECT path, 'SECURITY_PATH_OUTSIDE_ROOT' FROM a WHERE NOT starts_with(path, 'out/')""")
def _(spark, sf):
    before, after = _artifacts(spark, sf, "before"), _artifacts(spark, sf, "after")
    expected = before.filter(F.regexp_extract("path", r"(\d+)$", 1).cast("bigint") % 2 == 0).select("path")
    return runs.artifact_delta(expected, before, after, "out")


CODES = ["INPUT_NOT_FOUND", "SCHEMA_INVALID", "SECURITY_ZIP_UNSAFE", "WORKFLOW_STEP_FAILED", "FORMAT_UNSUPPORTED", "UNKNOWN_OPTION", "INTERNAL_ERROR"]


@query("classify_results", r"""
WITH r AS (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'edit' ELSE 'inspect' END AS command, event_type <> 'error' AS ok, CAST(event_id % 7 AS INT) AS k, event_id % 10 = 0 AS plan,
                  event_id % 10 = 1 AS dry, event_id % 3 = 0 AS changed, event_id % 4 AS n FROM events)
SELECT event_id, CASE WHEN plan THEN 'plan_only' WHEN dry THEN 'planned' WHEN command = 'edit' AND changed THEN 'changed' WHEN command = 'edit' THEN 'noop' ELSE 'not_applicable' END AS mutation_status,
  CASE WHEN n > 0 THEN 'complete' ELSE 'not_expected' END AS artifact_status,
  CASE WHEN NOT ok THEN ['input', 'schema', 'security', 'workflow', 'unsupported', 'usage', 'runtime'][k + 1] END AS error_category,
  CASE WHEN ok THEN 'none' ELSE ['input', 'schema', 'security', 'workflow', 'unsupported', 'usage', 'runtime'][k + 1] END AS failure_class FROM r""")
def _(spark, sf):
    e = F.col("event_id")
    results = corpus.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type").isin("view", "click"), "edit").otherwise("inspect").alias("command"), (F.col("event_type") != "error").alias("ok"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]), (e % 7 + 1).cast("int")).alias("code"), (e % 10 == 0).alias("plan_only"), (e % 10 == 1).alias("dry_run"),
        F.lit(True).alias("would_change"), (e % 3 == 0).alias("changed"), (e % 4).alias("artifacts"))
    return runs.classify_results(results).select("event_id", "mutation_status", "artifact_status", "error_category", "failure_class")


