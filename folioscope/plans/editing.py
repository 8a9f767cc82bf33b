"""Catalogue: selectors, geometry, bulk edits and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import edits, geometry, inventory, selectors, sequence, templates
from folioscope.plans.comparing import BOXES
from folioscope.plans.reading import DOC_LINES, LIST_TABLES, ORDER_CELLS, PAGE_NODES
from folioscope.sources import corpus, textnodes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# --- N: selectors -------------------------------------------------------------------


def _line_objects(spark, sf):
    return corpus.document_lines(spark, sf).select(
        "doc_id", F.concat_ws("#", "doc_id", "idx").alias("object_id"), "idx", "text",
        (F.col("idx") % 4).alias("slide"), F.when(F.col("idx") % 2 == 0, "even").otherwise("odd").alias("kind"))


def _line_selectors(spark, sf):
    """One selector per document; the kind of criterion follows from the id."""
    docs = corpus.table(spark, sf, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    kind = F.col("doc_id") % 6
    return docs.select(
        F.col("doc_id").alias("selector_id"), "doc_id",
        F.when(kind == 0, F.concat(F.col("doc_id").cast("string"), F.lit("#0"))).alias("object_id"),
        F.when(kind == 1, first).alias("equals"),
        F.when(kind == 2, F.nullif(F.substring(first, 5, 30), F.lit(""))).alias("contains"),
        F.when(kind.isin(3, 2), F.col("doc_id") % 4).cast("int").alias("slide"),
        F.when(kind == 4, F.lit("even")).alias("kind"))


RESOLVE = DOC_LINES + r""",
o AS (SELECT doc_id, doc_id || '#' || idx AS object_id, idx, text, CAST(idx % 4 AS INT) AS slide, CASE idx % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS kind FROM doc_lines),
s AS (SELECT doc_id AS selector_id, doc_id, CASE WHEN k = 0 THEN doc_id || '#0' END AS object_id, CASE WHEN k = 1 THEN f END AS equals,
             CASE WHEN k = 2 THEN nullif(substr(f, 5, 30), '') END AS contains, CASE WHEN k IN (2, 3) THEN CAST(doc_id % 4 AS INT) END AS slide, CASE WHEN k = 4 THEN 'even' END AS kind
      FROM (SELECT doc_id, doc_id % 6 AS k, split_part(text, chr(10), 1) AS f FROM documents)),
m AS (SELECT s.selector_id, o.doc_id, o.object_id FROM s JOIN o ON o.doc_id = s.doc_id
      WHERE (s.object_id IS NOT NULL AND s.object_id = o.object_id) OR (s.object_id IS NULL AND (s.equals IS NULL OR s.equals = o.text)
        AND (s.contains IS NULL OR contains(o.text, s.contains)) AND (s.slide IS NULL OR s.slide = o.slide) AND (s.kind IS NULL OR s.kind = o.kind)
        AND (s.equals IS NOT NULL OR s.contains IS NOT NULL OR s.slide IS NOT NULL OR s.kind IS NOT NULL))),
r AS (SELECT s.selector_id, s.doc_id, CASE WHEN count(m.object_id) = 0 THEN 'not_found' WHEN count(m.object_id) = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
             count(m.object_id) AS match_count, CASE WHEN count(m.object_id) = 1 THEN min(m.object_id) END AS object_id
      FROM s LEFT JOIN m ON m.selector_id = s.selector_id GROUP BY 1, 2)"""


def _resolved(spark, sf):
    chosen = _line_selectors(spark, sf)
    return selectors.resolve(selectors.matches(_line_objects(spark, sf), chosen, ["slide", "kind"]), chosen)


@query("resolve_selectors", "WITH " + RESOLVE + " SELECT * FROM r")
def _(spark, sf):
    return _resolved(spark, sf)


@query("selector_hints", "WITH " + ORDER_CELLS + r"""
SELECT o_orderkey AS selector_id, o_orderkey AS doc_id, o_orderkey || '/' || c.sheet_idx || '/' || c.ref || '/' || c.value AS object_id
FROM orders JOIN order_cells c ON c.doc_id = o_orderkey AND c.col IN (1, 3)
WHERE CASE o_orderkey % 3 WHEN 0 THEN c.sheet_idx = 2 AND c.col = 1 WHEN 1 THEN c.sheet_idx = 3 AND c.col = 3
      ELSE c.col = 1 AND c.ref = 'A' || (o_custkey % 50 + 1) END""")
def _(spark, sf):
    """Sheets by name or number in any case, cells in any case; a cell's formula is text of it. Line items meet the selectors of their order before they are cells."""
    cells = lambda rows: corpus.as_cells(rows, ("quantity", "discount")).select(
        "*", F.concat_ws("/", "doc_id", "sheet_idx", "ref", "value").alias("object_id"), F.col("value").alias("text"), F.col("sheet_idx").alias("sheet"),
        F.col("ref").alias("cell"), F.lit("cell").alias("kind"), F.when(F.col("col") == 1, F.lit("=SUM( one )")).otherwise("=NOW()").alias("formula"))
    third = F.col("o_orderkey") % 3
    asked = corpus.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("selector_id"), F.col("o_orderkey").alias("doc_id"), F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("string").alias("equals"),
        F.when(third == 0, F.lit("( one )")).when(third == 1, F.lit("NOW(")).alias("contains"), F.when(third == 0, "LINE 2").when(third == 1, "Sheet3").alias("sheet_name"),
        F.when(third == 2, F.concat(F.lit("a"), (F.col("o_custkey") % 50 + 1).cast("string"))).alias("cell"))
    return selectors.matches(corpus.order_rows(spark, sf), asked, ["sheet_name", "cell"], unfold=cells)


CONF = r"""
c AS (SELECT selector_id, list_filter([CASE WHEN object_id IS NOT NULL THEN 1.0::DOUBLE END, CASE WHEN equals IS NOT NULL THEN 0.84::DOUBLE END,
             CASE WHEN contains IS NOT NULL THEN 0.74::DOUBLE END, CASE WHEN slide IS NOT NULL THEN 0.58::DOUBLE END, CASE WHEN kind IS NOT NULL THEN 0.62::DOUBLE END], lambda x: x IS NOT NULL) AS p FROM s),
conf AS (SELECT selector_id, CASE WHEN len(p) = 0 THEN 0.0::DOUBLE WHEN list_contains(p, 1.0::DOUBLE) THEN 1.0 ELSE
         floor(least(0.98::DOUBLE, list_sum(p) / len(p) + least(0.12::DOUBLE, greatest(0, len(p) - 1) * 0.04::DOUBLE)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS confidence FROM c)"""


@query("selector_confidence", "WITH " + RESOLVE + "," + CONF + r"""
SELECT selector_id, doc_id, match_count, confidence, CASE WHEN status = 'matched' AND confidence < 0.65 THEN 'low_confidence' ELSE status END AS status
FROM r JOIN conf USING (selector_id)""")
def _(spark, sf):
    names = {"object_id": "object_id", "equals": "text_exact", "contains": "text", "slide": "slide", "kind": "kind"}
    scored = selectors.selector_confidence(_line_selectors(spark, sf), names).select("selector_id", "confidence")
    return selectors.final_status(_resolved(spark, sf).drop("object_id").join(scored, "selector_id"))


@query("near_misses", "WITH " + DOC_LINES + r""",
s AS (SELECT doc_id AS selector_id, replace(substr(split_part(text, chr(10), 1), 1, 25), ' ', '  ') AS needle FROM documents),
hit AS (SELECT DISTINCT selector_id FROM s JOIN doc_lines l ON l.doc_id = s.selector_id WHERE contains(l.text, needle)),
n AS (SELECT selector_id, l.doc_id, l.doc_id || '#' || idx AS object_id, row_number() OVER (PARTITION BY selector_id ORDER BY idx) AS rank
      FROM s ANTI JOIN hit USING (selector_id) JOIN doc_lines l ON l.doc_id = s.selector_id
      WHERE regexp_replace(needle, '\s+', '', 'g') <> '' AND contains(lower(regexp_replace(l.text, '\s+', '', 'g')), lower(regexp_replace(needle, '\s+', '', 'g'))))
SELECT selector_id, doc_id, object_id, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    needle = F.replace(F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 25), F.lit(" "), F.lit("  "))
    none = F.lit(None).cast("string")
    asked = docs.select(F.col("doc_id").alias("selector_id"), "doc_id", none.alias("object_id"), none.alias("equals"), needle.alias("contains"),
                        F.lit(None).cast("int").alias("slide"))
    objects = _line_objects(spark, sf)
    resolved = selectors.resolve(selectors.matches(objects, asked, ["slide"]), asked)
    return selectors.near_misses(objects, asked, resolved).withColumnRenamed("rn", "rank")


@query("nearest_objects", "WITH " + BOXES + r""",
p AS (SELECT o_orderkey AS selector_id, o_orderkey AS doc_id, CAST(o_custkey % 1000 AS DOUBLE) AS px, CAST(o_custkey % 300 AS DOUBLE) AS py FROM orders),
d AS (SELECT selector_id, p.doc_id, object_id, sqrt((x + w / 2 - px) * (x + w / 2 - px) + (y + h / 2 - py) * (y + h / 2 - py)) AS distance FROM p JOIN boxes b ON b.doc_id = p.doc_id),
n AS (SELECT *, min(distance) OVER (PARTITION BY selector_id) AS best FROM d WHERE distance <= 1000)
SELECT selector_id, doc_id, object_id, round(distance, 3) AS distance FROM n WHERE distance - best <= 24 OR distance <= best * 1.15""")
def _(spark, sf):
    points = corpus.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("selector_id"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("slide"),
        (F.col("o_custkey") % 1000).cast("double").alias("px"), (F.col("o_custkey") % 300).cast("double").alias("py"))
    return selectors.nearest(corpus.boxes(spark, sf), points).select(
        "selector_id", "doc_id", "object_id", F.round("distance", 3).alias("distance"))


OVERLAP = "greatest(0.0, least({a}.{s} + {a}.{e}, {b}.{s} + {b}.{e}) - greatest({a}.{s}, {b}.{s})) / greatest(1.0, least({a}.{e}, {b}.{e})) >= 0.25"
RIGHT = "f.x >= t.x + t.w AND " + OVERLAP.format(a="f", b="t", s="y", e="h")
EDGES = BOXES + r""",
edges AS (
  SELECT f.doc_id, f.object_id AS from_id, t.object_id AS to_id, 'contains' AS relation, 0.86::DOUBLE AS confidence FROM boxes f JOIN boxes t ON f.doc_id = t.doc_id AND f.object_id <> t.object_id
  WHERE f.w * f.h > t.w * t.h AND t.x >= f.x AND t.y >= f.y AND t.x + t.w <= f.x + f.w AND t.y + t.h <= f.y + f.h
  UNION ALL SELECT f.doc_id, f.object_id, t.object_id, 'rightOf', 0.82 FROM boxes f JOIN boxes t ON f.doc_id = t.doc_id AND f.object_id <> t.object_id WHERE """ + RIGHT + r"""
  UNION ALL SELECT f.doc_id, f.object_id, t.object_id, 'below', 0.78 FROM boxes f JOIN boxes t ON f.doc_id = t.doc_id AND f.object_id <> t.object_id
  WHERE f.y >= t.y + t.h AND """ + OVERLAP.format(a="f", b="t", s="x", e="w") + ")"


@query("geometry_edges", "WITH " + EDGES + " SELECT * FROM edges")
def _(spark, sf):
    return geometry.geometry_edges(corpus.boxes(spark, sf)).drop("slide")


def _title_anchors(spark, sf):
    return corpus.boxes(spark, sf).filter(F.col("kind") == "title").select(F.col("doc_id").alias("selector_id"), "doc_id", "slide", "object_id")


ANCHORS = "a AS (SELECT doc_id AS selector_id, *, count(*) OVER (PARTITION BY doc_id) AS n FROM boxes WHERE kind = 'title')"


@query("right_of_anchor", "WITH " + BOXES + "," + ANCHORS + r""",
g AS (SELECT t.selector_id, f.doc_id, f.object_id, f.x - t.x - t.w AS gap FROM a t JOIN boxes f ON f.doc_id = t.doc_id AND f.object_id <> t.object_id WHERE t.n = 1 AND """ + RIGHT + r"""),
b AS (SELECT *, min(gap) OVER (PARTITION BY selector_id) AS best FROM g)
SELECT selector_id, doc_id, object_id, gap, 'candidate' AS status FROM b WHERE gap - best <= 24
UNION ALL SELECT selector_id, doc_id, object_id, NULL, 'ambiguous' FROM a WHERE n > 1""")
def _(spark, sf):
    return selectors.right_of(corpus.boxes(spark, sf), _title_anchors(spark, sf))


@query("related_by_edge", "WITH " + EDGES + "," + ANCHORS + r"""
SELECT DISTINCT a.selector_id, e.doc_id, e.from_id AS object_id, 'candidate' AS status FROM edges e JOIN a ON a.doc_id = e.doc_id AND a.object_id = e.to_id WHERE a.n = 1 AND e.relation = 'below'
UNION ALL SELECT selector_id, doc_id, object_id, 'ambiguous' FROM a WHERE n > 1""")
def _(spark, sf):
    boxes = corpus.boxes(spark, sf)
    return selectors.by_relation(boxes, _title_anchors(spark, sf).drop("slide"), "below")


@query("objects_by_bbox", "WITH " + BOXES + r""",
q AS (SELECT o_orderkey AS selector_id, o_orderkey AS doc_id, CAST(o_custkey % 900 AS DOUBLE) AS bx, CAST(o_custkey % 300 AS DOUBLE) AS by_, 60.0 AS bw, 30.0 AS bh, 90.0 AS tol, o_custkey % 3 AS m FROM orders)
SELECT selector_id, q.doc_id, object_id FROM q JOIN boxes ON boxes.doc_id = q.doc_id WHERE CASE m
  WHEN 0 THEN abs(x - bx) <= tol AND abs(y - by_) <= tol AND abs(w - bw) <= tol AND abs(h - bh) <= tol
  WHEN 1 THEN x < bx + bw AND x + w > bx AND y < by_ + bh AND y + h > by_
  ELSE bx >= x AND by_ >= y AND bx + bw <= x + w AND by_ + bh <= y + h END""")
def _(spark, sf):
    number = lambda value: value.cast("double")
    mode = F.when(F.col("o_custkey") % 3 == 0, "near").when(F.col("o_custkey") % 3 == 1, "intersects").otherwise("contains")
    wanted = corpus.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("selector_id"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("slide"),
        number(F.col("o_custkey") % 900).alias("bx"), number(F.col("o_custkey") % 300).alias("by"), F.lit(60.0).alias("bw"), F.lit(30.0).alias("bh"),
        F.lit(90.0).alias("tolerance"), mode.alias("mode"))
    return selectors.by_bbox(corpus.boxes(spark, sf), wanted)


@query("largest_text", r"""
WITH s AS (SELECT lang, source, doc_id, (10 + doc_id % 20) * sqrt(greatest(1, length(trim(text)))) * CASE WHEN doc_id % 10 = 0 THEN 2.25 ELSE 1.0 END AS score FROM documents WHERE text <> '')
SELECT lang, source, doc_id FROM (SELECT *, max(score) OVER (PARTITION BY lang, source) AS best FROM s) WHERE score >= best * 0.95""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents").select(
        "lang", "source", "doc_id", "text", (F.lit(10) + F.col("doc_id") % 20).alias("h"), F.when(F.col("doc_id") % 10 == 0, "title").alias("placeholder"))
    return selectors.largest_text(docs, ["lang", "source"]).select("lang", "source", "doc_id")


@query("nth_body_shape", r"""
SELECT doc_id, turn FROM (SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'system') WHERE r = 2""")
def _(spark, sf):
    turns = corpus.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", F.lit("shape").alias("kind"), F.when(F.col("role") == "system", "title").alias("placeholder"))
    return selectors.nth_body(turns, 2, ["doc_id"], "turn").select("doc_id", "turn")


@query("lock_violations", r"""
SELECT op_id, doc_id, scope, 'EDIT_OUTSIDE_LOCK_SCOPE' AS code, 'error' AS severity FROM (
  SELECT o_orderkey AS op_id, o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'slide:2' WHEN 2 THEN 'sheet:LINE 1' WHEN 3 THEN 'paragraph:1' WHEN 4 THEN 'range:a1:b2' ELSE 'stableObjectId:x1' END AS scope, o_custkey AS c FROM orders)
WHERE NOT CASE op_id % 6 WHEN 0 THEN true WHEN 1 THEN c % 4 = 2 WHEN 2 THEN c % 3 = 1 WHEN 3 THEN c % 2 = 1 WHEN 4 THEN false ELSE c % 5 = 1 END""")
def _(spark, sf):
    orders = corpus.table(spark, sf, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 6
    scope = (F.when(k == 0, "document").when(k == 1, "slide:2").when(k == 2, "sheet:LINE 1").when(k == 3, "paragraph:1")
             .when(k == 4, "range:a1:b2").otherwise("stableObjectId:x1"))
    ops = orders.select(
        F.col("o_orderkey").alias("op_id"), F.col("o_orderkey").alias("doc_id"), (c % 4).cast("int").alias("slide"),
        F.concat(F.lit("Line "), (c % 3).cast("string")).alias("sheet"), (c % 2).cast("int").alias("paragraph"), F.lit("C1:D2").alias("range"),
        F.concat(F.lit("x"), (c % 5).cast("string")).alias("object_id"))
    return selectors.lock_violations(ops, orders.select(F.col("o_orderkey").alias("doc_id"), scope.alias("scope")))


# --- G: geometry ----------------------------------------------------------------------


@query("graph_nodes", "WITH " + BOXES + r"""
SELECT doc_id, object_id, kind, CASE WHEN l_linenumber = 2 THEN CASE WHEN kind = 'image' THEN 1.0 ELSE 0.95 END WHEN kind = 'image' THEN 0.97 ELSE 0.95 END::DOUBLE AS confidence,
       'UNTRUSTED_DOCUMENT_CONTENT' AS risk_flags FROM boxes""")
def _(spark, sf):
    """Line 2 has no box; images carry no slide hint."""
    boxes = corpus.boxes(spark, sf)
    objects = boxes.withColumn("box", F.when(F.col("w") != 60, F.col("x"))).withColumn("slide", F.when(F.col("kind") != "image", F.col("slide")))
    return geometry.graph_nodes(objects, ["slide"], "box")


@query("graph_index", "WITH " + EDGES + r"""
SELECT doc_id, 'node' AS entry, kind AS name, count(*) AS n FROM boxes GROUP BY 1, 3
UNION ALL SELECT doc_id, 'edge', relation, count(*) FROM edges GROUP BY 1, 3""")
def _(spark, sf):
    boxes = corpus.boxes(spark, sf)
    return geometry.graph_index(geometry.graph_nodes(boxes, ["slide"]), geometry.geometry_edges(boxes))


@query("layout_constraints", "WITH " + BOXES + r""",
s0 AS (SELECT *, x AS x0, y AS y0, w AS w0, h AS h0, l_linenumber % 2 = 0 AS on_, kind = 'shape' AS bound, CASE WHEN l_linenumber = 4 THEN 8.0 END AS snap FROM boxes),
s1 AS (SELECT * REPLACE (CASE WHEN on_ THEN least(120.0, greatest(50.0, w)) ELSE w END AS w, CASE WHEN on_ THEN least(48.0, h) ELSE h END AS h) FROM s0),
s2 AS (SELECT * REPLACE (CASE WHEN on_ AND bound THEN 100 + (600 - w) / 2 ELSE x END AS x, CASE WHEN on_ AND bound THEN 40 + 200 - h ELSE y END AS y) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN on_ AND bound THEN least(700 - w, greatest(100.0, x)) ELSE x END AS x, CASE WHEN on_ AND bound THEN least(240 - h, greatest(40.0, y)) ELSE y END AS y) FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN snap > 0 THEN floor(x / snap + 0.5) * snap ELSE x END AS x, CASE WHEN snap > 0 THEN floor(y / snap + 0.5) * snap ELSE y END AS y,
                         CASE WHEN snap > 0 THEN floor(w / snap + 0.5) * snap ELSE w END AS w, CASE WHEN snap > 0 THEN floor(h / snap + 0.5) * snap ELSE h END AS h) FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN on_ THEN least(120.0, greatest(50.0, w)) ELSE w END AS w, CASE WHEN on_ THEN least(48.0, h) ELSE h END AS h) FROM s4),
s6 AS (SELECT * REPLACE (CASE WHEN on_ AND bound THEN least(700 - w, greatest(100.0, x)) ELSE x END AS x, CASE WHEN on_ AND bound THEN least(240 - h, greatest(40.0, y)) ELSE y END AS y) FROM s5)
SELECT doc_id, object_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, x <> x0 OR y <> y0 OR w <> w0 OR h <> h0 AS changed FROM s6""")
def _(spark, sf):
    boxes = corpus.boxes(spark, sf)
    line = F.round(F.col("w") / 30).cast("int")
    bound = lambda value: F.when(F.col("kind") == "shape", F.lit(value))
    rules = boxes.filter(line % 2 == 0).select(
        "doc_id", "object_id", F.lit(50.0).alias("min_w"), F.lit(120.0).alias("max_w"), F.lit(None).cast("double").alias("min_h"), F.lit(48.0).alias("max_h"),
        bound(100.0).alias("bx"), bound(40.0).alias("by"), bound(600.0).alias("bw"), bound(200.0).alias("bh"), F.lit("center").alias("align_x"),
        F.lit("bottom").alias("align_y"), F.when(line == 4, 8.0).alias("snap"))
    return geometry.apply_constraints(boxes, rules).drop("slide", "kind", "text")


@query("align_boxes", "WITH " + BOXES + r""",
a AS (SELECT *, first_value(x) OVER o AS ax, first_value(w) OVER o AS aw, row_number() OVER o AS r FROM boxes WINDOW o AS (PARTITION BY doc_id ORDER BY y, object_id))
SELECT doc_id, object_id, CASE WHEN r = 1 THEN x ELSE ax + (aw - w) / 2 END AS x FROM a""")
def _(spark, sf):
    return geometry.align(corpus.boxes(spark, sf), "center", ["doc_id"], "y").select("doc_id", "object_id", "x")


@query("distribute_boxes", "WITH " + BOXES + r""",
a AS (SELECT *, min(x) OVER p AS x0, max(x) OVER p AS x1, count(*) OVER p AS n, row_number() OVER (PARTITION BY doc_id ORDER BY x, object_id) AS r FROM boxes WINDOW p AS (PARTITION BY doc_id))
SELECT doc_id, object_id, CASE WHEN n >= 3 AND r > 1 AND r < n THEN x0 + (x1 - x0) / (n - 1) * (r - 1) ELSE x END AS x FROM a""")
def _(spark, sf):
    return geometry.distribute(corpus.boxes(spark, sf), "x", ["doc_id"], width=200).select("doc_id", "object_id", "x")


# --- E: edits ---------------------------------------------------------------------------


@query("validate_ops", r"""
WITH o AS (SELECT o_orderkey AS doc_id, ['pptx', 'docx', 'xlsx'][CAST(o_orderkey % 3 AS INT) + 1] AS format, CASE WHEN o_custkey % 9 = 8 THEN NULL ELSE
   ['setText', 'set', 'pptx.setText', 'xlsx.setCell', 'docx.spell', 'pdf.annotate', '', 'docx.setText'][CAST(o_custkey % 9 AS INT) + 1] END AS op, o_custkey % 2 = 0 AS targeted FROM orders)
SELECT doc_id AS op_id, doc_id, 'SCHEMA_INVALID' AS code, 'error' AS severity FROM o WHERE coalesce(op, '') = ''
UNION ALL SELECT doc_id, doc_id, 'FEATURE_NOT_IMPLEMENTED', 'error' FROM o WHERE op = 'docx.spell'
UNION ALL SELECT doc_id, doc_id, 'FORMAT_UNSUPPORTED', 'error' FROM o WHERE (op = 'set' AND format <> 'xlsx') OR (contains(op, '.') AND split_part(op, '.', 1) <> format)
UNION ALL SELECT doc_id, doc_id, 'SELECTOR_MISSING', 'error' FROM o WHERE op IN ('setText', 'pptx.setText', 'docx.setText') AND NOT targeted""")
def _(spark, sf):
    orders = corpus.table(spark, sf, "orders")
    names = F.array(*[F.lit(n) for n in ("setText", "set", "pptx.setText", "xlsx.setCell", "docx.spell", "pdf.annotate", "", "docx.setText")])
    formats = F.array(F.lit("pptx"), F.lit("docx"), F.lit("xlsx"))
    key = F.col("o_orderkey").alias("doc_id")
    ops = orders.select(
        F.col("o_orderkey").alias("op_id"), key, F.try_element_at(names, (F.col("o_custkey") % 9 + 1).cast("int")).alias("op"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("x")).alias("object_id"), F.lit(None).cast("string").alias("contains"))
    return edits.validate_ops(ops, orders.select(key, F.element_at(formats, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("format")))


def _outcomes(spark, sf):
    ops = corpus.table(spark, sf, "documents").select(
        F.col("doc_id").alias("op_id"), "doc_id", F.col("doc_id").alias("op_idx"), F.concat(F.lit("NEW "), F.col("doc_id").cast("string")).alias("new_text"))
    return edits.set_text_outcomes(ops, _resolved(spark, sf))


@query("set_text_outcomes", "WITH " + RESOLVE + """
SELECT selector_id AS op_id, CASE status WHEN 'matched' THEN 'applied' WHEN 'not_found' THEN 'SELECTOR_NOT_FOUND' ELSE 'SELECTOR_AMBIGUOUS' END AS outcome FROM r""")
def _(spark, sf):
    return _outcomes(spark, sf).select("op_id", "outcome")


@query("set_text", "WITH " + RESOLVE + """
SELECT o.doc_id, o.object_id, CASE WHEN r.object_id IS NOT NULL THEN 'NEW ' || o.doc_id ELSE o.text END AS text, r.object_id IS NOT NULL AS edited
FROM o LEFT JOIN r ON r.doc_id = o.doc_id AND r.object_id = o.object_id""")
def _(spark, sf):
    return edits.apply_set_text(_line_objects(spark, sf), _outcomes(spark, sf)).select("doc_id", "object_id", "text", "edited")


@query("replace_text", "WITH " + DOC_LINES + r""",
x AS (SELECT doc_id, idx, text, CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'e', 'EE'), 'E', 'a') ELSE text END AS t FROM doc_lines)
SELECT doc_id, CAST(idx AS INT) AS idx, t AS text, t <> text AS edited FROM x""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents").filter(F.col("doc_id") % 2 == 0)
    steps = F.array(F.struct(F.lit(1).alias("op_idx"), F.lit("e").alias("old"), F.lit("EE").alias("new")),
                    F.struct(F.lit(2).alias("op_idx"), F.lit("E").alias("old"), F.lit("a").alias("new")))
    return sequence.replace_in_order(corpus.document_lines(spark, sf), docs.select("doc_id", F.inline(steps)))


EDIT_STEPS = r"""
WITH RECURSIVE """ + DOC_LINES + r""",
o AS (SELECT doc_id, doc_id || '#' || idx AS object_id, text, CAST(idx % 4 AS INT) AS slide FROM doc_lines),
f AS (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents),
ops AS (
  SELECT doc_id, 1 AS k, 'setText' AS op, NULL AS id, NULL AS eq, nullif(substr(line, 5, 30), '') AS has, NULL::INT AS slide, NULL AS old, 'one ' || doc_id AS new FROM f
  UNION ALL SELECT doc_id, 2, 'setText', NULL, 'one ' || doc_id, NULL, NULL, NULL, 'two e' FROM f
  UNION ALL SELECT doc_id, 3, 'replaceText', NULL, NULL, NULL, NULL, 'e', 'EE' FROM f
  UNION ALL SELECT doc_id, 4, 'setText', NULL, NULL, 'two EE', CASE WHEN doc_id % 2 = 0 THEN 0 END, NULL, 'three' FROM f
  UNION ALL SELECT doc_id, 5, 'setText', NULL, line, NULL, NULL, NULL, 'never' FROM f
  UNION ALL SELECT doc_id, 6, 'setText', doc_id || '#1', NULL, NULL, NULL, NULL, 'by id' FROM f
  UNION ALL SELECT doc_id, 7, 'setText', doc_id || '#1', NULL, NULL, NULL, NULL, 'three' FROM f
  UNION ALL SELECT doc_id, 8, 'setText', NULL, 'three', NULL, NULL, NULL, 'four' FROM f),
st AS (
  SELECT 0 AS k, doc_id, object_id, slide, text, false AS edited, '' AS outcome FROM o
  UNION ALL
  SELECT k, doc_id, object_id, slide, CASE WHEN hit AND op = 'setText' AND n = 1 THEN new WHEN hit AND op = 'replaceText' THEN replace(text, old, new) ELSE text END,
         edited OR (hit AND (op = 'replaceText' OR n = 1)), CASE WHEN n = 0 THEN 'SELECTOR_NOT_FOUND' WHEN op = 'setText' AND n > 1 THEN 'SELECTOR_AMBIGUOUS' ELSE 'applied' END
  FROM (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY doc_id) AS n FROM (
    SELECT p.k, st.doc_id, st.object_id, st.slide, st.text, st.edited, p.op, p.new, p.old,
           CASE WHEN p.op = 'replaceText' THEN contains(st.text, p.old) WHEN p.id IS NOT NULL THEN st.object_id = p.id
                ELSE (p.eq IS NOT NULL OR p.has IS NOT NULL OR p.slide IS NOT NULL) AND coalesce(st.text = p.eq, true) AND coalesce(contains(st.text, p.has), true) AND coalesce(st.slide = p.slide, true) END AS hit
    FROM st JOIN ops p ON p.doc_id = st.doc_id AND p.k = st.k + 1)))
"""


def _edit_steps(spark, sf):
    objects = _line_objects(spark, sf)
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    docs = corpus.table(spark, sf, "documents").select("doc_id", line.alias("line"))
    text = lambda value: F.lit(value).cast("string") if isinstance(value, (str, type(None))) else value

    def step(k, new, op="setText", object_id=None, equals=None, contains=None, slide=None, old=None):
        return F.struct(F.lit(k).alias("op_idx"), F.lit(op).alias("op"), text(object_id).alias("object_id"), text(equals).alias("equals"), text(contains).alias("contains"),
                        (F.lit(None).cast("bigint") if slide is None else slide).alias("slide"), text(old).alias("old"), text(new).alias("new_text"))

    key = F.col("doc_id").cast("string")
    second = F.concat(key, F.lit("#1"))
    steps = F.array(
        step(1, F.concat(F.lit("one "), key), contains=F.nullif(F.substring("line", 5, 30), F.lit(""))), step(2, "two e", equals=F.concat(F.lit("one "), key)),
        step(3, "EE", op="replaceText", old="e"), step(4, "three", contains="two EE", slide=F.when(F.col("doc_id") % 2 == 0, F.lit(0).cast("bigint"))),
        step(5, "never", equals=F.col("line")), step(6, "by id", object_id=second), step(7, "three", object_id=second), step(8, "four", equals="three"))
    ops = docs.select("doc_id", F.inline(steps)).withColumn("op_id", F.concat_ws("/", "doc_id", "op_idx"))
    return sequence.apply_in_order(objects.withColumn("slide", F.col("slide").cast("bigint")).select("doc_id", "object_id", "text", "slide"), ops, ["slide"])


@query("edits_in_order", EDIT_STEPS + "SELECT doc_id, object_id, text, edited FROM st WHERE k = 8")
def _(spark, sf):
    """Eight operations per document, each on what the one before left."""
    return _edit_steps(spark, sf)[0].select("doc_id", "object_id", "text", "edited")


@query("edit_outcomes", EDIT_STEPS + """
SELECT DISTINCT p.doc_id || '/' || p.k AS op_id, coalesce(outcome, 'SELECTOR_NOT_FOUND') AS outcome FROM ops p LEFT JOIN st ON st.doc_id = p.doc_id AND st.k = p.k""")
def _(spark, sf):
    return _edit_steps(spark, sf)[1].select("op_id", "outcome")


@query("set_table_cells", "WITH " + LIST_TABLES + r""",
c AS (SELECT doc_id, tindex, rindex, unnest(cells) AS text, generate_subscripts(cells, 1) - 1 AS cindex FROM (
    SELECT doc_id, tindex, unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS rindex FROM list_tables))
SELECT doc_id, CAST(tindex AS INT) AS "table", CAST(rindex AS INT) AS "row", CAST(cindex AS INT) AS col,
       CASE WHEN tindex = 0 AND rindex = doc_id % 3 AND cindex = 0 THEN 'second ' || doc_id ELSE text END AS text, tindex = 0 AND rindex = doc_id % 3 AND cindex = 0 AS edited FROM c""")
def _(spark, sf):
    cells = textnodes.table_cells(corpus.page_parts(spark, sf), ("ul", "li", "a"), ("a",)).drop("part")
    key = F.col("page_id").cast("string")
    pair = F.array(F.struct(F.lit(1).alias("op_idx"), F.concat(F.lit("first "), key).alias("new_text")),
                   F.struct(F.lit(2).alias("op_idx"), F.concat(F.lit("second "), key).alias("new_text")))
    ops = corpus.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit(1).alias("table"), (F.col("page_id") % 3 + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.inline(pair))
    return edits.apply_table_cell(cells, ops, one_based=True)


UNIQUE_CELLS = ORDER_CELLS + r""",
cells AS (SELECT doc_id, sheet, col, "row", value, CASE WHEN col = 3 THEN 'A' || "row" || '+$B$' || "row" END AS formula
  FROM (SELECT doc_id, sheet_name AS sheet, CAST(col AS INT) AS col, "row", max(value) AS value FROM order_cells GROUP BY doc_id, sheet_name, order_cells.col, "row"))"""


def _unique_cells(spark, sf):
    """The cells of ``corpus.order_cells`` with the greatest value of each place; a row's five values are compared before they become cells."""
    rows = corpus.order_rows(spark, sf).groupBy("doc_id", "sheet_idx", "row").agg(*[F.max(c).alias(c) for c in corpus.ORDER_COLUMNS])
    row, cells = F.col("row").cast("string"), F.array(*[F.struct(F.lit(i + 1).alias("col"), F.col(c).alias("value")) for i, c in enumerate(corpus.ORDER_COLUMNS)])
    return rows.select("doc_id", F.concat(F.lit("Line "), F.col("sheet_idx").cast("string")).alias("sheet"), F.inline(cells), "row").select(
        "doc_id", "sheet", "col", "row", "value", F.when(F.col("col") == 3, F.concat(F.lit("A"), row, F.lit("+$B$"), row)).alias("formula"))


@query("upsert_cells", "WITH " + UNIQUE_CELLS + r""",
n AS (SELECT o_orderkey AS doc_id, unnest([
   {'i': 1, 's': 'Line 1', 'c': 2, 'r': 2, 'v': 'first', 'f': NULL}, {'i': 2, 's': 'Line 1', 'c': 2, 'r': 2, 'v': CAST(o_custkey AS VARCHAR), 'f': NULL},
   {'i': 3, 's': 'Line 2', 'c': 3, 'r': 7, 'v': NULL, 'f': 'SUM(A1:B2)'},
   {'i': 4, 's': 'Line 3', 'c': 1, 'r': 10, 'v': 'a', 'f': NULL}, {'i': 4, 's': 'Line 3', 'c': 2, 'r': 10, 'v': o_orderstatus, 'f': NULL}, {'i': 4, 's': 'Line 3', 'c': 1, 'r': 11, 'v': 'c', 'f': NULL}]) AS u FROM orders),
a AS (SELECT doc_id, sheet, col, "row", -1 AS i, value, formula FROM cells UNION ALL SELECT doc_id, u.s, u.c, u.r, u.i, u.v, u.f FROM n)
SELECT doc_id, sheet, CAST(col AS INT) AS col, CAST("row" AS INT) AS "row", chr(CAST(64 + col AS INT)) || "row" AS ref, value, formula, i >= 0 AS edited
FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, sheet, col, "row" ORDER BY i DESC) = 1""")
def _(spark, sf):
    grid_type = "array<array<string>>"
    none = F.lit(None).cast("string")
    op = lambda i, kind, sheet, cell, value=none, formula=none, grid=F.lit(None): F.struct(
        F.lit(i).alias("op_idx"), F.lit(kind).alias("op"), F.lit(sheet).alias("sheet"), F.lit(cell).alias("cell"),
        value.alias("value"), formula.alias("formula"), grid.cast(grid_type).alias("grid"))
    ops = F.array(
        op(1, "xlsx.setCell", None, "cell://Line 1!b2", F.lit("first")), op(2, "xlsx.setCell", "Line 1", "B2", F.col("o_custkey").cast("string")),
        op(3, "xlsx.setFormula", "Line 2", "C7", formula=F.lit("=SUM(A1:B2)")),
        op(4, "xlsx.setRange", "Line 3", "A10", grid=F.array(F.array(F.lit("a"), F.col("o_orderstatus")), F.array(F.lit("c")))))
    changes = edits.cell_ops(corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(ops)))
    return edits.upsert_cells(_unique_cells(spark, sf), changes)


@query("insert_rows", "WITH " + UNIQUE_CELLS + r""",
s AS (SELECT DISTINCT doc_id, sheet FROM cells WHERE sheet IN ('Line 1', 'Line 2')),
m AS (SELECT c.doc_id, c.sheet, col, CASE WHEN s.sheet IS NOT NULL AND "row" >= 20 THEN "row" + 2 ELSE "row" END AS "row", value, formula IS NOT NULL AS has FROM cells c LEFT JOIN s ON s.doc_id = c.doc_id AND s.sheet = c.sheet)
SELECT doc_id, sheet, col, CAST("row" AS INT) AS "row", value, CASE WHEN has THEN 'A' || "row" || '+$B$' || "row" END AS formula, chr(64 + col) || "row" AS ref FROM m
UNION ALL SELECT doc_id, sheet, u.c, u.r, u.v, NULL, chr(64 + u.c) || u.r FROM (SELECT doc_id, sheet, unnest([{'c': 1, 'r': 20, 'v': 'x'}, {'c': 2, 'r': 20, 'v': 'y'}, {'c': 1, 'r': 21, 'v': 'z'}]) AS u FROM s)""")
def _(spark, sf):
    cells = _unique_cells(spark, sf)
    places = cells.filter(F.col("sheet").isin("Line 1", "Line 2")).select("doc_id", "sheet").distinct().withColumn("at", F.lit(20)).withColumn(
        "grid", F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z"))))
    return edits.insert_rows(cells, places)


@query("append_position", "WITH " + UNIQUE_CELLS + """SELECT doc_id, sheet, CAST(max("row") + 1 AS INT) AS "at" FROM cells GROUP BY 1, 2""")
def _(spark, sf):
    return edits.append_position(_unique_cells(spark, sf))


@query("workbook_object_upserts", r"""
WITH m AS (SELECT o_orderkey AS d, o_orderstatus AS st, o_orderpriority AS pr FROM orders)
SELECT d AS doc_id, 'sheet' AS kind, 'Q1_' || st AS name, '1' AS definition FROM m
UNION ALL SELECT d, 'table', 'T' || regexp_replace(pr, '[^A-Za-z0-9_]', '', 'g'), 'A1:B9' FROM m
UNION ALL SELECT d, 'name', 'TaxRate', '$A$2' FROM m
UNION ALL SELECT d, 'sheet', 'Data', '2' FROM m""")
def _(spark, sf):
    """A renamed sheet, an added table, a redefined name and an added sheet per workbook."""
    orders = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority")
    item = lambda kind, name, definition: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(definition).alias("definition"))
    meta = orders.select("doc_id", F.inline(F.array(item("sheet", "Old", "1"), item("name", "TaxRate", "$A$1"))))
    none = F.lit(None).cast("string")
    op = lambda i, kind, name, definition, new=none: F.struct(
        F.lit(i).alias("op_idx"), F.lit(kind).alias("kind"), name.alias("name"), F.lit(definition).alias("definition"), new.alias("new_name"))
    ops = orders.select("doc_id", F.inline(F.array(
        op(1, "sheet", F.lit("Old"), None, F.concat(F.lit("Q1/"), "o_orderstatus")), op(2, "table", F.concat(F.lit("T "), "o_orderpriority"), "A1:B9"),
        op(3, "name", F.lit("TaxRate"), "$A$2"), op(4, "sheet", F.lit("Data"), "2"))))
    return edits.upsert_workbook_objects(meta, ops)


@query("apply_batch", r"""
WITH o AS (SELECT l_suppkey AS batch_id, l_orderkey AS doc_id, l_linenumber AS op_idx, l_returnflag = 'R' AS failed, l_linestatus = 'F' AS required FROM lineitem),
s AS (SELECT *, min(op_idx) FILTER (failed AND required) OVER (PARTITION BY batch_id, doc_id) AS stop FROM o)
SELECT batch_id, doc_id, op_idx, CASE WHEN op_idx > stop THEN 'skipped-after-error' WHEN failed THEN 'failed' WHEN stop IS NOT NULL THEN 'rolled_back' ELSE 'applied' END AS status FROM s""")
def _(spark, sf):
    return edits.apply_batch(corpus.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("batch_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("op_idx"),
        (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_linestatus") == "F").alias("required")))


def _chart_inputs(spark, sf):
    events = corpus.table(spark, sf, "events")
    points = events.select(F.col("user_id").alias("doc_id"), F.lit("c1").alias("chart"), F.col("event_id").alias("idx"), F.col("event_type").alias("category"),
                           F.round(F.col("value") * 100).cast("bigint").cast("double").alias("value"), F.lit("Metric").alias("series"))
    charts = points.select("doc_id", "chart").distinct().select(
        "doc_id", "chart", F.lit("'Data set'!$B$5:$B$6").alias("category_ref"), F.lit("'Data set'!$C$5:$C$6").alias("value_ref"))
    return charts, points


@query("chart_cells", r"""
SELECT user_id AS doc_id, 'Data set' AS sheet, 2 AS col, CAST(5 + event_id AS INT) AS "row", event_type AS value FROM events
UNION ALL SELECT user_id, 'Data set', 3, CAST(5 + event_id AS INT), CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '.0' FROM events
UNION ALL SELECT DISTINCT user_id, 'Data set', 3, 4, 'Metric' FROM events""")
def _(spark, sf):
    return edits.chart_to_cells(*_chart_inputs(spark, sf))[0]


@query("chart_ranges", r"""
SELECT user_id AS doc_id, 'c1' AS chart, '''Data set''!$B$5:$B$' || (4 + count(*)) AS category_ref, '''Data set''!$C$5:$C$' || (4 + count(*)) AS value_ref FROM events GROUP BY 1""")
def _(spark, sf):
    return edits.chart_to_cells(*_chart_inputs(spark, sf))[1]


@query("replace_media", r"""
SELECT doc_id, 'media/image' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.bin' END AS target FROM documents""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    path = F.concat(F.lit("word/media/image"), F.col("doc_id").cast("string"), F.lit(".bin"))
    parts = docs.select("doc_id", path.alias("part"), F.encode("text", "UTF-8").alias("content"))
    rels = docs.select("doc_id", F.lit("word/document.xml").alias("owner"), F.concat(F.lit("media/image"), F.col("doc_id").cast("string"), F.lit(".bin")).alias("target"))
    swaps = docs.filter(F.col("doc_id") % 3 == 0).select("doc_id", path.alias("part"), F.encode("lang", "UTF-8").alias("new_content"), F.lit("png").alias("extension"))
    return edits.replace_media(parts, rels, swaps)[1].select("doc_id", "target")


@query("plan_ops", r"""
SELECT conv_id, turn, 'pptx.formatTitle' AS op, CAST(turn AS INT) AS slide, CAST(20 + turn AS INT) AS font_size, turn % 2 = 0 AS bold, NULL::VARCHAR AS old, NULL::VARCHAR AS "new" FROM conversations WHERE turn % 3 <> 2
UNION ALL SELECT conv_id, turn, 'replaceText', NULL, NULL, NULL, role, 'x' || turn FROM conversations WHERE turn % 3 <> 1""")
def _(spark, sf):
    turn = F.col("turn").cast("string")
    size = F.concat(F.lit("Slide "), F.translate(turn, edits.DIGITS, edits.WIDE_DIGITS), F.lit(" title to "), (F.col("turn") + 20).cast("string"), F.lit("pt"),
                    F.when(F.col("turn") % 2 == 0, " bold").otherwise(""))
    swap = F.when(F.col("turn") % 3 == 2, F.concat("role", F.lit("をx"), turn, F.lit("に置換"))).otherwise(
        F.concat(F.lit(' replace "'), "role", F.lit('" with "x'), turn, F.lit('"')))
    goal = F.concat(F.when(F.col("turn") % 3 != 2, size).otherwise(""), F.when(F.col("turn") % 3 != 1, swap).otherwise(""))
    return edits.plan_ops(corpus.table(spark, sf, "conversations").select("conv_id", "turn", goal.alias("goal")))


@query("apply_format", r"""
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS slide, CAST(k AS INT) AS pos, CASE WHEN k = 0 THEN 24.0 WHEN turn = 1 THEN 12.0 END::DOUBLE AS font_pt,
       CASE WHEN k = 1 AND turn = 1 THEN true END AS bold, k = 0 OR turn = 1 AS formatted FROM conversations, (SELECT unnest([0, 1]) AS k)""")
def _(spark, sf):
    objects = inventory.slide_objects(corpus.pptx_parts(spark, sf)).select(
        "doc_id", "slide", "pos", "placeholder", F.concat_ws("/", "slide", "pos").alias("object_id"),
        F.lit(None).cast("double").alias("font_pt"), F.lit(None).cast("boolean").alias("bold"))
    convs = objects.select("doc_id").distinct()
    op = lambda i, target, titles, size, bold: F.struct(
        F.lit(i).alias("op_idx"), F.lit(target).cast("string").alias("object_id"), F.lit(titles).alias("all_titles"),
        F.lit(size).cast("double").alias("font_pt"), F.lit(bold).cast("boolean").alias("bold"))
    ops = convs.select("doc_id", F.inline(F.array(
        op(1, None, True, 20, None), op(2, None, True, 24, None), op(3, "2/1", False, 12, None), op(4, "2/1", False, None, True))))
    return edits.apply_format(objects, ops, ["font_pt", "bold"]).select("doc_id", "slide", "pos", "font_pt", "bold", "formatted")


@query("skip_replays", r"""
WITH k AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey AS op_id, k.o_custkey IS NOT NULL AS replay FROM orders o LEFT JOIN k ON k.o_custkey = o.o_custkey AND k.o_orderpriority = o.o_orderpriority""")
def _(spark, sf):
    orders = corpus.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("op_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("batch_key"), "o_orderstatus")
    todo, replays = edits.skip_replays(orders, orders.filter(F.col("o_orderstatus") == "F"))
    return todo.select("op_id", F.lit(False).alias("replay")).unionByName(replays.select("op_id", F.lit(True).alias("replay")))


@query("write_back", "WITH " + PAGE_NODES + r"""
SELECT doc_id, CAST(idx AS INT) AS idx, CASE WHEN idx % 3 = 0 THEN text || ' & <new>' ELSE text END AS text FROM page_nodes""")
def _(spark, sf):
    """Pages with every third node edited, read again after the write-back."""
    tags = ("p", "h1", "a", "li")
    parts = corpus.page_parts(spark, sf)
    changes = corpus.page_objects(spark, sf).filter(F.col("idx") % 3 == 0).select("doc_id", "part", "idx", F.concat("text", F.lit(" & <new>")).alias("text"))
    rebuilt = edits.write_back(parts, changes, tags)
    return textnodes.text_objects(rebuilt, tags).select("doc_id", "idx", "text")


@query("write_back_identity", "SELECT page_id AS doc_id, sha256(html) AS sha256 FROM pages")
def _(spark, sf):
    """Nodes written back with their own raw text leave the page as it was."""
    tags = ("p", "h1", "a", "li")
    parts = corpus.page_parts(spark, sf)
    node = corpus.page_parts(spark, sf).select("doc_id", "part", F.posexplode(textnodes.elements("xml", *tags)).alias("idx", "raw"))
    plain = node.filter(~F.col("raw").rlike('[<>&"]')).select("doc_id", "part", "idx", F.col("raw").alias("text"))
    return edits.write_back(parts, plain, tags).select("doc_id", F.sha2("xml", 256).alias("sha256"))


@query("sheet_rows", "WITH " + UNIQUE_CELLS + r"""
SELECT doc_id, sheet, "row", '<row r="' || "row" || '">' || string_agg(CASE WHEN formula IS NOT NULL THEN '<c r="' || chr(64 + col) || "row" || '"><f>' || formula || '</f></c>'
  WHEN col < 4 THEN '<c r="' || chr(64 + col) || "row" || '"><v>' || value || '</v></c>' ELSE '<c r="' || chr(64 + col) || "row" || '" t="inlineStr"><is><t>' || value || '</t></is></c>' END, '' ORDER BY col) || '</row>' AS row_xml
FROM cells GROUP BY 1, 2, 3""")
def _(spark, sf):
    cells = _unique_cells(spark, sf)
    return edits.sheet_rows(cells.withColumn("ref", edits.make_ref("col", "row")))


# --- T: templates -----------------------------------------------------------------------


def _template_rows(spark, sf):
    """A template per order priority; one names a field no record has, one has none."""
    priorities = corpus.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("template_id")).distinct()
    xml = (
        F.when(F.col("template_id").startswith("1"), "<p>{{customer.name}} {{ customer.tier }}</p>")
        .when(F.col("template_id").startswith("2"), "<p>No fields</p>")
        .otherwise(F.concat(F.lit("<p>{{ customer.name }} owes {{amount}} ({{customer.name}}) "), "template_id", F.lit("</p>"))))
    return priorities.withColumn("xml", xml)


def _records(spark, sf):
    joined = corpus.table(spark, sf, "orders").join(corpus.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    body = F.struct(F.struct(F.concat("c_name", F.lit(" & {{amount}}")).alias("name")).alias("customer"), F.col("o_totalprice").alias("amount"))
    return joined.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("template_id"), F.to_json(body).alias("json"))


FILL = r"""
f AS (SELECT o_orderkey AS record_id, o_orderpriority AS template_id, c_name || ' &amp; {{amount}}' AS n, CAST(o_totalprice AS VARCHAR) AS amount, substr(o_orderpriority, 1, 1) AS k
      FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("placeholders", r"""
SELECT o_orderkey AS doc_id, 'name,a.b,' || lower(o_orderstatus) || '_x-1' AS names FROM orders""")
def _(spark, sf):
    text = F.concat(F.lit("Dear {{ name }}, {{a.b}} {{name}} {{"), F.lower("o_orderstatus"), F.lit("_x-1  }} {{ bad name }} { {no} }"))
    return corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array_join(templates.placeholders(text), ",").alias("names"))


@query("fill_templates", "WITH " + FILL + r"""
SELECT record_id, template_id, CASE k WHEN '1' THEN NULL WHEN '2' THEN '<p>No fields</p>' ELSE '<p>' || n || ' owes ' || amount || ' (' || n || ') ' || template_id || '</p>' END AS filled FROM f""")
def _(spark, sf):
    return templates.fill(_template_rows(spark, sf), _records(spark, sf)).select("record_id", "template_id", "filled")


@query("fill_report", "WITH " + FILL + r"""
SELECT record_id, template_id, CASE k WHEN '1' THEN 1 WHEN '2' THEN 0 ELSE 3 END AS replacements, CASE k WHEN '1' THEN 'customer.tier' ELSE '' END AS missing, k NOT IN ('1', '2') AS changed,
       CASE k WHEN '1' THEN 'TEMPLATE_FIELD_MISSING' WHEN '2' THEN 'NO_PLACEHOLDERS_FOUND' END AS code, CASE k WHEN '1' THEN 'blocked' WHEN '2' THEN 'warning' ELSE 'pass' END AS readiness FROM f""")
def _(spark, sf):
    return templates.fill_report(templates.fill(_template_rows(spark, sf), _records(spark, sf)))


@query("validate_values", r"""
SELECT event_id AS record_id, event_type AS template_id, 'note' AS name, 'FIELD_MISSING' AS code, 'error' AS severity FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, event_type, 'k', 'FIELD_TYPE', 'error' FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, event_type, 'when', 'FIELD_TYPE', 'error' FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    """Event properties against per-type fields; the date of errors is not a date."""
    events = corpus.table(spark, sf, "events")
    kinds = events.select(F.col("event_type").alias("template_id")).distinct()
    field = lambda name, type_, required, default=F.lit(None): F.struct(
        F.lit(name).alias("name"), type_.alias("type"), F.lit(required).alias("required"), default.cast("string").alias("default_json"))
    is_view = F.when(F.col("template_id") == "view", "string").otherwise("number")
    fields = kinds.select("template_id", F.inline(F.array(
        field("k", is_view, True), field("note", F.lit("string"), True, F.when(F.col("template_id") == "click", '"n/a"')),
        field("when", F.lit("date"), False), field("tags", F.lit("list"), False, F.lit("[1]")))))
    date = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), date.alias("when")))
    return templates.validate_values(fields, events.select(F.col("event_id").alias("record_id"), F.col("event_type").alias("template_id"), body.alias("json")))


@query("rank_templates", r"""
WITH t AS (SELECT doc_id, lower(text) AS s, source || '-' || lang AS tag FROM documents),
q AS (SELECT item_id, lower(trim(text)) AS q, 'src' || item_id % 20 || '-en' AS tag, 'q' || item_id % 2 AS field FROM benchmark),
a AS (SELECT item_id, doc_id, 5 AS w FROM q JOIN t ON contains(s, q) UNION ALL SELECT item_id, doc_id, 3 FROM q JOIN t ON q.tag = t.tag
      UNION ALL SELECT item_id, doc_id, 2 FROM q JOIN labels ON field = 'q' || quality),
r AS (SELECT item_id, doc_id, CAST(sum(w) AS BIGINT) AS score, row_number() OVER (PARTITION BY item_id ORDER BY sum(w) DESC, doc_id) AS rank FROM a GROUP BY 1, 2)
SELECT item_id AS request_id, doc_id AS template_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    items = corpus.table(spark, sf, "benchmark")
    request = F.col("item_id").alias("request_id")
    ranked = templates.rank_templates(
        docs.select(F.col("doc_id").alias("template_id"), F.col("text").alias("search_text")),
        docs.select(F.col("doc_id").alias("template_id"), F.concat_ws("-", "source", "lang").alias("tag")),
        corpus.table(spark, sf, "labels").select(F.col("doc_id").alias("template_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("field")),
        items.select(request, F.col("text").alias("query")),
        items.select(request, F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string"), F.lit("-EN")).alias("tag")),
        items.select(request, F.concat(F.lit("Q"), (F.col("item_id") % 2).cast("string")).alias("field")),
        limit=10)
    return ranked


@query("map_fields", r"""
WITH c AS (SELECT p_brand AS t, p_name AS c, p_partkey AS pos, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS n FROM part),
f AS (SELECT DISTINCT p_brand AS t, regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z0-9]+', '', 'g') AS f FROM part WHERE p_size < 3),
h AS (SELECT t, c, pos, row_number() OVER (PARTITION BY t ORDER BY pos) AS rank FROM c WHERE EXISTS (SELECT 1 FROM f WHERE f.t = c.t AND (contains(n, f.f) OR contains(f.f, n))))
SELECT t AS template_id, c AS candidate, CAST(rank AS INT) AS rank FROM h WHERE rank <= 8""")
def _(spark, sf):
    part = corpus.table(spark, sf, "part")
    fields = part.filter(F.col("p_size") < 3).select(F.col("p_brand").alias("template_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("field"))
    return templates.map_fields(fields, part.select(F.col("p_brand").alias("template_id"), F.col("p_name").alias("candidate"), F.col("p_partkey").alias("position")))
