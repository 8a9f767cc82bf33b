"""Catalogue: verification, critique, corpus reports, headings and design statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import critique, design, headings, integrity, inventory, verification
from folioscope.plans.reading import DOC_LINES, LIST_TABLES, PAGE_NODES, UNESCAPE
from folioscope.plans.comparing import BOOKS, BOXES
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


# Event type -> issue code, so that every category occurs.
EVENT_CODES = {
    "error": "SECURITY_ZIP_UNSAFE", "view": "TEXT_OVERFLOW_RISK", "purchase": "NATIVE_RENDERER_NOT_RUN",
    "signup": "OFFICE_REPAIR_RISK_BROKEN_RELATIONSHIP", "click": "PPTX_TINY_TEXT",
}


def event_issues(spark, sf):
    """Events as issues: user = document, type = code, low values of errors block."""
    codes = F.create_map(*[F.lit(v) for pair in EVENT_CODES.items() for v in pair])
    return corpus.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), codes[F.col("event_type")].alias("code"),
        F.when((F.col("event_type") == "error") & (F.col("value") < 2), "error").otherwise("warning").alias("severity"),
        F.concat(codes[F.col("event_type")], F.lit(": "), F.col("event_id").cast("string")).alias("message"), "ts", "event_id")


ISSUES = "issues AS (SELECT user_id AS doc_id, c AS code, CASE WHEN event_type = 'error' AND value < 2 THEN 'error' ELSE 'warning' END AS severity, " \
    "c || ': ' || event_id AS message, ts, event_id FROM (SELECT *, CASE event_type " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CODES.items()) + " END AS c FROM events))"
SUMMARY = ISSUES + """,
summary AS (SELECT doc_id, code, count(*) AS issues, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity,
  CASE code WHEN 'SECURITY_ZIP_UNSAFE' THEN 'security' WHEN 'NATIVE_RENDERER_NOT_RUN' THEN 'environment'
            WHEN 'OFFICE_REPAIR_RISK_BROKEN_RELATIONSHIP' THEN 'compatibility' ELSE 'quality' END AS category,
  string_agg(message, ' | ' ORDER BY rn) FILTER (rn <= 3) AS examples
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY ts, event_id) AS rn FROM issues) GROUP BY 1, 2)"""


@query("summarize_issues", "WITH " + SUMMARY + " SELECT * FROM summary")
def _(spark, sf):
    return verification.summarize_issues(event_issues(spark, sf), ["ts", "event_id"])


@query("top_risks", "WITH " + SUMMARY + """
SELECT doc_id, code, position FROM (SELECT doc_id, code, CAST(row_number() OVER (
  PARTITION BY doc_id ORDER BY CASE severity WHEN 'error' THEN 3 ELSE 2 END DESC, issues DESC, code) AS INT) AS position FROM summary) WHERE position <= 3""")
def _(spark, sf):
    summary = verification.summarize_issues(event_issues(spark, sf), ["ts", "event_id"])
    return verification.top_risks(summary, 3).select("doc_id", "code", "position")


@query("worst_overflows", "WITH " + ISSUES + """
SELECT doc_id, message, CAST(p AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(message) DESC, message) AS p
  FROM issues WHERE code = 'TEXT_OVERFLOW_RISK') WHERE p <= 5""")
def _(spark, sf):
    return verification.worst_overflows(event_issues(spark, sf)).select("doc_id", "message", "position")


@query("evaluate_gates", r"""
WITH g AS (SELECT d.doc_id, d.text, quality, toxic, CAST(d.doc_id % 3 AS INT) AS pages, CAST(d.n_chars // 1000 AS INT) AS warnings FROM labels l JOIN documents d USING (doc_id))
SELECT doc_id, 'GATE_EXPECTED_PAGES' AS code, 'error' AS severity, NULL::VARCHAR AS text FROM g WHERE pages <> quality
UNION ALL SELECT doc_id, 'GATE_MAX_WARNINGS', 'error', NULL FROM g WHERE warnings > 2
UNION ALL SELECT doc_id, 'GATE_REQUIRED_TEXT_MISSING', 'error', w FROM g, (SELECT unnest(['the', 'e']) AS w) WHERE NOT contains(text, w)
UNION ALL SELECT doc_id, 'GATE_FORBIDDEN_TEXT_PRESENT', 'error', 'http' FROM g WHERE contains(text, 'http')""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    summary = docs.select("doc_id", F.lit(1).alias("slides"), (F.col("doc_id") % 3).cast("int").alias("pages"),
                          F.floor(F.col("n_chars") / 1000).cast("int").alias("warnings"), F.lit(0).alias("blank_pages"))
    gates = corpus.table(spark, sf, "labels").select(
        "doc_id", F.lit(None).cast("int").alias("expected_slides"), F.col("quality").alias("expected_pages"),
        F.array(F.lit("the"), F.lit("e")).alias("required_text"), F.array(F.lit("http")).alias("forbidden_text"),
        F.lit(2).alias("max_warnings"), F.lit(None).cast("int").alias("max_blank_pages"))
    return verification.evaluate_gates(summary, docs, gates)


@query("verify_score", "WITH " + SUMMARY + """
SELECT doc_id, CAST(b AS BIGINT) AS blocking, CAST(w AS BIGINT) AS warnings, round(greatest(0.0, round(1 - least(0.85, b * 0.35) - p, 8)), 2) AS score,
  CASE WHEN b > 0 THEN 'blocked' WHEN q THEN 'warning' WHEN w > 0 THEN 'pass_with_environment_gap' ELSE 'pass' END AS readiness
FROM (SELECT doc_id, (SELECT count(*) FROM issues i WHERE i.doc_id = s.doc_id AND severity = 'error') AS b,
             (SELECT count(*) FROM issues i WHERE i.doc_id = s.doc_id AND severity <> 'error') AS w,
             sum(CASE WHEN category = 'environment' THEN 0.01::DOUBLE ELSE least(0.16::DOUBLE, issues * 0.04::DOUBLE) END) AS p,
             bool_or(severity = 'warning' AND category <> 'environment') AS q FROM summary s GROUP BY doc_id)""")
def _(spark, sf):
    return verification.verify_score(event_issues(spark, sf))


def _page_packages(spark, sf):
    return corpus.page_parts(spark, sf).select("doc_id", "format")


def _list_cells(spark, sf):
    return textnodes.table_cells(corpus.page_parts(spark, sf), ("ul", "li", "a"), ("a",))


HINTS = r"""
t AS (SELECT doc_id, count(*) AS texts, arg_min(length(text), idx) FILTER (length(text) > 1400) AS characters FROM page_nodes GROUP BY 1),
w AS (SELECT doc_id, max(length(c)) AS widest FROM (SELECT doc_id, unnest(flatten(rows)) AS c FROM list_tables) GROUP BY 1),
m AS (SELECT page_id AS doc_id, texts, characters, widest, html FROM pages LEFT JOIN t ON t.doc_id = page_id LEFT JOIN w ON w.doc_id = page_id),
hints AS (
SELECT doc_id, NULL::INT AS characters, 'OOXML_EMPTY_CONTENT_HINT' AS code, 'warning' AS severity FROM m WHERE texts IS NULL AND widest IS NULL
UNION ALL SELECT doc_id, CAST(characters AS INT), 'TEXT_OVERFLOW_HINT', 'warning' FROM m WHERE characters IS NOT NULL
UNION ALL SELECT doc_id, NULL, 'TABLE_CELL_OVERFLOW_HINT', 'warning' FROM m WHERE widest > 140)"""


@query("content_hints", "WITH " + PAGE_NODES + "," + LIST_TABLES + "," + HINTS + " SELECT * FROM hints")
def _(spark, sf):
    return verification.content_hints(_page_packages(spark, sf), corpus.page_objects(spark, sf), _list_cells(spark, sf))


def verify_pages(spark, sf):
    """Which pages fail or carry warnings: entities, external addresses, content hints."""
    parts = corpus.page_parts(spark, sf)
    hints = verification.content_hints(_page_packages(spark, sf), corpus.page_objects(spark, sf), _list_cells(spark, sf))
    return verification.verify(_page_packages(spark, sf), hints, integrity.entity_declarations(parts), integrity.unsafe_names(parts))


QUERIES["verify_pages"] = verify_pages
SQL["verify_pages"] = "WITH " + PAGE_NODES + "," + LIST_TABLES + "," + HINTS + r""",
i AS (SELECT doc_id, code, severity FROM hints
      UNION ALL SELECT page_id, 'ZIP_XML_ENTITY_DENIED', 'error' FROM pages WHERE regexp_matches(html, '(?i)<!DOCTYPE|<!ENTITY')
      UNION ALL SELECT page_id, 'ZIP_SLIP_ENTRY', 'error' FROM pages WHERE regexp_matches(url, '(^|[/\\])\.\.([/\\]|$)'))
SELECT page_id AS doc_id, count(code) FILTER (severity = 'error') AS errors, count(code) FILTER (severity = 'warning') AS warnings,
       coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes,
       CASE WHEN count(code) FILTER (severity = 'error') > 0 THEN 'fail' ELSE 'pass_with_environment_gap' END AS status
FROM pages LEFT JOIN i ON i.doc_id = page_id GROUP BY page_id"""


HEIGHT = r"""(greatest(list_sum(list_transform(regexp_split_to_array({text}, '\r?\n'),
   lambda l: greatest(1, ceil(length(l) / greatest(8, floor(greatest(48.0, {w}) / greatest(4.5, greatest(8.0, {pt} * 1.333) * 0.52))))))), {par})
   * greatest(8.0, {pt} * 1.333) * 1.22 + greatest(0, {par} - 1) * greatest(8.0, {pt} * 1.333) * 0.28 + 8)"""


@query("overflow_risk", r"""
WITH o AS (SELECT doc_id, text, CAST(200 + doc_id % 5 * 100 AS DOUBLE) AS w, n_chars / 4.0 AS h,
                  list_sort([10.0 + doc_id % 3, 12.0, 18.0])[2] AS pt, len(string_split(text, chr(10))) AS par FROM documents WHERE regexp_matches(text, '\S')),
m AS (SELECT *, """ + HEIGHT.format(text="text", w="w", pt="pt", par="par") + r""" AS eh FROM o)
SELECT doc_id, CAST(doc_id AS VARCHAR) AS object_id, 'TEXT_OVERFLOW_RISK' AS code, 'warning' AS severity,
       CASE WHEN eh > h * 1.15 THEN 'height' ELSE 'length' END AS reason, CAST(length(text) AS INT) AS text_length, CAST(pt AS DOUBLE) AS font_pt,
       CASE WHEN eh > h * 1.15 THEN round(eh, 1) END AS estimated_height, substr(text, 1, 219) || '…' AS suggested_text
FROM m WHERE eh > h * 1.15 OR length(text) > 220""")
def _(spark, sf):
    return verification.overflow_risk(_document_objects(spark, sf))


def _document_objects(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("object_id"), "text", F.lit("shape").alias("kind"),
        (F.lit(200) + F.col("doc_id") % 5 * 100).cast("double").alias("w"), (F.col("n_chars") / 4).alias("h"),
        F.array(F.lit(10.0) + F.col("doc_id") % 3, F.lit(12.0), F.lit(18.0)).alias("font_sizes"),
        F.size(F.split("text", "\n", -1)).alias("paragraphs"))


BODY_LINES = r"""
body AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda l, i: {'l': l, 'i': i - 1}), lambda s: s.l <> '') AS ls FROM conversations),
stats AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text, len(ls) AS par, list_min(list_transform(ls, lambda s: 8 + s.i % 5 * 2)) AS smallest,
                 list_sort(list_transform(ls, lambda s: 8.0 + s.i % 5 * 2))[len(ls) // 2 + 1] AS pt,
                 len(list_filter(ls, lambda s: length(s.l) > 80)) AS long FROM body)"""


@query("layout_lint", "WITH " + BODY_LINES + r"""
SELECT conv_id AS doc_id, 'ppt/slides/slide' || (turn + 1) || '.xml' AS part, 1 AS shape, code, 'warning' AS severity FROM (
  SELECT conv_id, turn, 'PPTX_TINY_TEXT' AS code FROM stats WHERE smallest < 9 AND regexp_matches(text, '\S')
  UNION ALL SELECT conv_id, turn, 'PPTX_OBJECT_OFF_SLIDE' FROM stats WHERE false
  UNION ALL SELECT conv_id, turn, 'PPTX_TEXT_OVERFLOW_ESTIMATE' FROM stats WHERE regexp_matches(text, '\S') AND """
       + HEIGHT.format(text="text", w="864", pt="pt", par="par") + r""" > 475 * 1.15)
UNION ALL SELECT conv_id, 'ppt/slides/slide' || (turn + 1) || '.xml', k, 'PPTX_OBJECT_OFF_SLIDE', 'warning' FROM conversations, (SELECT unnest([1]) AS k) WHERE 168 + 475 > 541""")
def _(spark, sf):
    parts = corpus.pptx_parts(spark, sf)
    objects = inventory.slide_objects(parts)
    return verification.layout_lint(objects, textnodes.runs(parts))


@query("slide_density", r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE turn % 6 <> 5),
s AS (SELECT conv_id, turn, count(*) AS n, sum(length(line)) AS c FROM l WHERE regexp_matches(line, '\S') GROUP BY 1, 2)
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS slide, 'PPTX_SLIDE_DENSITY_HIGH' AS code, 'warning' AS severity FROM s WHERE n > 18 OR c > 950
UNION ALL SELECT conv_id, NULL, 'PPTX_BLANK_SLIDE_RISK', 'warning' FROM conversations c GROUP BY conv_id
HAVING count(*) > 1 AND count(*) > (SELECT count(*) FROM s WHERE s.conv_id = c.conv_id)""")
def _(spark, sf):
    turns = corpus.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("slide"), "turn", "text")
    objects = turns.filter(F.col("turn") % 6 != 5).select("doc_id", "slide", F.explode(F.split("text", "\n")).alias("text"))
    return verification.slide_density(objects, turns)


@query("diagnose", r"""
SELECT doc_id, 'TEXT_OVERFLOW_RISK' AS code, 'warning' AS severity, CAST(doc_id AS VARCHAR) AS object_id, 'setText' AS suggested_op FROM documents
WHERE doc_id % 17 <> 0 AND length(text) > 220 AND regexp_matches(text, '\S')
UNION ALL SELECT doc_id, 'MACRO_PRESENT', 'warning', NULL, NULL FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'NO_TEXT_OBJECTS', 'info', NULL, NULL FROM documents WHERE doc_id % 17 = 0
UNION ALL SELECT doc_id, 'OPC_REQUIRED_PART_MISSING', 'error', NULL, NULL FROM documents WHERE doc_id % 9 = 0""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    packages = docs.select("doc_id", F.lit("docx").alias("format"))
    objects = _document_objects(spark, sf).filter(F.col("doc_id") % 17 != 0).withColumn("h", F.lit(None).cast("double"))
    macros = integrity.risky_parts(docs.filter(F.col("doc_id") % 4 == 0).select("doc_id", F.concat("source", F.lit("/vbaProject.bin")).alias("part")))
    parts = corpus.docx_parts(spark, sf).filter(~((F.col("part") == "word/document.xml") & (F.col("doc_id") % 9 == 0)))
    return verification.diagnose(packages, objects, verification.overflow_risk(objects), macros, integrity.required_parts(parts, packages))


DECK_FINDINGS = BODY_LINES + r""",
deck AS (SELECT c.conv_id AS doc_id, count(*) AS slides, count(DISTINCT role) AS roles, bool_or(smallest < 9) AS tiny, bool_or(long > 0) AS long
         FROM conversations c JOIN stats s ON s.conv_id = c.conv_id AND s.turn = c.turn GROUP BY 1),
findings AS (
SELECT doc_id, 'PPTX_ASSETS_NONE' AS code, 'warning' AS severity FROM deck WHERE slides > 1
UNION ALL SELECT doc_id, 'PPTX_CHARTS_NONE', 'warning' FROM deck
UNION ALL SELECT doc_id, 'PPTX_DUPLICATE_TITLES', 'warning' FROM deck WHERE roles < slides
UNION ALL SELECT doc_id, 'PPTX_VISUAL_ANCHOR_LOW', 'warning' FROM deck WHERE slides > 2
UNION ALL SELECT doc_id, 'PPTX_FONT_TOO_SMALL', 'warning' FROM deck WHERE tiny
UNION ALL SELECT doc_id, 'PPTX_BULLET_TOO_LONG', 'warning' FROM deck WHERE long
UNION ALL SELECT doc_id, 'PPTX_OBJECT_OFF_SLIDE', 'warning' FROM deck
UNION ALL SELECT DISTINCT conv_id, 'PPTX_TEXT_OVERFLOW_ESTIMATE', 'warning' FROM stats WHERE regexp_matches(text, '\S') AND """ + HEIGHT.format(text="text", w="864", pt="pt", par="par") + r""" > 475 * 1.15
UNION ALL SELECT DISTINCT conv_id, 'PPTX_SLIDE_DENSITY_HIGH', 'warning' FROM conversations
  WHERE length(role) + CASE WHEN regexp_matches(text, '\S') THEN length(text) ELSE 0 END > 950)"""


@query("critique_decks", "WITH " + DECK_FINDINGS + " SELECT * FROM findings")
def _(spark, sf):
    return critique.critique(critique.deck_metrics(corpus.pptx_parts(spark, sf)), "pptx")


@query("improvement_plan", "WITH " + DECK_FINDINGS + """
SELECT doc_id, code AS finding_code, severity, CASE code WHEN 'PPTX_ASSETS_NONE' THEN 'pptx.replaceImageByShape' WHEN 'PPTX_CHARTS_NONE' THEN 'pptx.updateChartData'
  WHEN 'PPTX_FONT_TOO_SMALL' THEN 'pptx.setText' WHEN 'PPTX_BULLET_TOO_LONG' THEN 'pptx.setText'
  WHEN 'PPTX_OBJECT_OFF_SLIDE' THEN 'pptx.setText' WHEN 'PPTX_TEXT_OVERFLOW_ESTIMATE' THEN 'pptx.setText' WHEN 'PPTX_SLIDE_DENSITY_HIGH' THEN 'pptx.setText' END AS skeleton_op, true AS dry_run_only FROM findings""")
def _(spark, sf):
    return verification.improvement_plan(critique.critique(critique.deck_metrics(corpus.pptx_parts(spark, sf)), "pptx"))


BOOK_FINDINGS = BOOKS + """,
findings AS (SELECT doc_id, 'XLSX_DASHBOARD_CHARTS_NONE' AS code, 'warning' AS severity FROM books WHERE NOT charted
UNION ALL SELECT doc_id, 'XLSX_TABLES_NONE', 'warning' FROM books WHERE NOT tabled
UNION ALL SELECT doc_id, 'XLSX_FORMULAS_NONE', 'info' FROM books WHERE formulas = 0
UNION ALL SELECT doc_id, 'XLSX_WIDE_SHEET_READABILITY_RISK', 'warning' FROM books WHERE cells > 250)"""


@query("critique_workbooks", "WITH " + BOOK_FINDINGS + " SELECT * FROM findings")
def _(spark, sf):
    return critique.critique(inventory.workbook_map(corpus.review_books(spark, sf)), "xlsx")


@query("critique_profile", "WITH " + BOOK_FINDINGS + " SELECT * FROM findings WHERE code <> 'XLSX_DASHBOARD_CHARTS_NONE'")
def _(spark, sf):
    """A profile that does not ask for charts."""
    return critique.critique(inventory.workbook_map(corpus.review_books(spark, sf)), "xlsx", "archive")


@query("critique_score", "WITH " + BOOK_FINDINGS + """,
p AS (SELECT doc_id, sum(CASE severity WHEN 'warning' THEN 0.12::DOUBLE ELSE 0.03::DOUBLE END) AS p, count(*) AS n FROM findings GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS findings, round(greatest(0.0, round(1 - coalesce(p, 0), 8)), 2) AS score, CASE WHEN n > 0 THEN 'warning' ELSE 'pass' END AS readiness
FROM books LEFT JOIN p USING (doc_id)""")
def _(spark, sf):
    books = inventory.workbook_map(corpus.review_books(spark, sf))
    return verification.critique_score(books, critique.critique(books, "xlsx"))


LEVELS = "CAST(1 + turn // 2 % 2 * 2 AS INT)"
TITLES = "'part ' || turn // 2"


def _turn_headings(spark, sf):
    pair = F.floor(F.col("turn") / 2)
    level = (1 + pair % 2 * 2).cast("int")
    return corpus.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), level.alias("level"), F.concat(F.lit("part "), pair.cast("string")).alias("text"))


HEADS = f"""
h AS (SELECT conv_id AS doc_id, turn AS idx, {LEVELS} AS level, {TITLES} AS text, lag({LEVELS}) OVER w AS pl, lag({TITLES}) OVER w AS pt
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query("repeated_headings", "WITH " + HEADS + " SELECT doc_id, idx, level, text FROM h WHERE level = pl AND text = pt")
def _(spark, sf):
    return headings.repeated_headings(_turn_headings(spark, sf), width=3)


@query("heading_jumps", "WITH " + HEADS + " SELECT doc_id, idx, pl AS prev_level, level FROM h WHERE level - pl > 1")
def _(spark, sf):
    return headings.heading_jumps(_turn_headings(spark, sf), width=3)


@query("critique_documents", "WITH " + HEADS + """,
d AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)
SELECT DISTINCT doc_id, 'DOCX_REPEATED_HEADINGS' AS code, 'warning' AS severity FROM h WHERE level = pl AND text = pt AND doc_id % 7 <> 3
UNION ALL SELECT doc_id, 'DOCX_HEADERS_NONE', 'info' FROM d WHERE doc_id % 2 = 1
UNION ALL SELECT DISTINCT doc_id, 'DOCX_HEADING_HIERARCHY_GAP', 'warning' FROM h WHERE level - pl > 1 AND doc_id % 7 <> 3
UNION ALL SELECT doc_id, 'DOCX_EMPTY_SECTION', 'warning' FROM d WHERE doc_id % 7 = 3
UNION ALL SELECT doc_id, 'DOCX_TABLE_WIDTH_RISK', 'warning' FROM d WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 'DOCX_STYLE_VARIETY_LOW', 'info' FROM d WHERE doc_id % 3 = 1""")
def _(spark, sf):
    return critique.critique(critique.document_metrics(corpus.review_reports(spark, sf)), "docx")


@query("repair_taxonomy", "WITH " + ISSUES + r""",
r AS (SELECT doc_id, code, CASE code WHEN 'SECURITY_ZIP_UNSAFE' THEN 'security' WHEN 'OFFICE_REPAIR_RISK_BROKEN_RELATIONSHIP' THEN 'compatibility'
             WHEN 'NATIVE_RENDERER_NOT_RUN' THEN 'environment' ELSE 'quality' END AS category, severity,
             code = 'TEXT_OVERFLOW_RISK' AND event_id % 50 = 0 AS auto_repairable FROM issues)
SELECT * FROM r UNION ALL
SELECT doc_id, 'REPAIR_NO_SAFE_OPS', 'compatibility', CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END, false
FROM r GROUP BY doc_id HAVING NOT bool_or(auto_repairable)""")
def _(spark, sf):
    fixable = (F.col("code") == "TEXT_OVERFLOW_RISK") & (F.col("event_id") % 50 == 0)
    return verification.repair_taxonomy(event_issues(spark, sf), fixable)


@query("corpus_report", r"""
WITH r AS (SELECT d.doc_id, coalesce(quality, 0) = 1 AS ok, CASE WHEN quality IS NULL THEN 'no label' WHEN quality = 0 THEN 'low quality, toxic ' || toxic END AS error
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS documents, count(*) FILTER (ok) AS ok_count, count(*) FILTER (NOT ok) AS failed_count,
  CASE WHEN count(*) FILTER (ok) = count(*) THEN 'pass' WHEN count(*) FILTER (ok) = 0 THEN 'blocked' ELSE 'warning' END AS readiness,
  CASE WHEN count(*) FILTER (ok) = count(*) THEN 'complete' WHEN count(*) FILTER (ok) = 0 THEN 'missing_or_unreadable' ELSE 'partial' END AS corpus_status,
  (SELECT string_agg(error, ' | ' ORDER BY first) FROM (SELECT error, min(doc_id) AS first FROM r WHERE NOT ok GROUP BY 1 ORDER BY 2 LIMIT 8)) AS errors
FROM r""")
def _(spark, sf):
    joined = corpus.table(spark, sf, "documents").join(corpus.table(spark, sf, "labels"), "doc_id", "left")
    error = F.when(F.col("quality").isNull(), "no label").when(
        F.col("quality") == 0, F.concat(F.lit("low quality, toxic "), F.col("toxic").cast("string")))
    return verification.corpus_report(joined.select(
        "doc_id", (F.coalesce("quality", F.lit(0)) == 1).alias("ok"), error.alias("error"), F.col("doc_id").alias("position")))


@query("compare_runs", r"""
WITH b AS (SELECT avg((n_chars % 100) / 100.0::DOUBLE) AS m, count(*) FILTER (n_chars > 1000) AS ok FROM documents WHERE doc_id % 7 <> 0),
a AS (SELECT avg((n_chars % 100) / 100.0::DOUBLE) AS m, count(*) FILTER (n_chars > 1000) AS ok FROM documents WHERE doc_id % 11 <> 0)
SELECT round(b.m, 4) AS before_score, b.ok AS before_ok, round(a.m, 4) AS after_score, a.ok AS after_ok, round(round(a.m, 4) - round(b.m, 4), 4) AS delta FROM a, b""")
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 100 / 100).alias("score"), (F.col("n_chars") > 1000).alias("ok"))
    return verification.compare_runs(docs.filter(F.col("doc_id") % 7 != 0), docs.filter(F.col("doc_id") % 11 != 0))


@query("page_quality", r"""
WITH p AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 6 <> 5 AND role <> 'system' THEN sha256(text) END AS digest FROM conversations),
g AS (SELECT doc_id, digest, count(*) AS n FROM p WHERE digest IS NOT NULL GROUP BY 1, 2)
SELECT p.doc_id, count(*) AS pages, count(*) FILTER (digest IS NULL) AS blank_pages,
       CAST(coalesce((SELECT sum(n) FROM g WHERE g.doc_id = p.doc_id AND n > 1), 0) AS BIGINT) AS identical_pages,
       count(*) > 1 AND coalesce((SELECT max(n) FROM g WHERE g.doc_id = p.doc_id), 0) = count(*) AS all_identical
FROM p GROUP BY p.doc_id""")
def _(spark, sf):
    pages = corpus.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text")
    objects = pages.filter((F.col("page") % 6 != 5) & (F.col("role") != "system")).select("doc_id", "page", F.lit(0).alias("idx"), "text")
    return verification.page_quality(objects, pages)


# --- H: titles --------------------------------------------------------------------------


@query("doc_titles", r"""
SELECT page_id AS doc_id, CASE page_id % 3 WHEN 2 THEN 'Untitled' ELSE """ + UNESCAPE.format(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + r""" END AS title FROM pages""")
def _(spark, sf):
    meta = inventory.page_metadata(corpus.page_parts(spark, sf))
    kind = F.col("doc_id") % 3
    ir = F.when(kind == 0, F.to_json(F.struct("title"))).when(kind == 1, F.to_json(F.struct(F.struct("title").alias("metadata")))).otherwise(
        F.to_json(F.struct(F.lit(7).alias("title"))))
    return headings.doc_titles(meta.select("doc_id", ir.alias("ir")))


@query("slide_titles", "SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS slide, role AS title FROM conversations")
def _(spark, sf):
    parts = corpus.pptx_parts(spark, sf)
    return headings.slide_titles(inventory.slide_objects(parts, inventory.slide_numbers(parts)))


# --- K: design ---------------------------------------------------------------------------


def _color_parts(spark, sf, condition=None):
    li = corpus.table(spark, sf, "lineitem")
    li = li.filter(condition) if condition is not None else li
    return li.select(
        F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("ppt/slides/slide"), F.col("l_linenumber").cast("string"), F.lit(".xml")).alias("part"),
        F.concat(F.lit('<a:solidFill><a:srgbClr val="'), F.lpad(F.lower(F.hex(F.col("l_partkey") % 13 * 1000)), 6, "0"), F.lit('"/></a:solidFill>')).alias("xml"))


COLORS = r"""
c AS (SELECT l_suppkey AS doc_id, 'ppt/slides/slide' || l_linenumber || '.xml' AS part, '#' || upper(lpad(to_hex(l_partkey % 13 * 1000), 6, '0')) AS color,
             l_returnflag, l_linestatus FROM lineitem)"""


@query("colors", "WITH " + COLORS + r"""
SELECT doc_id, color, count(*) AS uses, (SELECT string_agg(part, ',' ORDER BY part) FROM (SELECT DISTINCT part FROM c i WHERE i.doc_id = c.doc_id AND i.color = c.color ORDER BY part LIMIT 6)) AS sources
FROM c GROUP BY 1, 2""")
def _(spark, sf):
    return design.colors(_color_parts(spark, sf))


@query("color_roles", "WITH " + COLORS + r""",
allc AS (SELECT doc_id, color, count(*) AS n FROM c GROUP BY 1, 2),
bg AS (SELECT doc_id, color FROM (SELECT doc_id, color, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, color) AS r FROM c WHERE l_returnflag = 'R' AND doc_id % 2 = 0 GROUP BY 1, 2) WHERE r = 1),
tx AS (SELECT doc_id, color FROM (SELECT doc_id, color, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, color) AS r FROM c WHERE l_linestatus = 'F' GROUP BY 1, 2) WHERE r = 1),
b AS (SELECT doc_id, color, 0.82::DOUBLE AS confidence FROM bg UNION ALL
      SELECT doc_id, color, 0.45 FROM (SELECT doc_id, color, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, color) AS r FROM allc) WHERE r = 1 AND doc_id NOT IN (SELECT doc_id FROM bg)),
u AS (SELECT doc_id, color FROM b UNION SELECT doc_id, color FROM tx)
SELECT doc_id, color, confidence, 'background' AS role FROM b UNION ALL SELECT doc_id, color, 0.72, 'text' FROM tx UNION ALL
SELECT doc_id, color, 0.55, 'accent' FROM (SELECT doc_id, color, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, color) AS r FROM allc ANTI JOIN u USING (doc_id, color)) WHERE r <= 3""")
def _(spark, sf):
    counts = design.color_counts(_color_parts(spark, sf))
    background = design.color_counts(_color_parts(spark, sf, (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0)))
    text = design.color_counts(_color_parts(spark, sf, F.col("l_linestatus") == "F"))
    return design.color_roles(counts, background, text)


@query("size_buckets", """
SELECT p_brand AS doc_id, m AS min_pt, count(*) AS uses, m + 3 AS max_pt FROM (SELECT p_brand, CAST(floor(p_size / 4) * 4 AS INT) AS m FROM part WHERE p_size > 0) GROUP BY 1, 2""")
def _(spark, sf):
    return design.size_buckets(corpus.table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("size_pt")))


@query("classify_slides", r"""
WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber, l_quantity / 100 AS w, l_discount * 5 AS h,
                  CASE WHEN l_partkey % 40 = 0 THEN 'chart' WHEN l_partkey % 40 = 1 THEN 'diagram' WHEN l_returnflag = 'R' THEN 'picture' ELSE 'text' END AS kind, l_quantity AS q FROM lineitem),
g AS (SELECT doc_id, 1 AS slide, sum(w * h) AS area, sum(q) AS chars, count(*) FILTER (kind = 'text') AS t, count(*) FILTER (kind = 'picture') AS p,
             count(*) FILTER (kind = 'chart') AS c, count(*) FILTER (kind = 'diagram') AS d, bool_or(l_linenumber = 1) AS titled FROM s GROUP BY 1),
z AS (SELECT *, floor(least(1.0::DOUBLE, round(area * 0.7::DOUBLE + least(1.0::DOUBLE, chars / 1200) * 0.3::DOUBLE, 9)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS density FROM g)
SELECT doc_id, slide, density, CASE WHEN c > 0 THEN 'chart' WHEN d > 0 THEN 'diagram' WHEN p > 0 AND t <= 1 THEN 'image' WHEN t = 0 AND p = 0 THEN 'blank'
  WHEN titled AND t = 1 THEN 'title' WHEN titled AND t >= 2 THEN 'title-body' WHEN density < 0.2 THEN 'section' ELSE 'mixed' END AS type FROM z""")
def _(spark, sf):
    kind = (F.when(F.col("l_partkey") % 40 == 0, "chart").when(F.col("l_partkey") % 40 == 1, "diagram")
            .when(F.col("l_returnflag") == "R", "picture").otherwise("text"))
    return design.classify_slides(corpus.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("slide"), (F.col("l_quantity") / 100).alias("w"), (F.col("l_discount") * 5).alias("h"),
        kind.alias("kind"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"), (F.col("l_linenumber") == 1).alias("is_title")))


@query("bbox_patterns", "WITH " + BOXES + r""",
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'title' THEN 0 ELSE 1 END, CASE kind WHEN 'title' THEN 0 ELSE y END, object_id) AS r FROM boxes),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -w * h, object_id) AS r2 FROM t WHERE r > 1),
p AS (SELECT doc_id, 'title' AS role, x, y, w, h FROM t WHERE r = 1 UNION ALL SELECT doc_id, 'body', x, y, w, h FROM b WHERE r2 = 1
      UNION ALL SELECT doc_id, 'image', x, y, w, h FROM boxes WHERE kind = 'image')
SELECT doc_id, role, count(*) AS boxes, floor(avg(x) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS x , floor(avg(y) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS y , floor(avg(w) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS w , floor(avg(h) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS h FROM p GROUP BY 1, 2""")
def _(spark, sf):
    return design.bbox_patterns(corpus.boxes(spark, sf))


FIELD = r"regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("infer_fields", "WITH " + DOC_LINES + r""",
l AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM doc_lines),
n AS (SELECT doc_id, """ + FIELD.format("regexp_replace(t, '[:：]$', '')") + r""" AS field,
             CASE WHEN regexp_matches(text, '\{\{[^}]+\}\}') THEN 0.9::DOUBLE WHEN regexp_matches(text, '[:：]\s*$') THEN 0.75 WHEN length(text) <= 32 THEN 0.6 ELSE 0.35 END AS confidence, t FROM l),
b AS (SELECT doc_id, field, max(confidence) AS confidence FROM n WHERE length(t) BETWEEN 2 AND 80 AND regexp_matches(field, '^[a-z]') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, field) AS rn FROM b)
SELECT doc_id, field, CASE WHEN regexp_matches(field, '\bchart\b') THEN 'chartData' WHEN regexp_matches(field, '\b(table|rows|matrix)\b') THEN 'table'
  WHEN regexp_matches(field, '^(is|has|can|should|enabled|active)(_|$)') THEN 'boolean'
  WHEN list_has_any(string_split(field, '_'), ['amount','price','revenue','sales','count','number','score','rate','ratio','percent','total','qty','quantity']) THEN 'number'
  WHEN confidence >= 0.7 AND list_has_any(string_split(field, '_'), ['date','day','month','year','deadline']) AND NOT list_has_any(string_split(field, '_'), ['title','name','headline']) THEN 'date'
  WHEN list_has_any(string_split(field, '_'), ['created','modified','updated']) AND list_contains(string_split(field, '_'), 'at') THEN 'date' ELSE 'string' END AS type,
  confidence >= 0.7 AS required, confidence FROM r WHERE rn <= 24""")
def _(spark, sf):
    return design.infer_fields(corpus.document_lines(spark, sf))


