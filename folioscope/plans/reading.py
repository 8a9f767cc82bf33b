"""Catalogue: sources, projections, inventories and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.cellref import col_to_letters, make_ref, ref_col, ref_row
from folioscope.functions.text import fnv1a, normalize_text
from folioscope.functions.xml import xml_escape, xml_unescape
from folioscope.operators import inventory, projection, stories
from folioscope.sources import corpus, packages, pdf, relationships, sheets, textnodes

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Shared SQL fragments. They restate the corpus adapters on the driver tables.
UNESCAPE = "replace(replace(replace(replace({0},'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&amp;','&')"
PAGE_NODES = r"""
page_nodes AS (
  SELECT page_id AS doc_id, url AS part, idx, """ + UNESCAPE.format("raw") + r""" AS text
  FROM (SELECT page_id, url, unnest(nodes) AS raw, generate_subscripts(nodes, 1) - 1 AS idx
        FROM (SELECT page_id, url,
                     regexp_extract_all(html, '(?s)<(?:p|h1|a|li)(?:\s[^>]*)?>(.*?)</(?:p|h1|a|li)>', 1) AS nodes
              FROM pages))
  WHERE regexp_matches(raw, '\S'))"""
DOC_LINES = r"""
doc_lines AS (
  SELECT doc_id, CAST(idx AS BIGINT) AS idx, line AS text
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS idx
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
  WHERE regexp_matches(line, '\S'))"""
ORDER_CELLS = r"""
order_cells AS (
  SELECT doc_id, sheet_idx, "row", u.col AS col, u.value AS value,
         'Line ' || sheet_idx AS sheet_name, chr(CAST(64 + u.col AS INT)) || "row" AS ref
  FROM (SELECT l_orderkey AS doc_id, l_linenumber AS sheet_idx, CAST(l_suppkey % 50 + 1 AS INT) AS "row",
               unnest([{'col': 1, 'value': CAST(CAST(l_quantity AS INT) AS VARCHAR)},
                       {'col': 2, 'value': CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)},
                       {'col': 3, 'value': CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR)},
                       {'col': 4, 'value': l_returnflag}, {'col': 5, 'value': l_linestatus}]) AS u
        FROM lineitem))"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# --- S: sources ---------------------------------------------------------------------


@query("scan_packages", """
SELECT doc_id, 'docx' AS format, octet_length(encode(text)) AS byte_len, sha256(text) AS sha256 FROM documents""")
def _(spark, sf):
    return corpus.packages(spark, sf)


@query("pack_and_shred", r"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'ppt/slides/slide' || (turn + 1) || '.xml' AS part, CAST(turn + 4 AS INT) AS ord,
       text_nodes, body_chars
FROM (SELECT conv_id AS doc_id, turn, CAST(1 + len(string_split(text, chr(10))) AS INT) AS text_nodes,
             CAST(length(replace(text, chr(10), '')) AS INT) AS body_chars FROM conversations)""")
def _(spark, sf):
    """Slides zipped into packages and read back from the bytes."""
    parts = packages.readable(packages.shred(packages.pack(corpus.pptx_parts(spark, sf))))
    texts = F.transform(textnodes.matches("xml", r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>", 1), lambda t: xml_unescape(t))
    body = F.array_join(F.slice(texts, F.lit(2), F.size(texts)), "")
    return parts.filter(F.col("part").startswith("ppt/slides/slide")).select(
        "doc_id", "part", "ord", F.size(texts).alias("text_nodes"), F.length(body).alias("body_chars"))


@query("shredded_digests", r"""
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(5 + max(turn) AS BIGINT) AS parts, 0 AS changed
FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    """Digest of every part after zip and unzip equals the digest before."""
    before = corpus.pptx_parts(spark, sf)
    after = packages.readable(packages.shred(packages.pack(before))).select("doc_id", "part", "sha256")
    kept = before.select(F.col("doc_id").cast("string").alias("doc_id"), "part", F.sha2("xml", 256).alias("was"))
    return kept.join(after, ["doc_id", "part"], "full_outer").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum(F.when(F.col("was").eqNullSafe(F.col("sha256")), 0).otherwise(1)).cast("int").alias("changed"))


@query("page_links", r"""
SELECT page_id AS doc_id, pos, href AS target, CASE WHEN starts_with(href, '/') THEN substr(href, 2) ELSE href END AS resolved
FROM (SELECT page_id, unnest(h) AS href, CAST(generate_subscripts(h, 1) - 1 AS INT) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages))""")
def _(spark, sf):
    links = corpus.page_parts(spark, sf).select(
        "doc_id", F.posexplode(textnodes.matches("xml", r'<a\s[^>]*href="([^"]*)"', 1)).alias("pos", "target"))
    return links.withColumn("resolved", F.when(F.col("target").startswith("/"), relationships.resolve_target(F.lit(""), "target"))
                            .otherwise(F.col("target")))


@query("relationships", r"""
SELECT conv_id AS doc_id, 'ppt/_rels/presentation.xml.rels' AS rels_part, 'ppt/presentation.xml' AS owner,
       'rId' || (n + 1) AS rel_id, 'slide' AS type, 'slides/slide' || (n + 1) || '.xml' AS target, false AS external,
       'ppt/slides/slide' || (n + 1) || '.xml' AS resolved
FROM (SELECT conv_id, unnest(range(0, max(turn) + 1)) AS n FROM conversations GROUP BY conv_id)
UNION ALL
SELECT DISTINCT conv_id, '_rels/.rels', '', 'rId1', 'officeDocument', 'ppt/presentation.xml', false, 'ppt/presentation.xml'
FROM conversations""")
def _(spark, sf):
    return relationships.relationships(corpus.pptx_parts(spark, sf)).drop("pos", "target_mode")


@query("page_text_objects", "WITH " + PAGE_NODES + r"""
SELECT doc_id, part, CAST(idx AS INT) AS idx, text, 'html:' || substr(sha256('html' || part || idx), 1, 16) AS object_id FROM page_nodes""")
def _(spark, sf):
    return corpus.page_objects(spark, sf)


@query("package_text_objects", r"""
SELECT doc_id, part, CAST(idx AS INT) AS idx, text, 'docx:' || substr(sha256('docx' || part || idx), 1, 16) AS object_id
FROM (SELECT doc_id, 'word/document.xml' AS part, unnest(runs) AS text, generate_subscripts(runs, 1) - 1 AS idx
      FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda line:
              list_transform(string_split(line, '. '), lambda s, i: s || CASE WHEN i < len(string_split(line, '. ')) THEN '. ' ELSE '' END))) AS runs
            FROM documents))
WHERE regexp_matches(text, '\S')""")
def _(spark, sf):
    return textnodes.text_objects(corpus.docx_parts(spark, sf)).drop("format")


LIST_TABLES = r"""
list_tables AS (
  SELECT doc_id, tbl, tindex,
         list_filter(list_transform(regexp_extract_all(tbl, '(?s)<li(?:\s[^>]*)?>.*?</li>', 0),
           lambda r: list_transform(regexp_extract_all(r, '(?s)<a(?:\s[^>]*)?>.*?</a>', 0),
                lambda c: """ + UNESCAPE.format(r"regexp_extract(c, '(?s)<a(?:\s[^>]*)?>(.*?)</a>', 1)") + r""")), lambda r: len(r) > 0) AS rows
  FROM (SELECT page_id AS doc_id, unnest(t) AS tbl, generate_subscripts(t, 1) - 1 AS tindex
        FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul(?:\s[^>]*)?>.*?</ul>', 0) AS t FROM pages)))"""


@query("table_cells", "WITH " + LIST_TABLES + r"""
SELECT doc_id, CAST(tindex AS INT) AS "table", CAST(rindex AS INT) AS "row", CAST(cindex AS INT) AS col, text FROM (
  SELECT doc_id, tindex, rindex, unnest(cells) AS text, generate_subscripts(cells, 1) - 1 AS cindex FROM (
    SELECT doc_id, tindex, unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS rindex FROM list_tables))""")
def _(spark, sf):
    """Lists of links read as tables: ``ul`` / ``li`` / ``a`` as table / row / cell."""
    return textnodes.table_cells(corpus.page_parts(spark, sf), ("ul", "li", "a"), ("a",)).drop("part")


@query("table_objects", "WITH " + LIST_TABLES + r"""
SELECT doc_id, CAST(tindex AS INT) AS "table", CAST(len(rows) AS INT) AS row_count,
       CAST(list_max(list_transform(rows, lambda r: len(r))) AS INT) AS column_count
FROM list_tables WHERE len(rows) > 0""")
def _(spark, sf):
    return textnodes.tables(corpus.page_parts(spark, sf), ("ul", "li", "a"), ("a",)).select(
        "doc_id", "table", "row_count", "column_count")


@query("sheet_cells", r"""
SELECT l_orderkey AS doc_id, l_linenumber AS sheet_idx, 'Line ' || l_linenumber AS sheet_name,
       u.c || (l_suppkey % 50 + 1) AS ref, u.v AS value, u.f IS NOT NULL AS is_formula, u.f AS formula
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, unnest([
        {'c': 'A', 'v': CAST(CAST(l_quantity AS INT) AS VARCHAR), 'f': NULL},
        {'c': 'B', 'v': CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 'f': NULL},
        {'c': 'C', 'v': '0', 'f': 'A' || (l_suppkey % 50 + 1) || '*B' || (l_suppkey % 50 + 1)},
        {'c': 'D', 'v': o_orderstatus, 'f': NULL},
        {'c': 'E', 'v': o_orderpriority, 'f': NULL},
        {'c': 'F', 'v': l_returnflag, 'f': NULL}]) AS u
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def _(spark, sf):
    return sheets.sheet_cells(corpus.xlsx_parts(spark, sf)).drop("part", "col", "row")


@query("pdf_text", r"""
SELECT doc_id, text FROM (
  SELECT conv_id || '/' || turn AS doc_id, unnest(string_split(text, chr(10))) AS text FROM conversations)
WHERE length(trim(text)) >= 2 AND NOT contains(text, '%PDF') AND NOT contains(text, 'stream') AND NOT contains(text, 'xref')""")
def _(spark, sf):
    return pdf.pdf_text(corpus.pdf_packages(spark, sf), charset="UTF-8").select("doc_id", "text")


@query("slide_paragraphs", r"""
SELECT conv_id AS doc_id, 'ppt/slides/slide' || (turn + 1) || '.xml' AS part, CAST(i - 1 AS INT) AS para, line AS text,
       CAST((i - 1) % 3 AS INT) AS level, '-' AS bullet, i = 1 AS bold, (800 + (i - 1) % 5 * 200) / 100.0 AS font_pt
FROM (SELECT conv_id, turn, unnest(s) AS line, generate_subscripts(s, 1) AS i
      FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations))
WHERE line <> ''""")
def _(spark, sf):
    rows = textnodes.text_semantics(corpus.pptx_parts(spark, sf)).filter(F.col("shape") == 1)
    return rows.select("doc_id", "part", "para", "text", "level", "bullet",
                       F.col("runs")[0]["bold"].alias("bold"), F.col("runs")[0]["font_pt"].alias("font_pt"))


# --- P: projection and paging ---------------------------------------------------------


@query("project_fields", "SELECT doc_id, lang, NULL::VARCHAR AS title FROM documents")
def _(spark, sf):
    return projection.project(corpus.table(spark, sf, "documents"), ["doc_id", "lang", "title"])[0]


@query("scope_sheet", "WITH " + ORDER_CELLS + "SELECT doc_id, ref, value FROM order_cells WHERE lower(sheet_name) = 'line 3'")
def _(spark, sf):
    return projection.scope_sheet(corpus.order_cells(spark, sf), "LINE 3").select("doc_id", "ref", "value")


@query("scope_range", "WITH " + ORDER_CELLS + """
SELECT doc_id, sheet_idx, ref, value FROM order_cells WHERE col BETWEEN 2 AND 4 AND "row" BETWEEN 5 AND 12""")
def _(spark, sf):
    return projection.scope_range(corpus.order_cells(spark, sf), "D12:B5").select("doc_id", "sheet_idx", "ref", "value")


@query("scope_pages", "SELECT conv_id, turn, role FROM conversations WHERE turn = 1 OR turn BETWEEN 3 AND 5")
def _(spark, sf):
    return projection.scope_pages(corpus.table(spark, sf, "conversations"), "1,3-5", "turn").select("conv_id", "turn", "role")


@query("object_window", "WITH " + PAGE_NODES + r""",
n AS (SELECT doc_id, object_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn, count(*) OVER (PARTITION BY doc_id) AS total
      FROM (SELECT *, 'html:' || substr(sha256('html' || part || idx), 1, 16) AS object_id FROM page_nodes))
SELECT doc_id, object_id, CAST(rn AS INT) AS rn, total AS original_count,
       CAST(greatest(least(total - 5, 10), 0) AS BIGINT) AS returned_count,
       CAST(total - greatest(least(total - 5, 10), 0) AS BIGINT) AS omitted_count,
       CASE WHEN total > 15 THEN CAST(15 AS BIGINT) END AS next_offset
FROM n WHERE rn > 5 AND rn <= 15""")
def _(spark, sf):
    return projection.page_objects(corpus.page_objects(spark, sf), 5, 10).select(
        "doc_id", "object_id", "rn", "original_count", "returned_count", "omitted_count", "next_offset")


@query("text_preview", "WITH " + PAGE_NODES + """
SELECT doc_id, substr(string_agg(text, ' ' ORDER BY idx), 1, 400) AS preview FROM page_nodes GROUP BY doc_id""")
def _(spark, sf):
    return projection.preview(corpus.page_objects(spark, sf), 400)


# --- A: inventory -------------------------------------------------------------------


@query("document_summary", r"""
WITH runs AS (
  SELECT doc_id, unnest(flatten(list_transform(string_split(text, chr(10)), lambda line:
           list_transform(string_split(line, '. '), lambda s, i: s || CASE WHEN i < len(string_split(line, '. ')) THEN '. ' ELSE '' END)))) AS text
  FROM documents),
t AS (SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS c FROM runs WHERE regexp_matches(text, '\S') GROUP BY doc_id)
SELECT d.doc_id, CAST(3 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS images, CAST(0 AS BIGINT) AS charts,
       coalesce(n, 0) AS text_objects, coalesce(c, 0) AS characters, CAST(0 AS BIGINT) AS tables,
       coalesce(n, 0) > 0 AS has_text, octet_length(encode(d.text)) AS byte_len, sha256(d.text) AS sha256
FROM documents d LEFT JOIN t USING (doc_id)""")
def _(spark, sf):
    parts = corpus.docx_parts(spark, sf)
    summary = inventory.summarize(parts, textnodes.text_objects(parts))
    return summary.join(corpus.packages(spark, sf).drop("format"), "doc_id")


@query("page_summary", "WITH " + PAGE_NODES + "," + LIST_TABLES + r"""
SELECT p.page_id AS doc_id, n AS text_objects, c AS characters, coalesce(t, 0) AS tables
FROM pages p LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS c FROM page_nodes GROUP BY 1) x ON x.doc_id = p.page_id
LEFT JOIN (SELECT doc_id, count(*) AS t FROM list_tables WHERE len(rows) > 0 GROUP BY 1) y ON y.doc_id = p.page_id""")
def _(spark, sf):
    parts = corpus.page_parts(spark, sf)
    lists = textnodes.tables(parts, ("ul", "li", "a"), ("a",))
    return inventory.summarize(parts, corpus.page_objects(spark, sf), lists).select(
        "doc_id", "text_objects", "characters", "tables")


@query("sheet_map", r"""
WITH s AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_suppkey % 50 + 1) AS r0, max(l_suppkey % 50 + 1) AS r1
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT l_orderkey AS doc_id, l_linenumber AS sheet_idx, n * 6 AS cells, n AS formulas, CAST(0 AS BIGINT) AS validations, false AS protected,
       CASE WHEN n > 20 THEN 'model' WHEN l_linenumber = 1 THEN 'primary' ELSE 'support' END AS role,
       'A' || r0 || ':F' || r1 AS used_range
FROM s""")
def _(spark, sf):
    return inventory.sheet_map(corpus.xlsx_parts(spark, sf)).drop("sheet_name")


@query("workbook_map", r"""
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, coalesce(n, 0) * 6 AS cells, coalesce(n, 0)::BIGINT AS formulas, 0::BIGINT AS validations, 0::BIGINT AS protected_sheets,
       7::BIGINT AS sheets, 1::BIGINT AS hidden, 0::BIGINT AS very_hidden, 1::BIGINT AS defined_names,
       0::BIGINT AS tables, 0::BIGINT AS charts, 0::BIGINT AS pivots, 0::BIGINT AS slicers, 0::BIGINT AS external_links, 0::BIGINT AS macros,
       CASE WHEN n > 20 THEN 'model' ELSE 'support' END AS role
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def _(spark, sf):
    orders = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return inventory.workbook_map(corpus.xlsx_parts(spark, sf)).join(orders, "doc_id", "left_semi")


def _media(spark, sf):
    """Documents as media parts (vector, PNG header or plain bytes) and labels as their usages."""
    docs = corpus.table(spark, sf, "documents")
    header = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")),
                      F.unhex(F.lpad(F.hex("n_chars"), 8, "0")), F.unhex(F.lpad(F.hex(F.col("doc_id") + 1), 8, "0")))
    kind = F.col("doc_id") % 3
    content = (F.when(kind == 0, F.encode(F.concat(F.lit("<svg>"), "text"), "UTF-8")).when(kind == 1, header)
               .otherwise(F.encode(F.concat(F.lit("plain "), "text"), "UTF-8")))
    name = lambda doc: F.concat(F.lit("word/media/image"), doc.cast("string"), F.lit(".bin"))
    parts = docs.select(F.col("lang").alias("doc_id"), name(F.col("doc_id")).alias("part"), content.alias("content"))
    used = corpus.table(spark, sf, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    rels = used.select(F.col("lang").alias("doc_id"), F.lit("word/document.xml").alias("owner"),
                       F.lit(False).alias("external"), name(F.col("doc_id")).alias("resolved"))
    return parts, rels


@query("media_assets", r"""
WITH u AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT lang AS doc_id, 'word/media/image' || d.doc_id || '.bin' AS part,
       CASE d.doc_id % 3 WHEN 0 THEN 'image/svg+xml' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS media_type,
       CAST(CASE d.doc_id % 3 WHEN 0 THEN 5 + octet_length(encode(text)) WHEN 1 THEN 24 ELSE 6 + octet_length(encode(text)) END AS BIGINT) AS byte_len,
       CASE WHEN d.doc_id % 3 = 1 THEN n_chars END AS width, CASE WHEN d.doc_id % 3 = 1 THEN d.doc_id + 1 END AS height,
       coalesce(n, 0) AS usage_count, coalesce(n, 0) = 0 AS orphaned
FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id""")
def _(spark, sf):
    parts, rels = _media(spark, sf)
    return inventory.assets(parts, rels).drop("sha256", "first_slide", "embedding_kind")


@query("extract_media", r"""
SELECT lang AS doc_id, 'image' || doc_id || '.bin' AS name,
       CAST(CASE doc_id % 3 WHEN 0 THEN 5 + octet_length(encode(text)) WHEN 1 THEN 24 ELSE 6 + octet_length(encode(text)) END AS INT) AS bytes
FROM documents""")
def _(spark, sf):
    return inventory.extract_media(_media(spark, sf)[0]).select("doc_id", "name", F.octet_length("content").alias("bytes"))


@query("duplicate_content", r"""
SELECT doc_id, sha256, count(*) OVER (PARTITION BY sha256) AS copies, min(doc_id) OVER (PARTITION BY sha256) AS first_doc
FROM (SELECT doc_id, sha256(text) AS sha256 FROM documents) QUALIFY count(*) OVER (PARTITION BY sha256) > 1""")
def _(spark, sf):
    return inventory.duplicate_content(corpus.table(spark, sf, "documents"))


@query("style_inventory", r"""
WITH lines AS (SELECT conv_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT conv_id, string_split(text, chr(10)) AS s FROM conversations)),
r AS (SELECT * FROM lines WHERE line <> '')
SELECT conv_id AS doc_id, 'latin' AS kind, 'Arial' AS value, count(*) AS runs FROM r GROUP BY 1
UNION ALL SELECT conv_id, 'lang', 'en', count(*) FROM r GROUP BY 1
UNION ALL SELECT conv_id, 'bold', 'true', count(*) FROM r WHERE i = 1 GROUP BY 1
UNION ALL SELECT conv_id, 'size_pt', CAST((8 + (i - 1) % 5 * 2) AS VARCHAR) || '.0', count(*) FROM r GROUP BY 1, 3""")
def _(spark, sf):
    return inventory.style_inventory(textnodes.runs(corpus.pptx_parts(spark, sf)))


@query("pdf_scan", r"""
SELECT conv_id || '/' || turn AS doc_id, 1::BIGINT AS objects, 1::BIGINT AS streams, 0::BIGINT AS images, 0::BIGINT AS annotations,
       0::BIGINT AS metadata, 0::BIGINT AS embedded_files, 0::BIGINT AS object_streams, 0::BIGINT AS xref_streams,
       false AS encrypted, false AS acro_form, false AS javascript, false AS redaction, 0::BIGINT AS incremental_updates, '' AS unsupported_filters
FROM conversations""")
def _(spark, sf):
    return inventory.pdf_scan(corpus.pdf_packages(spark, sf))


@query("pdf_risks", r"""
SELECT doc_id, CASE WHEN n > 0 THEN 'PDF_EXTRACTABLE_TEXT_PRESENT' ELSE 'PDF_TEXT_BLOCKS_ZERO' END AS code,
       CASE WHEN n > 0 THEN 'info' ELSE 'warning' END AS severity
FROM (SELECT conv_id || '/' || turn AS doc_id, len(list_filter(string_split(text, chr(10)), lambda t: length(trim(t)) >= 2
        AND NOT contains(t, '%PDF') AND NOT contains(t, 'stream') AND NOT contains(t, 'xref'))) AS n FROM conversations)""")
def _(spark, sf):
    files = corpus.pdf_packages(spark, sf)
    return inventory.pdf_risks(inventory.pdf_scan(files), pdf.pdf_text(files, charset="UTF-8"))


@query("docx_structure", r"""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS paragraphs, 1::BIGINT AS sections, 0::BIGINT AS tables, 0::BIGINT AS fields,
       0::BIGINT AS content_controls, 0::BIGINT AS comments, 0::BIGINT AS tracked_changes, 0::BIGINT AS styles, 0::BIGINT AS headers, 0::BIGINT AS footers
FROM documents""")
def _(spark, sf):
    return inventory.docx_structure(corpus.docx_parts(spark, sf))


@query("page_headings", r"""
SELECT page_id AS doc_id, CAST(i - 1 AS INT) AS idx, CAST(regexp_extract(b, '^<h(\d)', 1) AS INT) AS level,
       """ + UNESCAPE.format(r"regexp_extract(b, '(?s)<(?:h1|h2|h3)(?:\s[^>]*)?>(.*?)</(?:h1|h2|h3)>', 1)") + r""" AS text
FROM (SELECT page_id, unnest(h) AS b, generate_subscripts(h, 1) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '(?s)<(?:h1|h2|h3)(?:\s[^>]*)?>.*?</(?:h1|h2|h3)>', 0) AS h FROM pages))""")
def _(spark, sf):
    return inventory.markup_headings(corpus.page_parts(spark, sf))


RUN_SQL = r"""
WITH p AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
r AS (SELECT doc_id, p, generate_subscripts(s, 1) AS r FROM (SELECT doc_id, p, string_split(line, '. ') AS s FROM p))
"""


@query("run_graph_edges", RUN_SQL + r"""
SELECT doc_id, 'word/document.xml' AS from_id, 'word/document.xml#' || p AS to_id, 'contains' AS relation FROM p
UNION ALL SELECT doc_id, 'word/document.xml#' || p, 'word/document.xml#' || p || '.' || r, 'contains' FROM r
UNION ALL SELECT doc_id, 'word/document.xml#' || p || '.' || r, 'word/document.xml#' || p || '.' || r || '.1', 'contains' FROM r
UNION ALL SELECT doc_id, 'word/document.xml#' || p || '.' || (r - 1), 'word/document.xml#' || p || '.' || r, 'next' FROM r WHERE r > 1""")
def _(spark, sf):
    return stories.edges(corpus.docx_parts(spark, sf))


@query("run_graph_nodes", RUN_SQL + r"""
SELECT doc_id, 'story' AS type, 1::BIGINT AS nodes FROM documents
UNION ALL SELECT doc_id, 'paragraph', count(*) FROM p GROUP BY 1
UNION ALL SELECT doc_id, 'run', count(*) FROM r GROUP BY 1
UNION ALL SELECT doc_id, 'text', count(*) FROM r GROUP BY 1""")
def _(spark, sf):
    return stories.nodes(corpus.docx_parts(spark, sf)).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("nodes"))


@query("slide_order", r"""
SELECT conv_id AS doc_id, CAST(n + 1 AS INT) AS slide, 'ppt/slides/slide' || (n + 1) || '.xml' AS part
FROM (SELECT conv_id, unnest(range(0, max(turn) + 1)) AS n FROM conversations GROUP BY conv_id)""")
def _(spark, sf):
    parts = corpus.pptx_parts(spark, sf)
    return inventory.slide_order(parts, relationships.relationships(parts))


@query("slide_objects", r"""
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS slide, CAST(k AS INT) AS pos, 'shape' AS kind, CAST(k + 2 AS VARCHAR) AS shape_id,
       CASE k WHEN 0 THEN 'Title' ELSE 'Body' END AS name, CASE k WHEN 0 THEN 'title' ELSE 'body' END AS placeholder,
       48::BIGINT AS x, CASE k WHEN 0 THEN 29 ELSE 168 END::BIGINT AS y, 864::BIGINT AS w, CASE k WHEN 0 THEN 120 ELSE 475 END::BIGINT AS h,
       CASE k WHEN 0 THEN role ELSE replace(text, chr(10), ' ') END AS text
FROM conversations, (SELECT unnest([0, 1]) AS k)""")
def _(spark, sf):
    parts = corpus.pptx_parts(spark, sf)
    return inventory.slide_objects(parts, inventory.slide_numbers(parts)).select(
        "doc_id", "slide", "pos", "kind", "shape_id", "name", "placeholder", "x", "y", "w", "h", "text")


GROUPED = r"""
turns AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) - turn + 1 AS slide, string_split(text, chr(10)) AS s FROM conversations),
lines AS (SELECT conv_id, turn, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM turns),
grouped AS (
  SELECT conv_id, turn, 0 AS pos, 'group' AS kind, '10' AS shape_id, NULL AS parent_id, 0 AS depth, turn * 8 + 100 AS x, 100 AS y, 400 AS w, 200 AS h, '' AS text,
         '11,20,' || (SELECT string_agg(CAST(29 + k AS VARCHAR), ',' ORDER BY k) FROM (SELECT unnest(range(1, len(s) + 1)) AS k)) AS child_ids FROM turns
  UNION ALL SELECT conv_id, turn, 1, 'shape', '11', '10', 1, turn * 8 + 140, 120, 80, 40, role, NULL FROM turns
  UNION ALL SELECT conv_id, turn, 2, 'group', '20', '10', 1, turn * 8 + 120, 160, 200, 100, '',
         (SELECT string_agg(CAST(29 + k AS VARCHAR), ',' ORDER BY k) FROM (SELECT unnest(range(1, len(s) + 1)) AS k)) FROM turns
  UNION ALL SELECT conv_id, turn, 2 + i, 'shape', CAST(29 + i AS VARCHAR), '20', 2, turn * 8 + 120 + 2 * (10 * i - 5), 160 + 2 * (20 * i - 10), 20, 40, line, NULL FROM lines
  UNION ALL SELECT conv_id, turn, 3 + len(s), 'picture', '12', NULL, 0, 100, 0, 100, 100, '', NULL FROM turns
  UNION ALL SELECT conv_id, turn, 4 + len(s), 'connector', '13', NULL, 0, NULL, NULL, NULL, NULL, '', NULL FROM turns)"""


@query("grouped_objects", "WITH " + GROUPED + r"""
SELECT g.conv_id AS doc_id, CAST(slide AS INT) AS slide, CAST(pos AS INT) AS pos, kind, shape_id, parent_id, CAST(depth AS INT) AS depth,
       CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, text, child_ids,
       CASE kind WHEN 'connector' THEN '11' END AS from_shape, CASE kind WHEN 'connector' THEN '30' END AS to_shape
FROM grouped g JOIN (SELECT conv_id, turn, slide FROM turns) t ON t.conv_id = g.conv_id AND t.turn = g.turn""")
def _(spark, sf):
    """Shapes inside groups inside groups, slides in presentation order."""
    parts = corpus.grouped_parts(spark, sf)
    return inventory.slide_objects(parts, inventory.slide_numbers(parts)).select(
        "doc_id", "slide", "pos", "kind", "shape_id", "parent_id", "depth", "x", "y", "w", "h", "text", "child_ids", "from_shape", "to_shape")


@query("picture_media", "WITH " + GROUPED + r"""
SELECT conv_id AS doc_id, CAST(slide AS INT) AS slide, '12' AS shape_id, 'ppt/media/image' || (turn + 1) || '.png' AS media_part FROM turns""")
def _(spark, sf):
    parts = corpus.grouped_parts(spark, sf)
    objects = inventory.slide_objects(parts, inventory.slide_numbers(parts))
    return inventory.picture_media(objects, relationships.relationships(parts)).select("doc_id", "slide", "shape_id", "media_part")


@query("nested_tables", r"""
SELECT o_orderkey AS doc_id, 0 AS "table", NULL::INT AS parent, NULL::INT AS parent_row, NULL::INT AS parent_col, 1 AS row_count, 2 AS column_count,
       o_orderstatus || '|outer after' AS texts FROM orders
UNION ALL SELECT o_orderkey, 1, 0, 0, 1, CAST(n AS INT), 2,
       (SELECT string_agg(k || '|' || o_orderpriority, ';' ORDER BY k) FROM (SELECT unnest(range(1, n + 1)) AS k))
FROM (SELECT o_orderkey, o_orderpriority, CAST(substr(o_orderpriority, 1, 1) AS INT) AS n FROM orders)""")
def _(spark, sf):
    """Tables inside cells of tables."""
    found = textnodes.tables(corpus.table_parts(spark, sf), textnodes.TABLE_TAGS["docx"])
    texts = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return found.select("doc_id", "table", "parent", "parent_row", "parent_col", "row_count", "column_count", texts.alias("texts"))


def _chart_parts(spark, sf):
    """One chart part per order: a series per order with references built from its keys."""
    orders = corpus.table(spark, sf, "orders")
    xml = F.concat(
        F.lit('<c:chart><c:ser><c:idx val="'), (F.col("o_custkey") % 9).cast("string"), F.lit('"/><c:order val="0"/><c:tx><c:v>'),
        xml_escape("o_orderpriority"), F.lit("</c:v></c:tx><c:cat><c:f>Sheet1!$A$2:$A$"), (F.col("o_custkey") % 20 + 2).cast("string"),
        F.lit("</c:f></c:cat><c:val><c:f>Sheet1!$B$2:$B$"), (F.col("o_custkey") % 20 + 2).cast("string"), F.lit("</c:f></c:val></c:ser></c:chart>"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("pptx").alias("format"), F.lit("ppt/charts/chart1.xml").alias("part"), xml.alias("xml"))


@query("chart_series", r"""
SELECT o_orderkey AS doc_id, CAST(o_custkey % 9 AS INT) AS series_idx, 0 AS series_order, o_orderpriority AS name,
       'Sheet1!$A$2:$A$' || (o_custkey % 20 + 2) AS category_ref, 'Sheet1!$B$2:$B$' || (o_custkey % 20 + 2) AS value_ref FROM orders""")
def _(spark, sf):
    return inventory.chart_series(_chart_parts(spark, sf)).drop("part", "pos")


HASH = """lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)),
  lambda h, x: (xor(h, x) * 16777619) & 4294967295))), 8, '0')"""
FINGERPRINTS = f"""
WITH b AS (SELECT l_orderkey AS doc_id, l_returnflag || ' ' || l_linestatus AS text,
  concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS object_id,
  concat_ws(':', CAST(l_quantity * 20 AS BIGINT), CAST(round(l_tax * 4000) AS BIGINT), CAST(l_linenumber * 30 AS BIGINT), CAST(round(l_discount * 400) + 20 AS BIGINT)) AS place
  FROM lineitem)
SELECT doc_id, object_id, {HASH.format('text')} AS text_hash, {HASH.format('place')} AS position_hash FROM b"""


@query("fingerprints", FINGERPRINTS)
def _(spark, sf):
    return inventory.fingerprints(corpus.boxes(spark, sf)).select("doc_id", "object_id", "text_hash", "position_hash")


@query("page_metadata", r"""
SELECT page_id AS doc_id, CASE WHEN contains(html, '<title>') THEN """ + UNESCAPE.format(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + r""" END AS title,
       regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1) AS lang FROM pages""")
def _(spark, sf):
    return inventory.page_metadata(corpus.page_parts(spark, sf))


# --- F, X1: column functions ----------------------------------------------------------


@query("xml_round_trip", r"SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    """Escaping, then numeric references for some letters, then unescaping gives the text back."""
    escaped = xml_escape("text")
    for letter, code in (("é", "&#233;"), ("ü", "&#xFC;"), ("e", "&#x65;")):
        escaped = F.replace(escaped, F.lit(letter), F.lit(code))
    docs = corpus.table(spark, sf, "documents").select("doc_id", escaped.alias("escaped"))
    return docs.select("doc_id", F.sha2(xml_unescape("escaped"), 256).alias("sha256"))


@query("normalize_text", "WITH " + PAGE_NODES + r"""
SELECT doc_id, CAST(idx AS INT) AS idx, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM page_nodes""")
def _(spark, sf):
    return corpus.page_objects(spark, sf).select("doc_id", "idx", normalize_text("text").alias("text"))


@query("cell_references", r"""
SELECT l_orderkey, l_linenumber, CAST(c AS INT) AS col, l1 || l2 || l3 AS letters, CAST(r AS INT) AS "row", l1 || l2 || l3 || r AS ref, CAST(c AS INT) AS back
FROM (SELECT *, CASE WHEN c > 702 THEN chr(CAST(65 + (c - 703) // 676 AS INT)) ELSE '' END AS l1,
             CASE WHEN c > 26 THEN chr(CAST(65 + ((c - 27) // 26) % 26 AS INT)) ELSE '' END AS l2, chr(CAST(65 + (c - 1) % 26 AS INT)) AS l3
      FROM (SELECT l_orderkey, l_linenumber, l_partkey % 16384 + 1 AS c, l_suppkey + 1 AS r FROM lineitem))""")
def _(spark, sf):
    li = corpus.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 16384 + 1).cast("int").alias("col"), (F.col("l_suppkey") + 1).cast("int").alias("row"))
    named = li.withColumn("letters", col_to_letters("col")).withColumn("ref", make_ref("col", "row"))
    return named.select("l_orderkey", "l_linenumber", "col", "letters", ref_row("ref").alias("row"), "ref", ref_col("ref").alias("back"))


@query("text_hashes", "SELECT item_id, " + HASH.format("text") + " AS text_hash FROM benchmark")
def _(spark, sf):
    return corpus.table(spark, sf, "benchmark").select("item_id", fnv1a("text").alias("text_hash"))
