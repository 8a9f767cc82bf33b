"""Catalogue: version comparison, integrity checks and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.text import string_distance
from folioscope.operators import integrity, inventory, redaction, versions
from folioscope.plans.reading import DOC_LINES, PAGE_NODES
from folioscope.sources import corpus, packages, relationships, textnodes
from folioscope.sources.packages import Limits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


SNAPSHOTS = r"""
b AS (SELECT doc_id, lang, source, text FROM documents WHERE doc_id % 7 <> 0),
a AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0),
changes AS (
  SELECT coalesce(b.lang, a.lang) AS doc_id, coalesce(b.doc_id, a.doc_id) AS id,
         'word/' || coalesce(b.source, a.source) || '/' || coalesce(b.doc_id, a.doc_id) || '.xml' AS part,
         CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.text <> b.text THEN 'changed' ELSE 'unchanged' END AS status,
         CAST(coalesce(octet_length(encode(a.text)), 0) - coalesce(octet_length(encode(b.text)), 0) AS BIGINT) AS byte_delta,
         sha256(b.text) AS before_sha256, sha256(a.text) AS after_sha256, b.text AS bt, a.text AS "at"
  FROM b FULL OUTER JOIN a ON a.doc_id = b.doc_id)"""


def _snapshots(spark, sf, make=corpus.snapshot_parts):
    return make(spark, sf, "before"), make(spark, sf, "after")


# --- J: versions --------------------------------------------------------------------


@query("diff_parts", "WITH " + SNAPSHOTS + """
SELECT doc_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
       count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged,
       CAST(sum(byte_delta) AS BIGINT) AS byte_delta FROM changes GROUP BY doc_id""")
def _(spark, sf):
    return versions.diff_parts(*_snapshots(spark, sf))


@query("part_changes", "WITH " + SNAPSHOTS + """
SELECT doc_id, part, 'packagePart' AS kind, status, byte_delta, before_sha256, after_sha256 FROM changes""")
def _(spark, sf):
    return versions.part_changes(*_snapshots(spark, sf))


@query("touched_parts", "WITH " + SNAPSHOTS + """
SELECT doc_id, part, CASE status WHEN 'added' THEN 'created' WHEN 'changed' THEN 'modified' ELSE 'deleted' END AS action,
       before_sha256, after_sha256 FROM changes WHERE status <> 'unchanged'""")
def _(spark, sf):
    return versions.touched_parts(*_snapshots(spark, sf))


def _page_versions(spark, sf):
    objects = corpus.page_objects(spark, sf)
    before = objects.filter(F.col("idx") % 11 != 3)
    after = objects.filter(F.col("idx") % 13 != 4).withColumn(
        "text", F.when(F.col("idx") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return before, after


@query("diff_objects", "WITH " + PAGE_NODES + r""",
o AS (SELECT *, 'html:' || substr(sha256('html' || part || idx), 1, 16) AS object_id FROM page_nodes),
x AS (SELECT doc_id, object_id, idx % 11 <> 3 AS inb, idx % 13 <> 4 AS ina, text AS bt, CASE WHEN idx % 5 = 0 THEN text || 'x' ELSE text END AS "at" FROM o)
SELECT doc_id, object_id, CASE WHEN NOT inb THEN 'added' WHEN NOT ina THEN 'removed' ELSE 'changed' END AS status,
       CASE WHEN inb THEN bt END AS before_text, CASE WHEN ina THEN "at" END AS after_text
FROM x WHERE (inb OR ina) AND (NOT inb OR NOT ina OR bt <> "at")""")
def _(spark, sf):
    return versions.diff_objects(*_page_versions(spark, sf))


BOXES = r"""
boxes AS (
  SELECT l_orderkey AS doc_id, 1 AS slide,
         l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS BIGINT)
           || '-' || strftime(l_shipdate, '%Y%m%d') AS object_id,
         CASE WHEN l_linenumber = 1 THEN 'title' WHEN l_returnflag = 'R' THEN 'image' ELSE 'shape' END AS kind,
         l_returnflag || ' ' || l_linestatus AS text,
         l_quantity * 20 AS x, round(l_tax * 4000) AS y, CAST(l_linenumber * 30 AS DOUBLE) AS w, round(l_discount * 400) + 20 AS h, l_linenumber
  FROM lineitem)"""


@query("diff_geometry", "WITH " + BOXES + r""",
v AS (SELECT doc_id, object_id, l_linenumber n, x, y, w, h FROM boxes)
SELECT doc_id, object_id, CASE WHEN n = 2 THEN 'added' ELSE 'changed' END AS status,
       CASE WHEN n = 2 THEN x ELSE 5.0 END AS dx, CASE WHEN n = 2 THEN y ELSE 0.0 END AS dy,
       CASE WHEN n = 2 THEN w ELSE 0.0 END AS dw, CASE WHEN n = 2 THEN h ELSE 0.0 END AS dh
FROM v WHERE n IN (2, 4)""")
def _(spark, sf):
    """Lines 2 are new, 4 move by five pixels, 5 by less than the threshold, 7 vanish."""
    boxes = corpus.boxes(spark, sf)
    line = F.round(F.col("w") / 30)
    before = boxes.filter(line != 2)
    shift = F.when(line == 4, 5.0).when(line == 5, 0.005).otherwise(0.0)
    return versions.diff_geometry(before, boxes.filter(line != 7).withColumn("x", F.col("x") + shift))


@query("diff_semantics", r"""
WITH t AS (SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda l: l <> '')) AS n FROM conversations),
f AS (SELECT conv_id, turn, turn % 3 = 1 AS para, turn % 4 = 1 AS bullet, turn % 5 = 2 AS fmt FROM t WHERE n > 0)
SELECT conv_id AS doc_id, 'ppt/slides/slide' || (turn + 1) || '.xml' AS part, 1 AS shape,
       concat_ws(',', CASE WHEN para THEN 'paragraph' END, CASE WHEN bullet THEN 'bullet' END, CASE WHEN fmt THEN 'run-format' END) AS changes
FROM f WHERE para OR bullet OR fmt""")
def _(spark, sf):
    parts = corpus.pptx_parts(spark, sf)
    turn = F.regexp_extract("part", r"slide(\d+)\.xml$", 1).try_cast("int") - 1
    xml = F.when(turn % 3 == 1, F.replace("xml", F.lit("</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"),
                                F.lit("!</a:t></a:r></a:p></p:txBody></p:sp></p:sld>")))
    edited = parts.withColumn("xml", F.coalesce(xml, "xml"))
    edited = edited.withColumn("xml", F.when(turn % 4 == 1, F.replace("xml", F.lit('buChar char="-"'), F.lit('buChar char="*"'))).otherwise(F.col("xml")))
    edited = edited.withColumn("xml", F.when(turn % 5 == 2, F.replace("xml", F.lit(' b="'), F.lit(' i="1" b="'))).otherwise(F.col("xml")))
    return versions.diff_semantics(textnodes.text_semantics(parts), textnodes.text_semantics(edited))


DISTANCE = r"""
CASE WHEN {a} = '' AND {b} = '' THEN 0.0 ELSE
 round(len(list_filter(list_zip(string_split({a}, ''), string_split({b}, '')), lambda p: p[1] IS DISTINCT FROM p[2]))
       / greatest(length({a}), length({b}), 1), 4) END"""


@query("string_distance", "SELECT x.conv_id, x.turn, " + DISTANCE.format(a="x.text", b="y.text") + """ AS distance
FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1""")
def _(spark, sf):
    turns = corpus.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(later, ["conv_id", "turn"]).select("conv_id", "turn", string_distance("text", "next_text").alias("distance"))


@query("diff_summary", "WITH " + SNAPSHOTS + r""",
s AS (SELECT *, """ + DISTANCE.format(a="coalesce(bt, '')", b="coalesce(\"at\", '')") + r""" AS score FROM changes)
SELECT doc_id, count(*) FILTER (status <> 'unchanged') AS changed_parts, count(*) FILTER (status = 'added') AS added_objects,
       count(*) FILTER (status = 'removed') AS removed_objects, count(*) FILTER (status = 'changed') AS changed_text_objects,
       round(avg(score), 4) AS regression_score, count(*) FILTER (status <> 'unchanged') > 0 AS changed
FROM s GROUP BY doc_id""")
def _(spark, sf):
    before, after = _snapshots(spark, sf, corpus.snapshot)
    as_objects = lambda d: d.select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("object_id"), F.col("doc_id").alias("page"), "text")
    left, right = as_objects(before), as_objects(after)
    return versions.diff_summary(versions.part_changes(*_snapshots(spark, sf)), versions.diff_objects(left, right),
                                 versions.page_scores(left, right))


MAP_DIGEST = r"""
digests AS (
  SELECT doc_id, sha256(string_agg(digest, ',' ORDER BY chunk)) AS map_sha256 FROM (
    SELECT doc_id, idx // 4096 AS chunk, sha256(string_agg(doc_id || '#' || idx || ':' || sha256(text), ',' ORDER BY idx)) AS digest
    FROM doc_lines GROUP BY 1, 2) GROUP BY doc_id)"""


@query("object_map_digest", "WITH " + DOC_LINES + "," + MAP_DIGEST + "SELECT * FROM digests")
def _(spark, sf):
    lines = corpus.document_lines(spark, sf)
    return versions.object_map_digest(lines.withColumn("object_id", F.concat_ws("#", "doc_id", "idx")))


@query("stale_plans", "WITH " + DOC_LINES + "," + MAP_DIGEST + r"""
SELECT doc_id AS plan_id, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'INPUT_MISSING' WHEN doc_id % 5 = 0 THEN 'INPUT_CHANGED'
       WHEN doc_id % 3 = 0 THEN 'OBJECT_MAP_CHANGED' ELSE 'CURRENT' END AS status
FROM documents WHERE doc_id % 7 <> 0""")
def _(spark, sf):
    """Plans made on the before snapshot, checked against the after snapshot."""
    def digests(which):
        docs = corpus.snapshot(spark, sf, which)
        lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
        maps = versions.object_map_digest(lines.withColumn("object_id", F.concat_ws("#", "doc_id", "idx")))
        return docs.select("doc_id", F.sha2("text", 256).alias("sha256")).join(maps, "doc_id")

    plans = digests("before").select(
        F.col("doc_id").alias("plan_id"), "doc_id", F.concat(F.lit("sha256:"), "sha256").alias("expected_sha256"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("outdated")).otherwise(F.col("map_sha256")).alias("expected_map_sha256"))
    return versions.stale_plans(plans, digests("after"))


# --- I: integrity ---------------------------------------------------------------------


def _damaged(spark, sf):
    parts = corpus.pptx_parts(spark, sf)
    drop = (
        ((F.col("part") == "ppt/presentation.xml") & (F.col("doc_id") % 3 == 0))
        | ((F.col("part") == "_rels/.rels") & (F.col("doc_id") % 4 == 1))
        | (F.col("part").startswith("ppt/slides/") & (F.col("doc_id") % 5 == 2))
    )
    return parts, parts.filter(~drop)


@query("required_parts", r"""
WITH c AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)
SELECT doc_id, part, 'OPC_REQUIRED_PART_MISSING' AS code, 'error' AS severity FROM (
  SELECT doc_id, 'ppt/presentation.xml' AS part FROM c WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, '_rels/.rels' FROM c WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 'ppt/slides/slide*.xml' FROM c WHERE doc_id % 5 = 2)""")
def _(spark, sf):
    parts, damaged = _damaged(spark, sf)
    return integrity.required_parts(damaged, parts.select("doc_id", "format").distinct())


@query("unlabelled_documents", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, sf):
    """Expected documents (labels) missing from the English part of the corpus."""
    english = corpus.table(spark, sf, "documents").filter(F.col("lang") == "en")
    return corpus.table(spark, sf, "labels").join(english, "doc_id", "left_anti").select("doc_id")


@query("unsafe_names", r"""
SELECT page_id AS doc_id, CASE page_id % 5 WHEN 0 THEN '/' || url WHEN 1 THEN 'C:\' || url WHEN 2 THEN 'a/../' || url WHEN 3 THEN '' END AS part,
       CASE page_id % 5 WHEN 0 THEN 'ZIP_ABSOLUTE_ENTRY' WHEN 1 THEN 'ZIP_WINDOWS_DRIVE_ENTRY' WHEN 2 THEN 'ZIP_SLIP_ENTRY' ELSE 'ZIP_EMPTY_ENTRY' END AS code,
       'error' AS severity FROM pages WHERE page_id % 5 < 4""")
def _(spark, sf):
    kind = F.col("page_id") % 5
    name = (F.when(kind == 0, F.concat(F.lit("/"), "url")).when(kind == 1, F.concat(F.lit("C:\\"), "url"))
            .when(kind == 2, F.concat(F.lit("a/../"), "url")).when(kind == 3, "").otherwise(F.col("url")))
    return integrity.unsafe_names(corpus.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), name.alias("part")))


@query("broken_targets", r"""
SELECT conv_id AS doc_id, 'ppt/_rels/presentation.xml.rels' AS rels_part, 'rId' || (turn + 1) AS rel_id,
       'ppt/slides/slide' || (turn + 1) || '.xml' AS target, 'OFFICE_REPAIR_RISK_BROKEN_RELATIONSHIP' AS code, 'warning' AS severity
FROM conversations WHERE conv_id % 5 = 2
UNION ALL SELECT DISTINCT conv_id, '_rels/.rels', 'rId1', 'ppt/presentation.xml', 'OFFICE_REPAIR_RISK_BROKEN_RELATIONSHIP', 'warning'
FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 4 <> 1""")
def _(spark, sf):
    damaged = _damaged(spark, sf)[1]
    return integrity.broken_targets(relationships.relationships(damaged), damaged)


@query("duplicate_entries", """
SELECT l_orderkey AS doc_id, l_linenumber AS part, count(*) AS copies, 'ZIP_DUPLICATE_ENTRY' AS code, 'error' AS severity
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    rows = corpus.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("part"))
    return integrity.duplicates(rows, ["doc_id", "part"])


@query("external_targets", """
SELECT page_id AS doc_id, 'rId1' AS rel_id, url AS target, 'ZIP_EXTERNAL_RELATIONSHIP' AS code, 'warning' AS severity
FROM pages WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')""")
def _(spark, sf):
    rels = corpus.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit("rId1").alias("rel_id"), F.col("url").alias("target"),
        relationships.is_external("url", F.lit(None).cast("string")).alias("external"))
    return integrity.external_targets(rels, "warning")


@query("risky_parts", r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'xl/' || source || '/vbaProject.bin' WHEN 1 THEN 'word/embeddings/' || source || '.XLSX' ELSE 'word/embeddings/' || source || '.bin' END AS part,
       CASE doc_id % 4 WHEN 0 THEN 'ZIP_MACRO_PART' WHEN 1 THEN 'ZIP_EMBEDDED_WORKBOOK' ELSE 'ZIP_EMBEDDED_OBJECT' END AS code,
       CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'warning' END AS severity
FROM documents WHERE doc_id % 4 < 3""")
def _(spark, sf):
    kind = F.col("doc_id") % 4
    name = (F.when(kind == 0, F.concat(F.lit("xl/"), "source", F.lit("/vbaProject.bin")))
            .when(kind == 1, F.concat(F.lit("word/embeddings/"), "source", F.lit(".XLSX")))
            .when(kind == 2, F.concat(F.lit("word/embeddings/"), "source", F.lit(".bin"))).otherwise(F.concat(F.lit("word/"), "source")))
    return integrity.risky_parts(corpus.table(spark, sf, "documents").select("doc_id", name.alias("part")))


@query("volume_limits", r"""
WITH t AS (SELECT l_orderkey AS doc_id, count(*) AS n, sum(CAST(round(l_extendedprice) AS BIGINT)) AS bytes,
                  max(CAST(round(l_extendedprice) AS BIGINT) / (l_suppkey * 20 + 1)) AS ratio, max(CAST(round(l_extendedprice) AS BIGINT)) AS big FROM lineitem GROUP BY 1)
SELECT doc_id, 'ZIP_ENTRY_LIMIT_EXCEEDED' AS code, 'error' AS severity FROM t WHERE n > 6
UNION ALL SELECT doc_id, 'ZIP_EXPANDED_BYTES_EXCEEDED', 'error' FROM t WHERE bytes > 300000
UNION ALL SELECT doc_id, 'ZIP_COMPRESSION_RATIO_EXCEEDED', 'error' FROM t WHERE ratio > 100
UNION ALL SELECT doc_id, 'ZIP_XML_PART_TOO_LARGE', 'error' FROM t WHERE big > 95000""")
def _(spark, sf):
    parts = corpus.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("xl/worksheets/sheet"), F.col("l_linenumber").cast("string"), F.lit(".xml")).alias("part"),
        F.round("l_extendedprice").cast("bigint").alias("size"), (F.col("l_suppkey") * 20 + 1).alias("comp_size"))
    return integrity.volume_limits(parts, Limits(entries=6, expanded_bytes=300000, xml_part_bytes=95000, ratio=100))


def _nested_packages(spark, sf):
    """A presentation inside a word-processing package, and every third time that inside another one."""
    def wrap(inner, name):
        body = F.encode(F.lit("<w:document/>"), "UTF-8")
        rows = F.array(F.struct(F.lit("word/document.xml").alias("part"), F.lit(0).alias("ord"), body.alias("content")),
                       F.struct(F.lit(f"word/embeddings/{name}").alias("part"), F.lit(1).alias("ord"), F.col("content").alias("content")))
        return packages.pack(inner.select("doc_id", F.lit("docx").alias("format"), F.inline(rows)).withColumn("xml", F.lit(None).cast("string")))

    held = wrap(packages.pack(corpus.pptx_parts(spark, sf)), "deck.pptx")
    third = F.col("doc_id") % 3 == 0
    return held.filter(~third).unionByName(wrap(held.filter(third), "report.docx"))


@query("nested_packages", r"""
WITH c AS (SELECT conv_id, max(turn) + 5 AS n FROM conversations GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(d AS INT) AS depth, CASE d WHEN 0 THEN 2 ELSE n END::BIGINT AS parts, NULL::VARCHAR AS blocked
FROM c, (SELECT unnest([0, 1]) AS d) WHERE conv_id % 3 <> 0
UNION ALL SELECT CAST(conv_id AS VARCHAR), 0, 1, 'ZIP_NESTED_ZIP_DETECTED' FROM c WHERE conv_id % 3 = 0""")
def _(spark, sf):
    """Packages in packages: one level is opened and counted, two are refused."""
    parts = packages.shred(_nested_packages(spark, sf), inner=True)
    return parts.groupBy("doc_id", "depth", "blocked").agg(F.count(F.lit(1)).alias("parts"))


@query("nested_limits", r"""
SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'ZIP_NESTED_ZIP_DETECTED' AS code, 'error' AS severity FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'ZIP_ENTRY_LIMIT_EXCEEDED', 'error' FROM conversations GROUP BY conv_id HAVING max(turn) + 5 + CASE WHEN conv_id % 3 = 0 THEN 4 ELSE 2 END > 9""")
def _(spark, sf):
    """The same limits over the parts of the whole tree."""
    tree = packages.shred(_nested_packages(spark, sf), packages.Limits(nested_depth=2), inner=True)
    return integrity.volume_limits(tree, packages.Limits(entries=9, nested_depth=1))


@query("entity_declarations", """
SELECT page_id AS doc_id, url AS part, 'ZIP_XML_ENTITY_DENIED' AS code, 'error' AS severity FROM pages
WHERE regexp_matches(html, '(?i)<!DOCTYPE|<!ENTITY')""")
def _(spark, sf):
    return integrity.entity_declarations(corpus.page_parts(spark, sf))


@query("malformed_xml", r"""
SELECT doc_id, 'word/document.xml' AS part, 'OOXML_XML_NOT_WELL_FORMED' AS code, 'error' AS severity FROM documents
WHERE doc_id % 10 = 3 OR regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')""")
def _(spark, sf):
    broken = F.when((F.col("doc_id") % 10 == 3) & (F.col("part") == "word/document.xml"), F.replace("xml", F.lit("</w:body>"), F.lit("")))
    return integrity.malformed_xml(corpus.docx_parts(spark, sf).withColumn("xml", F.coalesce(broken, "xml")))


@query("pdf_markers", r"""
SELECT doc_id, code, severity FROM (SELECT conv_id || '/' || turn AS doc_id, turn FROM conversations),
 (VALUES (0, 'PDF_HEADER_MISSING', 'error'), (1, 'PDF_XREF_MISSING', 'warning'), (2, 'PDF_EOF_MISSING', 'warning')) v(k, code, severity)
WHERE turn % 4 = k""")
def _(spark, sf):
    files = corpus.pdf_packages(spark, sf)
    turn = F.split_part("doc_id", F.lit("/"), F.lit(2)).cast("int") % 4
    text = F.decode("content", "UTF-8")
    cut = (F.when(turn == 0, F.replace(text, F.lit("%PDF-"), F.lit("%FDP-"))).when(turn == 1, F.replace(text, F.lit("startxref"), F.lit("")))
           .when(turn == 2, F.replace(text, F.lit("%%EOF"), F.lit(""))).otherwise(text))
    return integrity.pdf_markers(files.withColumn("content", F.encode(cut, "UTF-8")))


@query("unsafe_formulas", r"""
SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 1 OR len(list_filter(
  ['webservice(', 'hyperlink(', 'cmd|', 'powershell|', 'dde(', 'shell(', 'http://', 'https://', 'ftp://', 'file://', ']!'],
  lambda t: contains(lower(text), t))) > 0 OR regexp_matches(text, '\[[^\]]+\][^!]*!')""")
def _(spark, sf):
    """Document texts as formulas; some get an external reference or a network call."""
    formula = (F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("=[Book1]Sheet!A1+"), "text"))
               .when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("+WebService(1)"))).otherwise(F.col("text")))
    return integrity.unsafe_formulas(corpus.table(spark, sf, "documents").select("doc_id", formula.alias("formula"))).select("doc_id")


@query("forbidden_text", r"""
SELECT doc_id, item_id AS pattern_id,
       regexp_replace(substr(d.text, greatest(p - 24, 1), length(b.text) + 24 + least(24, p - 1)), '\s+', ' ', 'g') AS sample
FROM (SELECT doc_id, item_id, d.text, b.text, strpos(lower(d.text), lower(b.text)) AS p, d, b FROM documents d, benchmark b
      WHERE contains(lower(d.text), lower(b.text)))""")
def _(spark, sf):
    """Benchmark passages found anywhere in the documents."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", F.lit("body").alias("object_id"), "text")
    patterns = corpus.table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return integrity.forbidden_text(docs, patterns).drop("object_id")


@query("missing_text", r"""
SELECT l.doc_id, l.doc_id % n AS pattern_id FROM labels l JOIN documents d USING (doc_id), (SELECT count(*) AS n FROM benchmark) JOIN benchmark b ON b.item_id = l.doc_id % n
WHERE NOT contains(lower(d.text), lower(b.text))""")
def _(spark, sf):
    """A passage each labelled document is required to hold, but does not."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", F.lit("body").alias("object_id"), "text")
    patterns = corpus.table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    known = patterns.select("pattern_id")
    many = F.lit(patterns.count())
    required = corpus.table(spark, sf, "labels").select("doc_id", (F.col("doc_id") % many).alias("pattern_id")).join(known, "pattern_id")
    return integrity.missing_text(docs, patterns, required.join(docs.select("doc_id"), "doc_id").select("doc_id", "pattern_id"))


def _secret_sql(source: str) -> str:
    """The same chain in RE2 syntax."""
    steps = [
        ("-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----", redaction.MASK),
        (r"\bBearer\s+[A-Za-z0-9._~+/=-]{12,}\b", "Bearer " + redaction.MASK),
        (r"(?i)\b(?:sk|pk|api|key|token|secret)[-_]?[A-Za-z0-9]{16,}\b", redaction.MASK),
        (r"(?i)\b([A-Za-z0-9_.-]*(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)"
         r"""[A-Za-z0-9_.-]*\s*)=\s*["'']?(?:[^"''\s;&]{6,})["'']?""", r"\1=" + redaction.MASK),
        (r"(?i)([?&](?:access[_-]?token|api[_-]?key|token|key|secret|signature)=)[^&#\s]+", r"\1" + redaction.MASK),
        (r"(?i)\b(?:Cookie|Set-Cookie):\s*[^\n\r]+", "Cookie: " + redaction.MASK),
    ]
    columns = f"s0 AS ({source})"
    for i, (pattern, replacement) in enumerate(steps):
        columns += (f", s{i + 1} AS (SELECT * EXCLUDE (t, n), regexp_replace(t, '{pattern}', '{replacement}', 'g') AS t, "
                    f"n + len(regexp_extract_all(t, '{pattern}')) AS n FROM s{i})")
    return columns


@query("redact_secrets", "WITH " + _secret_sql("SELECT doc_id, text AS t, 0 AS n FROM documents")
       + "SELECT doc_id, t AS redacted, CAST(n AS INT) AS redactions FROM s6")
def _(spark, sf):
    docs = corpus.by_key(corpus.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return redaction.redact_secrets(docs, "text").select("doc_id", "redacted", "redactions")


@query("secret_records", "WITH " + _secret_sql("SELECT doc_id, text AS t, 0 AS n FROM documents")
       + "SELECT doc_id, CAST(n AS BIGINT) AS records FROM s6 WHERE n > 0")
def _(spark, sf):
    docs = corpus.by_key(corpus.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return redaction.secret_records(docs, "text", ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("records"))


@query("redact_paths", r"""
SELECT doc_id, 'see <project>/' || source || '/' || doc_id || '.txt and <absolutePath>, <userHome> or <uncPath>; "<absolutePath>" http://h/a/b a/b/c' AS redacted
FROM documents""")
def _(spark, sf):
    text = F.concat(
        F.lit("see /srv/work/"), "source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".txt and C:\\data\\"), "source",
        F.lit(", ~/notes/"), "lang", F.lit(" or \\\\server\\share\\"), "source", F.lit('; "/opt/'), "lang", F.lit("/"), "source",
        F.lit('" http://h/a/b a/b/c'))
    docs = corpus.table(spark, sf, "documents").select("doc_id", text.alias("line"))
    return redaction.redact_paths(docs, "line", {"/srv/work": "<project>", "/srv": "<system>"}).select("doc_id", "redacted")


@query("redact_json", "WITH " + _secret_sql("SELECT doc_id, text AS t, 0 AS n FROM documents") + r"""
SELECT doc_id, '$.text' AS location, t AS redacted FROM s6
UNION ALL SELECT doc_id, '$.meta.lang', lang FROM documents
UNION ALL SELECT doc_id, '$.meta.tags[0]', source FROM documents
UNION ALL SELECT doc_id, '$.meta.tags[1]', '<absolutePath>' FROM documents""")
def _(spark, sf):
    body = F.struct("text", F.struct("lang", F.array(F.col("source"), F.concat(F.lit("/etc/x/"), "source")).alias("tags")).alias("meta"))
    docs = corpus.table(spark, sf, "documents").select("doc_id", F.to_json(body).alias("json"))
    return redaction.redact_json(docs, ["doc_id"], "json").drop("changed")


BOOKS = r"""
books AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 5 = 0 AS linked, o_orderkey % 3 <> 0 AS named, o_custkey % 2 = 0 AS charted, starts_with(o_orderpriority, '1') AS tabled,
         coalesce(n, 0) * 2 * CASE WHEN o_orderkey % 11 = 0 THEN 50 ELSE 1 END AS cells, coalesce(f, 0) AS formulas, coalesce(p, 0) AS locked
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS f, count(*) FILTER (l_linenumber = 4) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


@query("workbook_flags", "WITH " + BOOKS + r"""
SELECT doc_id, 'XLSX_FORMULAS_NONE' AS code, 'warning' AS severity FROM books WHERE formulas = 0
UNION ALL SELECT doc_id, 'XLSX_NAMED_RANGES_NONE', 'warning' FROM books WHERE NOT named
UNION ALL SELECT doc_id, 'XLSX_EXTERNAL_LINKS_PRESENT', 'error' FROM books WHERE linked
UNION ALL SELECT doc_id, 'XLSX_PROTECTED_SHEETS_PRESENT', 'warning' FROM books WHERE locked > 0""")
def _(spark, sf):
    """Review flags over the summary of the workbooks' parts."""
    return integrity.workbook_flags(inventory.workbook_map(corpus.review_books(spark, sf)))
