"""Packages written by the tests: zip, relationships, worksheets, PDF, media."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators import edits, inventory, integrity, stories
from folioscope.sources import packages, pdf, relationships, sheets, textnodes
from folioscope.sources.packages import Limits


def zipped(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in entries:
            archive.writestr(name, data)
    return buffer.getvalue()


def frame(spark, items):
    return spark.createDataFrame([(d, f, bytearray(c)) for d, f, c in items], "doc_id string, format string, content binary")


@pytest.fixture
def parts_of(spark):
    def build(fmt, entries, doc="d"):
        return packages.readable(packages.shred(frame(spark, [(doc, fmt, zipped(entries))])))

    return build


def test_scan_reads_files_with_format_size_and_digest(spark, tmp_path, rows):
    (tmp_path / "a.DOCX").write_bytes(zipped([("x.xml", "<a/>")]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.bin").write_bytes(b"0" * 50)
    scanned = packages.scan_packages(spark, str(tmp_path), Limits(input_bytes=400))
    assert rows(scanned, "format") == [("docx",), ("pdf",), ("unknown",)]
    tight = packages.scan_packages(spark, str(tmp_path), Limits(input_bytes=40))
    assert rows(tight, "format", "blocked") == [("docx", "INPUT_TOO_LARGE"), ("pdf", None), ("unknown", "INPUT_TOO_LARGE")]
    assert ("INPUT_TOO_LARGE",) in rows(packages.shred(tight), "blocked")
    assert rows(packages.oversized(spark, str(tmp_path), Limits(input_bytes=40)), "code")[0] == ("INPUT_TOO_LARGE",)


def test_shred_pack_shred_is_identity(spark, rows):
    entries = [("[Content_Types].xml", "<T/>"), ("word/media/i.png", b"\x89PNG\x00"), ("word/bad.xml", b"\xff\xfe"), ("word/document.xml", "<d>é</d>")]
    first = packages.shred(frame(spark, [("a", "docx", zipped(entries))]))
    again = packages.shred(packages.pack(packages.readable(first)))
    assert rows(first, "part", "ord", "sha256") == rows(again, "part", "ord", "sha256")
    assert rows(first.filter("xml is null"), "part") == [("word/bad.xml",), ("word/media/i.png",)]


def test_refused_packages_are_reported_and_not_inflated(spark, rows):
    bomb = zipped([("a.xml", "0" * 500_000)])
    many = zipped([(f"{i}.txt", "x") for i in range(5)])
    got = packages.shred(frame(spark, [("bomb", "docx", bomb), ("many", "docx", many), ("junk", "docx", b"no zip")]), Limits(entries=3))
    assert rows(got, "doc_id", "blocked") == [
        ("bomb", "ZIP_COMPRESSION_RATIO_EXCEEDED"), ("junk", "ZIP_CENTRAL_DIRECTORY_INVALID"), ("many", "ZIP_ENTRY_LIMIT_EXCEEDED")]


def test_pack_refuses_documents_above_the_limit(spark, rows):
    parts = packages.readable(packages.shred(frame(spark, [("a", "docx", zipped([("1", "x"), ("2", "y")]))])))
    assert rows(packages.pack(parts, Limits(entries=1)), "doc_id", "blocked") == [("a", "PACKAGE_TOO_LARGE")]


def test_duplicate_entries_survive_and_are_found(spark, rows, parts_of):
    with pytest.warns(UserWarning):
        parts = parts_of("docx", [("a.xml", "1"), ("a.xml", "2")])
    assert rows(integrity.duplicates(parts, ["doc_id", "part"]), "part", "copies") == [("a.xml", 2)]


def test_unsafe_names(spark, rows, parts_of):
    parts = parts_of("docx", [("../evil.txt", "x"), ("/abs", "x"), ("C:/x", "x"), ("fine/a..b", "x")])
    assert rows(integrity.unsafe_names(parts), "part", "code") == [
        ("../evil.txt", "ZIP_SLIP_ENTRY"), ("/abs", "ZIP_ABSOLUTE_ENTRY"), ("C:/x", "ZIP_WINDOWS_DRIVE_ENTRY")]


def test_relationships_resolve_and_break(spark, rows, parts_of):
    xml = ("<Relationships><Relationship TargetMode='External' Id='r1' Target='http://x/y?a=1&amp;b=2' Type='t'/>"
           '<Relationship Target="../media/a.png#f" Type="image" Id="r2"/><Relationship Id="r3" Target="/ppt/none.xml"/></Relationships>')
    parts = parts_of("pptx", [("ppt/slides/_rels/slide1.xml.rels", xml), ("ppt/media/a.png", "x")])
    rels = relationships.relationships(parts)
    assert rows(rels, "rel_id", "owner", "external", "resolved") == [
        ("r1", "ppt/slides/slide1.xml", True, None), ("r2", "ppt/slides/slide1.xml", False, "ppt/media/a.png"),
        ("r3", "ppt/slides/slide1.xml", False, "ppt/none.xml")]
    assert rows(rels.filter("rel_id = 'r1'"), "target") == [("http://x/y?a=1&b=2",)]
    assert rows(integrity.broken_targets(rels, parts), "rel_id", "target") == [("r3", "ppt/none.xml")]
    assert rows(integrity.external_targets(rels), "rel_id", "severity") == [("r1", "error")]


def test_worksheet_values_shared_strings_and_shared_formulas(spark, rows, parts_of):
    workbook = '<workbook><sheets><sheet name="P&amp;L" r:id="rId9" sheetId="1"/></sheets></workbook>'
    rels = "<Relationships><Relationship Target='/xl/worksheets/sheet7.xml' Id='rId9'/></Relationships>"
    strings = "<sst><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>"
    sheet = ('<worksheet><row><c r="A1" t="s"><v>1</v></c><c r="B1" t="b"><v>1</v></c><c r="C1"><f t="shared" si="0" ref="C1:C2">A1&lt;B1</f><v>3</v></c>'
             '<c r="D1"/></row><row><c r="C2"><f t="shared" si="0"/><v>4</v></c><c r="E2" t="inlineStr"><is><t>in</t></is></c></row></worksheet>')
    parts = parts_of("xlsx", [("xl/workbook.xml", workbook), ("xl/_rels/workbook.xml.rels", rels), ("xl/sharedStrings.xml", strings), ("xl/worksheets/sheet7.xml", sheet)])
    assert rows(sheets.sheet_cells(parts), "sheet_name", "ref", "value", "formula") == [
        ("P&L", "A1", "two", None), ("P&L", "B1", "TRUE", None), ("P&L", "C1", "3", "A1<B1"), ("P&L", "C2", "4", "A1<B1"),
        ("P&L", "D1", "", None), ("P&L", "E2", "in", None)]


def test_text_object_ids_survive_a_text_edit(spark, rows, parts_of):
    before = parts_of("docx", [("word/document.xml", "<w:t>a</w:t><w:t> </w:t><w:t xml:space='preserve'>b &amp; c</w:t>")])
    after = parts_of("docx", [("word/document.xml", "<w:t>a</w:t><w:t> </w:t><w:t>changed</w:t>")])
    assert rows(textnodes.text_objects(before), "idx", "text") == [(0, "a"), (2, "b & c")]
    assert rows(textnodes.text_objects(before), "object_id") == rows(textnodes.text_objects(after), "object_id")


def test_tables_keep_ragged_rows_and_drop_blank_ones(spark, rows, parts_of):
    xml = ("<w:tbl><w:tr><w:tc><w:p><w:t>a</w:t><w:t>b</w:t></w:p></w:tc><w:tc/></w:tr><w:tr></w:tr>"
           "<w:tr><w:tc><w:t>c</w:t></w:tc><w:tc><w:t>d</w:t></w:tc><w:tc><w:t>e</w:t></w:tc></w:tr></w:tbl><w:tbl></w:tbl>")
    parts = parts_of("docx", [("word/document.xml", xml)])
    found = textnodes.tables(parts, textnodes.TABLE_TAGS["docx"])
    assert rows(found, "table", "row_count", "column_count") == [(0, 2, 3)]
    cells = textnodes.table_cells(parts, textnodes.TABLE_TAGS["docx"])
    assert (0, 0, "a b") in rows(cells, "row", "col", "text")


def test_run_formats_inherit_from_the_paragraph(spark, rows, parts_of):
    xml = ('<p:sld><p:txBody><a:p><a:pPr lvl="2"><a:buAutoNum type="arabicPeriod"/><a:defRPr sz="1200" b="1"><a:latin typeface="Base"/></a:defRPr></a:pPr>'
           '<a:r><a:rPr b="0" lang="ja-JP"><a:ea typeface="Gothic"/></a:rPr><a:t>x</a:t></a:r><a:br/><a:r><a:t>y</a:t></a:r></a:p></p:txBody></p:sld>')
    parts = parts_of("pptx", [("ppt/slides/slide1.xml", xml)])
    assert rows(textnodes.runs(parts), "pos", "text", "bold", "font_pt", "font_latin", "font_ea", "lang", "level", "numbering") == [
        (0, "x", False, 12.0, "Base", "Gothic", "ja-JP", 2, "arabicPeriod"), (1, "\n", None, None, None, None, None, 2, "arabicPeriod"),
        (2, "y", True, 12.0, "Base", None, None, 2, "arabicPeriod")]
    assert rows(textnodes.text_semantics(parts), "text", "line_breaks") == [("x\ny", 1)]


def test_story_graph_links_runs_of_a_paragraph(spark, rows, parts_of):
    xml = ("<w:document><w:p><w:r><w:t>a</w:t></w:r><w:r><w:instrText>PAGE</w:instrText></w:r></w:p>"
           '<w:p><w:hyperlink r:id="x"><w:r><w:t>b</w:t></w:r></w:hyperlink><w:ins/></w:p></w:document>')
    parts = parts_of("docx", [("word/document.xml", xml)])
    edges = stories.edges(parts)
    assert rows(edges.filter("relation = 'next'"), "from_id", "to_id") == [("word/document.xml#1.1", "word/document.xml#1.2")]
    assert edges.filter("relation = 'contains'").count() == 2 + 3 + 3
    assert rows(stories.markers(parts), "hyperlink", "field", "insertion") == [(1, 1, 1)]
    assert ("field_code",) in rows(stories.nodes(parts), "type")


def test_pdf_text_from_literals_arrays_and_deflated_streams(spark, rows):
    stream = zlib.compress(b"BT (hidden text) Tj ET")
    body = (b"%PDF-1.4\n1 0 obj << >>\nstream\nBT (plain \\(one\\)) Tj [(two) -20 (parts)] TJ (x) Tj ET\nendstream\nendobj\n"
            b"2 0 obj << /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj\nstartxref\n%%EOF")
    files = frame(spark, [("p", "pdf", body)])
    assert rows(pdf.pdf_text(files), "text") == [("plain (one)",), ("twoparts",)]
    assert ("hidden text",) in rows(pdf.pdf_text(files, deflated=True), "text")
    assert rows(inventory.pdf_scan(files), "objects", "streams", "encrypted", "unsupported_filters") == [(2, 2, False, "")]
    assert rows(integrity.pdf_markers(files)) == []


def test_pdf_risks(spark, rows):
    files = frame(spark, [("p", "pdf", b"%PDF-1.4 /Encrypt 1 0 R /JavaScript /Filter [/DCTDecode /FlateDecode] %%EOF %%EOF")])
    risks = inventory.pdf_risks(inventory.pdf_scan(files), pdf.pdf_text(files))
    assert rows(risks, "code") == [("PDF_ACTIVE_CONTENT",), ("PDF_ENCRYPTED",), ("PDF_INCREMENTAL_UPDATES",), ("PDF_TEXT_BLOCKS_ZERO",), ("PDF_UNSUPPORTED_FILTERS",)]


def test_assets_types_sizes_and_owners(spark, rows):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 20, 30) + b"\x01\x00\x00"
    rel = lambda target: f'<Relationships><Relationship Id="r" Target="{target}"/></Relationships>'
    parts = packages.readable(packages.shred(frame(spark, [("a", "pptx", zipped([
        ("ppt/media/a.png", png), ("ppt/media/b.jpg", jpeg), ("ppt/embeddings/w.xlsx", "x"),
        ("ppt/slides/_rels/slide3.xml.rels", rel("../media/a.png")), ("ppt/charts/_rels/chart1.xml.rels", rel("../embeddings/w.xlsx"))]))])))
    got = inventory.assets(parts, relationships.relationships(parts))
    assert rows(got, "part", "media_type", "width", "height", "usage_count", "orphaned", "first_slide", "embedding_kind") == [
        ("ppt/embeddings/w.xlsx", "application/octet-stream", None, None, 1, False, None, "chartEmbeddedWorkbook"),
        ("ppt/media/a.png", "image/png", 640, 480, 1, False, 3, None), ("ppt/media/b.jpg", "image/jpeg", 30, 20, 0, True, None, None)]


def test_slide_objects_groups_connectors_and_charts(spark, rows, parts_of):
    xml = ('<p:sld><p:cxnSp><p:cNvPr id="7" name="Line"/><a:stCxn id="2"/><a:endCxn id="3"/></p:cxnSp>'
           '<p:grpSp><p:cNvPr id="9" name="G"/><p:sp><p:cNvPr id="10" name="in"/></p:sp></p:grpSp>'
           '<p:pic><p:cNvPr id="4" name="Pic"/><a:off x="914400" y="0"/><a:ext cx="914400" cy="457200"/></p:pic></p:sld>')
    chart = "<c:ser><c:idx val='1'/><c:order val='2'/><c:tx><c:v>A&amp;B</c:v></c:tx><c:cat><c:f>S!$A$1</c:f></c:cat><c:val><c:f>S!$B$1</c:f></c:val></c:ser>"
    diagram = '<dgm:pt modelId="m1"><a:t>node</a:t></dgm:pt><dgm:pt modelId="m2"></dgm:pt>'
    parts = parts_of("pptx", [("ppt/slides/slide1.xml", xml), ("ppt/charts/chart1.xml", chart), ("ppt/diagrams/data1.xml", diagram)])
    assert rows(inventory.slide_objects(parts), "kind", "child_ids", "from_shape", "to_shape", "x", "w", "h") == [
        ("connector", None, "2", "3", None, None, None), ("group", "10", None, None, None, None, None), ("picture", None, None, None, 96, 96, 48),
        ("shape", None, None, None, None, None, None)]
    assert rows(inventory.chart_series(parts), "series_idx", "series_order", "name", "category_ref", "value_ref") == [(1, 2, "A&B", "S!$A$1", "S!$B$1")]
    assert rows(inventory.diagram_nodes(parts), "model_id", "text") == [("m1", "node")]


def test_headings_metadata_and_mixed_fonts(spark, rows, parts_of):
    doc = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>no</w:t></w:r></w:p>'
    core = "<dc:title>T &lt; U</dc:title><dc:creator>me</dc:creator><dcterms:created>2024-01-02T03:04:05Z</dcterms:created>"
    parts = parts_of("docx", [("word/document.xml", doc), ("docProps/core.xml", core)])
    assert rows(inventory.heading_tree(parts), "idx", "style", "level", "text") == [(1, "Heading2", 2, "Top")]
    assert rows(inventory.metadata(parts).select("title", "creator", F.year("created"))) == [("T < U", "me", 2024)]
    fonts = spark.createDataFrame([("d", "p", 0, f) for f in "abc"], "doc_id string, part string, shape int, font_latin string")
    fonts = fonts.withColumn("font_ea", F.lit(None).cast("string")).withColumn("font_cs", F.lit("a"))
    assert rows(inventory.mixed_fonts(fonts), "fonts") == [(3,)]


def test_replace_media_and_extract(spark, rows):
    parts = spark.createDataFrame([("d", "word/media/a.bmp", bytearray(b"1")), ("d", "x.xml", bytearray(b"2"))], "doc_id string, part string, content binary")
    rels = spark.createDataFrame([("d", "word/document.xml", "media/a.bmp"), ("d", "word/document.xml", "other.xml")], "doc_id string, owner string, target string")
    swap = spark.createDataFrame([("d", "word/media/a.bmp", bytearray(b"new"), "png")], "doc_id string, part string, new_content binary, extension string")
    new_parts, new_rels = edits.replace_media(parts, rels, swap)
    assert rows(new_parts, "part", "replaced") == [("word/media/a.png", True), ("x.xml", False)]
    assert rows(new_rels, "target") == [("media/a.png",), ("other.xml",)]
    assert rows(inventory.extract_media(parts), "name") == [("a.bmp",)]


def test_sheet_data_round_trip(spark, rows):
    cells = spark.createDataFrame([("d", "S", 2, 10, "B10", "x<y", None), ("d", "S", 1, 2, "A2", "5", None), ("d", "S", 1, 10, "A10", None, "A2*2")],
                                  "doc_id string, sheet string, col int, row int, ref string, value string, formula string")
    xml = edits.sheet_data(cells).select("xml").first()[0]
    assert xml == ('<sheetData><row r="2"><c r="A2"><v>5</v></c></row><row r="10"><c r="A10"><f>A2*2</f></c>'
                   '<c r="B10" t="inlineStr"><is><t>x&lt;y</t></is></c></row></sheetData>')
    assert rows(edits.sheet_data(cells, max_bytes=20), "blocked") == [("PART_TOO_LARGE",)]


def test_pdf_information_fields(spark, rows):
    files = frame(spark, [("p", "pdf", b"%PDF-1.4 << /Title (Annual report) /Author(me) /CreationDate (D:20240102) >>")])
    assert rows(inventory.pdf_metadata(files), "title", "author", "created", "modified") == [("Annual report", "me", "D:20240102", None)]


def test_elements_nest(spark, parts_of):
    from folioscope.functions import tree

    token = tree.tag_pattern("g", "s")
    assert tree.nodes_of("<g>a<s>b</s><g>c<s/>d</g>e</g><s>f</s>", token) == [
        ("g", [], "<g>ae</g>"), ("s", [0], "<s>b</s>"), ("g", [0], "<g>cd</g>"), ("s", [0, 2], "<s/>"), ("s", [], "<s>f</s>")]
    # Closing tags without an opening one, elements left open, comments, character data, longer names.
    assert tree.nodes_of("</s><g><s>x</g><!-- <s> --><![CDATA[<g>]]><sx>y</sx><s>z", token) == [
        ("g", [], "<g></g>"), ("s", [0], "<s>x"), ("s", [], "<s>z")]
    deep = "<g>" * 3000 + "</g>" * 3000
    assert [len(path) for _, path, _ in tree.nodes_of(deep, token)] == list(range(3000))


def test_groups_shift_and_scale_what_they_hold(spark, parts_of):
    frame = lambda x, y, w, h, c="": (f'<a:{c}{"O" if c else "o"}ff x="{x * 9525}" y="{y * 9525}"/><a:{c}{"E" if c else "e"}xt cx="{w * 9525}" cy="{h * 9525}"/>')
    shape = lambda i, x, y: f'<p:sp><p:cNvPr id="{i}" name="s{i}"/>{frame(x, y, 10, 20)}<a:t>t{i}</a:t></p:sp>'
    xml = (f'<p:sld><p:grpSp><p:cNvPr id="1"/>{frame(100, 50, 200, 100)}{frame(0, 0, 100, 100, "ch")}{shape(2, 5, 7)}'
           f'<p:grpSp><p:cNvPr id="3"/>{frame(10, 10, 20, 20)}{frame(1, 2, 10, 10, "ch")}{shape(4, 3, 4)}</p:grpSp></p:grpSp>'
           f'<p:grpSp><p:cNvPr id="5"/>{shape(6, 8, 9)}</p:grpSp></p:sld>')
    order = ('<p:presentation><p:sldIdLst><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/></p:sldIdLst></p:presentation>',
             '<Relationships><Relationship Id="a" Type="slide" Target="slides/slide1.xml"/><Relationship Id="b" Type="slide" Target="slides/slide2.xml"/></Relationships>')
    parts = parts_of("pptx", [("ppt/presentation.xml", order[0]), ("ppt/_rels/presentation.xml.rels", order[1]), ("ppt/slides/slide1.xml", xml),
                              ("ppt/slides/slide2.xml", "<p:sld/>"), ("ppt/slides/slide3.xml", f"<p:sld>{shape(9, 1, 1)}</p:sld>")])
    got = {r.shape_id: r for r in inventory.slide_objects(parts, inventory.slide_numbers(parts)).collect()}
    box = lambda i: (got[i].x, got[i].y, got[i].w, got[i].h, got[i].parent_id, got[i].depth, got[i].slide)
    assert box("2") == (110, 57, 20, 20, "1", 1, 2) and (got["2"].local_x, got["2"].local_y) == (5, 7)
    assert box("3") == (120, 60, 40, 20, "1", 1, 2)
    assert box("4") == (128, 64, 40, 40, "3", 2, 2)  # 10 + (3 - 1) * 2 = 14, then 100 + 14 * 2
    assert box("6") == (8, 9, 10, 20, "5", 1, 2)
    assert got["1"].child_ids == "2,3,4" and got["3"].child_ids == "4" and got["1"].text == "" and got["4"].text == "t4"
    assert "9" not in got  # not listed
    plain = {r.shape_id: r.slide for r in inventory.slide_objects(parts).collect()}
    assert plain["9"] == 3 and plain["1"] == 1
    unlisted = parts.where("part NOT LIKE 'ppt/%resentation%'")
    assert {(r.slide, r.part) for r in inventory.slide_numbers(unlisted).collect()} == {(i, f"ppt/slides/slide{i}.xml") for i in (1, 2, 3)}


def test_tables_within_cells(spark, parts_of):
    cell = lambda t, inner="": f"<w:tc><w:t>{t}</w:t>{inner}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell('x')}</w:tr><w:tr></w:tr><w:tr>{cell('y')}{cell('z')}</w:tr></w:tbl>"
    xml = f"<w:tbl><w:tr>{cell('a')}{cell('b', inner)}</w:tr></w:tbl><w:tbl><w:tr></w:tr></w:tbl><w:tbl><w:tr><w:tc/>{cell('c')}</w:tr></w:tbl>"
    found = textnodes.tables(parts_of("docx", [("word/document.xml", xml)]), textnodes.TABLE_TAGS["docx"]).orderBy("table").collect()
    assert [(r.table, r.parent, r.parent_row, r.parent_col, r.rows) for r in found] == [
        (0, None, None, None, [["a", "b"]]), (1, 0, 0, 1, [["x"], ["y", "z"]]), (2, None, None, None, [["", "c"]])]


def test_sheets_are_read_once(spark, parts_of):
    """F13, F16: no filter that Spark infers reads a sheet or a workbook a second time, and sheets meet their workbook before they are cells."""
    parts = parts_of("xlsx", [("xl/workbook.xml", '<workbook><sheets><sheet name="A" r:id="r1"/></sheets></workbook>'),
                              ("xl/worksheets/sheet1.xml", '<worksheet><c r="A1"/></worksheet>')])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    filters = lambda df: [line for line in plan(df).splitlines() if line.lstrip(" :+-").startswith("Filter") and "regexp_extract_all" in line]
    cells = sheets.sheet_cells(parts).drop("col", "row")
    assert not filters(cells) and not filters(sheets.sheets(parts))
    lines = plan(cells).splitlines()
    assert next(i for i, line in enumerate(lines) if "Generate posexplode" in line) < next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)


def test_attributes_and_cells_in_odd_spellings(spark, rows, parts_of):
    sheet = ('<worksheet><c r = "b2" xr="Z9" t=\'b\'><v>1</v></c><c/><c x:r="C3"><v>2</v></c><c r="é1"><f/><v>3</v></c><c s="1" r="D4" /><c r="AA10" t="str"><v a="1">&lt;</v></c></worksheet>')
    parts = parts_of("xlsx", [("xl/worksheets/sheet1.xml", sheet)])
    assert rows(sheets.sheet_cells(parts), "ref", "col", "row", "value", "is_formula") == [
        ("AA10", 27, 10, "<", False), ("B2", 2, 2, "TRUE", False), ("D4", 4, 4, "", False), ("É1", None, None, "3", True)]


def test_cells_of_orders_are_compared_as_rows(spark, sf):
    """the greatest value of each place is found before a row becomes five cells."""
    from folioscope.plans import editing

    lines = editing._unique_cells(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    place = lambda word: next(i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith(word))
    assert place("Generate inline") < place("Aggregate")


def test_orders_are_dealt_out_and_trees_come_in_slices(spark, sf, rows):
    """short rows that become long parts fill several partitions a core; results leave a worker slice by slice."""
    from folioscope.functions import tree
    from folioscope.sources import corpus

    assert corpus.table_parts(spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    held = []
    read = lambda text: held.append(text) or [(str(len(held)), [], text)]
    texts = spark.range(0, 3 * tree.SLICE + 5, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("text"))
    seen = texts.select("id", "text", tree._in_slices(read, tree.NODES, tree.ARROW_NODES)("text").alias("n")).collect()
    assert len(seen) == 3 * tree.SLICE + 5 and all((r.n is None) if r.text is None else (r.n[0].own == r.text) for r in seen)


def test_packages_pass_through_arrow(spark):
    """parts of several packages leave a worker together, and no package is a frame of its own."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("docx").alias("format"), F.inline(F.array(
        F.struct(F.lit("b.xml").alias("part"), F.lit(2).alias("ord"), F.lit("<b/>").alias("xml")),
        F.struct(F.lit("last.xml").alias("part"), F.lit(None).cast("int").alias("ord"), F.lit("<c/>").alias("xml")),
        F.struct(F.lit("a.xml").alias("part"), F.lit(1).alias("ord"), F.lit("<a/>").alias("xml")))))
    found = packages.shred(packages.pack(docs))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" in plan
    got = {}
    for row in found.collect():
        got.setdefault(row.doc_id, []).append((row.ord, row.part, row.xml))
    assert len(got) == 40 and all(v == [(0, "a.xml", "<a/>"), (1, "b.xml", "<b/>"), (2, "last.xml", "<c/>")] for v in got.values())
