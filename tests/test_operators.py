"""Operators against brute force on small inputs, and invariants."""

import json
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions.cellref import col_to_letters, letters_to_col, parse_range, range_bounds
from folioscope.functions.text import fnv1a, string_distance
from folioscope.functions.xml import xml_escape, xml_unescape
from folioscope.operators import documents, edits, formulas, geometry, integrity, redaction, runs, selectors, templates, verification, versions
from folioscope.plans import ordered
from folioscope.sources import corpus
from folioscope.sources.relationships import resolve_target
from folioscope.streaming import traces


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


# --- column functions -------------------------------------------------------------------


def test_fnv_matches_a_plain_loop(spark):
    def plain(text):
        h = 2166136261
        for ch in text:
            h = ((h ^ int.from_bytes(ch.encode("utf-16-be")[:2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    for text in ("", "hello", "Étion ß", "a😀b"):
        assert one(spark, fnv1a(F.lit(text))) == plain(text)


def test_unescape_orders_entities_before_references(spark):
    assert one(spark, xml_unescape(F.lit("&amp;lt; &#65;&#x42; &#xD800; &#99999999999; &amp;#67;"))) == "&lt; AB &#xD800; &#99999999999; C"
    assert one(spark, xml_unescape(F.lit("&#65;"), numeric=False)) == "&#65;"
    assert one(spark, xml_escape(F.lit('<a b="c&d">'))) == "&lt;a b=&quot;c&amp;d&quot;&gt;"


def test_cell_references_cover_the_largest_sheet(spark):
    df = spark.range(1, 16385).select(F.col("id").cast("int").alias("n")).withColumn("l", col_to_letters("n"))
    assert df.filter(letters_to_col("l") != F.col("n")).count() == 0
    assert df.filter("n = 16384").first()["l"] == "XFD"
    assert parse_range("C9:A2") == (1, 2, 3, 9)
    assert tuple(one(spark, range_bounds(F.lit("Sheet1!$C$9:A2")))) == (1, 2, 3, 9)
    assert one(spark, range_bounds(F.lit("oops"))) is None


def test_string_distance(spark):
    assert one(spark, string_distance(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, string_distance(F.lit(""), F.lit("ab"))) == 1.0
    assert one(spark, string_distance(F.lit("abcd"), F.lit("abxde"))) == 0.4  # one mismatch and one extra of five


def test_target_resolution(spark):
    cases = [("ppt/slides/slide1.xml", "../media/a.png", "ppt/media/a.png"), ("", "word/document.xml", "word/document.xml"),
             ("a/b.xml", "./c//d.xml?x#y", "a/c/d.xml"), ("a/b.xml", "/root.xml", "root.xml"), ("a/b.xml", "#only", None)]
    for owner, target, want in cases:
        assert one(spark, resolve_target(F.lit(owner), F.lit(target))) == want


# --- chunked ordering equals plain windows --------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; positions have gaps and values have NULLs."""
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", pos, None if rng.random() < 0.7 else f"v{pos}") for pos in rng.sample(range(5000), 900)]
    return spark.createDataFrame(data, "k string, pos int, v string")


def test_numbered_equals_row_number(skewed):
    w = Window.partitionBy("k").orderBy("pos")
    plain = skewed.withColumn("rn", F.row_number().over(w).cast("bigint"))
    chunked = ordered.numbered(skewed, ["k"], [F.col("pos")], ordered.chunk_of(F.col("pos"), 64))
    assert plain.exceptAll(chunked.select(plain.columns)).count() == 0 and chunked.count() == plain.count()


def test_previous_equals_lag(skewed):
    w = Window.partitionBy("k").orderBy("pos")
    plain = skewed.withColumn("before", F.lag("v").over(w))
    chunked = ordered.previous(skewed, ["k"], ["pos"], ordered.chunk_of(F.col("pos"), 64), {"v": "before"})
    assert plain.exceptAll(chunked.select(plain.columns)).count() == 0


def test_filled_equals_last_non_null(skewed):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("f", F.last("v", ignorenulls=True).over(w))
    chunked = ordered.filled(skewed, ["k"], ["pos"], ordered.chunk_of(F.col("pos"), 64), "v", "f")
    assert plain.exceptAll(chunked.select(plain.columns)).count() == 0


# --- geometry against brute force -------------------------------------------------------------


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(3)
    return [("d", 1 + i % 2, f"o{i}", rng.randrange(0, 900, 10) * 1.0, rng.randrange(-50, 500, 10) * 1.0, rng.choice([0.0, 20.0, 60.0, 300.0]), rng.choice([0.0, 10.0, 45.0, 200.0]))
            for i in range(120)]


SCHEMA = "doc_id string, slide int, object_id string, x double, y double, w double, h double"


def share(a, ea, b, eb):
    return max(0.0, min(a + ea, b + eb) - max(a, b)) / max(1.0, min(ea, eb))


def test_geometry_edges_equal_all_pairs(spark, boxes, rows):
    want = []
    for _, s1, i, x, y, w, h in boxes:
        for _, s2, j, u, v, q, r in boxes:
            if i == j or s1 != s2:
                continue
            if w * h > q * r and u >= x and v >= y and u + q <= x + w and v + r <= y + h:
                want.append((i, j, "contains"))
            if x >= u + q and share(y, h, v, r) >= 0.25:
                want.append((i, j, "rightOf"))
            if y >= v + r and share(x, w, u, q) >= 0.25:
                want.append((i, j, "below"))
    df = spark.createDataFrame(boxes, SCHEMA)
    for size in (16.0, 64.0, 1000.0):
        assert rows(geometry.geometry_edges(df, size), "from_id", "to_id", "relation") == sorted(want)


def test_nearest_equals_a_full_scan(spark, boxes, rows):
    rng = random.Random(5)
    points = [(k, "d", rng.choice([1, 2, None]), rng.uniform(-300, 1500), rng.uniform(-300, 900)) for k in range(40)] + [(99, "d", 1, 9000.0, 9000.0)]
    want = []
    for k, _, slide, px, py in points:
        found = [(math.hypot(x + w / 2 - px, y + h / 2 - py), i) for _, s, i, x, y, w, h in boxes if slide is None or s == slide]
        found = [f for f in found if f[0] <= 1000]
        best = min((f[0] for f in found), default=None)
        want += [(k, i) for d, i in found if d - best <= 24 or d <= best * 1.15]
    got = selectors.nearest(spark.createDataFrame(boxes, SCHEMA), spark.createDataFrame(points, "selector_id int, doc_id string, slide int, px double, py double"), cell=50.0)
    assert rows(got, "selector_id", "object_id") == sorted(want, key=repr)


def test_label_and_value_boxes(spark, rows):
    df = spark.createDataFrame([("d", 1, "label", 10.0, 10.0, 80.0, 20.0), ("d", 1, "value", 120.0, 10.0, 80.0, 20.0), ("d", 1, "far", 400.0, 12.0, 80.0, 20.0)], SCHEMA)
    anchors = spark.createDataFrame([(1, "d", 1, "label"), (2, "d", 1, "label"), (2, "d", 1, "far")], "selector_id int, doc_id string, slide int, object_id string")
    assert rows(selectors.right_of(df, anchors), "selector_id", "object_id", "status") == [
        (1, "value", "candidate"), (2, "far", "ambiguous"), (2, "label", "ambiguous")]


def test_align_and_distribute(spark, rows):
    df = spark.createDataFrame([("s", i, f"o{i}", x, 0.0, 10.0, 5.0) for i, x in enumerate([0.0, 5.0, 70.0, 90.0])], "set_id string, pos int, object_id string, x double, y double, w double, h double")
    assert rows(geometry.distribute(df, "x", ["set_id"], width=8), "object_id", "x") == [("o0", 0.0), ("o1", 30.0), ("o2", 60.0), ("o3", 90.0)]
    assert rows(geometry.align(df, "right", ["set_id"], "pos"), "x") == [(0.0,)] * 4


# --- text search -----------------------------------------------------------------------------


def test_text_hits_equal_substring_search(spark, rows):
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "delta-x", "épsilon", "zeta."]
    texts = [(f"d{i}", "o", " ".join(rng.choice(words) for _ in range(12))) for i in range(60)]
    needles = ["alpha beta gamma", "eta", "a b", "GAMMA delta-x alpha", "-", "épsilon zeta. beta", "missing phrase here", "lpha beta gam"]
    want = [(d, p) for d, _, t in texts for p, n in enumerate(needles) if n.lower() in t.lower()]
    got = integrity.text_hits(spark.createDataFrame(texts, "doc_id string, object_id string, text string"),
                              spark.createDataFrame(list(enumerate(needles)), "pattern_id int, pattern string"))
    assert rows(got, "doc_id", "pattern_id") == sorted(want, key=repr)


def test_forbidden_text_keeps_a_margin(spark, rows):
    docs = spark.createDataFrame([("d", "o", "a" * 30 + " The SECRET plan " + "b" * 40)], "doc_id string, object_id string, text string")
    patterns = spark.createDataFrame([(1, "the secret plan")], "pattern_id int, pattern string")
    assert rows(integrity.forbidden_text(docs, patterns), "sample") == [("a" * 23 + " The SECRET plan " + "b" * 23,)]


# --- versions --------------------------------------------------------------------------------


def test_diff_of_a_snapshot_with_itself_is_empty(spark, sf):
    parts = corpus.snapshot_parts(spark, sf, "before")
    assert versions.touched_parts(parts, parts).count() == 0
    objects = corpus.page_objects(spark, sf)
    assert versions.diff_objects(objects, objects).count() == 0


def test_added_removed_common_partition_the_union(spark, sf):
    before, after = corpus.snapshot_parts(spark, sf, "before"), corpus.snapshot_parts(spark, sf, "after")
    total = versions.diff_parts(before, after).agg(F.sum(F.col("added") + F.col("removed") + F.col("changed") + F.col("unchanged"))).first()[0]
    assert total == before.select("doc_id", "part").union(after.select("doc_id", "part")).distinct().count()


def test_part_kinds(spark):
    names = {"ppt/slides/slide2.xml": "slideXml", "xl/charts/chart1.xml": "chartXml", "word/styles.xml": "styles", "a/_rels/b.rels": "relationships",
             "word/media/x.png": "imageOrMedia", "docProps/app.xml": "packagePart", "[Content_Types].xml": "contentTypes"}
    df = spark.createDataFrame([(n,) for n in names], "part string").withColumn("kind", versions.part_kind())
    assert dict(df.collect()) == names


# --- redaction ---------------------------------------------------------------------------------


def test_secrets_are_masked_in_order(spark):
    text = ("Bearer abcdefghijkl1234 and sk-ABCDEFGHIJKLMNOP12 DB_PASSWORD='hunter22' https://x/?api_key=abc&b=1\n"
            "Set-Cookie: sid=1\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- done")
    row = redaction.redact_secrets(spark.createDataFrame([(text,)], "t string"), "t").first()
    mask = redaction.MASK
    assert row["redacted"] == (f"Bearer {mask} and {mask} DB_PASSWORD={mask} https://x/?api_key={mask}&b=1\nCookie: {mask}\n{mask} done")
    assert row["redactions"] == 6
    assert redaction.redact_secrets(spark.createDataFrame([("nothing = here",)], "t string"), "t").first()["redactions"] == 0


def test_paths_and_roots(spark):
    text = r"C:\Users\me\x.txt \\srv\share\a ~/notes /opt/app/bin http://h/a/b #/x/y"
    df = spark.createDataFrame([(text,), ("#/a/b/c",)], "t string")
    got = [r[0] for r in redaction.redact_paths(df, "t", {r"C:\Users\me": "<userHome>"}).select("redacted").collect()]
    assert got == ["<userHome>/x.txt <uncPath> <userHome> <absolutePath> http://h/a/b #<absolutePath>", "#/a/b/c"]


def test_json_leaves_go_to_any_depth(spark, rows):
    doc = {"a": [{"b": "/opt/x/y"}, 1, None], "c": {"d": {"e": {"f": "deep"}}}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "no json")], "id int, j string")
    assert rows(redaction.json_leaves(df, ["id"], "j"), "location", "value") == [
        ("$.a[0].b", "/opt/x/y"), ("$.a[1]", "1"), ("$.a[2]", None), ("$.c.d.e.f", "deep")]
    leaf = 'leaf \\" ] } \\\\'
    nested = leaf
    for level in range(40):
        nested = {f"k{level}": nested} if level % 2 else [nested]
    deep = spark.createDataFrame([(1, json.dumps(nested))], "id int, j string")
    assert [r["value"] for r in redaction.json_leaves(deep, ["id"], "j").collect()] == [leaf]
    assert ("$.a[0].b", "<absolutePath>", True) in rows(redaction.redact_json(df, ["id"], "j"), "location", "redacted", "changed")


def test_thousands_of_one_word_patterns(spark):
    texts = [(f"d{i}", "o", f"start w{i}x and W{i * 7}Y, é! end{i}") for i in range(60)]
    patterns = [(n, p) for n, p in enumerate([*(f"w{i}x" for i in range(2500)), *(f"{i}y" for i in range(2497)), "é", "D1", "and"])]
    objects = spark.createDataFrame(texts, "doc_id string, object_id string, text string")
    wanted = spark.createDataFrame(patterns, "pattern_id int, pattern string")
    got = {(r["doc_id"], r["pattern_id"]) for r in integrity.text_hits(objects, wanted).collect()}
    assert got == {(d, n) for d, _, t in texts for n, p in patterns if p.lower() in t.lower()}


def test_pointers_and_markup_keep_their_paths(spark, rows):
    doc = {"a": {"instancePath": "/opt/x/y", "other": "/opt/x/y"}, "page.html": "<html> /opt/x/y </html>", "page.txt": "<html> /opt/x/y </html>"}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, j string")
    assert rows(redaction.redact_json(df, ["id"], "j"), "location", "changed") == [
        ("$.a.instancePath", False), ("$.a.other", True), ("$.page.html", False), ("$.page.txt", True)]


def test_batch_modes(spark, rows):
    ops = spark.createDataFrame([("b", "d", 0, True, False), ("b", "d", 1, True, True), ("b", "d", 2, True, False)], "batch_id string, doc_id string, op_idx int, required boolean, failed boolean")

    def states(**mode):
        return [s for _, s in rows(edits.apply_batch(ops, **mode), "op_idx", "status")]

    assert states() == states(atomic=False) == ["rolled_back", "failed", "skipped-after-error"]
    assert states(atomic=False, allow_partial=True) == ["applied", "failed", "skipped-after-error"]
    assert states(atomic=False, allow_partial=True, continue_on_error=True) == ["applied", "failed", "applied"]
    assert states(continue_on_error=True) == ["rolled_back", "failed", "rolled_back"]


def test_findings_name_the_shape_behind_a_picture(spark, rows):
    from folioscope.operators import inventory
    from folioscope.sources import textnodes

    box = '<p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="952500" cy="952500"/></a:xfrm></p:spPr>'
    body = '<p:txBody><a:p><a:r><a:rPr sz="{0}"/><a:t>some words</a:t></a:r></a:p></p:txBody>'
    xml = ('<p:sld><p:pic><p:nvPicPr><p:cNvPr id="1" name="P"/></p:nvPicPr></p:pic>'
           f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="A"/></p:nvSpPr>{box}{body.format(1800)}</p:sp>'
           f'<p:sp><p:nvSpPr><p:cNvPr id="3" name="B"/></p:nvSpPr>{box}{body.format(600)}</p:sp></p:sld>')
    parts = spark.createDataFrame([("d", "pptx", "ppt/slides/slide1.xml", xml)], "doc_id string, format string, part string, xml string")
    objects = inventory.slide_objects(parts)
    assert rows(objects, "pos", "text_body") == [(0, None), (1, 0), (2, 1)]
    tiny = verification.layout_lint(objects, textnodes.runs(parts)).filter("code = 'PPTX_TINY_TEXT'")
    assert rows(tiny, "shape") == [(2,)]


# --- edits, templates ----------------------------------------------------------------------------


def test_batches_atomic_and_best_effort(spark, rows):
    data = [("b", "d", i, i != 1, i in (1, 3)) for i in range(5)]
    df = spark.createDataFrame(data, "batch_id string, doc_id string, op_idx int, required boolean, failed boolean")
    assert [r[0] for r in edits.apply_batch(df).orderBy("op_idx").select("status").collect()] == [
        "rolled_back", "failed", "rolled_back", "failed", "skipped-after-error"]
    assert [r[0] for r in edits.apply_batch(df, atomic=False, dry_run=True, allow_partial=True).orderBy("op_idx").select("status").collect()] == [
        "would_change", "failed", "would_change", "failed", "skipped-after-error"]


def test_formula_rows_shift_with_anchors(spark):
    shifted = one(spark, edits.shift_formula(F.lit("SUM(A$9:B10)+AB12*$C$3"), F.lit(10), F.lit(5)))
    assert shifted == "SUM(A$9:B15)+AB17*$C$3"


def test_values_are_not_expanded_again(spark, rows):
    t = spark.createDataFrame([("t", "<a>{{ x }}-{{y.z}}</a>")], "template_id string, xml string")
    d = spark.createDataFrame([(1, "t", '{"x":"{{y.z}}","y":{"z":"<1>"}}'), (2, "t", '{"x":null,"y":{"z":2}}')], "record_id int, template_id string, json string")
    filled = templates.fill(t, d)
    assert rows(filled, "record_id", "filled", "replacements", "missing") == [
        (1, "<a>{{y.z}}-&lt;1&gt;</a>", 2, ""), (2, None, 1, "x")]
    assert rows(templates.fill_report(filled), "record_id", "readiness") == [(1, "pass"), (2, "blocked")]


def test_a_fill_that_makes_a_formula_unsafe_is_blocked(spark, rows):
    t = spark.createDataFrame([("t", "<c><f>SUM({{x}})</f></c>")], "template_id string, xml string")
    d = spark.createDataFrame([(1, "t", '{"x":"A1"}'), (2, "t", '{"x":"WEBSERVICE(1)"}')], "record_id int, template_id string, json string")
    filled = templates.fill(t, d)
    assert rows(filled, "record_id", "filled") == [(1, "<c><f>SUM(A1)</f></c>"), (2, None)]
    assert rows(templates.fill_report(filled), "record_id", "code", "readiness") == [(1, None, "pass"), (2, "XLSX_FORMULA_UNSAFE", "blocked")]


def test_two_edits_of_one_node_leave_the_last(spark):
    parts = spark.createDataFrame([("d", "docx", "p.xml", "<w:t>a</w:t><w:t>b</w:t>")], "doc_id string, format string, part string, xml string")
    changes = spark.createDataFrame([("d", "p.xml", 0, "late", 2), ("d", "p.xml", 0, "soon", 1)], "doc_id string, part string, idx int, text string, op_idx int")
    assert edits.write_back(parts, changes).first()["xml"] == "<w:t>late</w:t><w:t>b</w:t>"


def test_gates_on_a_missing_document_fail(spark, rows):
    summary = spark.createDataFrame([("d", 3, 3, 0, 0)], "doc_id string, slides int, pages int, warnings int, blank_pages int")
    objects = spark.createDataFrame([("d", "hello")], "doc_id string, text string")
    gates = spark.createDataFrame(
        [("d", 3, None, ["hello"], None, None, None), ("gone", 3, None, ["hello"], None, None, None)],
        "doc_id string, expected_slides int, expected_pages int, required_text array<string>, forbidden_text array<string>, max_warnings int, max_blank_pages int")
    assert rows(verification.evaluate_gates(summary, objects, gates), "doc_id", "code") == [("gone", "GATE_EXPECTED_SLIDES"), ("gone", "GATE_REQUIRED_TEXT_MISSING")]


def test_layouts_and_notes_are_not_text_of_a_presentation(spark, rows):
    from folioscope.sources import textnodes

    names = ["ppt/slides/slide1.xml", "ppt/slideLayouts/slideLayout1.xml", "ppt/notesSlides/notesSlide1.xml"]
    parts = spark.createDataFrame([("d", "pptx", n, f"<a:t>{n}</a:t>") for n in names], "doc_id string, format string, part string, xml string")
    assert rows(textnodes.text_objects(parts), "text") == [("ppt/slides/slide1.xml",)]


def test_conflicting_operation_arrays(spark, rows):
    df = spark.createDataFrame([("a", "[1]", "[1]"), ("b", "[1]", "[2]"), ("c", None, "[2]")], "batch_id string, operations string, ops string")
    assert rows(edits.conflicting_arrays(df), "batch_id") == [("b",)]


def test_selector_statuses_partition(spark, sf):
    from folioscope.plans.editing import _line_selectors, _resolved

    counts = {r["status"]: r["n"] for r in _resolved(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(counts.values()) == _line_selectors(spark, sf).count()


# --- formulas, JSON -------------------------------------------------------------------------------


def test_formula_dependencies(spark, rows):
    cells = spark.createDataFrame([("d", 1, "C1", "SUM(A1:B1)+Lookup!A1+TaxRate"), ("d", 1, "C2", 'Sales[Qty]&"Z9"+[Bk]S!B2+\'My Sheet\'!$D$4*Größe')],
                                  "doc_id string, sheet_idx int, ref string, formula string")
    names = spark.createDataFrame([("d", "TaxRate"), ("d", "sales"), ("d", "Größe"), ("e", "SUM")], "doc_id string, name string")
    tables = spark.createDataFrame([("d", "Sales")], "doc_id string, name string")
    got = rows(formulas.formula_deps(cells, names, tables), "ref", "dep_kind", "dep_ref", "dep_sheet", "dep_book", "dep_name")
    assert got == sorted([
        ("C1", "range", "A1:B1", None, None, None), ("C1", "threeD", "A1", "Lookup", None, None), ("C1", "namedRange", None, None, None, "TaxRate"),
        ("C2", "tableStructuredRef", None, None, None, "Sales"), ("C2", "threeD", "B2", "S", "Bk", None), ("C2", "threeD", "D4", "My Sheet", None, None),
        ("C2", "namedRange", None, None, None, "Größe")], key=repr)


def test_schema_rules(spark, rows):
    schema = {"type": "object", "required": ["a"], "properties": {
        "a": {"anyOf": [{"type": "string", "minLength": 2}, {"const": 3}]}, "b": {"type": ["integer", "null"]}, "n": {"type": "number"},
        "l": {"type": "array", "items": {"type": "object", "required": ["x"]}}}}
    docs = ['{"a":"ok","b":null,"n":1,"l":[{"x":1}]}', '{"a":3,"n":1.5}', '{"a":"z","b":1.5,"l":[{"x":1},{}]}', "[]", "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, j string")
    assert rows(documents.validate_json(df, ["id"], "j", schema), "id", "path") == [(2, "/a"), (2, "/b"), (2, "/l/1/x"), (3, ""), (4, "/a")]


def test_tree_sheets_and_rows(spark, rows):
    ir = spark.createDataFrame([("d", '{"sheets":[{"name":"S","rows":[["a",1],["b"]]}],"blocks":[{"type":"table","rows":[["x","y"]]}]}')], "doc_id string, ir string")
    assert rows(documents.ir_sheets(ir), "name", "row", "col", "value") == [("S", 1, 1, "a"), ("S", 1, 2, "1"), ("S", 2, 1, "b")]
    assert rows(documents.block_rows(documents.ir_blocks(ir)), "row", "col", "text") == [(0, 0, "x"), (0, 1, "y")]


def test_upper_median_takes_the_higher_middle(spark):
    assert one(spark, verification.upper_median(F.array(F.lit(4.0), F.lit(1.0), F.lit(-3.0)))) == 4.0
    assert one(spark, verification.upper_median(F.array(F.lit(-1.0)))) is None


def test_graph_confidence_values(spark, rows):
    df = spark.createDataFrame([("a", "shape", 1.0, 1), ("b", "pdfAnnotation", None, None), ("c", "shape", 1.0, None)], "object_id string, kind string, x double, slide int").withColumn("doc_id", F.lit("d"))
    assert rows(geometry.graph_nodes(df, ["slide"], "x"), "object_id", "confidence", "risk_flags") == [
        ("a", 0.95, "UNTRUSTED_DOCUMENT_CONTENT"), ("b", 1.0, "UNTRUSTED_DOCUMENT_CONTENT,ANNOTATION_CONTENT"), ("c", 0.97, "UNTRUSTED_DOCUMENT_CONTENT")]


# --- streaming --------------------------------------------------------------------------------------


def test_streamed_summaries_follow_the_log(spark, tmp_path, rows):
    log, table, checkpoint = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    log.mkdir()

    def append(name, steps):
        lines = [json.dumps({"run_id": r, "step_idx": i, "step_id": f"s{i}", "status": s, "started_ms": i * 10, "finished_ms": i * 10 + 4}) for r, i, s in steps]
        (log / name).write_text("\n".join(lines))

    def advance():
        traces.start_summaries(traces.read_traces(spark, str(log)), table, checkpoint).awaitTermination()
        return rows(traces.latest(spark, table), "run_id", "completed_steps", "failed_step", "duration_ms")

    append("1.jsonl", [("a", 0, "pass"), ("b", 0, "pass")])
    assert advance() == [("a", 1, None, 4), ("b", 1, None, 4)]
    append("2.jsonl", [("a", 1, "pass"), ("a", 2, "fail")])
    assert advance() == [("a", 2, "s2", 24), ("b", 1, None, 4)]
    append("3.jsonl", [("a", 3, "pass"), ("b", 1, "fail"), ("b", 2, "pass")])
    assert advance() == [("a", 2, "s2", 24), ("b", 1, "s1", 14)]
    batch = spark.read.schema(traces.TRACE_SCHEMA).json(str(log))
    assert rows(runs.run_summary(batch), "run_id", "completed_steps", "failed_step", "duration_ms") == advance()
