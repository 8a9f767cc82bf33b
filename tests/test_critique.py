"""Critique rules, each fired and silent, and archives inside archives."""

import io
import zipfile

import pytest

from folioscope.operators import critique, integrity, inventory
from folioscope.sources import packages

BREAK = {"=": lambda v: v + 1, ">": lambda v: v, "<": lambda v: v}
MEET = {"=": lambda v: v, ">": lambda v: v + 1, "<": lambda v: v - 1}


@pytest.mark.parametrize("fmt", list(critique.RULES))
def test_every_rule_fires_and_stays_silent(spark, fmt):
    rules = critique.RULES[fmt]
    names = sorted({name for r in rules for name, _, _ in r.tests})
    rows, fires, silent = [], {}, {}
    for i, rule in enumerate(rules):
        meets = {name: MEET[sign](value) for name, sign, value in rule.tests}
        name, sign, value = rule.tests[-1]
        for doc, row in ((f"{i}+", meets), (f"{i}-", {**meets, name: BREAK[sign](value)}), (f"{i}0", {**meets, name: None})):
            rows.append((doc, *[float(row[n]) if row.get(n) is not None else None for n in names]))
        fires[f"{i}+"] = rule.code
        silent[f"{i}-"] = silent[f"{i}0"] = rule.code
    got = {}
    for r in critique.critique(spark.createDataFrame(rows, "doc_id string, " + ", ".join(f"{n} double" for n in names)), fmt).collect():
        got.setdefault(r.doc_id, set()).add(r.code)
    assert all(code in got.get(doc, ()) for doc, code in fires.items())
    assert not any(code in got.get(doc, ()) for doc, code in silent.items())


def test_profiles_choose_rules(spark):
    book = spark.createDataFrame([("a", 0, 0, 0, 0)], "doc_id string, charts int, tables int, formulas int, cells int")
    codes = lambda profile: {r.code for r in critique.critique(book, "xlsx", profile).collect()}
    assert "XLSX_DASHBOARD_CHARTS_NONE" in codes("Sales KPI") and "XLSX_DASHBOARD_CHARTS_NONE" not in codes("minimal")
    assert {"XLSX_TABLES_NONE", "XLSX_FORMULAS_NONE"} == codes("minimal")


def test_findings_of_the_diagnosis(spark):
    issues = spark.createDataFrame([("a", "TEXT_OVERFLOW_RISK", "warning"), ("a", "OFFICE_REPAIR_RISK_X", "error"), ("a", "MACRO_PRESENT", "warning")], "doc_id string, code string, severity string")
    assert {r.code for r in critique.from_diagnosis(issues).collect()} == {"TEXT_OVERFLOW_RISK", "OFFICE_REPAIR_RISK_X"}


def test_workbook_summary_counts_inside_its_sheets(spark):
    sheet = '<worksheet><sheetProtection/><c r="A1"><f>1+1</f></c><c r="A2"/><cols/><dataValidation/></worksheet>'
    parts = spark.createDataFrame([("d", "xlsx", name, xml) for name, xml in [("xl/workbook.xml", "<workbook><sheets><sheet/></sheets></workbook>"), ("xl/worksheets/sheet1.xml", sheet),
                              ("xl/worksheets/sheet2.xml", "<worksheet><c r='A1'/></worksheet>"), ("xl/externalLinks/externalLink1.xml", "<x/>")]], "doc_id string, format string, part string, xml string")
    r = inventory.workbook_map(parts).first()
    assert (r.cells, r.formulas, r.validations, r.protected_sheets, r.external_links, r.role) == (3, 1, 1, 1, 1, "input")


def zipped(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in entries:
            archive.writestr(name, data)
    return out.getvalue()


def shredded(spark, data, limits=packages.Limits(), inner=True):
    df = spark.createDataFrame([("d", "docx", data)], "doc_id string, format string, content binary")
    return packages.shred(df, limits, inner)


def test_archives_inside_archives(spark):
    deep = zipped(("z.xml", "<z/>"))
    book = zipped(("xl/workbook.xml", "<w/>"))
    one = zipped(("word/document.xml", "<d/>"), ("word/embeddings/a.xlsx", book), ("word/embeddings/b.zip", "no archive"))
    rows = {r.part: (r.depth, r.blocked, r.xml) for r in shredded(spark, one).collect()}
    assert rows["word/embeddings/a.xlsx!/xl/workbook.xml"] == (1, None, "<w/>") and len(rows) == 4
    assert {r.part for r in shredded(spark, one, inner=False).collect()} == {"word/document.xml", "word/embeddings/a.xlsx", "word/embeddings/b.zip"}
    two = zipped(("word/embeddings/a.docx", zipped(("word/embeddings/b.zip", deep))))
    assert [(r.part, r.blocked) for r in shredded(spark, two).collect()] == [(None, "ZIP_NESTED_ZIP_DETECTED")]
    assert {r.depth for r in shredded(spark, two, packages.Limits(nested_depth=2)).collect()} == {0, 1, 2}
    assert [r.blocked for r in shredded(spark, one, packages.Limits(nested_depth=0)).collect()] == ["ZIP_NESTED_ZIP_DETECTED"]
    # One budget for the whole tree.
    many = zipped(*[(f"word/embeddings/{i}.zip", zipped(*[(f"{k}.xml", "<x/>") for k in range(5)])) for i in range(3)])
    assert [r.blocked for r in shredded(spark, many, packages.Limits(entries=17)).collect()] == ["ZIP_ENTRY_LIMIT_EXCEEDED"]
    assert shredded(spark, many, packages.Limits(entries=18)).count() == 18


def test_limits_over_the_tree(spark):
    two = zipped(("word/embeddings/a.docx", zipped(("b.zip", zipped(("z.xml", "<z/>"))))))
    tree = shredded(spark, two, packages.Limits(nested_depth=2))
    codes = lambda **limits: {r.code for r in integrity.volume_limits(tree, packages.Limits(**limits)).collect()}
    assert codes() == {"ZIP_NESTED_ZIP_DETECTED"} and codes(nested_depth=2) == set() and codes(nested_depth=2, entries=2) == {"ZIP_ENTRY_LIMIT_EXCEEDED"}
