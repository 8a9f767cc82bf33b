"""The formula reader: strings, brackets of any depth, words before blanks."""

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.functions.formula import AFTER_WORD, AFTER_WORD_BREAK, masked
from folioscope.operators import formulas


def test_strings_and_brackets():
    assert masked('A1&"x""[y"&T[[#All],[a[b]c]]') == ("A1& & ", ["T[[#All],[a[b]c]]"])
    assert masked("T [q]+[Book]S!A1") == (" +[Book]S!A1", ["T [q]"])
    assert masked("T[[open") == ("T[[open", []) and masked('"open') == ('"open', [])
    assert masked("1.abc[d]x") == ("1. x", ["abc[d]"]) and masked("1abc[d]") == ("1abc[d]", [])


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("aZ1_. []\"'!$:+\n")), max_size=40))
def test_nothing_else_is_lost(formula):
    clean, tables = masked(formula)
    assert all(t.count("[") == t.count("]") and t in formula for t in tables)
    if '"' not in formula and not tables:
        assert clean.replace(AFTER_WORD, " ").replace(AFTER_WORD_BREAK, "\n") == formula


def test_dependencies_of_deep_brackets_and_long_names(spark):
    cells = spark.createDataFrame([("d", 1, "Z1", 'Sales[[#Data],[a[b[c]]]]+AVeryLongFunctionNameIndeed A9+"T[x"&B1+My Own Sheet!C1+Rate')],
                                  "doc_id string, sheet_idx int, ref string, formula string")
    names = spark.createDataFrame([("d", "rate")], "doc_id string, name string")
    tables = spark.createDataFrame([("d", "Sales")], "doc_id string, name string")
    got = {(r.dep_kind, r.dep_ref, r.dep_sheet, r.dep_name) for r in formulas.formula_deps(cells, names, tables).collect()}
    assert got == {("tableStructuredRef", None, None, "Sales"), ("cell", "B1", None, None), ("threeD", "C1", "My Own Sheet", None), ("namedRange", None, None, "rate")}


def test_equal_formulas_are_read_once(spark):
    cells = spark.range(0, 30).selectExpr("id AS doc_id", "1 AS sheet_idx", "'A1' AS ref", "concat('B', id % 3 + 1, '+Rate') AS formula")
    names = spark.createDataFrame([(3, "RATE")], "doc_id long, name string")
    deps = formulas.formula_deps(cells, names, names.limit(0))
    plan = deps._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[formula" in plan[plan.index("ArrowEvalPython"):]
    assert sorted((r.doc_id, r.source_text) for r in deps.collect()) == sorted([(d, f"B{d % 3 + 1}") for d in range(30)] + [(3, "RATE")])
    graph = formulas.formula_graph(deps.unionByName(deps))
    assert "Expand" not in graph._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in graph.filter("doc_id = 3").collect()} == {(3, 1, "cell", 1, 1), (3, 1, "namedRange", 1, 1)}


def _sheets(spark):
    formulas_ = ["A1+B2+Rate", "B2:C3+Sales[Q]+rate", "'S 2'!A1+D4+Net.Sum", "LOG10(E5)+Tax Ä", "\"A1\"", "Rate", "A1+A1"]
    cells = [(d, s, f"Z{(d * 7 + s * 3 + i) % 90 + 1}", formulas_[(d + i * i) % 7]) for d in range(6) for s in (1, 2) for i in range(1 + d * s)]
    cells += [(7, 1, f"C{i % 75}", formulas_[i % 7]) for i in range(160)]  # a crowded sheet
    cells += cells[::5] + [(8, 1, None, "A1+B2"), (8, None, "Z1", "A1"), (8, 1, "Z9", None), (8, 1, "Z9", ""), (9, 1, "Z1", "A1+Rate")]
    names = [(d, n) for d in range(9) for n in ("RATE", "Rate", "Sales", "Tax Ä", "Unused")]
    return (spark.createDataFrame(cells, "doc_id long, sheet_idx int, ref string, formula string"), spark.createDataFrame(names, "doc_id long, name string"),
            spark.createDataFrame([(d, "sales") for d in range(0, 9, 2)], "doc_id long, name string"))


def test_graph_of_sheets_is_the_graph_of_their_dependencies(spark):
    cells, names, tables = _sheets(spark)
    got, want = formulas.sheet_graph(cells, names, tables), formulas.formula_graph(formulas.formula_deps(cells, names, tables))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in want.collect()}
    assert any(r[:3] == (7, 1, "namedRange") and r[4] > 30 for r in rows) and any(r[2] == "tableStructuredRef" for r in rows)


def test_graph_of_small_sheets_makes_no_row_of_a_dependency(spark):
    cells, names, tables = _sheets(spark)
    plan = formulas.sheet_graph(cells.filter("doc_id < 7"), names, tables)._jdf.queryExecution().executedPlan().toString()
    assert "is_cell" not in plan and "collect_list(struct(ref" in plan
    # Few formulas are sent to the cells, which stay where they met the names of their workbook.
    assert "hashpartitioning(sheet_idx" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 2
