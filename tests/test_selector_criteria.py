"""Selectors with every kind of criterion, against a plain loop; run state of the stream; two-phase comparison."""

import json
import random

from pyspark.sql import functions as F

from folioscope.operators import runs, selectors, versions
from folioscope.plans import editing
from folioscope.streaming import traces

COLUMNS = ["doc_id", "object_id", "text", "kind", "formula", "label", "shape_name", "page", "slide", "sheet", "sheet_name", "cell", "placeholder"]
SCHEMA = "doc_id int, object_id string, text string, kind string, formula string, label string, shape_name string, page int, slide int, sheet int, sheet_name string, cell string, placeholder string"
CRITERIA = ["shape_name", "page", "sheet_name", "cell", "placeholder", "kind"]


def plain(objects, asked):
    out = []
    for s in asked:
        for row in objects:
            o = dict(zip(COLUMNS, row))
            if o["doc_id"] != s["doc_id"]:
                continue
            if s["object_id"] is not None:
                ok = o["object_id"] == s["object_id"]
            elif all(s[k] is None for k in ("equals", "contains", *CRITERIA)):
                ok = False
            else:
                texts = [t for t in (o["text"], o["formula"] if o["kind"] == "cell" else None) if t is not None]
                first = lambda *c: next((o[x] for x in c if o[x] is not None), None)
                low = lambda x: None if x is None else str(x).lower()
                ok = s["equals"] in texts if s["equals"] is not None else s["contains"] is None or any(s["contains"] in t for t in texts)
                ok = ok and (s["shape_name"] is None or s["shape_name"] in (o["label"], o["shape_name"]))
                ok = ok and (s["page"] is None or first("page", "slide", "sheet") == s["page"])
                ok = ok and (s["sheet_name"] is None or low(s["sheet_name"]) in (low(o["sheet_name"]), f"sheet{o['sheet']}" if o["sheet"] is not None else ""))
                ok = ok and (s["cell"] is None or low(first("cell", "label")) == low(s["cell"]))
                ok = ok and (s["placeholder"] is None or o["placeholder"] == s["placeholder"]) and (s["kind"] is None or o["kind"] == s["kind"])
            if ok:
                out.append((s["selector_id"], o["object_id"]))
    return sorted(out)


def test_selectors_equal_a_loop(spark):
    r = random.Random(11)
    maybe = lambda values, p=0.5: r.choice(values) if r.random() < p else None
    names, texts = ["Ann", "ann", "B1", "a1"], ["total of all", "all", "of", "x total, of all y", "total"]
    objects = [(r.randint(0, 2), f"o{i}", maybe(texts, 0.9), maybe(["cell", "shape"], 0.9), maybe(["=total of(1)", "=B1"]), maybe(names), maybe(names), maybe([1, 2]),
                maybe([1, 2]), maybe([1, 2]), maybe(["Data", "DATA 2"]), maybe(names), maybe(["title", "body"])) for i in range(60)]
    asked = [{"selector_id": f"s{i}", "doc_id": r.randint(0, 3), "object_id": maybe([f"o{r.randint(0, 70)}"], 0.1), "equals": maybe(texts + ["=B1"], 0.15),
              "contains": maybe(["of", " of ", "total", ", of all", "=", "total of("], 0.4), "shape_name": maybe(names, 0.2), "page": maybe([1, 2], 0.2),
              "sheet_name": maybe(["data", "SHEET2", "Data 2"], 0.3), "cell": maybe(["b1", "A1", "ANN"], 0.2), "placeholder": maybe(["title"], 0.1), "kind": maybe(["cell", "shape"], 0.2)}
             for i in range(80)]
    names_ = ["selector_id", "doc_id", "object_id", "equals", "contains", *CRITERIA]
    table = spark.createDataFrame([tuple(s[n] for n in names_) for s in asked],
                                  "selector_id string, doc_id int, object_id string, equals string, contains string, shape_name string, page int, sheet_name string, cell string, placeholder string, kind string")
    got = selectors.matches(spark.createDataFrame(objects, SCHEMA), table, CRITERIA)
    want = plain(objects, asked)
    assert want and sorted((x.selector_id, x.object_id) for x in got.collect()) == want


def shuffled(df):
    """Bytes that a query wrote to shuffles; ``df`` has run."""
    seen, todo, total = set(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.finalPhysicalPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if kind == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleBytesWritten").value()
    return total


def test_crowded_documents_equal_a_loop(spark, monkeypatch):
    for most in (0, 12, 25):
        monkeypatch.setattr(selectors, "LIST", most)
        test_selectors_equal_a_loop(spark)


def _lines(n_words):
    r = random.Random(7)
    return [(d, f"o{i}", i, " ".join(f"{r.getrandbits(40):x}" for _ in range(n_words))) for d in range(20) for i in range(3)]


def test_a_text_is_sent_once(spark):
    rows = _lines(400)
    objects = spark.createDataFrame(rows, "doc_id int, object_id string, idx int, text string")
    asked = spark.createDataFrame([(str(r[0]), r[0], None, None, r[3][20:60]) for r in rows if r[2] == 1],
                                  "selector_id string, doc_id int, object_id string, equals string, contains string")
    got = selectors.matches(objects.repartition(3), asked, [])
    got.write.format("noop").mode("overwrite").save()
    assert sorted((r.selector_id, r.object_id) for r in got.collect()) == sorted((str(d), "o1") for d in range(20))
    assert 0 < shuffled(got) < 3 * sum(len(r[3]) for r in rows)


def test_rows_meet_selectors_before_they_are_objects(spark, monkeypatch):
    """Rows that unfold into a cell per word and find the same as their cells; selectors of a document may repeat."""
    rows = [(d, i, " ".join(f"w{(d * i + k) % 5}" for k in range(4))) for d in range(6) for i in range(5)]
    lines = spark.createDataFrame(rows, "doc_id int, sheet int, words string")
    unfold = lambda df: df.select("*", F.posexplode(F.split("words", " ")).alias("at", "text")).select(
        "*", F.concat_ws("/", "doc_id", "sheet", "at").alias("object_id"), F.lit("cell").alias("kind"), F.concat(F.lit("="), "text").alias("formula"))
    asked = [(f"s{n}", n % 8, None, None, "=w1" if n % 2 else None, f"SHEET{n % 5}" if n % 3 else None) for n in range(40)] * 2 + [("id", 1, "1/2/3", None, "none", None)]
    table = spark.createDataFrame(asked, "selector_id string, doc_id int, object_id string, equals string, contains string, sheet_name string")
    want = sorted((s, f"{d}/{i}/{k}") for s, doc, own, _, text, sheet in asked for d, i, words in rows for k, w in enumerate(words.split())
                  if d == doc and (f"{d}/{i}/{k}" == own if own else (text or sheet) and (not text or text in "=" + w) and (not sheet or sheet == f"SHEET{i}")))
    for most in (64, 6, 0):
        monkeypatch.setattr(selectors, "LIST", most)
        got = selectors.matches(lines, table, ["sheet_name"], unfold=unfold)
        assert want and sorted((r.selector_id, r.object_id) for r in got.collect()) == want


def test_line_items_are_sent_once(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = editing.QUERIES["selector_hints"](spark, sf)
        assert got.count()
        sent = shuffled(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < sent < 40 * spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_near_misses_of_crowded_documents(spark, monkeypatch):
    rows = _lines(6)
    objects = spark.createDataFrame(rows, "doc_id int, object_id string, idx int, text string")
    schema = "selector_id string, doc_id int, object_id string, equals string, contains string"
    asked = spark.createDataFrame(
        [(f"e{i}", r[0], None, r[3].upper().replace(" ", "  "), None) for i, r in enumerate(rows)] + [(f"c{i}", r[0], None, None, r[3][2:30].replace(" ", " \t")) for i, r in enumerate(rows)]
        + [("both", 0, None, "none", rows[0][3]), ("blank", 0, None, None, "  ")], schema)
    want = sorted((f"{kind}{i}", r[1], 1) for i, r in enumerate(rows) for kind in "ec")
    for most in (64, 3):
        monkeypatch.setattr(selectors, "LIST", most)
        resolved = selectors.resolve(selectors.matches(objects, asked, []), asked)
        got = selectors.near_misses(objects, asked, resolved)
        assert sorted((r.selector_id, r.object_id, r["rank"]) for r in got.collect()) == want


def test_steps_that_arrive_late(spark, tmp_path):
    log, table, checkpoint = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    log.mkdir()
    r = random.Random(3)
    steps = [(f"r{k}", i, "fail" if r.random() < 0.15 else "pass") for k in range(5) for i in (*range(12), 4095, 4096, 9000)]
    r.shuffle(steps)
    steps += steps[:6]
    for n in range(4):
        part = steps[n::4]
        (log / f"{n}.jsonl").write_text("\n".join(json.dumps(
            {"run_id": k, "step_idx": i, "step_id": f"s{i}", "status": s, "started_ms": i * 10, "finished_ms": i * 10 + 4}) for k, i, s in part))
        traces.start_summaries(traces.read_traces(spark, str(log)), table, checkpoint).awaitTermination()
        batch = runs.run_summary(spark.read.schema(traces.TRACE_SCHEMA).json(str(log)))
        assert sorted(map(tuple, traces.latest(spark, table).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_steps_are_not_grouped_in_python(spark, tmp_path):
    """Many runs with few steps each; a failed step may have no name."""
    log, table = tmp_path / "log", str(tmp_path / "table")
    log.mkdir()
    (log / "0.jsonl").write_text("\n".join(json.dumps({"run_id": f"r{k % 40}", "step_idx": k * 4096, "step_id": None if k % 9 == 0 else f"s{k}", "status": "fail" if k % 7 == 0 else "pass",
                                                        "started_ms": k, "finished_ms": k + 3}) for k in range(200)))
    stream = traces.start_summaries(traces.read_traces(spark, str(log)), table, str(tmp_path / "checkpoint"))
    stream.awaitTermination()
    plan = stream._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "Pandas" not in plan
    batch = runs.run_summary(spark.read.schema(traces.TRACE_SCHEMA).json(str(log)))
    assert sorted(map(tuple, traces.latest(spark, table).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_comparison_reads_texts_of_what_differs(spark):
    side = lambda rows: spark.createDataFrame(rows, "doc_id int, object_id string, text string")
    before, after = side([(1, "a", "x"), (1, "b", "y"), (1, "c", None), (2, "d", "gone")]), side([(1, "a", "x"), (1, "b", "z"), (1, "c", ""), (3, "e", "new")])
    got = sorted(tuple(x) for x in versions.diff_objects(before, after).select("object_id", "status", "before_text", "after_text").collect())
    assert got == [("b", "changed", "y", "z"), ("c", "changed", None, ""), ("d", "removed", "gone", None), ("e", "added", None, "new")]
    pages = lambda df: df.withColumn("page", F.ascii("object_id")).drop("object_id")
    scores = {x.page: x.score for x in versions.page_scores(pages(before), pages(after)).collect()}
    assert scores == {97: 0.0, 98: 1.0, 99: 0.0, 100: 1.0, 101: 1.0}
