"""Interval joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import formulas, geometry, selectors
from folioscope.plans import intervals


@pytest.mark.parametrize("few", [0, 17, 64])
def test_small_and_crowded_scopes_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    test_overlaps_equal_all_pairs(spark, 64.0)
    test_edges_at_anchors_are_those_of_all_edges(spark)


def test_rows_of_small_scopes_are_not_copied(spark):
    rows = spark.range(0, 900).select((F.col("id") / 3).cast("int").alias("doc_id"), F.lit(1).alias("slide"), F.concat(F.lit("o"), "id").alias("object_id"),
                                      *[(F.col("id") % n).cast("double").alias(c) for c, n in (("x", 7), ("y", 200), ("w", 900), ("h", 300))])
    edges = geometry.geometry_edges(rows.repartition(3))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "BroadcastExchange" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_objects_of_workbooks_are_not_broadcast(spark):
    """Rows out of arrays look smaller than they are."""
    none = F.lit(None)
    item = F.struct(F.lit("pivotTable").alias("kind"), F.lit("P").alias("name"), F.lit("p.xml").alias("path"), none.cast("int").alias("sheet_idx"), none.cast("string").alias("sheet_name"),
                    none.cast("string").alias("table_name"), *[F.lit(n).alias(c) for c, n in (("c0", 1), ("r0", 1), ("c1", 9), ("r1", 9))])
    objects = spark.range(0, 50).select(F.col("id").alias("doc_id"), F.inline(F.array(item)))
    deps = spark.range(0, 50).select(F.col("id").alias("doc_id"), F.lit(1).alias("sheet_idx"), F.lit("Z1").alias("ref"), F.lit("range").alias("dep_kind"), none.cast("string").alias("dep_name"),
                                     none.cast("string").alias("dep_sheet"), *[F.lit(n).alias(c) for c, n in (("c0", 2), ("r0", 2), ("c1", 3), ("r1", 3))])
    seen = []
    cut = formulas.cut
    formulas.cut = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)
    try:
        assert formulas.related_objects(deps, objects).count() == 50
    finally:
        formulas.cut = cut
    assert "SortMergeJoin [doc_id" in seen[0] and "Generate explode" not in seen[0]


@pytest.mark.parametrize("base", [1.0, 64.0, 1000.0])
def test_overlaps_equal_all_pairs(spark, base):
    r = random.Random(int(base))
    make = lambda n: [(r.randint(0, 2), i, a, a + r.choice([0, 1, 63, 64, 65, 128, 500, 4096, 10**6, -5])) for i in range(n) for a in [r.randint(-500, 3000)]]
    left, right = make(60) + [(1, 900, None, 5), (None, 901, 0, 9)], make(50) + [(1, 900, 3, None)]
    a = spark.createDataFrame(left, "k int, i int, l0 int, l1 int").select("k", "i", F.col("l0").cast("double").alias("l0"), F.col("l1").cast("double").alias("l1"))
    b = spark.createDataFrame(right, "k int, j int, r0 int, r1 int")
    got = sorted((x.i, x.j) for x in intervals.overlapping(a, b, ["k"], ("l0", "l1"), ("r0", "r1"), base).collect())
    good = lambda rows: [(k, i, x, max(x, y)) for k, i, x, y in rows if None not in (k, x, y)]
    assert got == sorted((i, j) for k, i, x, y in good(left) for m, j, u, v in good(right) if k == m and max(x, u) <= min(y, v))


def test_a_tall_box_stays_few_rows(spark):
    tall = spark.createDataFrame([(1, float(a), float(a) + 1e6) for a in (0, 63, 1234)], "k int, l0 double, l1 double")
    low = spark.createDataFrame([(1, 0.0, 10.0 * 2**i) for i in range(20)], "k int, r0 double, r1 double")
    span = ("l0", "l1")
    placed = intervals._placed(tall, span, 64.0, intervals._levels(low, ("r0", "r1"), 64.0, None), [0], [1])
    every = intervals._placed(low, ("r0", "r1"), 64.0, intervals._levels(tall, span, 64.0, 1e6), [0, 1], [0])
    most = lambda df, by: df.groupBy(by).count().agg(F.max("count")).first()[0]
    assert most(placed, "l0") <= 2 + 2 * 9 and most(every, "r1") < 50


def test_levels_fit_their_cells(spark):
    rows = spark.range(0, 4000).select((F.col("id") / 3.7).alias("a"), (F.col("id") * 64.0 / 17).alias("w"))
    level = intervals.level_of(F.col("a"), F.col("a") + F.col("w"), 64.0)
    many = rows.select(F.size(intervals.cells(F.col("a"), F.col("a") + F.col("w"), level, 64.0)).alias("n"), (64.0 * F.pow(F.lit(2.0), level)).alias("wide"), "w")
    worst = many.agg(F.max("n"), F.min(F.col("wide") - F.col("w"))).first()
    assert worst[0] <= 2 and worst[1] >= -1e-6


def test_edges_at_anchors_are_those_of_all_edges(spark):
    r = random.Random(2)
    boxes = spark.createDataFrame([(i % 3, 1, f"o{i}", "shape", "t", float(r.randint(0, 400)), float(r.randint(0, 400)), float(r.choice([10, 40, 900])), float(r.choice([5, 30, 2000])))
                                   for i in range(60)], "doc_id int, slide int, object_id string, kind string, text string, x double, y double, w double, h double")
    anchors = spark.createDataFrame([(f"s{i}", i % 3, f"o{i}") for i in range(9)] + [("two", 0, "o0"), ("two", 0, "o3")], "selector_id string, doc_id int, object_id string")
    every = geometry.geometry_edges(boxes).collect()
    for relation in ("contains", "rightOf", "below"):
        for outgoing in (True, False):
            node, anchor = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
            want = {(f"s{i}", e[node]) for i in range(9) for e in every if e.relation == relation and e[anchor] == f"o{i}"}
            got = selectors.by_relation(boxes, anchors, relation, outgoing).collect()
            assert {(x.selector_id, x.object_id) for x in got if x.status == "candidate"} == want
            assert {x.object_id for x in got if x.status == "ambiguous"} == {"o0", "o3"}
