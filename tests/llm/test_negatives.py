"""Hard negatives against all pairs."""

import numpy as np
import pytest

from folioscope.llm import vertical_negatives as vn

SCHEMA = "vec_id long, embedding array<float>, label int, score int, x int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], y, 1, 2) for i, v, y in rows], SCHEMA)


def plain(rows):
    usable = {}
    for i, v, y in rows:
        if i is None or y is None or not v or any(c is None or not np.isfinite(c) or abs(c) >= vn.LARGEST for c in v):
            continue
        row = ((y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(float(np.float32(c)) * 256)) for c in v])
        usable[i] = min(usable.get(i, row), row)
    out = []
    for i, (y, x) in usable.items():
        if i % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(x, w)), j, z) for j, (z, w) in usable.items() if j != i and len(w) == len(x)]
        for s, j, _ in sorted(t for t in scores if t[2] == y)[:5]:
            found = sorted((t, k) for t, k, z in scores if z != y and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in vn.mined(df).collect())


@pytest.mark.parametrize("seed, size, labels", [(1, 16, 3), (2, 3, 10), (3, 64, 2)])
def test_equals_all_pairs(spark, seed, size, labels):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (labels, size))
    rows = [(int(i), (0.4 * centre[y] + rng.normal(0, 0.6, size)).tolist(), int(y)) for i, y in enumerate(rng.integers(0, labels, 400))]
    want = plain(rows)
    assert want and got(table(spark, rows)) == want


def test_ties_repeats_and_unusable_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-1, 2, 4).astype(float).tolist(), int(i % 2)) for i in range(200)]
    rows += [rows[50], (50, [0.0, 0.0, 9.0, 0.0], 5), (None, [1.0, 1.0, 1.0, 1.0], 1), (300, None, 1), (301, [1.0, None, 0.0, 1.0], 1),
             (302, [float("nan")] * 4, 0), (303, [float("inf"), 0.0, 0.0, 0.0], 0), (304, [1.0, 1.0, 1.0, 1.0], None), (305, [], 1),
             (306, [1.0, 0.5], 1), (350, [1.0, 2.0], 0), (351, [1.0, 1.0], 1), (353, [0.75, 1.0], 0), (307, [1e30, 0.0, 0.0, 0.0], 0)]
    want = plain(rows)
    assert any(r[0] == 350 for r in want) and got(table(spark, rows)) == want


def test_large_entries_and_one_hot_label(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(0, 1, 5) * 2.0 ** 16).clip(-2**17, 2**17).tolist(), 3 if i % 3 else int(i % 10)) for i in range(300)]
    assert got(table(spark, rows)) == plain(rows)


def test_no_rows(spark):
    assert got(table(spark, [])) == [] and got(table(spark, [(50, None, 1)])) == []
    assert got(table(spark, [(50, [1.0], 1)])) == []


def test_bitmap_keeps_every_row_that_counts():
    rng = np.random.default_rng(8)
    block = vn.Block(np.arange(500), rng.integers(0, 3, 500), rng.integers(-99, 99, (500, 20)))
    anchor = rng.integers(-99, 99, 20)
    exact = block.columns.T.astype(np.int64) @ anchor
    for label in range(4):
        same = np.flatnonzero(block.labels == label)
        top = same[np.lexsort((block.keys[same], -exact[same]))[:5]]
        assert vn.top_same(block, -1, label, anchor)[0].tolist() == block.keys[top].tolist()
        other = np.flatnonzero(block.labels != label)
        windows = [(-5000, 3000), (20000, 20100), (0, 0)]
        for (a, b), (keys, _) in zip(windows, vn.top_others(block, label, anchor, windows)):
            inside = other[(exact[other] >= a) & (exact[other] <= b)]
            assert keys.tolist() == block.keys[inside[np.lexsort((block.keys[inside], -exact[inside]))[:3]]].tolist()
