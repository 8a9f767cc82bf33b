"""Embedding whitening against plain numpy."""

import numpy as np
import pytest

from folioscope.llm import spectral_whitening as sw

SCHEMA = "vec_id long, embedding array<float>, label int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1) for i, v in rows], SCHEMA)


def plain(rows, most=8):
    """{(id, component): (n, deviation, whitened, explained)} by numpy and whole numbers."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([np.float32(v).astype(float) for _, v in usable])).astype(np.int64) + 100_000
    n, total = len(x), [int(t) for t in x.sum(axis=0)]
    apart = x - np.array(total) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k in range(min(most, x.shape[1])):
        v = vectors[:, k] * np.sign(vectors[np.abs(vectors[:, k]).argmax(), k])
        w = apart @ v / np.sqrt(values[k])
        for (i, _), row, one in zip(usable, x, w):
            out[i, k + 1] = (n, sum((n * int(c) - t) ** 2 for c, t in zip(row, total)), one, values[k] / values.sum())
    return out


def same(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation, deviation)
        assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-7, abs=1e-7)
        assert r.explained == pytest.approx(share, rel=1e-9)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("partitions, fan", [(1, 16), (7, 2), (9, 16)])
def test_components_equal_numpy(spark, partitions, fan):
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.normal(0, 0.2, (150, 12)) * np.linspace(1, 3, 12) + 0.5))
    same(sw.whitened(table(spark, rows).repartition(partitions), fan=fan).collect(), plain(rows))


def test_query_equals_numpy(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()])
    same(sw.op11_spectral_whitening(spark, sf).collect(), want)


def test_rank_one_updates_of_hard_spectra():
    rng = np.random.default_rng(5)
    for x in (np.repeat(rng.normal(0, 1, (3, 10)), 5, axis=0), rng.integers(0, 2, (200, 16)), np.eye(12), rng.normal(0, 1, (40, 1)),
              rng.normal(0, 1, (300, 6)) * np.array([1, 1, 1e-6, 1e4, 0, 2])):
        seen = sw.Spectrum(x.shape[1])
        for row in x.astype(float):
            seen.add(row)
        scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
        assert np.abs(seen.vectors.T @ seen.vectors - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(seen.vectors @ np.diag(seen.values) @ seen.vectors.T - scatter).max() < 1e-11 * max(1, np.abs(scatter).max())


def test_equal_rows_as_one_update():
    rng = np.random.default_rng(6)
    rows = rng.normal(0, 1, (20, 4))
    one, many = sw.Spectrum(4), sw.Spectrum(4)
    for row in rows:
        one.add(row, 3)
        for _ in range(3):
            many.add(row)
    assert one.n == many.n and np.allclose(one.values, many.values) and np.allclose(one.mean, many.mean)


def test_rows_that_take_no_part(spark):
    rows = [(1, [0.5, 0.1]), (2, None), (3, [None, 0.1]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1e20, 0.0]),
            (7, [0.2]), (8, []), (None, [0.25, 0.9]), (1, [0.5, 0.1]), (9, [-0.3, 0.2])]
    got = sw.whitened(table(spark, rows)).collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 0, 1, 1, 1, 1, 9, 9] and {r.n for r in got} == {4}


def test_no_rows_and_no_variance(spark):
    assert sw.whitened(table(spark, [(1, None)])).collect() == []
    assert sw.whitened(table(spark, [])).collect() == []
    got = sw.whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(got) == 4 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(None, 0.0, None, 0)}
    flat = sw.whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.0, 0.25])])).orderBy("vec_id", "component").collect()
    assert [r.whitened for r in flat] == [1.0, None, -1.0, None]


def test_deviations_beyond_64_bits():
    x, sums = np.array([[1 << 40, 0]]), [1 << 62, 5]
    assert sw.deviations(x, 1 << 20, sums) == [((1 << 60) - (1 << 62)) ** 2 + 25]
    assert sw.deviations(x, 3, [0, 0]) == [9 << 80]


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 0.3 * (i % 3)], 5, 7, 9) for i in range(6)],
                               "vec_id long, embedding array<float>, key int, vector int, whitened int")
    assert sw.whitened(df).count() == 12


def test_rows_of_one_split_are_dealt_out(spark, tmp_path):
    rng = np.random.default_rng(8)
    table(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (400, 3)))]).coalesce(1).write.parquet(f"{tmp_path}/one")
    found = sw.partial_spectra(spark.read.parquet(f"{tmp_path}/one").selectExpr("embedding AS vector"), 3).collect()
    assert len(found) > 1 and sum(r.n for r in found) == 400


def test_roots_of_close_poles_and_uneven_weights():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        d = np.cumsum(10.0 ** rng.uniform(-9, 3, n))
        z = 10.0 ** rng.uniform(-5, 2, n) * rng.choice([-1, 1], n)
        found, away = sw.roots(d, z)
        assert (np.diff(found) >= 0).all() and (found >= d).all()
        # Signs between the poles, and the value at the root against the sizes of its terms.
        assert (np.tril(away) <= 0).all() and (np.triu(away, 1) >= 0).all()
        terms = z * z / away
        assert (np.abs(1 + terms.sum(axis=1)) <= 1e-13 * n * (1 + np.abs(terms).sum(axis=1))).all()


def test_roots_next_to_the_middle_of_two_poles():
    for apart in (1e-6, -1e-7, 1e-9, 0.0):
        weight = np.array([0.0, 0.2, 0.7])
        weight[0] = weight[1] + 0.5 * (1 + weight[2] / 2.5) + apart  # the value at the middle is about -2 * apart
        found, away = sw.roots(np.array([0.0, 1.0, 3.0]), np.sqrt(weight))
        assert np.abs(1 + (weight / away).sum(axis=1)).max() < 1e-14


@pytest.mark.parametrize("rows", [1, 3, 4, 7, 90])
def test_spectra_side_by_side_are_the_spectrum_of_all_rows(rows):
    rng = np.random.default_rng(rows)
    for x in (rng.normal(0, 1, (rows, 6)), rng.integers(0, 2, (rows, 6)).astype(float), np.ones((rows, 6))):
        times, seen = rng.integers(1, 4, rows), sw.Spectra(6)
        for at in range(0, rows, sw.LANES):
            seen.add(x[at : at + sw.LANES], times[at : at + sw.LANES])
        n, mean, values, vectors = seen.merged()
        all_rows, vectors = np.repeat(x, times, axis=0), vectors.reshape(6, 6)
        scatter = (all_rows - all_rows.mean(axis=0)).T @ (all_rows - all_rows.mean(axis=0))
        assert n == times.sum() and np.allclose(mean, all_rows.mean(axis=0))
        assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12 and np.abs((vectors * values) @ vectors.T - scatter).max() < 1e-11 * max(1, np.abs(scatter).max())
