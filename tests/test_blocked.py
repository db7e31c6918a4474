"""Tiled matrices against numpy."""

import numpy as np
import pytest

from wavemill.operators import blocked as B


def stored(spark, x, tile):
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    return B.from_rows(spark.createDataFrame(rows, "i long, x array<double>").repartition(3), *x.shape, tile)


def dense(m):
    out = np.zeros((m.rows, m.cols))
    for r in m.df.collect():
        t = B._array(r["t"], B._side(m.cols, m.tile, r["bj"]))
        out[r["bi"] * m.tile : r["bi"] * m.tile + len(t), r["bj"] * m.tile : r["bj"] * m.tile + t.shape[1]] = t
    return out


def test_products_of_uneven_sides_over_several_cells(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 41)), rng.normal(size=(41, 9))
    got = B.matmul(stored(spark, a, 4), stored(spark, b, 4), cell=8)
    assert (got.rows, got.cols) == (23, 9) and np.allclose(dense(got), a @ b)
    t = B.transpose(stored(spark, a, 4))
    assert np.allclose(dense(t), a.T)


def test_absent_tiles_are_zero_and_entries_add(spark):
    rows = [(0, 0, 2.0), (0, 0, 1.0), (9, 9, 5.0), (None, 1, 1.0), (1, 1, None)]
    m = B.from_entries(spark.createDataFrame(rows, "i long, j long, v double"), 10, 10, 4)
    want = np.zeros((10, 10))
    want[0, 0], want[9, 9] = 3.0, 5.0
    assert m.df.count() == 2 and np.allclose(dense(B.matmul(m, m, 4)), want @ want)
    got = {(r["i"], r["j"]): r["v"] for r in B.to_entries(m).collect()}
    assert got[0, 0] == 3.0 and got[9, 9] == 5.0 and len(got) == 16 + 4
    assert B.determinant(m) == (0.0, -np.inf)
    with pytest.raises(ValueError, match="singular"):
        B.inverse(m)
    with pytest.raises(Exception, match="outside"):
        B.from_entries(spark.createDataFrame([(10, 0, 1.0)], "i long, j long, v double"), 10, 10, 4).df.count()


def test_matrix_without_rows(spark):
    none = B.from_entries(spark.createDataFrame([], "i long, j long, v double"), 0, 0, 4)
    assert B.matmul(none, none).df.count() == 0 and B.determinant(none) == (1.0, 0.0)


@pytest.mark.parametrize("kind", ["drawn", "permuted", "zero diagonal"])
def test_determinant_solution_and_inverse_need_pivots(spark, kind):
    rng = np.random.default_rng(2)
    n = 13
    a = rng.normal(size=(n, n)) if kind == "drawn" else np.eye(n)[rng.permutation(n)] * 3.0 if kind == "permuted" else rng.normal(size=(n, n)) * (1 - np.eye(n))
    m, rhs = stored(spark, a, 3), rng.normal(size=(n, 2))
    assert np.allclose(B.determinant(m), np.linalg.slogdet(a))
    assert np.allclose(dense(B.solve(m, stored(spark, rhs, 3))), np.linalg.solve(a, rhs))
    assert np.allclose(dense(B.inverse(m)) @ a, np.eye(n), atol=1e-9)


def test_nearly_singular_is_told(spark):
    a = np.ones((6, 6)) + np.diag([1.0, 2.0, 3.0, 4.0, 0.0, 0.0])
    with pytest.raises(ValueError, match="singular"):
        B.inverse(stored(spark, a, 2))


def test_tournament_in_levels(spark, monkeypatch):
    monkeypatch.setattr(B, "FAN", 2)
    a = np.random.default_rng(3).normal(size=(18, 18))
    assert np.allclose(B.determinant(stored(spark, a, 2)), np.linalg.slogdet(a))


def test_two_thousand_rows(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 2000))
    m = stored(spark, a, 500)
    assert np.allclose(dense(B.matmul(m, m, 1000)), a @ a)
    assert np.allclose(B.determinant(m), np.linalg.slogdet(a))
    assert np.abs(dense(B.inverse(m)) @ a - np.eye(2000)).max() < 1e-7
