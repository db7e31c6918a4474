import numpy as np
import pytest

from wavemill import kernels as K
from wavemill.operators import warping

DDL = "pair_id string, chunk_idx long, x array<double>"


def cut(sequences, tile):
    return [(n, k, v[k * tile : (k + 1) * tile].tolist()) for n, v in sequences.items() for k in range(-(-len(v) // tile))]


def test_warping_in_tiles_against_one_table(spark):
    rng = np.random.default_rng(3)
    a = {"walk": rng.normal(size=23).cumsum(), "ties": rng.integers(0, 2, 16).astype(float), "short": rng.normal(size=3), "lone": rng.normal(size=5)}
    b = {"walk": rng.normal(size=17).cumsum(), "ties": rng.integers(0, 2, 24).astype(float), "short": rng.normal(size=20)}
    total, path = warping.dtw_chunks(spark.createDataFrame(cut(a, 8), DDL), spark.createDataFrame(cut(b, 8), DDL))
    cost = {r["pair_id"]: r["cost"] for r in total.collect()}
    cells = {}
    for r in path.collect():
        cells.setdefault(r["pair_id"], []).append((r["row"], r["col"]))
    assert set(cost) == set(cells) == set(b)
    for n in b:
        want, total = K.dtw(np.abs(a[n][:, None] - b[n][None, :]))
        assert cost[n] == total and sorted(cells[n]) == [tuple(p) for p in want.tolist()]


def test_a_tile_is_the_whole_table():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=40), rng.normal(size=31)
    c = warping.costs(x, y, None, None, 0.0)
    path, total = K.dtw(np.abs(x[:, None] - y[None, :]))
    assert c[-1, -1] == total and warping.walk(c, 39, 30)[:-1][::-1] == [tuple(p) for p in path.tolist()]


def test_no_pairs(spark):
    none = spark.createDataFrame([], DDL)
    total, path = warping.dtw_chunks(none, none)
    assert total.collect() == [] and path.collect() == []


def test_equal_sequences(spark):
    one = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0])], DDL)
    total, path = warping.dtw_chunks(one, one)
    assert total.first()["cost"] == 0 and sorted((r["row"], r["col"]) for r in path.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_many_tiles_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 3, (50, 7)).astype(float), rng.integers(0, 3, (50, 5)).astype(float)
    top, left, corner = rng.integers(0, 4, (50, 5)).astype(float), np.full((50, 7), np.inf), rng.integers(0, 4, 50).astype(float)
    c = warping.costs_of(x, y, top, left, corner)
    rows, cols, n = warping.walks(c, np.full(50, 6), np.full(50, 4))
    for k in range(50):
        assert (c[k] == warping.costs(x[k], y[k], top[k], None, corner[k])).all()
        assert list(zip(rows[k, : n[k]].tolist(), cols[k, : n[k]].tolist(), strict=True)) == warping.walk(c[k], 6, 4)
