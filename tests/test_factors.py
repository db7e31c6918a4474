"""Factorisation by columns against the loop over one matrix."""

import numpy as np
import pytest

from wavemill.operators import factors, learn

SCHEMA = "signal_id string, block_idx long, mag array<double>"


def rows(x, name):
    return [(name, j, c.tolist()) for j, c in enumerate(x.T)]


@pytest.mark.parametrize("sparsity", [0.0, 0.05])
def test_equal_to_one_matrix_in_one_place(spark, sparsity):
    rng = np.random.default_rng(5)
    x = {"a": rng.random((6, 2)) @ rng.random((2, 90)), "b": rng.random((6, 3)) @ rng.random((3, 11))}
    w0, h0 = rng.random((6, 2)), rng.random((90, 2))
    df = spark.createDataFrame(rows(x["a"], "a") + rows(x["b"], "b"), SCHEMA).repartition(5)
    w, h, cost = factors.nmf_columns(df, 2, 8, sparsity, start_w=lambda bins: w0, start_h=lambda places: h0[places])
    got = {(r["signal_id"], r["block_idx"]): r for r in h.collect()}
    assert len(got) == 101
    for name, m in x.items():
        n = m.shape[1]
        ww, hh, est, c = learn.nmf_matrix(m, w0.copy(), h0[:n].T.copy(), 8, sparsity)
        assert np.allclose(w[name], ww, rtol=1e-9) and np.isclose(cost[name], c, rtol=1e-9)
        assert np.allclose([got[name, j]["h"] for j in range(n)], hh.T, rtol=1e-9)
        assert np.allclose([got[name, j]["est"] for j in range(n)], est.T, rtol=1e-9)


def test_odd_columns_and_bounds(spark, monkeypatch):
    good = [("a", 5, [1.0, 2.0]), ("a", 9, [0.0, 0.0])]
    odd = [("a", 1, None), ("a", 2, [None, 1.0]), ("a", 3, [-1.0, 1.0]), ("a", 4, [float("nan"), 1.0]), (None, 1, [1.0, 1.0]), ("a", None, [1.0, 1.0])]
    w, h, _ = factors.nmf_columns(spark.createDataFrame(good + odd, SCHEMA), 1, 3)
    assert sorted(r["block_idx"] for r in h.collect()) == [5, 9] and np.isclose(w["a"].sum(), 1)
    assert factors.nmf_columns(spark.createDataFrame([], SCHEMA), 1, 3)[1].count() == 0
    monkeypatch.setattr(factors, "MOST_NUMBERS", 1)
    with pytest.raises(ValueError, match="too many"):
        factors.nmf_columns(spark.createDataFrame(good, SCHEMA), 1)
