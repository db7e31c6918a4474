"""Transforms over tasks against numpy on the whole signal."""

import numpy as np
import pytest

from wavemill.operators import longfft as L


def chunks(spark, signals, chunk):
    rows = [(k, c, x[c * chunk : c * chunk + chunk].tolist()) for k, x in signals.items() for c in range(-(-len(x) // chunk))]
    return L.pieces_of_chunks(spark.createDataFrame(rows, "signal_id string, chunk_idx long, samples array<double>").repartition(4), chunk)


def whole(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r["signal_id"], np.zeros(n, dtype=complex))[r["at"] : r["at"] + len(r["re"])] = np.array(r["re"]) + 1j * np.array(r["im"])
    return out


@pytest.mark.parametrize("n, task", [(4, 1), (64, 16), (128, 8), (128, 1 << 20)])
def test_spectrum_and_way_back(spark, monkeypatch, n, task):
    monkeypatch.setattr(L, "TASK", task)
    rng = np.random.default_rng(n)
    signals = {"a": rng.normal(size=n), "b": rng.normal(size=n // 2 + 1)}
    spectrum = L.transform(chunks(spark, signals, 7), n)
    got, back = whole(spectrum, n), whole(L.transform(spectrum, n, inverse=True), n)
    for k, x in signals.items():
        padded = np.pad(x, (0, n - len(x)))
        assert np.allclose(got[k], np.fft.fft(padded) / n) and np.allclose(back[k], padded)


def test_a_million_values(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK", 1 << 17)
    n = 1 << 20
    x = np.random.default_rng(1).normal(size=n)
    got = whole(L.transform(chunks(spark, {"a": x}, 1 << 16), n), n)["a"]
    assert np.abs(got * n - np.fft.fft(x)).max() < 1e-7


def test_correlation_with_a_short_pattern(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=300), rng.normal(size=20)
    df = L.correlate(chunks(spark, {"a": x, "only here": x}, 50), chunks(spark, {"a": y}, 50))
    got = whole(df, 1024)
    want = np.correlate(x, y, "full")  # lags -19 to 299
    assert set(got) == {"a"} and np.allclose(got["a"].real[:300], want[19:]) and np.allclose(got["a"].real[-19:], want[:19]) and np.allclose(got["a"].imag, 0)


def test_odd_pieces(spark):
    ddl = "signal_id string, at long, re array<double>, im array<double>"
    odd = spark.createDataFrame([("a", 1, [1.0, None], [0.0, 0.0]), ("a", 1, [1.0], [1.0]), ("a", 2, None, None), (None, 0, [1.0], [0.0]), ("a", None, [1.0], [0.0]), ("a", 3, [], [])], ddl)
    assert np.allclose(whole(L.transform(odd, 4), 4)["a"], np.fft.fft([0, 2 + 1j, 0, 0]) / 4)
    assert L.transform(spark.createDataFrame([], ddl), 8).count() == 0 and L.length(spark.createDataFrame([], ddl)) == 4
    with pytest.raises(Exception, match="outside"):
        L.transform(spark.createDataFrame([("a", 3, [1.0, 2.0], [0.0, 0.0])], ddl), 4).count()
    with pytest.raises(ValueError, match="power of two"):
        L.transform(odd, 6)
