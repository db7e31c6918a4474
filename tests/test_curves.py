"""Segmented curves against loops over whole ones."""

import numpy as np
import pytest

from wavemill import kernels as K
from wavemill.operators import curves
from wavemill.plans import planner

DDL = "signal_id string, rate double, block_idx long, value double"


def triangle(x, size):
    return np.array([sum(x[j] * (size - abs(i - j)) for j in range(max(0, i - size + 1), min(len(x), i + size))) for i in range(len(x))]) / size**2


def plain(x, rate):
    """(novelty, excess, onset) of a whole curve."""
    top = np.abs(x).max()
    nov = np.maximum(triangle(x / (top if top > 0 else 1.0), K.moving_average_length(0.07, rate)), 0.0)
    level = nov[1:].mean() if len(x) > 1 else 0.0
    excess = np.maximum(nov - triangle(nov, K.moving_average_length(0.14, rate)) - 0.4 * level, 0.0)
    onset = [0 < i < len(x) - 1 and bool(excess[i] > excess[i - 1] and excess[i] > excess[i + 1] and excess[i] > 0) for i in range(len(x))]
    return nov, excess, onset


@pytest.mark.parametrize("segment, run", [(8, 2), (4096, 256)])
def test_segments_equal_whole_curves(spark, monkeypatch, segment, run):
    monkeypatch.setattr(curves, "SEGMENT", segment)
    monkeypatch.setattr(curves, "RUN", run)
    rng = np.random.default_rng(1)
    signals = {"a": (100.0, rng.normal(size=300)), "b": (20.0, rng.random(97) * (rng.random(97) < 0.3)), "c": (5.0, np.array([2.0])), "d": (64.0, np.zeros(130))}
    df = spark.createDataFrame([(k, r, i, float(v)) for k, (r, x) in signals.items() for i, v in enumerate(x)], DDL).repartition(5)
    got = {(r["signal_id"], r["block_idx"]): r for r in curves.onsets(df, "rate").collect()}
    assert len(got) == sum(len(x) for _, x in signals.values())
    for k, (rate, x) in signals.items():
        nov, excess, onset = plain(x, rate)
        mine = [got[k, i] for i in range(len(x))]
        assert np.allclose([r["novelty"] for r in mine], nov, atol=1e-12) and np.allclose([r["excess"] for r in mine], excess, atol=1e-12)
        assert [r["onset"] for r in mine] == onset and np.allclose([r["value"] for r in mine], x)


def test_odd_rows(spark):
    rows = [("a", 30.0, i, 1.0 if i == 5 else 0.0) for i in range(12)]
    odd = [("a", 30.0, 12, None), ("a", None, 3, 1.0), (None, 30.0, 3, 1.0), ("a", 30.0, None, 1.0), ("a", 30.0, -1, 9.0), ("z", 0.0, 1, 1.0)]
    got = sorted(curves.onsets(spark.createDataFrame(rows + odd, DDL), "rate").collect(), key=lambda r: r["block_idx"])
    assert [r["block_idx"] for r in got] == list(range(13)) and [r["block_idx"] for r in got if r["onset"]] == [5]
    assert curves.onsets(spark.createDataFrame([], DDL), "rate").count() == 0
    assert curves.beat_histogram(spark.createDataFrame([], DDL), "rate").count() == 0
    twice = curves.onsets(spark.createDataFrame(rows + rows, DDL), "rate").collect()
    assert len(twice) == 24 and sum(r["onset"] for r in twice) == 2


@pytest.mark.parametrize("method", ["fft", "acf"])
def test_beats_in_segments(spark, monkeypatch, method):
    monkeypatch.setattr(curves, "SEGMENT", 1)
    rng = np.random.default_rng(2)
    signals = {"a": (25.0, rng.random(2000)), "b": (10.0, rng.random(256)), "c": (10.0, np.zeros(9)), "d": (25.0, rng.random(70))}
    df = spark.createDataFrame([(k, r, i, float(v)) for k, (r, x) in signals.items() for i, v in enumerate(x)], DDL).repartition(5)
    got = {}
    for r in curves.beat_histogram(df, "rate", method, 64).collect():
        got.setdefault(r["signal_id"], []).append((r["bin"], r["bpm"], r["value"]))
    for k, (rate, x) in signals.items():
        want, bpm = K.beat_histogram(x, rate, method, 64), K.beat_axis(method, 64, rate)
        mine = np.array(sorted(got[k]))
        assert np.allclose(mine[:, 2], want) and np.allclose(mine[:, 1], bpm[max(0, -K.beat_range(method, 64, rate)[0]) :][: len(want)])


def test_long_signals_have_beats(spark):
    x = (np.random.default_rng(3).random(4000) * (np.arange(4000) % 500 < 60)).tolist()
    ddl = "signal_id string, sample_rate double, samples array<double>"
    whole = planner.Signals(spark.createDataFrame([("a", 1000.0, x)], ddl)).beat_histogram("acf", 64, 16)
    chunks = spark.createDataFrame([("a", 1000.0, k, x[k * 320 : k * 320 + 320]) for k in range(13)], "signal_id string, sample_rate double, chunk_idx long, samples array<double>")
    parts = planner.LongSignals(chunks, 320).beat_histogram("acf", 64, 16)
    values = lambda df: np.array(sorted((r["bin"], r["bpm"], r["value"]) for r in df.collect()))
    assert len(values(whole)) and np.allclose(values(whole), values(parts))


def test_keys_of_chunks_are_those_of_whole_signals(spark):
    t = np.arange(6000) / 4000.0
    tones = {"c": [261.63, 329.63, 392.0], "a": [220.0, 261.63, 329.63]}
    x = {k: sum(np.sin(2 * np.pi * f * t) for f in v).tolist() for k, v in tones.items()}
    whole = planner.Signals(spark.createDataFrame([(k, 4000.0, v) for k, v in x.items()], "signal_id string, sample_rate double, samples array<double>")).keys(1024, 512)
    rows = [(k, 4000.0, c, v[c * 1024 : c * 1024 + 1024]) for k, v in x.items() for c in range(6)]
    parts = planner.LongSignals(spark.createDataFrame(rows, "signal_id string, sample_rate double, chunk_idx long, samples array<double>"), 1024).keys(1024, 512)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() == 2
