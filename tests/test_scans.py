"""Recurrences over chunks against the same recurrence in one task."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill import kernels as K
from wavemill.operators import music, scans

DDL = "signal_id string, sample_rate double, chunk_idx long, samples array<double>"


def cut(signals, chunk):
    """Rows of {name: (rate, samples)} in chunks, the last of which may be short."""
    return [(n, fs, k, [float(v) for v in x[k * chunk : (k + 1) * chunk]]) for n, (fs, x) in signals.items() for k in range(-(-len(x) // chunk))]


def joined(df, band=None):
    out = {}
    for r in df.orderBy("chunk_idx").collect():
        out.setdefault((r["signal_id"], r["band"]) if band else r["signal_id"], []).extend(r["samples"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(4)
    return {"long": (100.0, rng.normal(size=1003)), "short": (100.0, rng.normal(size=41)), "other": (150.0, rng.normal(size=350)), "even": (100.0, rng.normal(size=200))}


def test_filters_over_chunks(spark, signals):
    df = spark.createDataFrame(cut(signals, 20), DDL).repartition(5)
    b, a = K.butterworth(4, 0.2)
    got = joined(scans.filter_chunks(df, (b, a), group=8))  # two levels of groups
    for n, (_, x) in signals.items():
        assert got[n] == pytest.approx(K.iir(b, a, x[None, :])[0], abs=1e-9)
    got = joined(scans.filter_chunks(df, (b, a), zero_phase=True))
    for n, (_, x) in signals.items():
        assert got[n] == pytest.approx(K.filtfilt(b, a, x[None, :])[0], abs=1e-9)
    got = joined(scans.single_pole_chunks(df, 0.1))
    for n, (fs, x) in signals.items():
        assert got[n] == pytest.approx(K.single_pole(x[None, :], K.single_pole_alpha(0.1, fs))[0], abs=1e-9)


def test_gammatone_over_chunks(spark, signals):
    got = joined(scans.gammatone_chunks(spark.createDataFrame(cut(signals, 37), DDL), 3, 10.0), band=True)
    for n, (fs, x) in signals.items():
        for k, c in enumerate(K.gammatone_centres(3, 10.0, fs)):
            assert got[n, k] == pytest.approx(K.gammatone(x[None, :], float(c), fs)[0], abs=1e-9)


def test_resampling_over_chunks(spark, signals):
    for rate in (100.0, 120.0):
        out = scans.resample_chunks(spark.createDataFrame(cut(signals, 25), DDL), rate, 25)
        got = joined(out)
        assert out.select("sample_rate").distinct().collect()[0][0] == rate
        assert out.where(F.size("samples") > 25).count() == 0
        for n, (fs, x) in signals.items():
            want = x if fs == rate else K.resample(x, fs, rate)
            assert got[n] == pytest.approx(want, abs=1e-9)


def test_odd_signals(spark):
    b, a = K.butterworth(2, 0.3)
    assert scans.filter_chunks(spark.createDataFrame([], DDL), (b, a)).collect() == []
    assert scans.filter_chunks(spark.createDataFrame([], DDL), (b, a), zero_phase=True).collect() == []
    df = spark.createDataFrame([("a", 1.0, 0, None), ("b", 1.0, 0, []), ("c", 1.0, 0, [1.0, None, 2.0]), ("d", 1.0, 5, [1.0, 2.0])], DDL)
    got = joined(scans.filter_chunks(df, (b, a)))
    assert set(got) == {"c", "d"} and np.isnan(got["c"][1:]).all()
    assert got["d"] == pytest.approx(K.iir(b, a, np.array([[1.0, 2.0]]))[0])
    with pytest.raises(Exception, match="more than 6 samples"):
        scans.filter_chunks(df, (b, a), zero_phase=True).collect()
    gain = joined(scans.filter_chunks(df.where("signal_id = 'd'"), ((2.0,), (1.0,)), zero_phase=True))
    assert gain["d"].tolist() == [4.0, 8.0]


@pytest.mark.parametrize("group", [512, 8])
def test_decoding_over_chunks(spark, group):
    rng = np.random.default_rng(6)
    start, move = K.chord_model()
    e = {"a": K.chord_probabilities(rng.random((500, 12))), "b": K.chord_probabilities(rng.random((7, 12))), "one": K.chord_probabilities(rng.random((1, 12)))}
    e["tie"] = np.full((60, 25), 1 / 25)
    rows = [(n, k, k * 10, p[k * 10 : k * 10 + 10].tolist()) for n, p in e.items() for k in range(-(-len(p) // 10))]
    df = spark.createDataFrame(rows, "signal_id string, chunk_idx long, first long, emissions array<array<double>>").repartition(4)
    got = {}
    for r in scans.viterbi_chunks(df, start, move, group).orderBy("block_idx").collect():
        got.setdefault(r["signal_id"], []).append((r["state"], r["probability"]))
    for n, p in e.items():
        path, total = K.viterbi(p.T, start, move)
        assert [s for s, _ in got[n]] == path.tolist()
        assert got[n][0][1] == pytest.approx(total, abs=1e-6) and len({v for _, v in got[n]}) == 1


def test_equal_paths_go_to_the_first_state(spark):
    # two states that are alike in all: every path has the same probability
    rows = [(0, k, 3 * k, [[0.3, 0.3]] * 3) for k in range(5)]
    df = spark.createDataFrame(rows, "signal_id long, chunk_idx long, first long, emissions array<array<double>>")
    half = [[0.5, 0.5], [0.5, 0.5]]
    flat = spark.createDataFrame([(0, i, [0.3, 0.3]) for i in range(15)], "signal_id long, block_idx long, emission array<double>")
    want = [r["state"] for r in music.viterbi(flat, [0.5, 0.5], half).orderBy("block_idx").collect()]
    assert [r["state"] for r in scans.viterbi_chunks(df, [0.5, 0.5], half, 2).orderBy("block_idx").collect()] == want == [0] * 15


def test_chords_and_fingerprints_of_long_signals(spark):
    from wavemill.plans.planner import LongSignals, Signals

    rng = np.random.default_rng(1)
    x = {"a": (8000.0, rng.normal(size=2500)), "b": (8000.0, rng.normal(size=700))}
    long = LongSignals(spark.createDataFrame(cut(x, 256), DDL), 256)
    whole = Signals(spark.createDataFrame([(n, fs, v.tolist()) for n, (fs, v) in x.items()], "signal_id string, sample_rate double, samples array<double>"))
    rows = lambda df, *c: sorted(tuple(r) for r in df.select("signal_id", "block_idx", *c).collect())
    assert rows(long.chords(128, 64), "chord", "name") == rows(whole.chords(128, 64), "chord", "name")
    small = {"block": 128, "hop": 64}
    assert rows(long.fingerprints(**small), "word") == rows(music.fingerprints(whole.df, **small), "word")


def test_equal_chunks_are_filtered_together(spark, monkeypatch):
    from wavemill.operators import scans

    batch = pa.RecordBatch.from_pydict({"samples": [[1.0, 2.0], [3.0], [4.0, None], [5.0, 6.0], [7.0, 8.0]], "sample_rate": [8.0, 8.0, 8.0, 4.0, 8.0]})
    got = [(some.tolist(), x.tolist(), rate) for some, x, rate in scans._alike(batch, True)]
    assert [(s, r) for s, _, r in got] == [([0, 2, 4], 8.0), ([1], 8.0), ([3], 4.0)]
    assert got[0][1][0] == [2.0, 1.0] and np.isnan(got[0][1][1][0]) and got[0][1][2] == [8.0, 7.0]
    monkeypatch.setattr(scans, "AT_ONCE", 4)
    assert [some.tolist() for some, _, _ in scans._alike(batch, False)] == [[0, 2], [4], [1], [3]]


@pytest.mark.parametrize("rate", [8000.0, 5000.0, 6000.0])
def test_parts_of_a_resampled_signal_are_those_of_the_whole(rate):
    x = np.random.default_rng(3).normal(size=2000)
    n, around = K.resample_length(2000, rate, 6000.0), K.resample_reach(rate, 6000.0)
    want = x if rate == 6000.0 else K.resample(x, rate, 6000.0)
    for first, end in ((0, 90), (n // 2, n // 2 + 60), (n - 70, n)):
        low, high = max(0, int(first * rate / 6000) - around), min(2000, int(end * rate / 6000) + 1 + around)
        assert np.abs(K.resample_part(x[low:high], low, 2000, first, end, rate, 6000.0) - want[first:end]).max() < 1e-12


@pytest.mark.parametrize("chunk", [64, 320])  # by scans, as the filters remember more than a chunk, and in one pass
def test_fingerprints_of_chunks_are_those_of_the_whole(spark, chunk):
    from wavemill.operators import music

    rng = np.random.default_rng(5)
    x = {"down": (8000.0, rng.normal(size=2048)), "up": (4000.0, rng.normal(size=1500)), "same": (5000.0, rng.normal(size=5 * chunk)), "short": (8000.0, rng.normal(size=20)), "odd": (8000.0, rng.normal(size=900))}
    x["odd"][1][300] = np.nan  # a null for Spark
    listed = lambda v: [None if np.isnan(a) else float(a) for a in v]
    chunks = spark.createDataFrame([(n, fs, k, listed(v[k * chunk : (k + 1) * chunk])) for n, (fs, v) in x.items() for k in range(-(-len(v) // chunk))], DDL)
    whole = spark.createDataFrame([(n, fs, listed(v)) for n, (fs, v) in x.items()], "signal_id string, sample_rate double, samples array<double>")
    rows = lambda df: sorted(tuple(r) for r in df.select("signal_id", "sample_rate", "block_idx", "t_s", "word").collect())
    got = rows(music.fingerprints_of_chunks(chunks, chunk, 128, 32))
    assert got == rows(music.fingerprints(whole, 128, 32)) and len({r[4] for r in got}) > 50


def test_chunks_are_placed_by_the_samples_before_them(spark):
    rows = [("a", 8.0, 0, [1.0, 2.0]), ("a", 8.0, 2, [3.0]), ("a", 8.0, 5, [4.0, 5.0, 6.0]), ("b", 8.0, 0, [float("inf")]), ("b", 8.0, 1, [None])]
    placed = scans.placed_chunks(spark.createDataFrame(rows, DDL))
    assert sorted((r["signal_id"], r["at"], r["length"], r["sound"]) for r in placed.collect()) == [("a", 0, 6, True), ("a", 2, 6, True), ("a", 3, 6, True), ("b", 0, 2, False), ("b", 1, 2, False)]
    got = {r["chunk_idx"]: (r["at"], r["samples"]) for r in scans.bordered(placed.where("signal_id = 'a'"), 3, 1, 2).collect()}
    assert got == {0: (0, [1.0, 2.0, 3.0, 4.0, 5.0]), 1: (2, [3.0, 4.0, 5.0, 6.0]), 2: (5, [6.0])}
