import numpy as np
import pytest

from wavemill import kernels as K
from wavemill.streaming import stateful

RATE = 1000.0


def stream(spark, tmp_path, make, x, end=False, lost=()):
    """Runs a streaming operator over files of out-of-order samples; rows as a sorted list. ``end``: with a row that tells the length."""
    src, rng = str(tmp_path / "in"), np.random.default_rng(1)
    rows = [("a", i, float(v)) for i, v in enumerate(x) if i not in lost] + [("b", i, float(-v)) for i, v in enumerate(x)] + [("a", len(x), None)] * end
    schema = "signal_id string, i long, x double"
    for part in range(0, len(x) + 1, 97):
        some = [r for r in rows if part <= r[1] < part + 97]
        rng.shuffle(some)
        spark.createDataFrame([(s, int(i), None if v is None else float(v)) for s, i, v in some], schema).coalesce(1).write.mode("append").parquet(src)
    out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = out.writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table(q.name).where("signal_id = 'a'").collect()]
    return sorted(got, key=lambda r: r[1])


@pytest.fixture(scope="module")
def x():
    return np.sin(2 * np.pi * 50 * np.arange(400) / RATE) * np.linspace(0, 1, 400)


def test_blocks_and_flux(spark, tmp_path, x):
    got = stream(spark, tmp_path, lambda s: stateful.blocks(s, 64, 32), x)
    assert [r[1] for r in got] == list(range(11))
    assert all(np.allclose(r[2], x[32 * r[1] : 32 * r[1] + 64]) for r in got)


def test_flux_equals_batch(spark, tmp_path, x):
    got = stream(spark, tmp_path, lambda s: stateful.flux(s, 64, 32), x)
    m = K.magnitude(np.stack([x[32 * n : 32 * n + 64] for n in range(11)]))
    want = K.spectral_flux(m, np.concatenate([np.zeros((1, 33)), m[:-1]]))
    assert [r[2] for r in got] == pytest.approx(want.tolist())


def padded(x, block, hop):
    x = np.pad(x, (0, block))
    b = np.stack([x[n * hop : n * hop + block] for n in range((len(x) - block) // hop + 1)])
    return b, np.concatenate([np.zeros((1, block)), b[:-1]])


@pytest.mark.parametrize("kind", ["blocks", "flux", "novelty", "phase", "words"])
def test_whole_signals_equal_batch(spark, tmp_path, x, kind):
    rate = 5000.0
    make, want = {
        "blocks": (lambda s: stateful.blocks(s, 64, 32), lambda b, p: b),
        "flux": (lambda s: stateful.flux(s, 64, 32), lambda b, p: K.spectral_flux(K.magnitude(b), K.magnitude(p))),
        "novelty": (lambda s: stateful.novelty(s, 64, 32, "Hainsworth"), lambda b, p: K.novelty_hainsworth(2 * K.magnitude(b), 2 * K.magnitude(p))),
        "phase": (lambda s: stateful.instantaneous_frequency(s, 64, 32, rate), lambda b, p: K.instantaneous_frequency(K.spectrum(b), K.spectrum(p), 32, rate)),
        "words": (lambda s: stateful.fingerprints(s, 64, 32, rate), lambda b, p: K.fingerprint_words(*(K.fingerprint_differences(K.magnitude(v), rate) for v in (b, p)))),
    }[kind]
    got = stream(spark, tmp_path, make, x, end=True)
    assert [r[1] for r in got] == list(range(13))
    assert np.allclose(np.array([r[2] for r in got]), want(*padded(x, 64, 32)))


def test_lost_samples_are_given_up(spark, tmp_path, x):
    got = stream(spark, tmp_path, lambda s: stateful.moving_average(s, 3, patience=150), x, lost={5, 6, 40})
    y = x.copy()
    y[[5, 6, 40]] = 0
    assert [r[1] for r in got] == list(range(400))
    assert [r[2] for r in got] == pytest.approx(K.moving_average(y[None, :], 3)[0].tolist())
    late = tmp_path / "late"
    late.mkdir()
    assert len(stream(spark, late, lambda s: stateful.moving_average(s, 3), x, lost={5})) == 5


def test_signals_without_samples_and_after_their_end(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "signal_id string, i long, x double"
    for rows in ([("a", 0, None), ("b", 0, 1.0), ("b", 1, None)], [("a", 0, 9.0), ("b", 1, 9.0), ("b", 0, 7.0), ("c", 0, 5.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    q = stateful.blocks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 2, 2).writeStream.format("memory").queryName("ends").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("ends").collect())) == [("a", 0, [0.0, 0.0]), ("b", 0, [1.0, 0.0])]


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "user_id long, ts timestamp, value double"
    for k, times in enumerate((["2024-01-01 00:00:00", "2024-01-01 00:05:00"], ["2024-01-01 03:00:00"], ["2024-01-01 03:02:00"], ["2024-01-01 00:01:00", "2024-01-01 03:01:00"], ["2024-01-01 09:00:00"])):
        rows = spark.createDataFrame([(1, t, float(k + 1)) for t in times], "user_id long, ts string, value double")
        rows.selectExpr("user_id", "cast(ts as timestamp) ts", "value").coalesce(1).write.mode("append").parquet(src)
    out = stateful.windowed_levels(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "1 hour")
    q = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["start"]): (r["n"], r["mean"]) for r in spark.table("late").collect()}
    assert got["2024-01-01 00:00:00"] == (2, 1.0) and got["2024-01-01 03:00:00"] == (3, 3.0)


@pytest.mark.parametrize("name", ["iir", "pole", "average", "meter", "rms", "delay", "gammatone"])
def test_filters_equal_batch(spark, tmp_path, x, name):
    make, want = {
        "iir": (lambda s: stateful.iir(s, *K.butterworth(2, 0.3)), lambda: K.iir(*K.butterworth(2, 0.3), x[None, :])[0]),
        "pole": (lambda s: stateful.single_pole(s, 0.3, RATE), lambda: K.single_pole(x[None, :], K.single_pole_alpha(0.3, RATE))[0]),
        "average": (lambda s: stateful.moving_average(s, 5), lambda: K.moving_average(x[None, :], 5)[0]),
        "meter": (lambda s: stateful.peak_meter(s, RATE), lambda: K.peak_meter(x, RATE)[0]),
        "rms": (lambda s: stateful.rms_meter(s, RATE, 0.1), lambda: np.sqrt(K.single_pole((x * x)[None, :], K.single_pole_alpha(0.1, RATE))[0])),
        "delay": (lambda s: stateful.delay(s, 7.25), lambda: K.interpolate(x, np.arange(400) - 7.25)),
        "gammatone": (lambda s: stateful.gammatone(s, 100.0, RATE), lambda: K.gammatone(x[None, :], 100.0, RATE)[0]),
    }[name]
    got = stream(spark, tmp_path, make, x)
    assert [r[1] for r in got] == list(range(400))
    assert [r[2] for r in got] == pytest.approx(want().tolist())


def test_steps_of_paired_operators(x):
    for fn in (stateful._pair(K.spectral_flux), stateful._pair(K.novelty_laroche)):
        whole = stateful.block_step(64, 32, fn)(np.empty(0), x, 0)[1]
        memory, parts = np.empty(0), []
        for at in range(0, 400, 50):
            memory, rows = stateful.block_step(64, 32, fn)(memory, x[at : at + 50], at)
            parts += rows
        assert [n for n, _ in parts] == [n for n, _ in whole] and [v for _, v in parts] == pytest.approx([v for _, v in whole])


def test_event_time_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "cast(ts as timestamp) ts", "value")
    assert stateful.windowed_levels(e, "1 day").agg({"n": "sum"}).first()[0] == e.count()
    assert stateful.sessions(e, "1 hour").agg({"n": "sum"}).first()[0] == e.count()


def test_a_long_batch_is_worked_on_in_slices(spark, tmp_path, x, monkeypatch):
    monkeypatch.setattr(stateful, "FILL", 64)

    def step(memory, part, at):
        if len(part) > 64:
            raise ValueError("a slice is too long")
        return np.array([float(at)]), [(at + k, float(v)) for k, v in enumerate(part)]

    got = stream(spark, tmp_path, lambda s: stateful.run(s, step, "i bigint, y double"), x)
    assert [(i, y) for _, i, y in got] == [(i, float(v)) for i, v in enumerate(x)]
