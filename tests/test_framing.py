import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import features, framing, learn, music, spectral


def plain(x, block, hop):
    """(x, xp) of every block."""
    x = np.pad(np.asarray(x, float), (0, block + hop))
    n = (len(x) - block - hop) // hop + 1
    b = [x[k * hop : k * hop + block].tolist() for k in range(n)]
    return list(zip(b, [[0.0] * block, *b[:-1]], strict=True))


def got(df, previous=True):
    out = {}
    for r in df.collect():
        out.setdefault(r["signal_id"], {})[r["block_idx"]] = (r["x"], r["xp"]) if previous else r["x"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


@pytest.mark.parametrize(("block", "hop", "hops"), [(4, 2, 0), (5, 2, 1), (5, 3, 2), (7, 7, 1), (8, 1, 3), (16, 8, 1)])
def test_blocks_of_every_form_are_the_same(spark, block, hop, hops):
    rng = np.random.default_rng(block)
    signals = {f"s{n}": rng.integers(1, 99, n).astype(float).tolist() for n in (1, 2, 7, 8, 33, 48)}
    want = {k: plain(v, block, hop) for k, v in signals.items()}
    whole = spark.createDataFrame([(k, 10.0, v) for k, v in signals.items()], "signal_id string, sample_rate double, samples array<double>")
    assert got(framing.blocks(whole, block, hop, previous=True)) == want
    assert got(framing.blocks(whole, block, hop), False) == {k: [x for x, _ in v] for k, v in want.items()}
    samples = whole.select("signal_id", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    assert got(framing.blocks_from_samples(samples, block, hop, 10.0, True, hops)) == want
    assert got(framing.blocks_from_samples(samples, block, hop, 10.0), False) == {k: [x for x, _ in v] for k, v in want.items()}
    size = 2 * hop
    chunks = whole.select("signal_id", "sample_rate", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / size).cast("int")), lambda k: F.slice("samples", k * size + 1, size))).alias("chunk_idx", "samples"))
    assert got(framing.blocks_from_chunks(chunks, block, hop, size, previous=True)) == want


def test_missing_and_repeated_samples_keep_their_places(spark):
    rows = [("a", 0, 1.0), ("a", 2, 3.0), ("b", 9, 5.0), ("b", 9, 4.0), ("b", 3, None), ("c", 40, 1.0)]
    out = got(framing.blocks_from_samples(spark.createDataFrame(rows, "signal_id string, i long, x double"), 4, 4, previous=True, chunk_hops=2))
    dense = {"a": [1, 0, 3], "b": [0] * 9 + [4], "c": [0] * 40 + [1]}
    assert out == {k: plain(v, 4, 4) for k, v in dense.items()}


def test_neighbouring_blocks_need_no_exchange(spark):
    whole = spark.createDataFrame([("a", 10.0, [1.0] * 20)], "signal_id string, sample_rate double, samples array<double>")
    out = features.features(framing.blocks(whole, 4, 2, previous=True), ["SpectralFlux"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_null_blocks_and_elements_give_null_results(spark):
    rows = [(0, 8.0, [1.0, 2.0, 3.0, 4.0]), (1, 8.0, None), (2, 8.0, [1.0, None, 3.0, 4.0]), (3, None, [1.0, 2.0, 3.0, 4.0]), (4, 8.0, [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "signal_id int, sample_rate double, x array<double>")
    out = {r["signal_id"]: r for r in features.features(df, ["SpectralCentroid", "SpectralMfccs", "TimeRms"], keep=["signal_id"]).collect()}
    assert len(out) == 5 and all(out[i]["TimeRms"] is None and out[i]["SpectralMfccs"] is None for i in (1, 2, 3))
    assert out[0]["TimeRms"] == pytest.approx(7.5**0.5) and out[4]["SpectralCentroid"] > 0
    assert [r["mag"] is None for r in spectral.magnitudes(df, keep=["signal_id"]).orderBy("signal_id").collect()] == [False, True, True, True, False]


def test_rows_without_whole_features_take_no_part(spark):
    rows = [(i, i % 2, [float(i % 2) + 0.01 * i, 1.0]) for i in range(20)] + [(20, 0, None), (21, 1, [None, 1.0])]
    o = spark.createDataFrame(rows, "obs_id long, label int, f array<double>")
    home, centres = learn.kmeans(o, np.array([[0.0, 1.0], [1.0, 1.0]]), 5)
    assert home.count() == 20 and {(r["obs_id"] % 2, r["cluster"]) for r in home.collect()} == {(0, 0), (1, 1)}
    n, mean, _ = learn.moments(o)
    assert n == 20 and mean[1] == 1.0
    drawn, _ = learn.kmeans(o, 2, 20)
    assert drawn.select("cluster").distinct().count() == 2 and (learn.seeds(o, 3) == learn.seeds(o, 3)).all()
    m = learn.gmm(o.withColumn("f", F.transform("f", lambda v: v + F.col("obs_id") * 0.003)), 2, 3)
    assert m.prior.sum() == pytest.approx(1.0)
    assert learn.knn(o, o, 1, exclude_self=True).count() == 20


def test_each_signal_has_its_own_rate(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{rate:.0f}", rate, (rng.random(6000) * (np.arange(6000) % 700 < 90)).tolist()) for rate in (1000.0, 4000.0)]
    ddl = "signal_id string, sample_rate double, samples array<double>"
    both = music.novelty(spark.createDataFrame(rows, ddl), block=64, hop=16)
    for row in rows:
        one = music.novelty(spark.createDataFrame([row], ddl), block=64, hop=16).select("signal_id", "block_idx", F.round("novelty", 9), "onset")
        assert sorted(map(tuple, both.where(F.col("signal_id") == row[0]).select("signal_id", "block_idx", F.round("novelty", 9), "onset").collect())) == sorted(map(tuple, one.collect()))
        beats = music.beat_histogram(spark.createDataFrame(rows, ddl), "acf", 64, 16).where(F.col("signal_id") == row[0]).select("bin", F.round("bpm", 6), F.round("value", 6)).collect()
        assert sorted(map(tuple, beats)) == sorted(map(tuple, music.beat_histogram(spark.createDataFrame([row], ddl), "acf", 64, 16).select("bin", F.round("bpm", 6), F.round("value", 6)).collect()))


def test_moving_averages_far_from_the_start(spark):
    rng = np.random.default_rng(1)
    v = rng.random(300)
    for size in (1, 2, 5, 7, 64, 400):
        for start in (0, 10**9):
            df = spark.createDataFrame([("a", start + i, float(x)) for i, x in enumerate(v)], "signal_id string, block_idx long, v double")
            one = [r["y"] for r in framing.moving_average(df, "v", size, "y").orderBy("block_idx").collect()]
            assert one == pytest.approx(np.convolve(v, np.ones(size))[:300] / size, abs=1e-12)
            two = [r["y"] for r in framing.moving_average_zero_phase(df, "v", size, "y").orderBy("block_idx").collect()]
            kernel = np.convolve(np.ones(size), np.ones(size)) / size**2
            assert two == pytest.approx(np.convolve(v, kernel)[size - 1 : size - 1 + 300], abs=1e-12)
