import numpy as np
import pytest

from wavemill import kernels as K
from wavemill.functions import convert
from wavemill.plans.planner import Signals


@pytest.fixture(scope="module")
def tone(spark):
    x = 0.25 * np.sin(2 * np.pi * 441 * np.arange(20000) / 44100)
    return spark.createDataFrame([("t", 44100.0, x.tolist())], "signal_id string, sample_rate double, samples array<double>")


def test_features_share_one_pass(tone):
    out = Signals(tone).normalise().blocks(2048, 1024).features("SpectralCentroid", "SpectralMfccs", "TimeRms", "SpectralFlux")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = out.orderBy("block_idx").collect()
    assert len(rows) == 20000 // 1024 + 1 and len(rows[3]["SpectralMfccs"]) == 13
    assert rows[3]["TimeRms"] == pytest.approx(np.sqrt(0.5), rel=0.02)


def test_normalisation_is_skipped_where_it_does_not_matter(tone):
    s = Signals(tone).normalise().blocks()
    free = s.features("SpectralCentroid", "TimeZeroCrossingRate")._jdf.queryExecution().optimizedPlan().toString()
    full = s.features("TimeRms")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_max" not in free and "array_max" in full
    assert s.pitch("TimeAcf").first()["TimeAcf"] == pytest.approx(441)


def test_spectrogram_of_a_normalised_tone_is_one(tone):
    x = np.array(tone.first()["samples"])
    m = np.array(Signals(tone).normalise().blocks(2048, 2048).spectrogram().orderBy("block_idx").first()["mag"])
    assert m.max() == pytest.approx(2 * K.magnitude(x[None, :2048] / np.abs(x).max()).max())
    with pytest.raises(Exception, match="power of two"):
        Signals(tone).blocks(1000, 500).spectrogram().collect()
    with pytest.raises(ValueError, match="unknown feature"):
        Signals(tone).blocks().features("Loudness")
    with pytest.raises(ValueError):
        Signals(tone).blocks(512, 1024)


def test_chords_keys_and_novelty(tone):
    s = Signals(tone)
    assert s.keys(4096, 2048).first()["key"] in range(25)
    assert s.chords(4096, 2048).count() == 20000 // 2048 + 1
    assert s.novelty("Flux", 1024, 512).count() == 20000 // 512 + 1
    assert s.blocks(1024, 1024).with_window([1.0] * 1024).magnitudes().count() == 20


def test_sql_functions(spark):
    names = convert.register(spark)
    assert "hz_to_mel_fant" in names
    row = spark.sql("select hz_to_midi(440D) a, hz_to_bark_schroeder(1000D) b, next_pow2(5) c, signal_blocks(array(1D, 2D, 3D), 2, 2) d, word_distance(5, 6) e").first()
    assert row["a"] == pytest.approx(69) and row["b"] == pytest.approx(8.51137148802024) and row["c"] == 8
    assert row["d"] == [[1, 2], [3, 0]] and row["e"] == 2


def test_ring_reads(spark):
    from pyspark.sql import functions as F

    from wavemill.functions import exprs as E

    ring = spark.createDataFrame([(p,) for p in (0.7, 7.5, 14.5, -0.25)], "p double").withColumn("a", F.expr("transform(sequence(0, 14), x -> cast(x as double))"))
    got = [round(r["v"], 9) for r in ring.select(E.ring_get("a", "p").alias("v")).collect()]
    assert got == [0.7, 7.5, 7.0, 3.5]
    moved = spark.range(1).select(E.moved(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), 0, 2, 2).alias("m"), E.divide(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("d"), E.subtract_scaled(F.array(F.lit(3.0)), F.array(F.lit(2.0)), 0.5).alias("s")).first()
    assert moved["m"] == [3.0, 4.0, 3.0, 4.0] and moved["d"] == [None] and moved["s"] == [2.0]
