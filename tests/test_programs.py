import numpy as np
import pytest

from wavemill.plans import programs
from wavemill.sources import audio


@pytest.fixture(scope="module")
def wav(spark, tmp_path_factory):
    audio.register(spark)
    path = str(tmp_path_factory.mktemp("wav"))
    x = 0.5 * np.sin(2 * np.pi * 441 * np.arange(44100) / 44100)
    spark.createDataFrame([("tone", 44100.0, [x.tolist(), x.tolist()])], "signal_id string, sample_rate double, channels array<array<double>>").write.format("audio").mode("append").save(path)
    return path


@pytest.mark.parametrize(
    ("name", "lines", "kw"),
    [
        ("compute_feature", 1, {}),
        ("compute_feature", 13, {"name": "SpectralMfccs"}),
        ("compute_pitch", 87, {}),
        ("compute_novelty", 87, {}),
        ("compute_spectrogram", 2049, {}),
        ("compute_mel_spectrogram", 128, {}),
        ("compute_beat_histogram", None, {"block": 256, "hop": 64}),
        ("compute_chords", 22, {}),
        ("compute_key", 1, {}),
        ("compute_fingerprint", None, {}),
    ],
)
def test_program(spark, wav, tmp_path, name, lines, kw):
    out = str(tmp_path / "out")
    df = getattr(programs, name)(spark, wav, out, **kw)
    got = spark.read.text(out + "/signal_id=tone.wav").collect()
    assert len(got) == (df.count() if lines is None else lines)


def test_long_files_in_chunks_give_the_same(spark, wav, tmp_path):
    for name, kw in (("compute_feature", {"name": "SpectralFlux"}), ("compute_pitch", {"name": "TimeAcf"}), ("compute_novelty", {"name": "Hainsworth"}), ("compute_mel_spectrogram", {})):
        texts = []
        for chunk in (None, 8192):
            out = str(tmp_path / f"{name}{chunk}")
            getattr(programs, name)(spark, wav, out, chunk=chunk, **kw)
            lines = [r["value"].split("\t") for r in spark.read.text(out + "/signal_id=tone.wav").collect()]
            texts.append(np.array(lines, dtype=float))
        assert texts[0].shape == texts[1].shape and np.allclose(texts[0], texts[1], atol=1e-9)


def test_raw_files_take_reader_options(spark, tmp_path):
    (np.sin(np.arange(4000) / 9) * 9000).astype("<i2").tofile(tmp_path / "x.raw")
    options = {"fileFormat": "raw", "sampleRate": 8000, "nChannels": 1}
    whole = programs.compute_feature(spark, str(tmp_path / "x.raw"), str(tmp_path / "a"), "TimeRms", 512, 256, **options).collect()
    parts = programs.compute_feature(spark, str(tmp_path / "x.raw"), str(tmp_path / "b"), "TimeRms", 512, 256, chunk=1024, **options).collect()
    assert len(whole) == 16 == len(parts) and whole[0]["sample_rate"] == 8000
    assert sorted(round(r["TimeRms"], 9) for r in whole) == sorted(round(r["TimeRms"], 9) for r in parts)
