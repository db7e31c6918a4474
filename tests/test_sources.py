import numpy as np
import pytest

from wavemill.sources import audio, codec, synth, text


@pytest.mark.parametrize(("kind", "stream"), [("wav", "int16"), ("wav", "float32"), ("aiff", "int16be"), ("aiff", "int16"), ("aiff", "float32be"), ("raw", "int16")])
def test_write_and_read_round_trip(spark, tmp_path, kind, stream):
    audio.register(spark)
    x = 0.6 * np.sin(2 * np.pi * 441 * np.arange(1027) / 44100)
    rows = [("a", 44100.0, [x.tolist(), np.roll(x, 25).tolist()]), ("b", 44100.0, [(-x).tolist(), x.tolist()])]
    path = str(tmp_path / "out")
    spark.createDataFrame(rows, "signal_id string, sample_rate double, channels array<array<double>>").write.format("audio").option("fileFormat", kind).option("bitStream", stream).mode("append").save(path)
    reader = spark.read.format("audio").option("chunkFrames", 300).option("fileFormat", kind).option("sampleRate", 44100).option("nChannels", 2).option("bitStream", stream)
    got = reader.load(path).where(f"path = '{path}/a.{kind}'").orderBy("start_frame").collect()
    assert [r["start_frame"] for r in got] == [0, 300, 600, 900] and got[0]["n_frames"] == 1027 and got[0]["sample_rate"] == 44100
    back = np.concatenate([np.array(r["channels"]) for r in got], axis=1)
    assert np.abs(back - np.array(rows[0][2])).max() < 1e-3
    late = reader.load(path).where("start_frame >= 600")
    assert late.count() == 4
    whole = audio.read_files(spark, f"{path}/b.{kind}", fileFormat=kind, sampleRate=44100, nChannels=2, bitStream=stream).first()
    assert np.abs(np.array(whole["channels"]) - np.array(rows[1][2])).max() < 1e-3
    mono = audio.mono(reader.load(f"{path}/b.{kind}")).orderBy("chunk_idx").collect()
    assert np.abs(np.concatenate([r["samples"] for r in mono])).max() < 1e-3


def test_clipping_and_rounding():
    spec = codec.Spec("raw", "int16", 1, 1.0, 0, 0)
    x = np.array([[2.0, -2.0, 0.5 / 32768, -0.5 / 32768]])
    assert codec.decode(codec.encode(x), spec)[0].tolist() == [32767 / 32768, -1, 1 / 32768, -1 / 32768]
    assert codec.decode(codec.encode(x, "float32", clip=False), codec.Spec("raw", "float32", 1, 1.0, 0, 0))[0, 1] == -2
    assert codec.extended_to_float(codec.float_to_extended(44100.0)) == 44100


def test_bad_files():
    with pytest.raises(OSError):
        codec.parse(b"RIFF1234WAVEfmt ", 16)
    with pytest.raises(ValueError):
        codec.parse(b"", 0, "mp3")
    with pytest.raises(ValueError):
        codec.parse(b"", 0, "raw", bit_stream="int24")


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0.5, [1.0, 2.0]), ("a", 1, 1.5, [3.0, 4.0])], "signal_id string, block_idx long, t_s double, v array<double>")
    lines = [r["value"] for r in text.matrix_lines(df, "v").orderBy("row").collect()]
    assert lines == ["1.0\t3.0", "2.0\t4.0"]
    text.write_matrix(df, "v", str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == lines
    text.write_series(df.withColumn("y", df["block_idx"]), "y", str(tmp_path / "s"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["0.5\t0", "1.5\t1"]


def test_generators(spark):
    n = [r["x"] for r in synth.noise(spark, 500, 0.5, False).collect()]
    assert -0.5 <= min(n) < -0.4 and 0.4 < max(n) <= 0.5
    saw = [r["x"] for r in synth.saw(spark, 1.0, 8.0, 16).orderBy("i").collect()]
    assert saw[:5] == [0, 0.25, 0.5, 0.75, -1]


def test_overwrite_append_and_failed_writes(spark, tmp_path):
    import os

    audio.register(spark)
    path = str(tmp_path / "out")
    ddl = "signal_id string, sample_rate double, channels array<array<double>>"
    rows = lambda *names: spark.createDataFrame([(n, 100.0, [[0.5] * 4]) for n in names], ddl).write.format("audio")
    rows("a", "b").mode("append").save(path)
    rows("c").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["a.wav", "b.wav", "c.wav"]
    rows("a").mode("overwrite").save(path)
    assert os.listdir(path) == ["a.wav"]
    bad = spark.createDataFrame([("z", 100.0, [[0.5]]), ("y", 100.0, None)], ddl)
    with pytest.raises(Exception, match="(?s).*"):
        bad.write.format("audio").mode("overwrite").save(path)
    assert os.listdir(path) == ["a.wav"]  # nothing of the failed job, and nothing of the old one lost


def test_short_files_are_not_opened_for_planning(spark, tmp_path):
    audio.register(spark)
    path = str(tmp_path / "out")
    rows = [("short", 100.0, [[0.25] * 10]), ("long", 100.0, [[0.5] * 900]), ("empty", 100.0, [[]])]
    spark.createDataFrame(rows, "signal_id string, sample_rate double, channels array<array<double>>").write.format("audio").mode("append").save(path)
    reader = audio.AudioReader({"path": path, "chunkframes": "400"})
    parts = reader.partitions()
    assert [(p.path.split("/")[-1], p.spec is None) for p in parts] == [("empty.wav", True), ("long.wav", False), ("long.wav", False), ("long.wav", False), ("short.wav", True)]
    got = spark.read.format("audio").option("chunkFrames", 400).load(path)
    assert {(r["path"].split("/")[-1], r["start_frame"], len(r["channels"][0])) for r in got.collect()} == {("short.wav", 0, 10), ("long.wav", 0, 400), ("long.wav", 400, 400), ("long.wav", 800, 100)}
    assert got.where("start_frame >= 800").count() == 1 and got.where("start_frame < 400").count() == 2


def test_many_signals_share_text_files(spark, tmp_path):
    import os

    rows = [(f"s {i}", b, float(b), [float(i), b / 2]) for i in range(300) for b in range(2)] + [(None, 0, 0.0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "signal_id string, block_idx long, t_s double, v array<double>")
    for name, write in (("m", lambda p, **k: text.write_matrix(df, "v", p, **k)), ("s", lambda p, **k: text.write_series(df.withColumn("y", df["v"][1]), "y", p, **k)), ("c", lambda p, **k: text.write_column(df, df["v"][1], p, **k))):
        write(str(tmp_path / name), together=True)
        write(str(tmp_path / f"{name}1"))
        got = sorted((r["signal_id"] or "", r["value"]) for r in text.read_together(spark, str(tmp_path / name)).collect())
        assert got == sorted((r["signal_id"] or "", r["value"]) for r in spark.read.text(str(tmp_path / f"{name}1")).collect())
        # files are as many as tasks, not as signals
        assert len([f for f in os.listdir(tmp_path / name) if f.startswith("part-")]) <= 4
    with pytest.raises(Exception, match="tab"):
        text.write_column(df.withColumn("signal_id", text.F.lit("a\tb")), df["v"][1], str(tmp_path / "bad"), together=True)


def test_many_short_ranges_share_tasks(spark, tmp_path, monkeypatch):
    audio.register(spark)
    path = str(tmp_path / "out")
    values = {n: np.arange(k) / 1024 for n, k in (("a", 997), ("b", 400), ("c", 3), ("d", 0), ("e", 2))}
    spark.createDataFrame([(n, 100.0, [v.tolist()]) for n, v in values.items()], "signal_id string, sample_rate double, channels array<array<double>>").write.format("audio").mode("append").save(path)
    reader = lambda most, *filters: (monkeypatch.setattr(audio, "MOST_TASKS", most), audio.AudioReader({"path": path, "chunkframes": "30"}))[1]
    rows = lambda r: sorted((x[0], x[6], x[7], x[8][0]) for p in r.partitions() for x in r.read(p))
    one = rows(reader(1000))
    assert len(reader(1000).partitions()) == 51 and len(reader(6).partitions()) <= 12
    assert rows(reader(6)) == one and len(one) == 50
    for low, high in ((90, None), (0, 60), (91, 400), (2000, None), (0, -1)):
        r = reader(6)
        r.low, r.high = low, high
        assert [x for x in rows(r) if x[2] >= low and (high is None or x[2] <= high)] == [x for x in one if x[2] >= low and (high is None or x[2] <= high)]
    # the default
    monkeypatch.undo()
    huge = audio.AudioReader({"path": path, "chunkframes": "1"})
    assert len(huge.partitions()) <= audio.MOST_TASKS + 5 and sum(1 for p in huge.partitions() for _ in huge.read(p)) == 997 + 400 + 3 + 2
