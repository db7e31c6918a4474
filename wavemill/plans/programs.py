"""One function per command-line program of this kind of toolkit: audio files in, text files out.

Each reads audio through the source, computes, and writes one folder per signal. ``options`` go to the
reader (raw files need fileFormat, sampleRate, nChannels, bitStream). Programs that work block by block take
``chunk``: files of any length are then read and cut in chunks of that many frames, over many tasks (the
folder must be mounted on all machines); without it a file is read as one row by Spark's file readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import music
from ..sources import audio, text
from .planner import LongSignals, Signals


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("signal_id", F.element_at(F.split("signal_id", "/"), -1))


def signals(spark: SparkSession, path: str, chunk: int | None = None, **options) -> Signals | LongSignals:
    """Mono signals of audio files, whole or in chunks; their names are the file names without folders."""
    if chunk:
        return LongSignals(_named(audio.read_chunks(spark, path, chunk, **options)), chunk)
    return Signals(_named(audio.mono(audio.read_files(spark, path, **options))).select("signal_id", "sample_rate", "samples"))


def compute_feature(spark: SparkSession, path: str, out: str, name: str = "SpectralCentroid", block: int = 4096, hop: int = 2048, chunk: int | None = None, **options) -> DataFrame:
    df = signals(spark, path, chunk, **options).normalise().blocks(block, hop).features(name)
    values = F.col(name) if dict(df.dtypes)[name].startswith("array") else F.array(name)
    text.write_matrix(df.withColumn("v", values), "v", out)
    return df


def compute_pitch(spark: SparkSession, path: str, out: str, name: str = "SpectralAcf", block: int = 4096, hop: int = 512, chunk: int | None = None, **options) -> DataFrame:
    df = signals(spark, path, chunk, **options).normalise().blocks(block, hop).pitch(name)
    text.write_series(df, name, out)
    return df


def compute_novelty(spark: SparkSession, path: str, out: str, name: str = "Flux", block: int = 4096, hop: int = 512, chunk: int | None = None, **options) -> DataFrame:
    df = signals(spark, path, chunk, **options).normalise().novelty(name, block, hop)
    text.write_series(df, "novelty", out)
    return df


def compute_spectrogram(spark: SparkSession, path: str, out: str, block: int = 4096, hop: int = 2048, chunk: int | None = None, **options) -> DataFrame:
    df = signals(spark, path, chunk, **options).normalise().blocks(block, hop).spectrogram()
    text.write_matrix(df, "mag", out)
    return df


def compute_mel_spectrogram(spark: SparkSession, path: str, out: str, block: int = 4096, hop: int = 2048, bands: int = 128, fmin: float = 100.0, fmax: float = 16000.0, chunk: int | None = None, **options) -> DataFrame:
    df = signals(spark, path, chunk, **options).normalise().blocks(block, hop).mel_spectrogram(bands, fmin, fmax)
    text.write_matrix(df, "mel", out)
    return df


def compute_beat_histogram(spark: SparkSession, path: str, out: str, block: int = 1024, hop: int = 8, **options) -> DataFrame:
    df = signals(spark, path, **options).beat_histogram("fft", block, hop)
    text.write_column(df, F.col("value"), out, "bin")
    return df


def compute_chords(spark: SparkSession, path: str, out: str, block: int = 8192, hop: int = 2048, **options) -> DataFrame:
    s = signals(spark, path, **options)
    rates = s.df.select("signal_id", "sample_rate")
    df = s.chords(block, hop).join(rates, "signal_id").withColumn("t_s", (F.lit(block / 2) + F.col("block_idx") * hop) / F.col("sample_rate"))
    text.write_series(df, "name", out)
    return df


def compute_key(spark: SparkSession, path: str, out: str | None = None, block: int = 4096, hop: int = 2048, **options) -> DataFrame:
    df = signals(spark, path, **options).keys(block, hop)
    if out:
        text.write_column(df, F.col("name"), out, "key")
    return df


def compute_fingerprint(spark: SparkSession, path: str, out: str | None = None, **options) -> DataFrame:
    df = music.fingerprints(signals(spark, path, **options).df)
    if out:
        text.write_column(df, text.hex_word(), out)
    return df
