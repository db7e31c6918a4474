"""Sequence-level music operators: novelty and onsets, beat histograms, chords, keys, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.arrow import map_arrays
from . import curves
from .framing import _check, resample, time_stamp
from .framing import blocks as frame
from .matching import met_words, run_starts
from .scans import _numbers, bordered, resample_pieces, viterbi_chunks
from .spectral import _keys

NOVELTY = {"Flux": K.novelty_flux, "Hainsworth": K.novelty_hainsworth, "Laroche": K.novelty_laroche}
_NOTES = ["C", "C#/Db", "D", "D#/Eb", "E", "F", "F#/Gb", "G", "G#/Ab", "A", "A#/Bb", "B"]


def novelty_values(blocks: DataFrame, kind: str = "Flux", window="hann", keep: list[str] | None = None) -> DataFrame:
    """``value``: the raw novelty of each block against the block before (``xp``), on twice the magnitudes."""
    if kind not in NOVELTY:
        raise ValueError(f"unknown novelty {kind!r}; known are {', '.join(NOVELTY)}")
    fn = lambda v, fs: {"value": NOVELTY[kind](2 * K.magnitude(v["x"], window), 2 * K.magnitude(v["xp"], window))}
    return map_arrays(blocks, ["x", "xp"], {"value": "double"}, fn, keep or _keys(blocks))


def onsets_from_values(values: DataFrame, rate: float) -> DataFrame:
    """``novelty`` (scaled, smoothed over 0.07 s, rectified), ``threshold`` excess and ``onset`` of raw values; ``rate`` is blocks per second."""
    return curves.onsets(values.withColumn("rate", F.lit(float(rate))), "rate").drop("rate")


def novelty_of_blocks(blocks: DataFrame, kind: str, block: int, hop: int) -> DataFrame:
    """(signal_id, sample_rate, block_idx, t_s, value, novelty, excess, onset) of blocks with the block before (``xp``)."""
    values = novelty_values(blocks, kind, keep=["signal_id", "sample_rate", "block_idx"])
    return curves.onsets(values, "sample_rate", hop).withColumn("t_s", time_stamp("block_idx", block, hop, "sample_rate"))


def novelty(signals: DataFrame, kind: str = "Flux", block: int = 4096, hop: int = 512, rate: float | None = None) -> DataFrame:
    """Novelty curve and onsets of signals; ``rate`` is the sample rate of all of them (each signal's own if not given)."""
    rated = signals if rate is None else signals.withColumn("sample_rate", F.lit(float(rate)))
    return novelty_of_blocks(frame(rated, block, hop, previous=True), kind, block, hop)


def peaks(df: DataFrame, value: str, threshold: float = 0.0, key: str = "signal_id", order: str = "block_idx") -> DataFrame:
    """``peak``: strict local maximum above the threshold, ends excluded."""
    w = Window.partitionBy(key).orderBy(order)
    is_peak = (F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)) & (F.col(value) > threshold)
    return df.withColumn("peak", F.coalesce(is_peak, F.lit(False)))


def beat_histogram_from_curve(curves: DataFrame, method: str = "fft", size: int = 65536) -> DataFrame:
    """(signal_id, bin, bpm, value) from (signal_id, rate, curve ARRAY): blocks of the curve, summed, 30 to 200 BPM."""
    if method not in ("fft", "acf"):
        raise ValueError("the method is fft or acf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rate, curve in zip(batch.column("signal_id").to_pylist(), batch.column("rate").to_pylist(), batch.column("curve"), strict=True):
                v = K.beat_histogram(np.asarray(curve.as_py(), dtype=float), rate, method, size)
                skipped = max(0, -K.beat_range(method, size, rate)[0])  # bins below the first one
                bpm = K.beat_axis(method, size, rate)[skipped : skipped + len(v)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(v), batch.schema.field("signal_id").type), pa.array(np.arange(len(v))), pa.array(bpm), pa.array(v)], names=["signal_id", "bin", "bpm", "value"])

    source = curves.select("signal_id", F.col("rate").cast("double").alias("rate"), "curve")
    return source.mapInArrow(run, f"signal_id {dict(source.dtypes)['signal_id']}, bin long, bpm double, value double")


def beat_histogram(signals: DataFrame, method: str = "fft", block: int = 1024, hop: int = 8, size: int = 65536, rate: float | None = None) -> DataFrame:
    """Beat histogram of each signal from its novelty curve, in segments of the curve."""
    return beat_histogram_of_novelty(novelty(signals, "Flux", block, hop, rate), method, hop, size)


def beat_histogram_of_novelty(found: DataFrame, method: str, hop: int, size: int = 65536) -> DataFrame:
    """Of (signal_id, sample_rate, block_idx, novelty), one value every ``hop`` samples."""
    return curves.beat_histogram(found.drop("value").withColumnRenamed("novelty", "value"), "sample_rate", method, size, hop)


# --- chords --------------------------------------------------------------------------------------


def chord_name(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    names = ["/".join(f"{n} {mode}" for n in note.split("/")) for mode in ("Major", "Minor") for note in _NOTES] + ["No Chord"]
    return F.element_at(F.array(*map(F.lit, names)), code.cast("int") + 1)


def chord_code(name: str) -> int:
    """Code of a chord name; either spelling of a black key."""
    for code in range(24):
        mode = "Major" if code < 12 else "Minor"
        if name in (f"{n} {mode}" for n in _NOTES[code % 12].split("/")) or name == "/".join(f"{n} {mode}" for n in _NOTES[code % 12].split("/")):
            return code
    if name in ("No Chord", "NoChord"):
        return 24
    raise ValueError(f"unknown chord {name!r}")


def chord_probabilities(chroma: DataFrame, keep: list[str]) -> DataFrame:
    """``prob``: 25 chord probabilities of ``chroma`` arrays."""
    return map_arrays(chroma, ["chroma"], {"prob": "array<double>", "chord": "int"}, lambda v, fs: {"prob": (p := K.chord_probabilities(v["chroma"])), "chord": p.argmax(axis=1)}, keep)


def block_chords(blocks: DataFrame, octaves: int = 4) -> DataFrame:
    def fn(v, fs):
        p = K.chord_probabilities(K.spectral_pitch_chroma(K.magnitude(v["x"]), fs, octaves))
        return {"prob": p, "chord": p.argmax(axis=1)}

    return map_arrays(blocks, ["x"], {"prob": "array<double>", "chord": "int"}, fn, _keys(blocks))


def decode_chords(probabilities: DataFrame) -> DataFrame:
    """(signal_id, block_idx, chord) by Viterbi over each signal's chord probabilities."""
    start, move = K.chord_model()
    return viterbi(probabilities.select("signal_id", "block_idx", F.col("prob").alias("emission")), start, move).withColumnRenamed("state", "chord")


def decode_chords_chunked(probabilities: DataFrame, blocks: int = 1024) -> DataFrame:
    """``decode_chords`` over parts of ``blocks`` blocks, so that a sequence is spread over tasks."""
    parts = probabilities.groupBy("signal_id", F.expr(f"block_idx div {blocks}").alias("chunk_idx")).agg(F.array_sort(F.collect_list(F.struct("block_idx", "prob"))).alias("v"))
    parts = parts.select("signal_id", "chunk_idx", (F.col("chunk_idx") * blocks).alias("first"), F.transform("v", lambda s: s["prob"]).alias("emissions"))
    return viterbi_chunks(parts, *K.chord_model()).withColumnRenamed("state", "chord")


def chords(signals: DataFrame, block: int = 8192, hop: int = 2048, smooth: bool = True) -> DataFrame:
    found = block_chords(frame(signals, block, hop))
    return (decode_chords(found) if smooth else found.select("signal_id", "block_idx", "chord")).withColumn("name", chord_name(F.col("chord")))


def viterbi(sequences: DataFrame, start, move, log: bool = True) -> DataFrame:
    """(signal_id, block_idx, state, probability): most likely states of (signal_id, block_idx, emission ARRAY).

    A sequence is decoded in one task; its emissions must fit in that task's memory.
    """
    start, move = np.asarray(start, dtype=float), np.asarray(move, dtype=float)
    kind = dict(sequences.dtypes)["signal_id"]

    def decode(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_idx")
        e = np.array(table.column("emission").to_pylist(), dtype=float).T
        path, p = K.viterbi(e, start, move, log)
        return pa.table({"signal_id": table.column("signal_id"), "block_idx": table.column("block_idx"), "state": pa.array(path, pa.int32()), "probability": pa.array([p] * len(path))})

    source = sequences.select("signal_id", F.col("block_idx").cast("long").alias("block_idx"), "emission")
    return source.groupBy("signal_id").applyInArrow(decode, f"signal_id {kind}, block_idx long, state int, probability double")


# --- keys ----------------------------------------------------------------------------------------


def key_name(code: Column) -> Column:
    return F.when(code == 24, F.lit("No Chord")).otherwise(chord_name(code))


def keys_from_chroma(chroma: DataFrame, keep: list[str]) -> DataFrame:
    """``key``: nearest profile of ``chroma`` arrays (12 values)."""
    return map_arrays(chroma, ["chroma"], {"key": "int"}, lambda v, fs: {"key": K.key_of(v["chroma"])}, keep)


def keys(signals: DataFrame, block: int = 4096, hop: int = 2048) -> DataFrame:
    return keys_of_blocks(frame(signals, block, hop))


def keys_of_blocks(blocks: DataFrame) -> DataFrame:
    """(signal_id, key, name): the mean chroma over all blocks of a signal, summed with partial aggregation."""
    per = map_arrays(blocks, ["x"], {"chroma": "array<double>"}, lambda v, fs: {"chroma": K.spectral_pitch_chroma(K.magnitude(v["x"]), fs)}, ["signal_id", "sample_rate"])
    mean = per.groupBy("signal_id", "sample_rate").agg(F.array(*[F.avg(F.get("chroma", F.lit(p))) for p in range(12)]).alias("chroma"))
    return keys_from_chroma(mean, ["signal_id"]).withColumn("name", key_name(F.col("key")))


# --- fingerprints --------------------------------------------------------------------------------


def fingerprint_blocks(blocks: DataFrame, window="hann", keep: list[str] | None = None) -> DataFrame:
    """``word``: 32-bit sub-fingerprint against the block before (``xp``)."""

    def fn(v, fs):
        now, before = (K.fingerprint_differences(K.magnitude(v[n], window), fs) for n in ("x", "xp"))
        return {"word": K.fingerprint_words(now, before)}

    return map_arrays(blocks, ["x", "xp"], {"word": "bigint"}, fn, keep or _keys(blocks))


def fingerprints(signals: DataFrame, block: int = 2048, hop: int = 64, rate: float = 5000.0) -> DataFrame:
    """Sub-fingerprints of signals resampled to 5 kHz, without normalisation."""
    return fingerprint_blocks(frame(resample(signals, rate), block, hop, previous=True))


def fingerprints_of_chunks(chunks: DataFrame, chunk: int, block: int = 2048, hop: int = 64, rate: float = 5000.0) -> DataFrame:
    """``fingerprints`` of signals in chunks; no signal is gathered, and blocks are cut in the task that transforms them."""
    _check(block, hop)
    if chunk % hop:
        raise ValueError("the chunk length must be a multiple of the hop")
    parts = bordered(resample_pieces(chunks, rate, chunk), chunk, hop, block - hop, ("length",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select(["length", "chunk_idx", "at"]).to_pylist()):
                first = r["chunk_idx"] * (chunk // hop)
                count = min(chunk // hop, r["length"] // hop + 1 - first)
                if count <= 0:
                    continue
                lead = np.zeros(r["at"] - (first - 1) * hop)
                words = K.fingerprint_part(np.concatenate([lead, _numbers(batch.column("samples"), i)]), count, block, hop, rate, first == 0)
                keys = [batch.column(c).take(pa.array([i] * count)) for c in ("signal_id", "sample_rate")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(first, first + count)), pa.array(words, pa.int64())], names=["signal_id", "sample_rate", "block_idx", "word"])

    source = parts.select("signal_id", "sample_rate", "length", "chunk_idx", "at", "samples")
    found = source.mapInArrow(run, f"signal_id {dict(source.dtypes)['signal_id']}, sample_rate double, block_idx long, word long")
    return found.select("signal_id", "sample_rate", "block_idx", time_stamp("block_idx", block, hop, "sample_rate").alias("t_s"), "word")


def match_fingerprints(queries: DataFrame, corpus: DataFrame, most_bits: int = 8, least_hits: int = 1) -> DataFrame:
    """(query_id, signal_id, offset, words, bits): words compared at the offsets at which at least ``least_hits`` words are equal.

    Words that both sides hold are counted per signal first; for each pair of signals only offsets that
    reach the threshold are compared word by word. Steady sounds repeat a word: of each run of equal
    words in a signal only the first place is looked up, so a hot word does not meet itself at all
    places. Words are compared at all places afterwards.

    The sides are read several times, so they should not be long computations; places of a signal are unique.
    """
    q = queries.select("signal_id", "block_idx", "word")
    c = corpus.select("signal_id", "block_idx", "word")
    starts = lambda df: run_starts(df).where("word <> 0")
    keys = starts(q).select(F.col("signal_id").alias("query_id"), F.col("block_idx").alias("qi"), "word")
    hits = keys.join(starts(c), "word").groupBy("query_id", "signal_id", (F.col("block_idx") - F.col("qi")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    offsets = hits.where(F.col("hits") >= least_hits).drop("hits")
    return met_words(offsets, q, c).where(F.col("bits") <= most_bits)
