"""The fluent interface and its planning: one spectrum for many features, normalisation only where it matters.

``Signals(df).normalise().blocks(2048, 1024).features("SpectralCentroid", "TimeRms")``

Normalising needs the maximum of each signal. Results that do not change with a positive factor are
computed without it; if any requested result does change, the factor is applied to the samples once,
for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators import features as feat
from ..operators import framing, music
from ..operators import pitch as pitches
from ..operators import scans, spectral

#: Pitch extractors and novelty kinds that ignore a positive factor on the signal.
SCALE_FREE_PITCH = {"SpectralAcf", "SpectralHps", "TimeAcf", "TimeAmdf", "TimeZeroCrossings"}
SCALE_FREE_NOVELTY = {"Flux", "Laroche"}


@dataclass(frozen=True)
class Signals:
    """Signals (signal_id, sample_rate, samples), perhaps to be normalised."""

    df: DataFrame
    scaled: bool = False

    def normalise(self) -> Signals:
        return replace(self, scaled=True)

    def resample(self, rate: float) -> Signals:
        return Signals(framing.resample(self._signals(True), rate))

    def blocks(self, block: int = 2048, hop: int = 1024) -> Blocks:
        framing._check(block, hop)
        return Blocks(self, block, hop)

    def novelty(self, kind: str = "Flux", block: int = 4096, hop: int = 512) -> DataFrame:
        return music.novelty(self._signals(kind not in SCALE_FREE_NOVELTY), kind, block, hop)

    def beat_histogram(self, method: str = "fft", block: int = 1024, hop: int = 8) -> DataFrame:
        return music.beat_histogram(self._signals(False), method, block, hop)

    def chords(self, block: int = 8192, hop: int = 2048, smooth: bool = True) -> DataFrame:
        return music.chords(self._signals(False), block, hop, smooth)

    def keys(self, block: int = 4096, hop: int = 2048) -> DataFrame:
        return music.keys(self._signals(False), block, hop)

    def fingerprints(self) -> DataFrame:
        return music.fingerprints(self.df)

    def gammatone(self, bands: int = 20, start: float = 100.0) -> DataFrame:
        return framing.gammatone_bands(self.df, bands, start, self.scaled)

    def framed(self, block: int, hop: int, matters: bool, previous: bool) -> DataFrame:
        return framing.blocks(self._signals(matters), block, hop, previous)

    def _signals(self, matters: bool) -> DataFrame:
        return framing.normalise(self.df) if self.scaled and matters else self.df


@dataclass(frozen=True)
class LongSignals:
    """Signals in chunks (signal_id, sample_rate, chunk_idx, samples) of ``chunk`` samples; no signal has to fit a task."""

    df: DataFrame
    chunk: int
    scaled: bool = False

    def normalise(self) -> LongSignals:
        return replace(self, scaled=True)

    def blocks(self, block: int = 2048, hop: int = 1024) -> Blocks:
        framing._check(block, hop)
        return Blocks(self, block, hop)

    def novelty(self, kind: str = "Flux", block: int = 4096, hop: int = 512) -> DataFrame:
        scaled = framing.normalise_chunks(self.df) if self.scaled and kind not in SCALE_FREE_NOVELTY else self.df
        return music.novelty_of_blocks(framing.blocks_from_chunks(scaled, block, hop, self.chunk, True), kind, block, hop)

    def beat_histogram(self, method: str = "fft", block: int = 1024, hop: int = 8, size: int = 65536) -> DataFrame:
        return music.beat_histogram_of_novelty(self.novelty("Flux", block, hop), method, hop, size)

    def filter(self, b, a, zero_phase: bool = False) -> LongSignals:
        return replace(self, df=scans.filter_chunks(self.df, (b, a), zero_phase))

    def single_pole(self, tau: float) -> LongSignals:
        return replace(self, df=scans.single_pole_chunks(self.df, tau))

    def resample(self, rate: float) -> LongSignals:
        return replace(self, df=scans.resample_chunks(self.df, rate, self.chunk))

    def gammatone(self, bands: int = 20, start: float = 100.0) -> DataFrame:
        """(signal_id, sample_rate, chunk_idx, band, samples)."""
        return scans.gammatone_chunks(framing.normalise_chunks(self.df) if self.scaled else self.df, bands, start)

    def fingerprints(self, block: int = 2048, hop: int = 64, rate: float = 5000.0) -> DataFrame:
        """Sub-fingerprints of the resampled signals; the chunk must be a multiple of the hop."""
        return music.fingerprints_of_chunks(self.df, self.chunk, block, hop, rate)

    def chords(self, block: int = 8192, hop: int = 2048) -> DataFrame:
        """(signal_id, block_idx, chord, name): smoothed over the whole signal, decoded in parts of as many blocks as a chunk has."""
        found = music.block_chords(self.framed(block, hop, False, False))
        return music.decode_chords_chunked(found, max(1, self.chunk // hop)).withColumn("name", music.chord_name("chord"))

    def keys(self, block: int = 4096, hop: int = 2048) -> DataFrame:
        return music.keys_of_blocks(self.framed(block, hop, False, False))

    def framed(self, block: int, hop: int, matters: bool, previous: bool) -> DataFrame:
        scaled = framing.normalise_chunks(self.df) if self.scaled and matters else self.df
        return framing.blocks_from_chunks(scaled, block, hop, self.chunk, previous)


@dataclass(frozen=True)
class Blocks:
    signals: Signals | LongSignals
    block: int
    hop: int
    window: object = "hann"

    def with_window(self, window) -> Blocks:
        """A named window or a sequence of weights, one per sample of a block."""
        return replace(self, window=window)

    def frame(self, matters: bool = True, previous: bool = False) -> DataFrame:
        return self.signals.framed(self.block, self.hop, matters, previous)

    def features(self, *names: str, **parameters: float) -> DataFrame:
        chosen = [feat.feature(n) for n in names]
        matters = any(not f.scale_free for f in chosen)
        return feat.features(self.frame(matters, any(f.needs == "mp" for f in chosen)), list(names), self.window, parameters)

    def pitch(self, *names: str) -> DataFrame:
        return pitches.pitch(self.frame(any(n not in SCALE_FREE_PITCH for n in names)), list(names), self.window)

    def magnitudes(self) -> DataFrame:
        return spectral.magnitudes(self.frame(), self.window)

    def spectrogram(self) -> DataFrame:
        return spectral.spectrogram(self.frame(), self.window)

    def mel_spectrogram(self, bands: int = 128, fmin: float = 100.0, fmax: float = 16000.0, log: bool = True) -> DataFrame:
        return spectral.mel_spectrogram(self.frame(), bands, fmin, fmax, log, self.window)
