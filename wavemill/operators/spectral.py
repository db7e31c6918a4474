"""Spectra, correlation and instantaneous frequency of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.arrow import map_arrays

KEYS = ["signal_id", "block_idx", "t_s", "sample_rate"]


def _keys(blocks: DataFrame) -> list[str]:
    return [c for c in KEYS if c in blocks.columns]


def magnitudes(blocks: DataFrame, window="hann", zero_pad: int = 1, factor: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """``mag``: |rfft(x * window)| / N, times ``factor``; N is the next power of two of the block length."""
    return map_arrays(blocks, ["x"], {"mag": "array<double>"}, lambda v, fs: {"mag": factor * K.magnitude(v["x"], window, zero_pad)}, keep or _keys(blocks))


def spectra(blocks: DataFrame, window="hann", zero_pad: int = 1, keep: list[str] | None = None) -> DataFrame:
    """``re`` and ``im`` of the half spectrum, ``mag`` and ``phase`` (pi at the two real bins)."""

    def fn(v, fs):
        s = K.spectrum(v["x"], window, zero_pad)
        return {"re": s.real, "im": s.imag, "mag": np.abs(s), "phase": K.phase(s)}

    return map_arrays(blocks, ["x"], {n: "array<double>" for n in ("re", "im", "mag", "phase")}, fn, keep or _keys(blocks))


def inverse(spectra: DataFrame, window=None, keep: list[str] | None = None) -> DataFrame:
    """Back to samples ``x``, with an optional window after the transform."""

    def fn(v, fs):
        x = K.inverse(v["re"] + 1j * v["im"])
        return {"x": x if window is None else x * K._window(window, x.shape[1])}

    return map_arrays(spectra, ["re", "im"], {"x": "array<double>"}, fn, keep or _keys(spectra))


def conjugate(im: str = "im") -> Column:
    return F.transform(im, lambda v: -v)


def product(re1: str, im1: str, re2: str, im2: str) -> tuple[Column, Column]:
    """Real and imaginary part of the element-wise product of two complex arrays."""
    mul = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    return F.zip_with(mul(re1, re2), mul(im1, im2), lambda x, y: x - y), F.zip_with(mul(re1, im2), mul(im1, re2), lambda x, y: x + y)


def instantaneous_frequency(blocks: DataFrame, hop: int, window="hann") -> DataFrame:
    """``inst_hz`` per bin; the blocks carry the block before as ``xp``."""

    def fn(v, fs):
        return {"inst_hz": K.instantaneous_frequency(K.spectrum(v["x"], window), K.spectrum(v["xp"], window), hop, fs)}

    return map_arrays(blocks, ["x", "xp"], {"inst_hz": "array<double>"}, fn, _keys(blocks))


def autocorrelation(blocks: DataFrame, normalised: bool = True, keep: list[str] | None = None) -> DataFrame:
    return map_arrays(blocks, ["x"], {"acf": "array<double>"}, lambda v, fs: {"acf": K.acf(v["x"], normalised)}, keep or _keys(blocks))


def crosscorrelation(pairs: DataFrame, a: str, b: str, keep: list[str], normalised: bool = True) -> DataFrame:
    """``ccf`` for lags -(B-1) .. B-1, with ``ccf_max`` and ``ccf_max_idx`` (first maximum)."""

    def fn(v, fs):
        r = K.ccf(v[a], v[b], normalised)
        return {"ccf": r, "ccf_max": r.max(axis=1), "ccf_max_idx": r.argmax(axis=1)}

    return map_arrays(pairs, [a, b], {"ccf": "array<double>", "ccf_max": "double", "ccf_max_idx": "int"}, fn, keep)


def mel_spectrogram(blocks: DataFrame, bands: int = 128, fmin: float = 100.0, fmax: float = 16000.0, log: bool = True, window="hann", keep: list[str] | None = None) -> DataFrame:
    """``mel``: area-normalised mel bands of twice the magnitudes, in dB unless ``log`` is off."""
    return map_arrays(blocks, ["x"], {"mel": "array<double>"}, lambda v, fs: {"mel": K.mel_spectrogram(2 * K.magnitude(v["x"], window), fs, bands, fmin, fmax, log)}, keep or _keys(blocks))


def spectrogram(blocks: DataFrame, window="hann", keep: list[str] | None = None) -> DataFrame:
    """``mag``: magnitudes times two; blocks must have a power-of-two length."""

    def fn(v, fs):
        if not K.is_pow2(v["x"].shape[1]):
            raise ValueError("the spectrogram needs blocks of a power of two")
        return {"mag": 2 * K.magnitude(v["x"], window)}

    return map_arrays(blocks, ["x"], {"mag": "array<double>"}, fn, keep or _keys(blocks))


def frequency_axis(bins: int, fs: float) -> list[float]:
    return [k * fs / (2 * (bins - 1)) for k in range(bins)]


def mel_axis(bands: int = 128, fmin: float = 100.0, fmax: float = 16000.0) -> list[float]:
    """Centre frequencies."""
    return K.mel_edges(bands, fmin, fmax)[1:-1].tolist()
