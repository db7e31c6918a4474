"""Fundamental frequency per block; 0 where none is found."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import kernels as K
from ..functions.arrow import map_arrays
from .spectral import _keys

#: name -> (kernel, reads a spectrum)
PITCH = {
    "SpectralAcf": (K.pitch_spectral_acf, True),
    "SpectralHps": (K.pitch_spectral_hps, True),
    "TimeAcf": (K.pitch_time_acf, False),
    "TimeAmdf": (K.pitch_time_amdf, False),
    "TimeAuditory": (K.pitch_time_auditory, False),
    "TimeZeroCrossings": (K.pitch_time_zero_crossings, False),
}


def pitch(blocks: DataFrame, names: list[str], window="hann", keep: list[str] | None = None) -> DataFrame:
    """One column of Hz per extractor name; extractors share the spectrum."""
    for n in names:
        if n not in PITCH:
            raise ValueError(f"unknown pitch extractor {n!r}; known are {', '.join(PITCH)}")

    def fn(v, fs):
        m = K.magnitude(v["x"], window) if any(PITCH[n][1] for n in names) else None
        return {n: PITCH[n][0](m if PITCH[n][1] else v["x"], fs) for n in names}

    return map_arrays(blocks, ["x"], {n: "double" for n in names}, fn, keep or _keys(blocks))
