"""The 19 block features and their registry.

All features that are asked for together share one pass: the block crosses to Python once, is
transformed once, and only the results come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import kernels as K
from ..functions.arrow import map_arrays
from .spectral import _keys


@dataclass(frozen=True)
class Feature:
    fn: Callable
    #: what it reads: "m" magnitudes, "mp" magnitudes and those before, "x" samples
    needs: str
    #: unchanged by a positive factor on the signal
    scale_free: bool = False
    many: bool = False
    parameter: str | None = None


FEATURES: dict[str, Feature] = {
    "SpectralCentroid": Feature(K.spectral_centroid, "m", True),
    "SpectralCrestFactor": Feature(K.spectral_crest, "m", True),
    "SpectralDecrease": Feature(K.spectral_decrease, "m", True),
    "SpectralFlatness": Feature(K.spectral_flatness, "m", True),
    "SpectralFlux": Feature(K.spectral_flux, "mp"),
    "SpectralKurtosis": Feature(K.spectral_kurtosis, "m", True),
    "SpectralMfccs": Feature(K.spectral_mfccs, "m", many=True, parameter="coeffs"),
    "SpectralPitchChroma": Feature(K.spectral_pitch_chroma, "m", True, True, "octaves"),
    "SpectralRolloff": Feature(K.spectral_rolloff, "m", True, parameter="kappa"),
    "SpectralSkewness": Feature(K.spectral_skewness, "m", True),
    "SpectralSlope": Feature(K.spectral_slope, "m"),
    "SpectralSpread": Feature(K.spectral_spread, "m", True),
    "SpectralTonalPowerRatio": Feature(K.spectral_tonal_power_ratio, "m", parameter="threshold"),
    "TimeAcfCoeff": Feature(K.time_acf_coeff, "x", parameter="lag"),
    "TimeMaxAcf": Feature(K.time_max_acf, "x", True, parameter="fmax"),
    "TimePeakEnvelope": Feature(K.time_peak, "x"),
    "TimeRms": Feature(K.time_rms, "x"),
    "TimeStd": Feature(K.time_std, "x"),
    "TimeZeroCrossingRate": Feature(K.time_zero_crossing_rate, "x", True),
}


def feature(name: str) -> Feature:
    if name not in FEATURES:
        raise ValueError(f"unknown feature {name!r}; known are {', '.join(FEATURES)}")
    return FEATURES[name]


def features(blocks: DataFrame, names: list[str], window="hann", parameters: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One column per feature name (array<double> for MFCCs and chroma). SpectralFlux needs blocks with ``xp``."""
    chosen = {n: feature(n) for n in names}
    kw = {n: {f.parameter: (parameters or {})[n]} if f.parameter and n in (parameters or {}) else {} for n, f in chosen.items()}

    def fn(v, fs):
        m = K.magnitude(v["x"], window) if any(f.needs != "x" for f in chosen.values()) else None
        before = K.magnitude(v["xp"], window) if "xp" in v else None
        inputs = {"m": (m, fs), "mp": (m, before), "x": (v["x"], fs)}
        return {n: f.fn(*inputs[f.needs], **kw[n]) for n, f in chosen.items()}

    arrays = ["x", "xp"] if any(f.needs == "mp" for f in chosen.values()) else ["x"]
    return map_arrays(blocks, arrays, {n: "array<double>" if f.many else "double" for n, f in chosen.items()}, fn, keep or _keys(blocks))


#: Samples, overlapping ones counted each time, that meters run over at once.
METER_SAMPLES = 1 << 22


def envelopes(signals: DataFrame, block: int = 2048, hop: int = 1024, rms_tau: float = 0.3) -> DataFrame:
    """(signal_id, block_idx, peak, ppm, rms, rms_lp): block values and those of meters whose state runs on over the blocks.

    Signals of equal length and rate run through the meters side by side. Null signals have no blocks; null samples are 0.
    """

    def some(ids: list, x: np.ndarray, fs: float, kind: pa.DataType) -> pa.RecordBatch:
        n = x.shape[1] // hop + 1
        x = np.pad(x, ((0, 0), (0, block)))
        b = np.stack([x[:, k * hop : k * hop + block] for k in range(n)], axis=1)
        # overlapping blocks pass through the meters one after the other
        run = b.reshape(len(x), -1)
        ppm, _ = K.peak_meter(run, fs)
        low = K.single_pole(run**2, K.single_pole_alpha(rms_tau, fs))
        most = lambda v: v.reshape(len(x), n, block).max(axis=2).ravel()
        cols = {"block_idx": np.tile(np.arange(n), len(x)), "peak": most(b), "ppm": most(ppm), "rms": K.time_rms(b.reshape(-1, block), fs), "rms_lp": np.sqrt(np.maximum(most(low), 0))}
        return pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in range(n)], kind), *map(pa.array, cols.values())], names=["signal_id", *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, float], list[int]] = {}
            for row, (s, fs) in enumerate(zip(batch.column("samples"), batch.column("sample_rate").to_pylist(), strict=True)):
                if s.is_valid and fs is not None:
                    groups.setdefault((len(s), fs), []).append(row)
            for (size, fs), rows in groups.items():
                step = max(1, METER_SAMPLES // ((size // hop + 1) * block))
                for at in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[at : at + step]))
                    x = part.column("samples").flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(part.num_rows, size)
                    yield some(part.column("signal_id").to_pylist(), x, fs, batch.schema.field("signal_id").type)

    source = signals.select("signal_id", "sample_rate", "samples")
    return source.mapInArrow(run, f"signal_id {dict(source.dtypes)['signal_id']}, block_idx long, peak double, ppm double, rms double, rms_lp double")
