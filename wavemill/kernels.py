"""Vectorised signal kernels: numpy arrays in, numpy arrays out; axis 0 runs over blocks.

These are the bodies of the Arrow operators. ``x`` is an array of blocks (n, B); ``m`` one of
magnitude spectra (n, L) with L = N/2 + 1. Nothing here knows about Spark.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Norms below this count as silence.
EPS = 1e-30


def round_half_away(v):
    return np.copysign(np.floor(np.abs(v) + 0.5), v)


def next_pow2(n: int) -> int:
    return 0 if n <= 0 else 1 << (n - 1).bit_length()


def is_pow2(n: int) -> bool:
    return n & (n - 1) == 0


# --- transforms ---------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def window(kind: str, size: int) -> np.ndarray:
    """Symmetric windows without their zero end points (denominator size + 1)."""
    i = np.arange(size)
    if kind == "hann":
        return 0.5 * (1 - np.cos(2 * np.pi * i / (size + 1)))
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * i / (size + 1))
    if kind == "sine":
        return np.sin(np.pi * i / (size + 1))
    if kind == "none":
        return np.ones(size)
    raise ValueError(f"unknown window {kind!r}; known are hann, hamming, sine, none")


def _window(w, size: int) -> np.ndarray:
    if isinstance(w, str):
        return window(w, size)
    w = np.asarray(w, dtype=float)
    if w.shape != (size,):
        raise ValueError(f"the window has {w.shape} values, the blocks {size}")
    return w


def spectrum(x: np.ndarray, w="hann", zero_pad: int = 1) -> np.ndarray:
    """Complex half spectrum with 1/N scaling."""
    n = next_pow2(x.shape[1]) * zero_pad
    return np.fft.rfft(x * _window(w, x.shape[1]), n, axis=1) / n


def inverse(spec: np.ndarray) -> np.ndarray:
    n = 2 * (spec.shape[1] - 1)
    return np.fft.irfft(spec * n, n, axis=1)


def magnitude(x: np.ndarray, w="hann", zero_pad: int = 1) -> np.ndarray:
    return np.abs(spectrum(x, w, zero_pad))


def phase(spec: np.ndarray) -> np.ndarray:
    """atan2, with pi at the two real bins."""
    out = np.angle(spec)
    out[:, [0, -1]] = np.pi
    return out


def wrapped(v: np.ndarray) -> np.ndarray:
    """Into [-pi, pi)."""
    return (v + np.pi) % (2 * np.pi) - np.pi


def instantaneous_frequency(spec: np.ndarray, before: np.ndarray, hop: int, fs: float) -> np.ndarray:
    """Per bin, from the phases of a spectrum and of the block before (zeros at the start)."""
    size = 2 * (spec.shape[1] - 1)
    omega = 2 * np.pi * hop / size * np.arange(spec.shape[1])
    now = phase(spec)
    last = np.where(np.abs(before).sum(axis=1, keepdims=True) > 0, phase(before), 0.0)
    return fs / (2 * np.pi * hop) * (omega + wrapped(now - last - omega))


def ccf(a: np.ndarray, b: np.ndarray, norm: bool = True) -> np.ndarray:
    """Linear correlation r[t] = sum a[n + t] b[n] for t = -(B-1) .. B-1."""
    size = a.shape[1]
    n = next_pow2(2 * size)
    r = np.fft.irfft(np.fft.rfft(a, n, axis=1) * np.conj(np.fft.rfft(b, n, axis=1)), n, axis=1)
    r = np.concatenate([r[:, n - size + 1 :], r[:, :size]], axis=1)
    if norm:
        scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        r = r / np.where(scale > 0, scale, 1.0)[:, None]
    return r


def acf(a: np.ndarray, norm: bool = True) -> np.ndarray:
    return ccf(a, a, norm)[:, a.shape[1] - 1 :]


# --- spectral features ---------------------------------------------------------------------------


def _bins(m):
    return np.arange(m.shape[1], dtype=float)


def _safe(num, den, ok):
    return np.where(ok, num / np.where(ok, den, 1.0), 0.0)


def _centroid_bin(m):
    s = m.sum(axis=1)
    return _safe(m @ _bins(m), s, s >= EPS)


def _spread_bin(m):
    s, c = m.sum(axis=1), _centroid_bin(m)
    var = (((_bins(m)[None, :] - c[:, None]) ** 2) * m).sum(axis=1)
    return np.where(c >= EPS, np.sqrt(_safe(var, s, s >= EPS)), 0.0)


def _hz(bins, m, fs):
    return bins * fs / (2 * (m.shape[1] - 1))


def spectral_centroid(m, fs):
    return _hz(_centroid_bin(m), m, fs)


def spectral_crest(m, fs):
    s = m.sum(axis=1)
    return _safe(m.max(axis=1), s, s >= EPS)


def spectral_decrease(m, fs):
    s = m[:, 1:].sum(axis=1)
    return _safe(((m[:, 1:] - m[:, :1]) / np.arange(1, m.shape[1])).sum(axis=1), s, s >= EPS)


def spectral_flatness(m, fs):
    ok = (m >= EPS).all(axis=1)
    return _safe(np.exp(np.log(np.where(ok[:, None], m, 1.0)).mean(axis=1)), m.mean(axis=1), ok)


def spectral_flux(m, before):
    return np.sqrt(((m - before) ** 2).sum(axis=1)) / m.shape[1]


def spectral_spread(m, fs):
    return _hz(_spread_bin(m), m, fs)


def _moment(m, order, fs):
    s, c, sd = m.sum(axis=1), _centroid_bin(m), _spread_bin(m)
    v = (((_bins(m)[None, :] - c[:, None]) ** order) * m).sum(axis=1)
    ok = (s >= EPS) & (sd >= EPS)
    return _safe(v, sd**order * s, ok), ok


def spectral_kurtosis(m, fs):
    v, ok = _moment(m, 4, fs)
    return np.where(ok, v - 3, 0.0)


def spectral_skewness(m, fs):
    return _moment(m, 3, fs)[0]


def spectral_rolloff(m, fs, kappa: float = 0.85):
    if not 0 < kappa <= 1:
        raise ValueError("kappa must be in (0, 1]")
    c = np.cumsum(m, axis=1)
    over = c > kappa * c[:, -1:]
    at = np.where(over.any(axis=1), over.argmax(axis=1), m.shape[1] - 1)
    return np.where(c[:, -1] >= EPS, _hz(at.astype(float), m, fs), 0.0)


def spectral_slope(m, fs):
    f = _bins(m) - (m.shape[1] + 1) / 2
    d = m - _centroid_bin(m)[:, None]
    return np.where(m.sum(axis=1) >= EPS, d @ f / (f @ f), 0.0)


def local_peaks(m):
    """Strict local maxima without the ends."""
    out = np.zeros(m.shape, bool)
    out[:, 1:-1] = (m[:, 1:-1] > m[:, :-2]) & (m[:, 1:-1] > m[:, 2:])
    return out


def spectral_tonal_power_ratio(m, fs, threshold: float = 5e-4):
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    e = m * m
    s = e.sum(axis=1)
    return _safe((e * (local_peaks(m) & (m > threshold))).sum(axis=1), s, s >= EPS)


@lru_cache(maxsize=32)
def mfcc_bank(bins: int, fs: float, bands: int = 40) -> np.ndarray:
    """(bands, bins) triangles: 13 linear steps from 133.3 Hz, then geometric ones."""
    # fixed values of the filter layout
    start, step, ratio, linear = 400 / 3, 200 / 3, 1.0711703, 10
    steps = linear + 3
    edge = np.concatenate([start + step * np.arange(steps), (start + step * (steps - 1)) * ratio ** np.arange(1, bands + 1)])[: bands + 2]
    size, k = 2 * (bins - 1), np.arange(bins)
    at, hz = (edge / fs * size).astype(int)[:, None], k * fs / size
    lo, mid, hi = edge[:-2, None], edge[1:-1, None], edge[2:, None]
    slope = np.where(k <= at[1:-1], (hz - lo) / (mid - lo), (hi - hz) / (hi - mid))
    return 2 / (hi - lo) * np.maximum(slope, 0) * ((k >= at[:-2]) & (k <= at[2:]))


@lru_cache(maxsize=8)
def dct_basis(coeffs: int, bands: int) -> np.ndarray:
    c, b = np.arange(coeffs)[:, None], np.arange(bands)[None, :]
    out = np.cos(c * (2 * b + 1) * np.pi / 2 / bands) / np.sqrt(bands / 2)
    out[0] /= np.sqrt(2)
    return out


def spectral_mfccs(m, fs, coeffs: int = 13):
    bank = mfcc_bank(m.shape[1], float(fs))
    return np.log10(m @ bank.T + 1e-20) @ dct_basis(coeffs, bank.shape[0]).T


@lru_cache(maxsize=32)
def chroma_bank(bins: int, fs: float, octaves: int = 4) -> np.ndarray:
    """(12, bins): equal weights within a quarter tone of each pitch of ``octaves`` octaves from C4."""
    mid, quarter, size = 440 * 2 ** ((60 - 69) / 12), 2 ** (1 / 24), 2 * (bins - 1)
    while octaves > 0 and mid * 2**octaves > fs / 2:
        octaves -= 1
    out = np.zeros((12, bins))
    for p in range(12):
        for o in range(octaves):
            f = mid * 2 ** (p / 12 + o)
            lo, hi = int(f / quarter / fs * size) + 1, int(f * quarter / fs * size)
            if hi >= lo:
                out[p, lo : hi + 1] = 1 / (hi - lo + 1)
    return out


def spectral_pitch_chroma(m, fs, octaves: int = 4):
    v = (m * m) @ chroma_bank(m.shape[1], float(fs), octaves).T
    s = v.sum(axis=1, keepdims=True)
    return np.where(s > 0, v / np.where(s > 0, s, 1), 0.0)


# --- time-domain features ------------------------------------------------------------------------


def time_acf_coeff(x, fs, lag: int = 19):
    if not 0 <= lag < x.shape[1]:
        raise ValueError("the lag must be within the block")
    return (x[:, : x.shape[1] - lag] * x[:, lag:]).sum(axis=1)


def _first(mask, default):
    return np.where(mask.any(axis=1), mask.argmax(axis=1), default)


def acf_search_start(r, fs, fmax, threshold: float = 0.35):
    """First lag to look at: beyond the main lobe, the shortest period and the first minimum (0 if there is none)."""
    last = r.shape[1] - 1
    lobe = _first(r <= threshold, last)
    falling = r[:, :-1] > r[:, 1:]
    minimum = _first(~falling, last)
    start = np.maximum(np.maximum(int(fs / fmax), lobe), minimum)
    return np.minimum(np.where(minimum >= last, 0, start), last)


def _from(r, start):
    return np.arange(r.shape[1])[None, :] >= start[:, None]


def time_max_acf(x, fs, fmax: float = 2000.0):
    if not 0 < fmax:
        raise ValueError("the frequency must be positive")
    r = acf(x)
    return np.where(_from(r, acf_search_start(r, fs, fmax)), np.abs(r), 0.0).max(axis=1)


def time_peak(x, fs):
    return x.max(axis=1)


def time_rms(x, fs):
    return np.sqrt((x * x).mean(axis=1))


def time_std(x, fs):
    return x.std(axis=1)


def time_zero_crossing_rate(x, fs):
    s = np.sign(x)
    return (np.abs(s[:, 0]) + np.abs(np.diff(s, axis=1)).sum(axis=1)) / (2 * x.shape[1])


# --- pitch ---------------------------------------------------------------------------------------


def pitch_spectral_acf(m, fs, fmin: float = 300.0):
    bins = m.shape[1]
    mirrored = np.concatenate([m[:, :0:-1], m.max(axis=1, keepdims=True), m[:, 1:-1]], axis=1)
    r = acf(mirrored)[:, : bins + 1]
    k0 = max(int(round_half_away(fmin / fs * 2 * (bins - 1))) - 1, 0)
    k = np.arange(bins)
    falls = (r[:, 1 : bins + 1] < r[:, :bins][:, : r.shape[1] - 1]) & (k[: r.shape[1] - 1] >= k0)
    low = _first(falls, bins)
    search = np.where((k[None, :] >= low[:, None]) & (k < bins - 1)[None, :], r[:, :bins], -np.inf)
    return np.where(low < bins - 2, search.argmax(axis=1) * fs / (2 * (bins - 1)), 0.0)


def pitch_spectral_hps(m, fs, fmin: float = 300.0, order: int = 4):
    top = m.shape[1] // order
    lo = min(max(int(round_half_away(fmin / fs * 2 * (m.shape[1] - 1))), 0), top)
    k = np.arange(top)
    p = np.prod([m[:, j * k] for j in range(1, order + 1)], axis=0) if top else np.zeros((len(m), 1))
    p[:, :lo] = 0
    return np.where(p.max(axis=1) > EPS, p.argmax(axis=1) * fs / (2 * (m.shape[1] - 1)), 0.0)


def _acf_pitch(r, fs, fmax):
    v = np.where(_from(r, acf_search_start(r, fs, fmax)), r, -np.inf)
    at = v.argmax(axis=1)
    return np.where((v.max(axis=1) > 0) & (at > 0), fs / np.maximum(at, 1), 0.0)


def pitch_time_acf(x, fs, fmax: float = 2000.0):
    return _acf_pitch(acf(x), fs, fmax)


def pitch_time_amdf(x, fs, fmin: float = 50.0, fmax: float = 2000.0):
    size = x.shape[1]
    lags = np.arange(int(fs / fmax), min(int(fs / fmin) + 1, size))
    if not len(lags):
        return np.zeros(len(x))
    d = np.stack([np.abs(x[:, : size - e] - x[:, e:]).sum(axis=1) for e in lags], axis=1)
    at = lags[len(lags) - 1 - d[:, ::-1].argmin(axis=1)]  # the last of equal minima
    return np.where((np.abs(x).sum(axis=1) > 0) & (at > 0), fs / np.maximum(at, 1), 0.0)


def pitch_time_zero_crossings(x, fs):
    out = np.zeros(len(x))
    change = x[:, :-1] * x[:, 1:] < 0
    for i in range(len(x)):
        at = np.flatnonzero(change[i])
        if len(at) and at[0] == 0:
            at = at[1:]
        if len(at) > 2:
            out[i] = fs * (len(at) - 1) / (2.0 * (at[-1] - at[0]))
    return out


def pitch_time_auditory(x, fs, fmax: float = 2000.0, bands: int = 20):
    """Mean of the band autocorrelations of a smoothed gammatone filterbank; blocks are independent.

    The mean (not the sum) keeps the main lobe's threshold meaningful for any number of bands.
    """
    total = np.zeros(x.shape)
    b, a = butterworth(2, 0.02)
    for fc in gammatone_centres(bands, 100.0, fs):
        total += acf(iir(b, a, gammatone(x, fc, fs)))
    return _acf_pitch(total / bands, fs, fmax)


# --- filters -------------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _state_space(b: tuple, a: tuple, chunk: int):
    """Matrices that advance a transposed direct-form filter by a whole chunk at once."""
    order = max(len(a), len(b)) - 1
    b, a = (np.pad(np.array(v, dtype=float), (0, order + 1 - len(v))) for v in (b, a))
    step = np.eye(order, k=1)
    step[:, 0] -= a[1:]
    gain = b[1:] - a[1:] * b[0]
    powers = [np.eye(order)]
    for _ in range(chunk):
        powers.append(powers[-1] @ step)
    impulse = np.array([b[0]] + [(p @ gain)[0] for p in powers[: chunk - 1]])
    lag = np.arange(chunk)[:, None] - np.arange(chunk)[None, :]
    through = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    ring = np.stack([p[0] for p in powers[:chunk]])
    load = np.stack([powers[chunk - 1 - i] @ gain for i in range(chunk)])
    return order, through, ring, load, powers[chunk]


def iir(b, a, x: np.ndarray, state: np.ndarray | None = None, with_state: bool = False, chunk: int = 64):
    """Filters the rows of x; a[0] must be 1. ``state`` (rows, order) carries over calls."""
    if not len(a) or a[0] != 1:
        raise ValueError("a[0] must be 1")
    b, a = tuple(map(float, b)), tuple(map(float, a))
    x = np.asarray(x, dtype=float)
    order = max(len(a), len(b)) - 1
    if order == 0:
        return (x * b[0], np.zeros((len(x), 0))) if with_state else x * b[0]
    s = np.zeros((len(x), order)) if state is None else np.array(state, dtype=float)
    out = np.empty_like(x)
    at = 0
    while at < x.shape[1]:
        n = min(chunk, x.shape[1] - at)
        _, through, ring, load, power = _state_space(b, a, n)
        part = x[:, at : at + n]
        out[:, at : at + n] = part @ through.T + s @ ring.T
        s = s @ power.T + part @ load
        at += n
    return (out, s) if with_state else out


def steady_state(b, a) -> np.ndarray:
    """The filter memory that a constant input of 1 settles to."""
    order = max(len(a), len(b)) - 1
    b, a = (np.pad(np.array(v, dtype=float), (0, order + 1 - len(v))) for v in (b, a))
    m = np.eye(order) - np.eye(order, k=1)
    m[:, 0] += a[1:]
    return np.linalg.solve(m, b[1:] - b[0] * a[1:])


def filtfilt(b, a, x: np.ndarray, ends: tuple[bool, bool] = (True, True)) -> np.ndarray:
    """Zero phase: forwards and backwards, with odd reflection of 3 * order samples at both ends.

    Without one of the ``ends`` the signal goes on there, and results are those of the whole signal only ``reach`` samples away.
    """
    x = np.asarray(x, dtype=float)
    pad = 3 * (max(len(a), len(b)) - 1)
    if any(ends) and pad >= x.shape[1]:
        raise ValueError(f"zero-phase filtering needs more than {pad} samples")
    zi = steady_state(b, a)
    front = 2 * x[:, :1] - x[:, pad:0:-1] if ends[0] else x[:, :0]
    back = 2 * x[:, -1:] - x[:, -2 : -2 - pad : -1] if ends[1] else x[:, :0]
    y = np.concatenate([front, x, back], axis=1)
    y = iir(b, a, y, y[:, :1] * zi)[:, front.shape[1] :]
    y = y[:, ::-1]
    return iir(b, a, y, y[:, :1] * zi)[:, back.shape[1] :][:, ::-1]


def reach(b, a, left: float = 2.0**-60) -> int:
    """Samples, a power of two of at least 64, after which no more than ``left`` of a stable filter's memory is left."""
    order = max(len(a), len(b)) - 1
    n, power = 64, iir(b, a, np.zeros((order, 64)), np.eye(order), with_state=True)[1]
    while np.abs(power).max(initial=0.0) > left:
        n, power = 2 * n, power @ power
    return n


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients by the bilinear transform; the cutoff is relative to half the sample rate."""
    if order < 1 or not 0 < cutoff < 1:
        raise ValueError("order must be positive and the cutoff in (0, 1)")
    warped = np.tan(np.pi * cutoff / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    a = np.real(np.poly((1 + poles) / (1 - poles)))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


# fixed values of the ear model
EAR_Q, MIN_BANDWIDTH = 9.26449, 24.7


def gammatone_centres(bands: int, start: float, fs: float) -> np.ndarray:
    """Centre frequencies equally spaced on the ERB scale from start up to, without, fs/2."""
    c = EAR_Q * MIN_BANDWIDTH
    k = np.arange(bands)
    return (fs / 2 + c) * np.exp((bands - k) / bands * np.log((start + c) / (fs / 2 + c))) - c


@lru_cache(maxsize=512)
def gammatone_sections(fc: float, fs: float) -> tuple[tuple[tuple, tuple], ...]:
    """Four second-order sections with unit gain at fc."""
    width = 1.019 * 2 * np.pi * (fc / EAR_Q + MIN_BANDWIDTH) / fs
    angle, decay = 2 * np.pi * fc / fs, np.exp(-width)
    a = (1.0, -2 * np.cos(angle) * decay, decay**2)
    roots = [s * np.sqrt(3 + t * 2**1.5) for t in (1, -1) for s in (1, -1)]
    z = np.exp(-1j * angle)
    response = lambda b: (b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)
    raw = [(1.0, -decay * (np.cos(angle) + r * np.sin(angle)), 0.0) for r in roots]
    gain = abs(np.prod([response(b) for b in raw]))
    raw[0] = tuple(v / gain for v in raw[0])
    return tuple((b, a) for b in raw)


def gammatone(x, fc: float, fs: float, states: list | None = None, with_state: bool = False):
    out, after = np.asarray(x, dtype=float), []
    for i, (b, a) in enumerate(gammatone_sections(float(fc), float(fs))):
        out, s = iir(b, a, out, None if states is None else states[i], with_state=True)
        after.append(s)
    return (out, after) if with_state else out


def single_pole_alpha(tau: float, fs: float) -> float:
    return float(np.exp(-2.2 / (fs * tau)))


def single_pole(x, alpha: float, state=None, with_state: bool = False):
    return iir((1 - alpha,), (1.0, -alpha), x, None if state is None else np.asarray(state) * alpha, with_state)


def moving_average_length(tau: float, fs: float) -> int:
    return 1 if tau <= 1.5 / fs else int(np.ceil(tau * fs))


def moving_average(x, size: int):
    c = np.cumsum(np.pad(x, ((0, 0), (size, 0))), axis=1)
    return (c[:, size:] - c[:, :-size]) / size


def moving_average_zero_phase(x, size: int):
    """Forwards and backwards: a triangular kernel of width 2 * size - 1, zeros outside."""
    y = moving_average(np.pad(x, ((0, 0), (0, size - 1))), size)
    return moving_average(y[:, ::-1], size)[:, ::-1][:, : x.shape[1]]


def peak_meter(x: np.ndarray, fs: float, state=0.0, attack: float = 0.01, release: float = 1.5):
    """Peak programme meter over one sample sequence, or over the rows of a matrix side by side: (values, state)."""
    up, down = single_pole_alpha(attack, fs), single_pole_alpha(release, fs)
    if x.ndim == 2 and len(x) > 8:
        v = np.abs(x).T.copy()
        s, out = np.broadcast_to(np.asarray(state, dtype=float), len(x)), np.empty_like(v)
        for i, now in enumerate(v):
            out[i] = s = np.where(s > now, down * s, (1 - up) * now + up * s)
        return out.T, s
    if x.ndim == 2:
        rows = [peak_meter(r, fs, s, attack, release) for r, s in zip(x, np.broadcast_to(state, len(x)), strict=True)]
        return np.stack([r for r, _ in rows]) if rows else x, np.array([s for _, s in rows])
    out = np.empty(len(x))
    for i, v in enumerate(np.abs(x).tolist()):
        state = down * state if state > v else (1 - up) * v + up * state
        out[i] = state
    return out, state


# --- resampling ----------------------------------------------------------------------------------


def interpolate(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation of a sequence at fractional places; fades to zero within one sample outside."""
    padded = np.concatenate([[0.0], x, [0.0]])
    pos = np.asarray(at, dtype=float) + 1
    inside = (pos >= 0) & (pos <= len(x) + 1)
    i = np.clip(np.floor(pos).astype(int), 0, len(x))
    frac = pos - i
    return np.where(inside, (1 - frac) * padded[i] + frac * padded[np.minimum(i + 1, len(x) + 1)], 0.0)


def resample_length(n: int, fs_in: float, fs_out: float) -> int:
    return int(round_half_away(n / fs_in * fs_out))


def resample(x: np.ndarray, fs_in: float, fs_out: float) -> np.ndarray:
    at = np.arange(resample_length(len(x), fs_in, fs_out)) * fs_in / fs_out
    b, a = butterworth(4, 0.9 * min(fs_in, fs_out) / max(fs_in, fs_out))
    if fs_out > fs_in:
        return filtfilt(b, a, interpolate(x, at)[None, :])[0]
    return interpolate(filtfilt(b, a, np.asarray(x, dtype=float)[None, :])[0], at)


def resample_reach(fs_in: float, fs_out: float) -> int:
    """Samples on both sides that ``resample_part`` needs."""
    return 0 if fs_in == fs_out else reach(*butterworth(4, 0.9 * min(fs_in, fs_out) / max(fs_in, fs_out))) + 2


def resample_part(x: np.ndarray, at: int, length: int, first: int, end: int, fs_in: float, fs_out: float) -> np.ndarray:
    """Values ``first`` to ``end`` (without) of ``resample`` of a signal of ``length`` samples, of which x holds those from ``at`` on:
    ``resample_reach`` more on both sides than the values lie between, or up to the signal's ends.
    """
    if fs_in == fs_out:
        return x[first - at : end - at]
    b, a = butterworth(4, 0.9 * min(fs_in, fs_out) / max(fs_in, fs_out))
    if fs_out < fs_in:
        y = filtfilt(b, a, x[None, :], (at == 0, at + len(x) == length))[0]
        return interpolate(y, np.arange(first, end) * fs_in / fs_out - at)
    n, around = resample_length(length, fs_in, fs_out), reach(b, a)
    low, high = max(0, first - around), min(n, end + around)
    y = interpolate(x, np.arange(low, high) * fs_in / fs_out - at)
    return filtfilt(b, a, y[None, :], (low == 0, high == n))[0][first - low : end - low]


# --- mel and log bands ---------------------------------------------------------------------------


def hz_to_mel(f):
    return 1000 * np.log2(1 + np.asarray(f, dtype=float) / 1000)


def mel_to_hz(m):
    return 1000 * (2 ** (np.asarray(m, dtype=float) / 1000) - 1)


def mel_edges(bands: int, fmin: float, fmax: float) -> np.ndarray:
    return mel_to_hz(np.linspace(hz_to_mel(fmin), hz_to_mel(fmax), bands + 2))


@lru_cache(maxsize=32)
def mel_bank(bins: int, fs: float, bands: int, fmin: float, fmax: float) -> np.ndarray:
    if fmin < 0 or fmax > fs / 2 or not 0 < bands <= bins:
        raise ValueError("the mel bands do not fit the spectrum")
    e, size = mel_edges(bands, fmin, fmax), 2 * (bins - 1)
    at = 1 + np.floor(e / fs * size + 1e-9).astype(int)
    hz = np.arange(bins) * fs / size
    out = np.zeros((bands, bins))
    for k in range(bands):
        lo, mid, hi = e[k : k + 3]
        up, down = slice(at[k], min(at[k + 1], bins)), slice(at[k + 1], min(at[k + 2], bins))
        out[k, up] = 2 / (hi - lo) * (hz[up] - lo) / (mid - lo)
        out[k, down] = 2 / (hi - lo) * (hi - hz[down]) / (hi - mid)
    return out


def mel_spectrogram(m, fs, bands: int = 128, fmin: float = 100.0, fmax: float = 16000.0, log: bool = True):
    v = m @ mel_bank(m.shape[1], float(fs), bands, float(fmin), float(fmax)).T
    return 20 * np.log10(v + 1e-12) if log else v


@lru_cache(maxsize=16)
def fingerprint_bank(bins: int, fs: float, bands: int = 33, lo: float = 300.0, hi: float = 2000.0) -> np.ndarray:
    """0/1 bands on a log axis. The last band stays empty: its energy is never measured."""
    e = lo * (hi / lo) ** (np.arange(bands + 1) / bands)
    at = np.floor(e / fs * 2 * (bins - 1)).astype(int)
    out = np.zeros((bands, bins))
    for p in range(bands - 1):
        out[p, at[p] + 1 : at[p + 1] + 1] = 1
    return out


def fingerprint_differences(m, fs):
    return np.diff((m * m) @ fingerprint_bank(m.shape[1], float(fs)).T, axis=1)


def fingerprint_words(diff, before):
    """32-bit words: bit b + 1 is set where the band difference rose (b up to 30)."""
    return ((diff - before)[:, :31] > 0).astype(np.int64) @ (np.int64(2) << np.arange(31, dtype=np.int64))


def fingerprint_part(x: np.ndarray, count: int, block: int, hop: int, fs: float, start: bool, w="hann", at_once: int = 256) -> np.ndarray:
    """Words of ``count`` blocks; x begins with the block before them, zeros are behind it. Each block is transformed once, ``at_once`` at a time."""
    held = np.zeros(block + count * hop)
    held[: len(x)] = x[: len(held)]
    cut = np.lib.stride_tricks.sliding_window_view(held, block)[::hop]
    diff = np.concatenate([fingerprint_differences(magnitude(cut[k : k + at_once], w), fs) for k in range(0, count + 1, at_once)])
    if start:  # silence is before the first block
        diff[0] = 0
    return fingerprint_words(diff[1:], diff[:-1])


# --- novelty, chords, keys -----------------------------------------------------------------------


def novelty_flux(m, before):
    return np.sqrt((np.maximum(m - before, 0) ** 2).sum(axis=1)) / m.shape[1]


def novelty_hainsworth(m, before):
    a, b = (np.where(v > 0, v, 1e-5) for v in (m, before))
    return np.log2(a / b).mean(axis=1)


def novelty_laroche(m, before):
    return np.maximum(np.sqrt(m) - np.sqrt(before), 0).mean(axis=1)


def chord_templates() -> np.ndarray:
    """(25, 12): twelve major triads, twelve minor triads, no chord."""
    out = np.full((25, 12), 1 / 12)
    for code in range(24):
        third = 4 if code < 12 else 3
        out[code] = 0
        out[code, [(code + d) % 12 for d in (0, third, 7)]] = 1 / 3
    return out


def chord_probabilities(chroma):
    s = chroma.sum(axis=1, keepdims=True)
    p = chroma @ chord_templates().T
    total = p.sum(axis=1, keepdims=True)
    silent = np.zeros(25)
    silent[24] = 1
    return np.where(s > 1e-20, p / np.where(total > 0, total, 1), silent)


def chord_model() -> tuple[np.ndarray, np.ndarray]:
    """(start, transition) probabilities of the 25 chords."""
    # fixed values: places on the circle of fifths, twelve major keys, then twelve minor keys
    fifths = np.array([0, -5, 2, -3, 4, -1, 6, 1, -4, 3, -2, 5, -3, 4, -1, 6, 1, -4, 3, -2, 5, 0, -5, 2])
    turn = 2 * np.pi * fifths / 12
    place = np.stack([np.cos(turn), np.sin(turn), np.repeat([0.5, 0.0], 12)], axis=1)
    d = 0.1 + np.sqrt(((place[:, None, :] - place[None, :, :]) ** 2).sum(axis=2))
    move = np.full((25, 25), 1 / 25)
    move[:24, :24] = 1 - d / (0.1 + d.max())
    start = np.full(25, 1 / 26)
    start[24] *= 2
    return start, move / move.sum(axis=1, keepdims=True)


def key_profiles() -> np.ndarray:
    """(25, 12): major keys, minor keys, no key; each sums to one."""
    # fixed values: Krumhansl's probe tone ratings
    major = np.array([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88])
    minor = np.array([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17])
    rows = [np.roll(base / base.sum(), tonic) for base in (major, minor) for tonic in range(12)]
    return np.stack([*rows, np.full(12, 1 / 12)])


def key_of(chroma):
    """Code of the nearest key profile (Manhattan); silence is no key (24)."""
    s = chroma.sum(axis=1, keepdims=True)
    c = chroma / np.where(s > 0, s, 1)
    d = np.abs(c[:, None, :] - key_profiles()[None, :, :]).sum(axis=2)
    # profiles that are equally near but for rounding: the first one
    return np.where(s[:, 0] > 0, np.round(d, 12).argmin(axis=1), 24)


# --- sequences -----------------------------------------------------------------------------------


def viterbi(emission: np.ndarray, start: np.ndarray, move: np.ndarray, log: bool = True) -> tuple[np.ndarray, float]:
    """Most likely state sequence of (states, observations) emissions, and its probability (log in log mode)."""
    if log:
        emission, start, move = (np.log(v + 1e-30) for v in (emission, start, move))
    join = np.add if log else np.multiply
    p = join(start, emission[:, 0])
    back = np.zeros(emission.shape, int)
    for n in range(1, emission.shape[1]):
        q = join(p[:, None], move)
        back[:, n] = q.argmax(axis=0)
        p = join(q.max(axis=0), emission[:, n])
    path = [int(p.argmax())]
    for n in range(emission.shape[1] - 1, 0, -1):
        path.append(int(back[path[-1], n]))
    return np.array(path[::-1]), float(p.max())


def dtw(d: np.ndarray) -> tuple[np.ndarray, float]:
    """Cheapest corner-to-corner path (n, 2) and its cost; ties go to the diagonal, then along the row."""
    rows, cols = d.shape
    came = np.zeros((rows, cols), np.int8)
    # cells of one anti-diagonal depend on the two before only; index i + 1, the ends are outside
    older, last = (np.full(rows + 1, np.inf) for _ in range(2))
    for n in range(rows + cols - 1):
        i = np.arange(max(0, n - cols + 1), min(rows, n + 1))
        diag, horiz, vert = older[i], last[i + 1], last[i]
        step = np.where((diag <= horiz) & (diag <= vert), 0, np.where(horiz <= vert, 1, 2))
        came[i, n - i] = step
        now = np.full(rows + 1, np.inf)
        now[i + 1] = d[i, n - i] + (np.choose(step, (diag, horiz, vert)) if n else 0.0)
        older, last = last, now
    total = float(last[rows])
    i, j, path = rows - 1, cols - 1, [(rows - 1, cols - 1)]
    while i or j:
        step = came[i, j]
        i, j = i - int(step != 1), j - int(step != 2)
        path.append((i, j))
    return np.array(path[::-1]), total


# --- beat histogram ------------------------------------------------------------------------------


def beat_range(method: str, size: int, rate: float) -> tuple[int, int]:
    """First and last bin between 30 and 200 BPM; ``rate`` is novelty values per second."""
    if method == "fft":
        return int(30 / 60 / rate * 2 * size), int(200 / 60 / rate * 2 * size) + 1
    return size - int(60 * rate / 30), size - int(60 * rate / 200)


def beat_axis(method: str, size: int, rate: float) -> np.ndarray:
    lo, hi = beat_range(method, size, rate)
    k = np.arange(lo, hi + 1)
    return 60 * k * rate / (2 * size) if method == "fft" else 60 * rate / (size - k)


def beat_histogram(curve: np.ndarray, rate: float, method: str = "fft", size: int = 65536) -> np.ndarray:
    """Sum over blocks of a novelty curve, cut to 30-200 BPM and scaled to a maximum of one."""
    hop, total = size // 4, 0.0
    for n in range(len(curve) // hop + 1):
        part = curve[n * hop : n * hop + size]
        part = np.pad(part, (0, size - len(part)))[None, :]
        total = total + (magnitude(part, "hann", 2)[0][:size] if method == "fft" else acf(part)[0][::-1])
    lo, hi = beat_range(method, size, rate)
    out = total[max(lo, 0) : hi + 1]
    most = np.abs(out).max(initial=0)
    return out / most if most > 0 else out
