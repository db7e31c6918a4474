"""Analytic results of the kernels on synthetic signals."""

import numpy as np
import pytest

from wavemill import kernels as K


def one(m):
    return np.asarray(m, dtype=float)[None, :]


def impulse(n, at, v=1.0):
    x = np.zeros(n)
    x[at] = v
    return one(x)


def test_fft_scaling_and_round_trip():
    x = one(np.sin(2 * np.pi * 8 * np.arange(128) / 128))
    assert K.magnitude(x, "none")[0, 8] == pytest.approx(0.5)
    assert np.allclose(K.inverse(K.spectrum(x, "none")), x)
    assert K.phase(K.spectrum(x, "none"))[0, 8] == pytest.approx(-np.pi / 2)
    assert K.magnitude(one(np.ones(128)), "hann", 8)[0, 0] == pytest.approx(64.5 / 1024, rel=1e-4)
    with pytest.raises(ValueError):
        K.window("flat", 8)


def test_correlation():
    x = np.random.default_rng(1).normal(size=(3, 50))
    full = np.stack([np.correlate(v, v, "full") for v in x])
    assert np.allclose(K.ccf(x, x, False), full)
    assert np.allclose(K.acf(x)[:, 0], 1)
    assert np.all(K.acf(np.zeros((1, 8))) == 0)


def test_spectral_features_of_impulse_flat_and_silent_spectra():
    fs = 200.0
    flat, silent, peak = one(np.ones(1025)), one(np.zeros(1025)), impulse(1025, 512)
    assert K.spectral_centroid(peak, fs)[0] == pytest.approx(50)
    assert K.spectral_centroid(flat, fs)[0] == pytest.approx(50)
    assert K.spectral_kurtosis(flat, fs)[0] == pytest.approx(-1.2, abs=1e-3)
    assert K.spectral_skewness(flat, fs)[0] == pytest.approx(0, abs=1e-9)
    assert K.spectral_flatness(flat, fs)[0] == pytest.approx(1)
    assert K.spectral_flatness(peak, fs)[0] == 0
    assert K.spectral_crest(peak, fs)[0] == 1
    assert K.spectral_rolloff(flat, fs)[0] == pytest.approx(85, abs=0.2)
    assert K.spectral_rolloff(flat, fs, 0.75)[0] == pytest.approx(75, abs=0.2)
    assert K.spectral_rolloff(flat, fs, 1.0)[0] <= fs / 2
    assert K.spectral_flux(flat, silent)[0] == pytest.approx(np.sqrt(1025) / 1025)
    for f in (K.spectral_centroid, K.spectral_crest, K.spectral_decrease, K.spectral_flatness, K.spectral_spread, K.spectral_kurtosis, K.spectral_rolloff, K.spectral_skewness, K.spectral_slope, K.spectral_tonal_power_ratio):
        assert f(silent, fs)[0] == 0
    with pytest.raises(ValueError):
        K.spectral_rolloff(flat, fs, 1.5)


def test_tonal_power_ratio_counts_each_bin_once():
    m = np.full(64, 0.5)
    m[[10, 20, 62]] = 2
    assert K.spectral_tonal_power_ratio(one(m), 1.0)[0] == pytest.approx(12 / (12 + 61 * 0.25))


def test_mfcc_and_chroma_of_flat_spectrum():
    flat = one(np.ones(1025))
    assert K.spectral_mfccs(flat, 32000)[0, 0] == pytest.approx(-7.5502166, abs=1e-4)
    assert K.spectral_pitch_chroma(flat, 32000)[0] == pytest.approx(np.full(12, 1 / 12))
    assert K.spectral_pitch_chroma(impulse(1025, round(440 / 32000 * 2048)), 32000)[0].argmax() == 9
    assert np.isfinite(K.spectral_mfccs(one(np.ones(33)), 8000)).all()  # bands beyond the spectrum


def test_time_features():
    i = np.arange(1025)
    square = one(np.where(i % 100 < 50, 1.0, -1.0))
    assert K.time_rms(square, 1)[0] == 1 and K.time_std(one(np.ones(9)), 1)[0] == 0
    assert K.time_zero_crossing_rate(one(np.sin(2 * np.pi * 1 * (np.arange(1000) + 0.5) / 100)), 100)[0] == pytest.approx(19.5 / 1000, abs=1e-3)
    assert K.time_max_acf(one(np.sin(2 * np.pi * 5 * np.arange(1000) / 100)), 100, 10.0)[0] > 0.95
    assert K.time_acf_coeff(one(np.arange(30.0)), 1)[0] == sum(k * (k + 19) for k in range(11))


def test_envelopes_decay_by_their_coefficients():
    y, _ = K.peak_meter(np.concatenate([np.ones(5000), np.zeros(3)]), 1000.0)
    assert y[5001] / y[5000] == pytest.approx(K.single_pole_alpha(1.5, 1000))
    p = K.single_pole(one(np.concatenate([np.ones(5000), np.zeros(3)])), 0.9)[0]
    assert p[5001] / p[5000] == pytest.approx(0.9)


def test_pitch():
    m = np.zeros(2049)
    for j, k in enumerate((30, 60, 90, 120)):
        m[k] = 0.5**j
    hz = 30 * 48000 / 4096
    assert K.pitch_spectral_hps(one(m), 48000)[0] == pytest.approx(hz)
    assert K.pitch_spectral_acf(one(m), 48000)[0] == pytest.approx(hz)
    x = one(np.sin(2 * np.pi * 441 * np.arange(4096) / 44100))
    assert K.pitch_time_acf(x, 44100)[0] == pytest.approx(441)
    assert K.pitch_time_zero_crossings(x, 44100)[0] == pytest.approx(441, rel=0.01)
    # the lowest bands still ring within one block, so a multiple of the period may win
    assert (441 / K.pitch_time_auditory(x, 44100)[0]) % 1 == pytest.approx(0, abs=0.02)
    silent = np.zeros((1, 4096))
    assert [float(f(silent, 44100)[0]) for f in (K.pitch_time_acf, K.pitch_time_amdf, K.pitch_time_zero_crossings)] == [0, 0, 0]


def test_instantaneous_frequency_wraps():
    fs, hop = 8000.0, 256
    x = np.sin(2 * np.pi * 441 * np.arange(2000) / fs)
    f = K.instantaneous_frequency(K.spectrum(one(x[hop : hop + 1024])), K.spectrum(one(x[:1024])), hop, fs)
    assert f[0, round(441 / fs * 1024)] == pytest.approx(441, abs=0.5)
    assert np.allclose(K.wrapped(np.array([0.5, np.pi + 0.5, -4.0])), [0.5, 0.5 - np.pi, 2 * np.pi - 4.0])


def test_butterworth_iir_and_zero_phase():
    b, a = K.butterworth(2, 0.5)
    assert b == pytest.approx([0.29289322, 0.58578644, 0.29289322]) and a == pytest.approx([1, 0, 0.17157288])
    x = np.random.default_rng(2).normal(size=(2, 300))
    direct = np.zeros_like(x)
    for n in range(300):
        direct[:, n] = sum(b[k] * x[:, n - k] for k in range(3) if n >= k) - sum(a[k] * direct[:, n - k] for k in (1, 2) if n >= k)
    assert np.allclose(K.iir(b, a, x), direct)
    first, s = K.iir(b, a, x[:, :111], with_state=True)
    assert np.allclose(np.concatenate([first, K.iir(b, a, x[:, 111:], s)], axis=1), direct)
    assert K.filtfilt(b, a, np.ones((1, 50))) == pytest.approx(np.ones((1, 50)))
    with pytest.raises(ValueError):
        K.filtfilt(b, a, np.ones((1, 6)))


def test_gammatone_has_unit_gain_at_its_centre():
    fs = 32000.0
    centres = K.gammatone_centres(20, 100.0, fs)
    assert centres[0] == pytest.approx(100)
    x = one(np.sin(2 * np.pi * 100 * np.arange(40000) / fs))
    assert np.abs(K.gammatone(x, 100.0, fs)[0, 20000:]).max() == pytest.approx(1, abs=0.01)
    assert np.abs(K.gammatone(x, float(centres[10]), fs)[0, 20000:]).max() < 0.1


def test_moving_averages():
    y = K.moving_average_zero_phase(impulse(16, 6), 5)[0]
    assert y[2:11] * 25 == pytest.approx([1, 2, 3, 4, 5, 4, 3, 2, 1])
    assert K.moving_average(one(np.ones(6)), 4)[0] == pytest.approx([0.25, 0.5, 0.75, 1, 1, 1])
    assert K.moving_average_length(0.07, 20) == 1 and K.moving_average_length(0.07, 25) == 2


def test_interpolation_and_resampling():
    assert K.interpolate(np.array([1.0, 2, 3]), np.array([-1.5, -0.5, 0, 0.5, 2, 2.25, 3.5])) == pytest.approx([0, 0.5, 1, 1.5, 3, 2.25, 0])
    assert K.resample_length(1000, 48000, 44100) == 919
    x = np.sin(2 * np.pi * 100 * np.arange(8000) / 8000)
    y = K.resample(x, 8000, 16000)
    assert len(y) == 16000 and y[4000:8000] == pytest.approx(np.sin(2 * np.pi * 100 * np.arange(4000, 8000) / 16000), abs=0.01)


def test_mel_bank_of_tone():
    m = 2 * K.magnitude(one(np.sin(2 * np.pi * 1000 * np.arange(2048) / 48000)))
    edges = K.mel_edges(40, 100, 16000)
    v = K.mel_spectrogram(m, 48000, 40, 100, 16000, False)[0]
    assert edges[v.argmax()] < 1000 < edges[v.argmax() + 2]
    with pytest.raises(ValueError):
        K.mel_bank(33, 64.0, 8, 1.0, 40.0)


def test_fingerprint_word_of_one_bin():
    now = K.fingerprint_differences(impulse(1025, 500), 5000)
    words = K.fingerprint_words(now, np.zeros_like(now))
    assert words[0] == 1 << 24
    assert K.fingerprint_words(now, now)[0] == 0


def test_chords_and_keys():
    for code in range(24):
        third = 4 if code < 12 else 3
        c = np.zeros(12)
        c[[(code + d) % 12 for d in (0, third, 7)]] = 1
        assert K.chord_probabilities(one(c))[0].argmax() == code
        assert K.key_of(one(c))[0] == code and K.key_of(one(3 * c))[0] == code
    assert K.chord_probabilities(np.zeros((1, 12)))[0, 24] == 1 and K.key_of(np.zeros((1, 12)))[0] == 24
    start, move = K.chord_model()
    assert move.sum(axis=1) == pytest.approx(np.ones(25)) and start.sum() == pytest.approx(1)


def test_viterbi_removes_a_disruption():
    start, move = K.chord_model()
    e = np.full((25, 20), 0.01)
    e[0, :] = 0.5
    e[0, 9:11], e[6, 9:11] = 0.3, 0.35
    path, _ = K.viterbi(e, start, move)
    assert set(path.tolist()) == {0}


def test_viterbi_and_dtw_examples():
    emission = np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])
    path, p = K.viterbi(emission, np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), log=False)
    assert path.tolist() == [0, 0, 1] and p == pytest.approx(0.01512)
    _, lp = K.viterbi(emission, np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]))
    assert np.exp(lp) == pytest.approx(p)
    d = np.array([[0, 1, 2], [1, 0, 1], [1, 1, 0], [2, 1, 0]], dtype=float)
    path, cost = K.dtw(d)
    assert cost == 0 and path.tolist() == [[0, 0], [1, 1], [2, 2], [3, 2]]
    assert K.dtw(np.ones((1, 4)))[1] == 4


@pytest.mark.parametrize("method", ["fft", "acf"])
def test_beat_histogram_finds_120_bpm(method):
    rate = 44100 / 8
    assert len(K.beat_axis("acf", 65536, rate)) > 4000
    curve = np.zeros(int(10 * rate))
    for k in range(20):
        curve[int(k * rate / 2) : int(k * rate / 2) + 40] = 1
    h, bpm = K.beat_histogram(curve, rate, method), K.beat_axis(method, 65536, rate)
    near = np.abs(bpm - 120) < 3
    assert h[near].max() == pytest.approx(1, abs=0.05) and h.max() == pytest.approx(1)


def test_helpers():
    assert [K.next_pow2(n) for n in (-1, 0, 1, 5, 8)] == [0, 0, 1, 8, 8]
    assert K.round_half_away(np.array([-2.5, 2.5, 0.4])).tolist() == [-3, 3, 0]
    assert K.is_pow2(0) and K.is_pow2(64) and not K.is_pow2(12)


def test_warping_against_plain_loops():
    rng = np.random.default_rng(8)
    for _ in range(40):
        d = rng.integers(0, 4, (int(rng.integers(1, 9)), int(rng.integers(1, 9)))).astype(float)
        rows, cols = d.shape
        cost = np.full((rows + 1, cols + 1), np.inf)
        cost[0, 0] = 0
        for i in range(rows):
            for j in range(cols):
                cost[i + 1, j + 1] = d[i, j] + min(cost[i, j], cost[i + 1, j], cost[i, j + 1])
        path, total = K.dtw(d)
        assert total == cost[rows, cols] == sum(d[i, j] for i, j in path)
        steps = np.diff(path, axis=0)
        assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (rows - 1, cols - 1)
        assert ((steps >= 0) & (steps <= 1)).all() and (steps.sum(axis=1) > 0).all()
        # going back, the diagonal is preferred, then the row
        for (i, j), (a, b) in zip(path[1:], path[:-1], strict=True):
            options = [cost[i, j], cost[i + 1, j], cost[i, j + 1]]
            assert (i - a, j - b) == [(1, 1), (0, 1), (1, 0)][int(np.argmin(options))]


def test_filter_bank_edges_by_rule():
    bank = K.mfcc_bank(513, 16000.0)
    assert bank.shape == (40, 513) and (bank >= 0).all()
    peak = bank.argmax(axis=1) * 16000 / 1024
    assert peak[0] == pytest.approx(200, abs=16) and np.all(np.diff(peak) > 0)
    assert K.mfcc_bank(65, 500.0)[-1].sum() == 0
