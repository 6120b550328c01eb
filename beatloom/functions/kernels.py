"""Signal kernels over numpy arrays, from public definitions (Appendix B of the survey). No Spark here."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..params import BANDS, FRONTAL, POSTERIOR


@lru_cache(maxsize=64)
def butter(order: int, low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a Butterworth band-pass by the bilinear transform."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    bw, w0 = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * bw / 2
    root = np.sqrt(half**2 - w0**2 + 0j)
    poles = np.concatenate([half + root, half - root])
    z_poles = (2 * fs + poles) / (2 * fs - poles)
    b = np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    a = np.real(np.poly(z_poles))
    z0 = np.exp(1j * 2 * np.arctan(w0 / (2 * fs)))
    return b * np.abs(np.polyval(a, z0) / np.polyval(b, z0)), a


@lru_cache(maxsize=64)
def notch_filter(freq: float, fs: float, q: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch."""
    w0 = 2 * np.pi * freq / fs
    beta = np.tan(w0 / q / 2)
    gain = 1 / (1 + beta)
    b = gain * np.array([1, -2 * np.cos(w0), 1])
    return b, np.array([1, -2 * gain * np.cos(w0), 2 * gain - 1])


#: Samples that run_filter takes in one product.
BLOCK = 48


@lru_cache(maxsize=64)
def _modes(coefficients: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A filter as a sum of its poles' responses, in real numbers: step matrix, input and output vectors, steady state.

    A pole w' = p w + x of its own never grows, so long products stay exact where powers of the direct form's matrix do not (narrow
    bands at high rates). Poles must differ, as those of G1 to G3 do; a pair of conjugates is one pole of double weight.
    """
    b, a = np.frombuffer(coefficients).reshape(2, -1).astype(np.longdouble)
    slope, poles = np.polyder(a), np.roots(a.astype(float)).astype(np.clongdouble)
    for _ in range(3):
        poles = poles - np.polyval(a, poles) / np.polyval(slope, poles)
    poles = poles[poles.imag >= -1e-12]
    weight = np.polyval(b, poles) / np.polyval(slope, poles)
    pair = np.abs(poles.imag) > 1e-12
    dim = len(a) - 1
    step, ahead, out, steady, k = np.zeros((dim, dim)), np.zeros(dim), np.zeros(dim), np.zeros(dim), 0
    for p, r, two in zip(poles, weight, pair, strict=True):
        s = 1 / (1 - p)
        if two:
            step[k : k + 2, k : k + 2] = [[p.real, -p.imag], [p.imag, p.real]]
            out[k : k + 2], steady[k : k + 2] = (2 * r.real, -2 * r.imag), (s.real, s.imag)
        else:
            step[k, k], out[k], steady[k] = p.real, r.real, s.real
        ahead[k] = 1
        k += 2 if two else 1
    return step, ahead, out, steady


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of a filter that has had 1 as input for ever."""
    return _modes(np.stack([b, a]).tobytes())[3]


@lru_cache(maxsize=1024)
def _block(coefficients: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix from (n inputs, state) to n outputs, and one to the state after them."""
    step, ahead, weight, _ = _modes(coefficients)
    dim, direct = len(step), np.frombuffer(coefficients)[0]
    out, state = np.zeros((n, n + dim)), np.hstack([np.zeros((dim, n)), np.eye(dim)])
    for t in range(n):
        out[t] = weight @ state
        out[t, t] += direct
        state = step @ state
        state[:, t] += ahead
    return out.T.copy(), state.T.copy()


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x filtered together from states z (a row each), BLOCK samples at a time: outputs and the states after them."""
    key, out = np.stack([b, a]).tobytes(), np.empty(x.shape)
    for t in range(0, x.shape[-1], BLOCK):
        v = x[:, t : t + BLOCK]
        to_out, to_state = _block(key, v.shape[1])
        v = np.hstack([v, z])
        out[:, t : t + BLOCK], z = v @ to_out, v @ to_state
    return out, z


@lru_cache(maxsize=8192)
def state_power(coefficients: bytes, n: int) -> np.ndarray:
    """What a filter's state becomes in n steps without input; coefficients are the bytes of b, then a."""
    return np.linalg.matrix_power(_modes(coefficients)[0], n)


@lru_cache(maxsize=256)
def passed_back(coefficients: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What a state at a chunk's start adds to the state of a backward pass over the chunk's n outputs, and to the last output."""
    b, a = np.frombuffer(coefficients).reshape(2, -1)
    dim = len(a) - 1
    y, _ = run_filter(b, a, np.zeros((dim, n)), np.eye(dim))
    return run_filter(b, a, y[:, ::-1], np.zeros((dim, dim)))[1].T, y[:, -1]


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Forward and backward, with odd extension and steady-state starts; over the last axis."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    pad = 3 * max(len(a), len(b)) if pad is None else pad
    if x.shape[-1] <= pad:
        raise ValueError(f"a signal of {x.shape[-1]} samples is not longer than the padding of {pad}")
    zi = steady_state(b, a)
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    ext = np.concatenate([left, x, right], axis=-1) if pad else x
    y, _ = run_filter(b, a, ext, zi * ext[:, :1])
    y = run_filter(b, a, y[:, ::-1], zi * y[:, -1:])[0][:, ::-1]
    return y[:, pad : y.shape[-1] - pad]


def find_peaks(x: np.ndarray, distance: float, prominence: float) -> np.ndarray:
    """Strict local maxima (flat tops at their floored middle), thinned from the highest by distance, then by prominence."""
    change = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(x)]])
    v = x[starts] if len(x) else np.zeros(0)
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    peaks = (starts[top] + ends[top] - 1) // 2
    keep, gap = np.ones(len(peaks), dtype=bool), int(np.ceil(distance))
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            keep[np.searchsorted(peaks, peaks[k] - gap, "right") : k] = False
            keep[k + 1 : np.searchsorted(peaks, peaks[k] + gap, "left")] = False
    out = []
    for p in peaks[keep]:
        higher_left, higher_right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        lo = higher_left[-1] + 1 if len(higher_left) else 0
        hi = p + 1 + higher_right[0] if len(higher_right) else len(x)
        if x[p] - max(x[lo : p + 1].min(), x[p:hi].min()) >= prominence:
            out.append(p)
    return np.array(out, dtype=np.int64)


def r_peaks(ecg: np.ndarray, fs: float) -> np.ndarray:
    """Band-pass, slope energy, 150 ms mean, peaks, then the highest filtered sample within 50 ms."""
    return r_peaks_of(np.atleast_2d(ecg), fs)[0]


def r_peaks_of(ecg: np.ndarray, fs: float) -> list[np.ndarray]:
    """G7 of signals of one length, a row each, filtered together."""
    width, reach, found = max(1, int(0.15 * fs)), int(0.05 * fs), []
    for x in filtfilt(*butter(3, 5.0, 40.0, fs), ecg):
        energy = np.convolve(np.diff(x) ** 2, np.ones(width) / width, mode="same")
        out = []
        for p in find_peaks(energy, int(0.3 * fs), 0.5 * energy.std()):
            lo = max(0, p - reach)
            out.append(lo + int(np.argmax(x[lo : min(len(x), p + reach)])))
        found.append(np.array(out, dtype=np.int64))
    return found


def clean_peaks(peaks: np.ndarray) -> np.ndarray:
    """Drops a beat whose interval is 30 % or more off the median of all; the first stays; fewer than 3 stay as they are."""
    if len(peaks) < 3:
        return peaks
    rr = np.diff(peaks).astype(float)
    mid = np.median(rr)
    return peaks[np.concatenate([[True], np.abs(rr - mid) < 0.3 * mid])]


@lru_cache(maxsize=64)
def band_kernel(band: str, fs: float, mode: str = "as_computed") -> tuple[np.ndarray, ...]:
    """The wavelets of a band. as_computed: one, whose width ignores the frequency (Q1); else one a frequency."""
    low, high = BANDS[band]
    cycles = max(4, int((low + high) / 2 * 0.5))
    reach = 5 * cycles / (2 * np.pi * low)
    m = int(np.ceil((2 * reach + 1 / fs) * fs - 1e-9))
    out = []
    for f in (low,) if mode == "as_computed" else np.linspace(low, high, 3):
        s = 1.0 if mode == "as_computed" else cycles * fs / (2 * np.pi * f)
        x = (np.arange(m) - (m - 1) / 2) / s
        k = np.pi**-0.25 * np.exp(1j * cycles * x) * np.exp(-(x**2) / 2)
        out.append(k / np.sqrt((np.abs(k) ** 2).sum()))
    return tuple(out)


def band_power(x: np.ndarray, band: str, fs: float, mode: str = "as_computed") -> np.ndarray:
    """Mean power over the band's wavelets; the output is as long as the signal, also where the wavelet is longer."""
    x = np.atleast_2d(x)
    total = np.zeros(x.shape)
    kernels = band_kernel(band, fs, mode)
    for k in kernels:
        n = x.shape[-1] + len(k) - 1
        size = 1 << (n - 1).bit_length()
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(k, size))[:, :n]
        start = (len(k) - 1) // 2
        total += np.abs(full[:, start : start + x.shape[-1]]) ** 2
    return total / len(kernels)


@lru_cache(maxsize=16)
def _responses(fs: float, n: int, step: int, mode: str) -> tuple[np.ndarray, tuple[int, ...]]:
    """A matrix from n samples to the real, then the imaginary parts of all bands' wavelets at every step-th sample, and the wavelets a band."""
    times, parts = np.arange(0, n, step if n > step else 1), []
    kernels = [band_kernel(band, fs, mode) for band in BANDS]
    for k in (k for of_band in kernels for k in of_band):
        at = times[None, :] + (len(k) - 1) // 2 - np.arange(n)[:, None]
        parts.append(np.where((at >= 0) & (at < len(k)), k[np.clip(at, 0, len(k) - 1)], 0))
    both = np.hstack(parts)
    return np.hstack([both.real, both.imag]), tuple(map(len, kernels))


def window_powers(windows: np.ndarray, fs: float, step: int, mode: str = "as_computed") -> np.ndarray:
    """band_power of all bands at every step-th sample of windows, a row each: (windows, bands, times), from those samples alone."""
    matrix, counts = _responses(fs, windows.shape[1], step, mode)
    parts = windows @ matrix
    parts *= parts
    half = parts.shape[1] // 2
    power = (parts[:, :half] + parts[:, half:]).reshape(len(windows), sum(counts), -1)
    return np.add.reduceat(power, np.cumsum([0, *counts[:-1]]), axis=1) / np.array(counts)[:, None]


def beat_tensor(channels: list[np.ndarray | None], ecg: np.ndarray, fs: float, before: float = 0.4, after: float = 0.4, step: int = 5, mode: str = "as_computed") -> tuple[np.ndarray | None, int, np.ndarray]:
    """(channels, bands, times) mean power around the beats, beats used, intervals in ms. Channels that are None give zeros."""
    out = beat_tensors([(channels, ecg)], fs, before, after, step, mode)[0]
    if isinstance(out, ValueError):
        raise out
    return out


def beat_tensors(epochs: list[tuple[list[np.ndarray | None], np.ndarray]], fs: float, before: float = 0.4, after: float = 0.4, step: int = 5, mode: str = "as_computed") -> list[tuple[np.ndarray | None, int, np.ndarray] | ValueError]:
    """beat_tensor of several epochs (channels, ecg) at one rate; one that fails gives its error. A channel that serves several targets is computed once."""
    lo, hi = int(before * fs), int(after * fs)
    found: list = [None] * len(epochs)
    for n in {len(ecg) for _, ecg in epochs}:
        rows = [k for k, (_, ecg) in enumerate(epochs) if len(ecg) == n]
        try:
            peaks = r_peaks_of(np.stack([epochs[k][1] for k in rows]), fs)
        except ValueError as e:
            peaks = [e] * len(rows)
        for k, own in zip(rows, peaks, strict=True):
            found[k] = own
    out, windows, places = [], [], []
    for k, (channels, ecg) in enumerate(epochs):
        if isinstance(found[k], ValueError):
            out.append(found[k])
            continue
        peaks = clean_peaks(found[k])
        rr = np.diff(peaks) / fs * 1000.0 if len(peaks) > 1 else np.zeros(0)
        used = peaks[(peaks - lo >= 0) & (peaks + hi <= len(ecg))] if len(peaks) > 1 else peaks[:0]
        if not len(used):
            out.append((None, 0, rr))
            continue
        given = {id(x): x for x in channels if x is not None}
        if any(used[-1] + hi > len(x) for x in given.values()):
            out.append(ValueError("a channel is shorter than the ECG"))
            continue
        tensor = np.zeros((len(channels), len(BANDS), -(-(lo + hi) // step) if lo + hi > step else lo + hi))
        at = used[:, None] + np.arange(-lo, hi)
        for name, x in given.items():
            windows.append(x[at])
            places.append((tensor, [c for c, y in enumerate(channels) if y is not None and id(y) == name]))
        out.append((tensor, len(used), rr))
    if windows:
        power = window_powers(np.concatenate(windows), fs, step, mode)
        counts = np.array([len(w) for w in windows])
        means = np.add.reduceat(power, np.cumsum([0, *counts[:-1]]), axis=0) / counts[:, None, None]
        for (tensor, targets), mean in zip(places, means, strict=True):
            tensor[targets] = mean
    return out


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling of the last axis to n samples."""
    m = x.shape[-1]
    spectrum = np.fft.rfft(x)
    out = np.zeros((*x.shape[:-1], n // 2 + 1), dtype=complex)
    least = min(m, n)
    k = least // 2 + 1
    out[..., :k] = spectrum[..., :k]
    if least % 2 == 0 and m != n:  # the middle bin stands for two: half of it when there is room for both, both when there is not
        out[..., k - 1] *= 0.5 if n > m else 2.0
    return np.fft.irfft(out, n) * (n / m)


def clean_eeg(eeg: np.ndarray, fs: float, mains: float = 50.0) -> np.ndarray:
    """1-40 Hz band-pass, notches at the mains and its double, average reference; channels by samples."""
    x = filtfilt(*butter(4, 1.0, 40.0, fs), eeg)
    for f in (mains, 2 * mains):
        if f < fs / 2:
            x = filtfilt(*notch_filter(f, fs), x)
    return x - x.mean(axis=0)


def fast_ica(x: np.ndarray, n: int, seed: int = 42, rounds: int = 800) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources, mixing and the channel means, by symmetric FastICA on whitened data; channels by samples."""
    mean = x.mean(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd((x - mean) @ (x - mean).T / x.shape[1])
    white = (u[:, :n] / np.sqrt(s[:n] + 1e-12)).T
    z = white @ (x - mean)

    def orthogonal(w: np.ndarray) -> np.ndarray:
        a, _, b = np.linalg.svd(w)
        return a @ b

    w = orthogonal(np.random.default_rng(seed).standard_normal((n, n)))
    for _ in range(rounds):
        g = np.tanh(w @ z)
        new = orthogonal(g @ z.T / z.shape[1] - np.diag((1 - g**2).mean(axis=1)) @ w)
        done = np.abs(np.abs(np.diag(new @ w.T)) - 1).max() < 1e-5
        w = new
        if done:
            break
    return w @ z, np.linalg.pinv(w @ white), mean


def remove_artifacts(eeg: np.ndarray, names: list[str], ecg: np.ndarray | None, eog: np.ndarray | None, fs: float) -> tuple[np.ndarray, dict]:
    """Drops components that follow the eye or heart channels; a heart component must look posterior by 1.5.

    Skipped, with the reason, below 20 s or without an ECG.
    """
    info = {"ica_n_excluded": 0, "ica_skipped": True, "ica_skip_reason": None, "ica_posterior_check_failed": False}
    if ecg is None or eeg.shape[1] < 20 * fs:
        return eeg, info | {"ica_skip_reason": "no_ecg" if ecg is None else "too_short"}
    sources, mixing, mean = fast_ica(eeg, min(20, len(eeg) - 1))
    unit = lambda v: (v - v.mean()) / (v.std() + 1e-12)
    drop = set()
    if eog is not None:
        r = np.array([abs(float(unit(s) @ unit(eog)) / len(eog)) for s in sources])
        drop |= set(np.flatnonzero((r - r.mean()) / (r.std() + 1e-12) > 3.0).tolist())
    for k in [k for k, s in enumerate(sources) if abs(float(unit(s) @ unit(ecg)) / len(ecg)) > 0.4]:
        w = np.abs(mixing[:, k])
        part = lambda group, w=w: float(np.mean([w[i] for i, n in enumerate(names) if n in group] or [0.0]))
        if part(POSTERIOR) > 1.5 * part(FRONTAL):
            drop.add(k)
        else:
            info["ica_posterior_check_failed"] = True
    kept = sources.copy()
    kept[sorted(drop)] = 0
    return mixing @ kept + mean, info | {"ica_skipped": False, "ica_n_excluded": len(drop)}
