"""Spectra, filters and decompositions in numpy; rows are channels, columns samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from driftwell.functions.numbers import next_nice_number


def band_mask(n: int, passband: Sequence[float], stopband: Sequence[float], taper: int | None = None) -> np.ndarray:
    """Weights of the n // 2 + 1 frequencies of a real transform of n samples; bands are in units of the Nyquist frequency.

    Taper 1 rises and falls by straight lines, taper 2 by the integral of a triangle, which has no corners. By default 2, but 1 where a
    transition is narrower than four bins.
    """
    if passband[0] < stopband[0] or passband[1] > stopband[1]:
        raise ValueError(f"passband {tuple(passband)} outside stopband {tuple(stopband)}")
    if stopband[1] > 2:
        raise ValueError("filter frequency too high for the data: a matter of units?")
    half = n / 2
    s0, p0, p1, s1 = (float(int(x * half)) for x in (stopband[0], passband[0], passband[1], stopband[1]))
    width = max(p0 - s0, s1 - p1)
    if taper is None:
        taper = 2 if width >= 4 else 1
    if taper == 2 and width < 4:
        raise ValueError("taper 2 needs a wider margin between stop and pass")
    k = np.arange(n // 2 + 1, dtype=float)
    if taper == 2:
        s0, s1 = p0 - width, p1 + width
        if s1 >= half + 4:
            raise ValueError("mask aliasing")
    up = np.where(k >= p0, 1.0, np.clip((k - s0) / max(p0 - s0, 1e-9), 0, 1))
    down = np.where(k <= p1, 1.0, np.clip((s1 - k) / max(s1 - p1, 1e-9), 0, 1))
    ramp = np.minimum(up, down)
    if taper == 2:
        ramp = np.where(ramp < 0.5, 2 * ramp**2, 1 - 2 * (1 - ramp) ** 2)
    if not ramp.max() > 0:
        raise ValueError("zero mask")
    return ramp / ramp.max()


def bandpass(x: np.ndarray, dt: float, passband: Sequence[float], stopband: Sequence[float], taper: int | None = None) -> np.ndarray:
    """Samples within a band, by a mask on the transform of a length that is cheap."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    n = next_nice_number(x.shape[1])
    nyquist = 0.5 / dt
    mask = band_mask(n, [f / nyquist for f in passband], [f / nyquist for f in stopband], taper)
    return np.fft.irfft(np.fft.rfft(x, n, axis=1) * mask, n, axis=1)[:, : x.shape[1]]


def butterworth(order: int, edges: Sequence[float] | float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter; edges in units of the Nyquist frequency; kind lowpass, highpass or bandpass."""
    w = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(edges, dtype=float)) / 2)  # sampling at 2
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    zeros = np.zeros(0, dtype=complex)
    if kind == "lowpass":
        poles, gain = poles * w[0], w[0] ** order
    elif kind == "highpass":
        poles, zeros, gain = w[0] / poles, np.zeros(order, dtype=complex), 1.0
    elif kind == "bandpass":
        wide, mid = w[1] - w[0], np.sqrt(w[0] * w[1])
        half = poles * wide / 2
        root = np.sqrt(half**2 - mid**2)
        poles, zeros, gain = np.r_[half + root, half - root], np.zeros(order, dtype=complex), wide**order
    else:
        raise ValueError(f"unknown kind {kind}")
    fs2 = 4.0
    gain = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    z = np.r_[(fs2 + zeros) / (fs2 - zeros), -np.ones(len(poles) - len(zeros))]
    p = (fs2 + poles) / (fs2 - poles)
    return np.real(gain * np.poly(z)), np.real(np.poly(p))


def butterworth_order(passband: Sequence[float], stopband: Sequence[float], loss: float, attenuation: float) -> int:
    """The least order that loses at most ``loss`` dB in the passband and takes at least ``attenuation`` dB in the stopband."""
    wp, ws = np.tan(np.pi * np.asarray(passband) / 2), np.tan(np.pi * np.asarray(stopband) / 2)
    if len(wp) == 1:
        ratio = ws[0] / wp[0] if ws[0] > wp[0] else wp[0] / ws[0]
    else:
        ratio = np.min(np.abs((ws**2 - wp[0] * wp[1]) / (ws * (wp[0] - wp[1]))))
    return max(1, math.ceil(math.log10((10 ** (attenuation / 10) - 1) / (10 ** (loss / 10) - 1)) / (2 * math.log10(ratio))))


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The causal filter b / a along the samples of all channels at once."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    b, a = b / a[0], a / a[0]
    m = max(len(a), len(b)) - 1
    b, a = np.r_[b, np.zeros(m + 1 - len(b))], np.r_[a, np.zeros(m + 1 - len(a))]
    state = np.zeros((x.shape[0], m))
    out = np.empty_like(x)
    for i in range(x.shape[1]):
        v = x[:, i]
        y = b[0] * v + (state[:, 0] if m else 0.0)
        if m:
            state = np.column_stack([state[:, 1:], np.zeros(len(v))]) + np.outer(v, b[1:]) - np.outer(y, a[1:])
        out[:, i] = y
    return out


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of each channel."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def analytic_phase(x: np.ndarray) -> np.ndarray:
    return np.unwrap(np.angle(analytic(x)), axis=1)


def peak_frequency(x: np.ndarray, dt: float, low: float = 0.0, high: float = math.inf) -> tuple[float, int, float]:
    """(frequency, its bin, peak over rms of the spectrum) of the greatest component from low up to below high."""
    spectrum = np.abs(np.fft.rfft(x))
    f = np.arange(len(spectrum)) / (len(x) * dt)
    inside = np.flatnonzero((f >= low) & (f < high))
    if not len(inside):
        return math.nan, -1, math.nan
    k = int(inside[np.argmax(spectrum[inside])])
    rms = math.sqrt(float(np.mean(spectrum[inside] ** 2)))
    return float(f[k]), k, float(spectrum[k] / rms) if rms > 0 else math.nan


def spectral_peaks(x: np.ndarray, dt: float, min_ratio: float = 0.0) -> list[tuple[float, float]]:
    """(frequency, amplitude) of the local maxima of the spectrum of x without its mean, in order of frequency."""
    a = np.abs(np.fft.fft(np.asarray(x) - np.mean(x)))[: len(x) // 2] / len(x)
    k = np.flatnonzero((a[1:-1] > a[:-2]) & (a[1:-1] >= a[2:])) + 1
    top = a[1:].max(initial=0.0)
    return [(float(i / (dt * len(x))), float(a[i])) for i in k if a[i] > min_ratio * top]


def spectrogram(x: np.ndarray, n: int, overlap: int, decibel: bool = False) -> np.ndarray:
    """Power of windows (rows) by frequency; the first and last frequency count half."""
    window = np.hanning(n)
    hop = n - overlap
    starts = np.arange(0, max(0, len(x) - n + 1), hop)
    if not len(starts):
        return np.zeros((0, n // 2 + 1))
    p = np.abs(np.fft.rfft(np.stack([x[s : s + n] * window for s in starts]), axis=1)) ** 2
    p[:, [0, -1]] *= 0.5
    return 10 * np.log10(np.maximum(p, 1e-300)) if decibel else p


def cross_power(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fft.fft(a) * np.conj(np.fft.fft(b))


def time_delay(a: np.ndarray, b: np.ndarray, dt: float) -> float:
    """How much later a is than b, by the greatest circular correlation."""
    n = len(a)
    k = int(np.argmax(np.abs(np.fft.ifft(np.fft.fft(a - np.mean(a)) * np.conj(np.fft.fft(b - np.mean(b)))))))
    return (k - n if k > n // 2 else k) * dt


def damped_music(x: np.ndarray, components: int, rows: int, dampings: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Pseudo-spectrum over dampings x angular frequencies (a sample) from the noise space of the Hankel matrix."""
    columns = len(x) - rows + 1
    if not components < min(rows, columns):
        raise ValueError("components must be fewer than rows and columns of the Hankel matrix")
    hankel = np.lib.stride_tricks.sliding_window_view(np.asarray(x, dtype=complex), rows)[:columns].T
    u = np.linalg.svd(hankel, full_matrices=True)[0][:, components:]
    m = np.arange(rows)
    out = np.empty((len(dampings), len(freqs)))
    for i, d in enumerate(dampings):
        v = np.exp(np.outer(m, -d + 1j * freqs))
        v /= np.linalg.norm(v, axis=0)
        out[i] = 1.0 / np.maximum(np.sum(np.abs(u.conj().T @ v) ** 2, axis=0), 1e-300)
    return out


def decompose(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(topos as rows, singular values, chronos as rows, entropy, energy) of channels x samples."""
    u, s, v = np.linalg.svd(np.asarray(x, dtype=float), full_matrices=False)
    energy = float(np.sum(s**2))
    p = s**2 / energy if energy > 0 else np.zeros_like(s)
    nz = p[p > 0]
    entropy = float(-np.sum(nz * np.log(nz)) / math.log(len(s))) if len(s) > 1 else 0.0
    return u.T, s, v, entropy, energy


def coherence_groups(chronos: np.ndarray, s: np.ndarray, how: str = "geometric", *, max_energy: float = 1.0, threshold: float = 0.7) -> list[list[int]]:
    """Singular vectors put together by the cross power of their time courses.

    The strongest vector left leads; gamma of each other is the squared mean cross power over the product of the self powers. 'threshold'
    takes those above the threshold, 'geometric' those before the largest drop of gamma in descending order.
    """
    p = s**2 / max(float(np.sum(s**2)), 1e-300)
    keep = int(np.searchsorted(np.cumsum(p), max_energy) + 1) if max_energy < 1 else len(s)
    left = list(range(min(keep, len(s))))
    spectra = np.fft.fft(chronos, axis=1)
    own = np.mean(np.abs(spectra) ** 2, axis=1)
    out = []
    while left:
        if len(left) == 1:
            out.append(left)
            break
        lead = left[0]
        gamma = np.array([1.0 if k == lead else np.mean(np.abs(spectra[lead] * np.conj(spectra[k]))) ** 2 / max(own[lead] * own[k], 1e-300) for k in left])
        if how == "threshold":
            group = [k for k, g in zip(left, gamma, strict=True) if g > threshold or k == lead]
        else:
            order = np.argsort(-gamma, kind="stable")
            drop = int(np.argmin(np.diff(gamma[order])))
            group = sorted(left[i] for i in order[: drop + 1])
            if lead not in group:
                group = sorted([lead, *group])
        out.append(group)
        left = [k for k in left if k not in group]
    return out
