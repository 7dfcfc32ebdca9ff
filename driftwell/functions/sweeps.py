"""Conditioning of probe sweeps and slow signals, in numpy."""

from __future__ import annotations

import math

import numpy as np

from driftwell.functions.spectra import analytic


def sweep_cycles(v: np.ndarray) -> float:
    """Cycles of a sweep voltage in its samples: the strongest component, or the lowest of those it is a second or third harmonic of."""
    a = np.abs(np.fft.rfft(v - np.mean(v)))
    k = int(np.argmax(a[1:]) + 1)
    for part in (3, 2):
        if k % part == 0 and a[k // part] > 0.5 * a[k]:
            return k / part
    return float(k)


def gaussian_lowpass(x: np.ndarray, v: np.ndarray, lpf: float) -> np.ndarray:
    """x without what is fast against the sweep v: a normal curve over frequency, 1.7 * cycles * lpf bins wide."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    width = max(1.7 * sweep_cycles(v) * lpf, 1e-9)
    k = np.arange(x.shape[1] // 2 + 1)
    return np.fft.irfft(np.fft.rfft(x, axis=1) * np.exp(-((k / width) ** 2)), x.shape[1], axis=1)


def remove_leakage(current: np.ndarray, voltage: np.ndarray, quiet: slice) -> tuple[np.ndarray, complex]:
    """(current without leakage, conductance): a complex conductance at the sweep's frequency is found where there is no plasma, and what
    it drives is taken off everywhere, with the offset there. ValueError for fewer than 2000 quiet samples."""
    i0, v0 = current[quiet], voltage[quiet]
    if len(i0) < 2000:
        raise ValueError("too few quiet samples")
    w = np.blackman(len(i0))
    w /= w.sum()
    offset, base = float(np.sum(w * i0)), float(np.sum(w * v0))
    fv, fi = np.fft.rfft(w * (v0 - base)), np.fft.rfft(w * (i0 - offset))
    k = int(np.argmax(np.abs(fv)))
    g = complex(fi[k] / fv[k])
    quadrature = analytic(voltage - base)[0].imag
    return current - offset - g.real * (voltage - base) + g.imag * quadrature, g


def restore_sine(x: np.ndarray, dt: float, freq: float, *, passes: int = 6, clipped: np.ndarray | None = None) -> np.ndarray:
    """A clipped sine of a known frequency whole again, at constant amplitude and with its slow offset.

    The phase is that of the signal against a wave of the frequency, averaged over one period; amplitude and offset come from the samples
    that are not clipped. What is clipped is then filled with the result, and again.
    """
    x = np.asarray(x, dtype=float)
    ok = ~clipped if clipped is not None else (x > x.min()) & (x < x.max())
    n = max(1, int(round(1 / (freq * dt))))
    whole = x
    turn = np.exp(-2j * math.pi * freq * dt * np.arange(len(x)))
    seen = np.convolve(np.ones(len(x)), np.ones(n), "same")
    for _ in range(max(1, passes)):
        phase = np.angle(np.convolve((whole - whole.mean()) * turn, np.ones(n), "same") / seen / turn)
        design = np.column_stack([np.cos(phase), np.sin(phase), np.ones(len(x))])
        fit = design @ np.linalg.lstsq(design[ok], x[ok], rcond=None)[0]
        error = np.convolve(np.where(ok, x - fit, 0.0), np.ones(n), "same") / np.maximum(np.convolve(ok.astype(float), np.ones(n), "same"), 1.0)
        whole = np.where(ok, x, fit + error)
    return fit + error


def longest_low(t: np.ndarray, x: np.ndarray, *, least: float = 0.1) -> tuple[float, float, float] | None:
    """(start, end, fraction) of a pulse: the lowest fraction 1 / div of the peak, from 1 / 100 to 1 / 2, above which there is one unbroken run, longer than ``least`` of the samples."""
    peak = float(np.nanmax(x)) if len(x) else 0.0
    for div in range(100, 1, -1):
        on = np.r_[False, x > peak / div, False]
        up, down = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
        long = [(a, b) for a, b in zip(up, down, strict=True) if b - a > least * len(x)]
        if peak > 0 and len(up) == 1 and len(long) == 1:
            a, b = long[0]
            return float(t[a]), float(t[b - 1]), 1.0 / div
    return None


def pulse_by_duty(t: np.ndarray, power: np.ndarray, *, threshold: float, duty: tuple[float, float] = (0.1, 0.9), passes: int = 30, margin: float = 0.0) -> tuple[float, float]:
    """(start, end) of a pulse: the threshold is lowered or raised until the part of samples above it lies within ``duty``."""
    for _ in range(passes):
        part = float(np.mean(power > threshold))
        if part < duty[0]:
            threshold *= 0.8
        elif part > duty[1]:
            threshold *= 1.2
        else:
            break
    k = np.flatnonzero(power > threshold)
    if not len(k):
        return math.nan, math.nan
    return float(t[k[0]] - margin), float(t[k[-1]] + margin)


def profile_quality(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, degree: int = 5, least: float = 0.0) -> tuple[np.ndarray | None, float]:
    """(coefficients, error) of a weighted polynomial over a profile: error 9 for too few points, 10 where the profile is too weak."""
    ok = np.isfinite(x) & np.isfinite(y) & np.isfinite(weight)
    if ok.sum() <= degree + 1:
        return None, 9.0
    if np.abs(y[ok]).max() <= least:
        return None, 10.0
    c = np.polyfit(x[ok], y[ok], degree, w=weight[ok])
    return c, float(np.sqrt(np.mean((weight[ok] * (np.polyval(c, x[ok]) - y[ok])) ** 2)))
