"""Least squares and simplex fits in numpy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def least_squares(residual: Callable[[np.ndarray], np.ndarray], start: Sequence[float], *, steps: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, int]:
    """(parameters, covariance scaled by the residual variance, steps) of the least sum of squares, by damped Gauss-Newton steps."""
    p = np.asarray(start, dtype=float)
    r = residual(p)
    cost, damp, n = float(r @ r), 1e-3, 0
    jac = _jacobian(residual, p, r)
    for n in range(1, steps + 1):
        normal, slope = jac.T @ jac, jac.T @ r
        move = np.linalg.lstsq(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), -slope, rcond=None)[0]
        trial = p + move
        r2 = residual(trial)
        c2 = float(r2 @ r2) if np.isfinite(r2).all() else np.inf
        if c2 < cost:
            gain = cost - c2
            p, r, cost, damp = trial, r2, c2, max(damp / 5, 1e-12)
            jac = _jacobian(residual, p, r)
            if gain <= tolerance * max(cost, 1e-300):
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    free = max(1, len(r) - len(p))
    cov = np.linalg.pinv(jac.T @ jac) * cost / free
    return p, cov, n


def _jacobian(residual: Callable[[np.ndarray], np.ndarray], p: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty((len(r), len(p)))
    for j in range(len(p)):
        h = 1e-6 * max(abs(p[j]), 1e-3)
        q = p.copy()
        q[j] += h
        out[:, j] = (residual(q) - r) / h
    return out


def simplex(cost: Callable[[np.ndarray], float], start: Sequence[float], scale: Sequence[float], *, steps: int = 500, tolerance: float = 1e-8) -> tuple[np.ndarray, float, int]:
    """(parameters, cost, steps) of the least cost by the simplex method of Nelder and Mead."""
    x = [np.asarray(start, dtype=float)]
    for j, s in enumerate(scale):
        v = x[0].copy()
        v[j] += s
        x.append(v)
    f = [cost(v) for v in x]
    n = 0
    for n in range(1, steps + 1):
        order = np.argsort(f, kind="stable")
        x, f = [x[i] for i in order], [f[i] for i in order]
        if abs(f[-1] - f[0]) <= tolerance * (abs(f[0]) + tolerance):
            break
        mid = np.mean(x[:-1], axis=0)
        up = mid + (mid - x[-1])
        fu = cost(up)
        if fu < f[0]:
            far = mid + 2 * (mid - x[-1])
            ff = cost(far)
            x[-1], f[-1] = (far, ff) if ff < fu else (up, fu)
        elif fu < f[-2]:
            x[-1], f[-1] = up, fu
        else:
            near = mid + 0.5 * ((up if fu < f[-1] else x[-1]) - mid)
            fn = cost(near)
            if fn < min(fu, f[-1]):
                x[-1], f[-1] = near, fn
            else:
                x = [x[0], *(x[0] + 0.5 * (v - x[0]) for v in x[1:])]
                f = [f[0], *(cost(v) for v in x[1:])]
    i = int(np.argmin(f))
    return x[i], float(f[i]), n


# Fixed forms: curves by name (function of x and parameters, start values from the data).
CURVES: dict[str, tuple[Callable, Callable]] = {
    "gaussian_pedestal": (lambda x, p: p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2)) + p[3], lambda x, y: [np.ptp(y), x[np.argmax(y)], np.ptp(x) / 4 or 1.0, np.min(y)]),
    "mirrored_exponential": (lambda x, p: p[0] * np.exp(-np.abs(x - p[1]) / p[2]) + p[3], lambda x, y: [np.ptp(y), x[np.argmax(y)], np.ptp(x) / 4 or 1.0, np.min(y)]),
    "exponential": (lambda x, p: p[0] * np.exp(-(x - x[0]) / p[1]) + p[2], lambda x, y: [y[0] - y[-1], np.ptp(x) / 3 or 1.0, y[-1]]),
    "double_exponential": (
        lambda x, p: p[0] * np.exp(-(x - x[0]) / p[1]) + p[2] * np.exp(-(x - x[0]) / p[3]) + p[4],
        lambda x, y: [(y[0] - y[-1]) / 2, np.ptp(x) / 8 or 1.0, (y[0] - y[-1]) / 2, np.ptp(x) / 2 or 1.0, y[-1]],
    ),
}


def fit_curve(name: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(parameters, rms residual) of a named curve; NaN points are left out; ValueError for fewer points than parameters."""
    curve, guess = CURVES[name]
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = np.asarray(x, dtype=float)[ok], np.asarray(y, dtype=float)[ok]
    start = guess(x, y) if len(x) else []
    if len(x) <= len(start) or not len(x):
        raise ValueError("too few points")
    with np.errstate(all="ignore"):
        p, _, _ = least_squares(lambda q: curve(x, q) - y, start)
    return p, float(np.sqrt(np.mean((curve(x, p) - y) ** 2)))


def probe_current(v: np.ndarray, te: float, vf: float, i0: float) -> np.ndarray:
    """Current of a swept probe at voltage v."""
    return i0 * (1 - np.exp(np.clip((v - vf) / te, -60, 60)))


def fit_probe(v: np.ndarray, i: np.ndarray, *, norm: float = 2.0, start: Sequence[float] | None = None, steps: int = 100) -> dict[str, float]:
    """te, vf, i0, their errors, resid (over i0), nits of a probe's characteristic; norm 2 by least squares, else the mean of |residual| ** norm by a simplex."""
    ok = np.isfinite(v) & np.isfinite(i)
    v, i = np.asarray(v, dtype=float)[ok], np.asarray(i, dtype=float)[ok]
    if len(v) < 5:
        raise ValueError("too few points")
    first = list(start or [50.0, 15.0, 1.7 * float(np.mean(np.clip(i, 0, None)))])
    first[2] = first[2] or 1e-6
    # The temperature is fitted as its logarithm, which keeps it positive.
    first[0] = np.log(max(first[0], 1e-3))
    real = lambda q: (float(np.exp(np.clip(q[0], -20, 20))), float(q[1]), float(q[2]))
    if norm == 2.0:
        q, cov, n = least_squares(lambda q: probe_current(v, *real(q)) - i, first, steps=steps)
        errors = np.sqrt(np.maximum(np.diag(cov), 0)) * [real(q)[0], 1, 1]
    else:
        q, _, n = simplex(lambda q: float(np.mean(np.abs(probe_current(v, *real(q)) - i) ** norm)), first, [0.5, 0.3 * abs(first[1]) + 1e-6, 0.3 * abs(first[2]) + 1e-9], steps=steps * 5)
        errors = np.full(3, np.nan)
    p = real(q)
    resid = float(np.sqrt(np.mean((probe_current(v, *p) - i) ** 2)) / abs(p[2])) if p[2] else np.inf
    return {"te": p[0], "vf": p[1], "i0": p[2], "e_te": errors[0], "e_vf": errors[1], "e_i0": errors[2], "resid": resid, "nits": n}


def polynomial_profile(x: np.ndarray, y: np.ndarray, w: np.ndarray, degree: int) -> tuple[np.ndarray, float]:
    """(coefficients, rms of the weighted residual) of a weighted polynomial."""
    c = np.polyfit(x, y, degree, w=w)
    return c, float(np.sqrt(np.mean((w * (np.polyval(c, x) - y)) ** 2)))
