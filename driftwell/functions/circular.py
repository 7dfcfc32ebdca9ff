"""Column functions on angles and arrays of angles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def remap(x: Column, low: float = -math.pi, period: float = TWO_PI) -> Column:
    """x moved by whole periods into [low, low + period)."""
    return x - F.lit(period) * F.floor((x - F.lit(low)) / F.lit(period))


def wrapped_distance(phases: Column, centre: Sequence[float]) -> list[Column]:
    """The wrapped difference of each phase from a template's."""
    return [remap(F.get(phases, F.lit(i)).cast("double") - F.lit(float(c))) for i, c in enumerate(centre)]


def template_distance(phases: Column, centre: Sequence[float], spread: Sequence[float] | None = None) -> Column:
    """Root of the mean squared wrapped difference, each over its spread."""
    s = spread or [1.0] * len(centre)
    parts = [(d / F.lit(float(w))) * (d / F.lit(float(w))) for d, w in zip(wrapped_distance(phases, centre), s, strict=True)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.sqrt(total / F.lit(float(len(parts))))


def neighbour_differences(phases: Column, low: float = -math.pi) -> Column:
    """Differences of successive phases in [low, low + 2 pi)."""
    a = F.slice(phases, F.lit(1), F.greatest(F.size(phases) - 1, F.lit(0)))
    b = F.slice(phases, F.lit(2), F.greatest(F.size(phases) - 1, F.lit(0)))
    return F.zip_with(a, b, lambda x, y: remap(y.cast("double") - x.cast("double"), low))


def deadband(phases: Column, width: float) -> Column:
    """Phases of a magnitude below ``width`` as 0."""
    return F.transform(phases, lambda x: F.when(F.abs(x) < width, F.lit(0.0)).otherwise(x.cast("double")))


def bit_mask(indices: Column) -> Column:
    """Indices 0 to 62 as bits of a long."""
    return F.aggregate(indices, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.expr("cast(1 as bigint)") * F.pow(F.lit(2.0), i).cast("long")))


def bit_list(mask: Column) -> Column:
    """The set bits of a long as indices."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: (mask / F.pow(F.lit(2.0), i)).cast("long") % 2 == 1)


def close_loop(values: Column, step: float = TWO_PI) -> Column:
    """The array with its first element, moved by ``step``, at the end."""
    return F.when(F.size(values) > 0, F.concat(values, F.array(F.get(values, F.lit(0)) + F.lit(step)))).otherwise(values)


def resultant_to_kappa(r: Column) -> Column:
    """Concentration of a von Mises distribution from its mean resultant length, piecewise."""
    return F.when(r < 0.53, 2 * r + r * r * r + 5 * r * r * r * r * r / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(1 / (2 * (1 - r)))


def bessel_ratio(kappa: np.ndarray) -> np.ndarray:
    """I1(kappa) / I0(kappa) by Gauss' continued fraction, from its end."""
    k = np.maximum(np.asarray(kappa, dtype=float), 1e-12)
    depth = 400
    f = np.zeros_like(k)
    for n in range(depth, 0, -1):
        f = 1.0 / (2.0 * n / k + f)
    return f


def log_i0(kappa: np.ndarray) -> np.ndarray:
    """log I0 without overflow."""
    k = np.asarray(kappa, dtype=float)
    small = np.minimum(k, 500.0)
    big = np.maximum(k, 500.0)
    return np.where(k <= 500, np.log(np.i0(small)), big - 0.5 * np.log(2 * math.pi * big) + 1 / (8 * big))


def kappa_from_resultant(r: np.ndarray) -> np.ndarray:
    """Concentration that has the mean resultant length r, by bisection on the ratio of Bessel functions, from 0 to 1000."""
    r = np.asarray(r, dtype=float)
    lo, hi = np.zeros_like(r), np.full_like(r, 1000.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        less = bessel_ratio(mid) < r
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


def kappa_to_sigma(kappa: np.ndarray, degrees: bool = False) -> np.ndarray:
    """Circular standard deviation of a concentration."""
    s = np.sqrt(-2 * np.log(bessel_ratio(kappa)))
    return np.degrees(s) if degrees else s


def ideal_modes(numbers: Sequence[int], angles: Sequence[float]) -> list[list[float]]:
    """Phases that modes of the given numbers have at probes of the given angles, wrapped to [-pi, pi)."""
    return [[float((n * a + math.pi) % TWO_PI - math.pi) for a in angles] for n in numbers]
