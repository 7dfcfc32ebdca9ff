"""Segments of many channels to fluctuation structures, and other operators on arrays of samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import spectra as S

STRUCTURE = (
    "seg_id long, fs_id int, t0 double, t_mid double, n_channels int, freq double, amp double, a12 double, p double, h double, e double, cpkf double, fpkf double, "
    "svs array<int>, svs_mask long, phases array<double>, dphase array<double>"
)


def wrap(x: np.ndarray, low: float = -math.pi) -> np.ndarray:
    return low + np.mod(x - low, 2 * math.pi)


def structures_of(x: np.ndarray, dt: float, t0: float, *, how: str, normalise: str | None, max_energy: float, min_phase: float = -math.pi) -> list[dict]:
    """The fluctuation structures of one segment of channels x samples."""
    x = x - x.mean(axis=1, keepdims=True)
    scale = np.ones(len(x))
    if normalise not in (None, "0"):
        scale = {"rms": np.sqrt(np.mean(x**2, axis=1)), "peak": np.abs(x).max(axis=1), "var": x.var(axis=1)}[normalise]
        scale = np.where(scale > 0, scale, 1.0)
        x = x / scale[:, None]
    topos, s, chronos, entropy, energy = S.decompose(x)
    if not energy > 0:
        return []
    out = []
    for k, group in enumerate(S.coherence_groups(chronos, s, how, max_energy=max_energy)):
        lead = chronos[group[0]]
        freq, at, fpkf = S.peak_frequency(lead, dt)
        part = np.einsum("gc,g,gt->ct", topos[group], s[group], chronos[group])
        phases = np.angle(np.fft.rfft(part, axis=1)[:, at]) if at >= 0 else np.full(len(x), math.nan)
        p = float(np.sum(s[group] ** 2) / energy)
        topo = topos[group[0]]
        rms = math.sqrt(float(np.mean(topo**2)))
        out.append({
            "fs_id": k, "t0": t0, "t_mid": t0 + dt * (x.shape[1] - 1) / 2, "n_channels": len(x), "freq": freq, "amp": math.sqrt(p) * math.sqrt(float(np.mean(scale**2))),
            "a12": float(s[group[1]] / s[group[0]]) if len(group) > 1 and s[group[0]] > 0 else 0.0, "p": p, "h": entropy, "e": energy,
            "cpkf": float(np.abs(topo).max() / rms) if rms > 0 else math.nan, "fpkf": fpkf, "svs": group, "svs_mask": sum(1 << g for g in group if g < 63),
            "phases": phases.tolist(), "dphase": wrap(np.diff(phases), min_phase).tolist(),
        })
    return out


def fluctuation_structures(segments: DataFrame, *, keys: Sequence[str], how: str = "geometric", normalise: str | None = "rms", max_energy: float = 1.0, min_channels: int = 2) -> DataFrame:
    """Rows of STRUCTURE behind the keys, several a segment: mean taken off, normalised, singular value decomposition, groups by cross power.

    ``segments`` has keys, seg_id, t0, dt and signal (array of arrays of one length). The unit of work is a segment, so there is no
    exchange. Segments of fewer than ``min_channels`` channels, of unequal lengths, or with unknown or NaN samples give nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), STRUCTURE])
    names = [c.split()[0] for c in STRUCTURE.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                signal = [np.asarray(c, dtype=float) for c in r.signal]
                if len(signal) < min_channels or len({len(c) for c in signal}) != 1 or len(signal[0]) < 4 or r.dt is None or not r.dt > 0:
                    continue
                x = np.stack(signal)
                if not np.isfinite(x).all():
                    continue
                for f in structures_of(x, float(r.dt), float(r.t0), how=how, normalise=normalise, max_energy=max_energy):
                    rows.append([*(getattr(r, k) for k in keys), r.seg_id, *(f[n] for n in names[1:])])
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return segments.select(*keys, "seg_id", "t0", "dt", "signal").mapInPandas(work, schema)


PEAK = "seg_id long, place int, t_mid double, freq double, peakedness double, amp double, phases array<double>, dphase array<double>"


def peaks_of(x: np.ndarray, dt: float, *, n_points: int, lower: float) -> list[tuple]:
    """(place, freq, peakedness, amp, phases, dphase) of the components of a segment of channels x samples that stand out most.

    A component's peakedness is its mean power over the channels less the mean of that power over five neighbouring components.
    """
    z = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hanning(x.shape[1]), axis=1)
    power = np.mean(np.abs(z) ** 2, axis=0)
    peaked = power - np.convolve(power, np.ones(5) / 5)[2:-2]  # as long as the spectrum; "same" gives five for shorter ones
    freq = np.fft.rfftfreq(x.shape[1], dt)
    best = np.argsort(-peaked, kind="stable")[:n_points]
    phases = np.angle(z)
    return [(k, float(freq[i]), float(peaked[i]), float(np.sqrt(power[i])), phases[:, i].tolist(), wrap(np.diff(phases[:, i])).tolist()) for k, i in enumerate(best) if freq[i] >= lower]


def spectral_features(segments: DataFrame, *, keys: Sequence[str], n_points: int = 8, lower: float = 0.0, min_channels: int = 2) -> DataFrame:
    """Rows of PEAK behind the keys: the ``n_points`` most peaked components of each segment's averaged spectrum, those below ``lower`` dropped.

    Input and left-out segments are as in fluctuation_structures; there is no exchange.
    """
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), PEAK])
    names = [c.split()[0] for c in PEAK.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                signal = [np.asarray(c, dtype=float) for c in r.signal]
                if len(signal) < min_channels or len({len(c) for c in signal}) != 1 or len(signal[0]) < 4 or r.dt is None or not r.dt > 0 or not np.isfinite(np.stack(signal)).all():
                    continue
                t_mid = float(r.t0) + float(r.dt) * (len(signal[0]) - 1) / 2
                rows += [[*(getattr(r, k) for k in keys), r.seg_id, k, t_mid, *rest] for k, *rest in peaks_of(np.stack(signal), float(r.dt), n_points=n_points, lower=lower)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return segments.select(*keys, "seg_id", "t0", "dt", "signal").mapInPandas(work, schema)


def on_arrays(df: DataFrame, column: str, kernel: Callable[..., np.ndarray], *more: str, to: str | None = None) -> DataFrame:
    """df with an array column put through a numpy kernel, row by row in Arrow batches; ``more`` columns are further arguments. Null stays null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or any(r is None for r in rs) else np.asarray(kernel(np.asarray(v, dtype=float), *rs), dtype=float).ravel().tolist() for v, *rs in zip(first, *rest, strict=True)])

    return df.withColumn(to or column, run(column, *more))


def on_stacks(df: DataFrame, column: str, kernel: Callable[[np.ndarray], np.ndarray], *, to: str | None = None) -> DataFrame:
    """The same for kernels on a matrix of rows of one length: the rows of a batch are worked on together by length. NaN and null elements make the row null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(first: pd.Series) -> pd.Series:
        rows = [None if v is None else np.asarray(v, dtype=float) for v in first]
        out: list = [None] * len(rows)
        sizes = np.array([-1 if v is None or not len(v) or not np.isfinite(v).all() else len(v) for v in rows])
        for n in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == n)
            for i, y in zip(at, kernel(np.stack([rows[i] for i in at])), strict=True):
                out[i] = y.tolist()
        return pd.Series(out, dtype=object)

    return df.withColumn(to or column, run(column))


def bandpassed(segments: DataFrame, passband: Sequence[float], stopband: Sequence[float], *, taper: int | None = None) -> DataFrame:
    """Segments of one channel with the signal within a band; dt is the segment's column of that name."""
    return on_arrays(segments, "signal", lambda v, dt: S.bandpass(v, dt, passband, stopband, taper), "dt")


def butterworthed(segments: DataFrame, order: int, edges: Sequence[float] | float, kind: str) -> DataFrame:
    """Segments filtered by a causal Butterworth filter; edges in units of the Nyquist frequency."""
    b, a = S.butterworth(order, edges, kind)
    return on_stacks(segments, "signal", lambda x: S.recursive_filter(b, a, x))


def spectrograms(segments: DataFrame, keys: Sequence[str], n: int, overlap: int) -> DataFrame:
    """keys, seg_id, window, bin, power."""
    made = on_arrays(segments, "signal", lambda v: S.spectrogram(v, n, overlap), to="power")
    rows = made.select(*keys, "seg_id", F.posexplode("power").alias("__k", "power"))
    width = n // 2 + 1
    return rows.select(*keys, "seg_id", F.expr(f"__k div {width}").cast("int").alias("window"), (F.col("__k") % width).alias("bin"), "power")


def spectral_powers(segments: DataFrame, keys: Sequence[str], channel: str, n: int) -> DataFrame:
    """keys, seg_id, channel, bin, re, im: the transform of each full segment of one channel."""
    full = segments.where(F.size("signal") == n)
    made = on_arrays(full, "signal", lambda v: np.column_stack([(f := np.fft.rfft((v - v.mean()) * np.hanning(len(v)))).real, f.imag]), to="__z")
    rows = made.select(*keys, "seg_id", channel, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda i: F.struct(F.get("__z", 2 * i).alias("re"), F.get("__z", 2 * i + 1).alias("im")))).alias("bin", "__s"))
    return rows.select(*keys, "seg_id", channel, "bin", "__s.re", "__s.im")


def coherence(transforms: DataFrame, keys: Sequence[str], channel: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """keys, channel_1, channel_2, bin, coherence, phase, n: of stated pairs of channels, averaged over segments.

    Each row is sent to the pairs that its channel is in, and a pair's two sides meet by aggregation: there is no join.
    """
    sides = F.filter(F.array(*[F.struct(F.lit(a).alias("channel_1"), F.lit(b).alias("channel_2"), F.lit(side).alias("side"), F.lit(c).alias("c")) for a, b in pairs for side, c in ((1, a), (2, b))]), lambda x: x["c"] == F.col(channel))
    rows = transforms.withColumn("__p", F.explode(sides)).select(*keys, "seg_id", "bin", "__p.channel_1", "__p.channel_2", "__p.side", "re", "im")
    pick = lambda name, side: F.max(F.when(F.col("side") == side, F.col(name)))
    met = rows.groupBy(*keys, "channel_1", "channel_2", "bin", "seg_id").agg(pick("re", 1).alias("a"), pick("im", 1).alias("b"), pick("re", 2).alias("c"), pick("im", 2).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    met = met.where("a is not null and c is not null").groupBy(*keys, "channel_1", "channel_2", "bin").agg(
        F.avg(a * c + b * d).alias("re"), F.avg(b * c - a * d).alias("im"), F.avg(a * a + b * b).alias("aa"), F.avg(c * c + d * d).alias("cc"), F.count("*").alias("n"),
    )
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return met.select(*keys, "channel_1", "channel_2", "bin", F.when(F.col("aa") * F.col("cc") > 0, power / (F.col("aa") * F.col("cc"))).alias("coherence"), F.atan2("im", "re").alias("phase"), "n")
