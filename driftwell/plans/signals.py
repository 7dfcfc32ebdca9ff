"""Queries of the array operators: structures, filters, spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import spectra, sweeps
from driftwell.operators import fluctuations as X
from driftwell.operators import mining as M
from driftwell.operators import series as S
from driftwell.plans.series import known
from driftwell.sources import table

N = 64


def by_channel(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of N samples of each series, the last ones short, one row each: series_id, seg_id, t0, dt, signal. Those of fewer than four samples have no spectrum."""
    rows = S.segment(known(spark, folder), ["series_id"], "timebase", N)
    return S.segment_arrays(rows, ["series_id"]).where((F.col("n") >= 4) & (F.col("dt") > 0))


def by_shot(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of all channels of a shot, aligned by sample number."""
    rows = S.segment(known(spark, folder), ["series_id"], "timebase", N)
    # Channels are of one length in a segment; the short last windows of channels go together where they are equally long.
    sized = rows.withColumn("length", F.count("*").over(S.Window.partitionBy("series_id", "seg_id")))
    # A channel recorded twice in a shot is two channels.
    named = sized.withColumn("channel", F.concat_ws("/", "channel", "series_id"))
    return S.segment_arrays(named, ["shot", "length"], channel="channel")


def structures(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: readings to segments to fluctuation structures."""
    return X.fluctuation_structures(by_shot(spark, folder), keys=["shot", "length"], max_energy=0.99)


def stft_features(spark: SparkSession, folder: str) -> DataFrame:
    """The eight most peaked components of each segment of a shot, with their phases."""
    return X.spectral_features(by_shot(spark, folder), keys=["shot", "length"], n_points=8, lower=5.0)


def good_structures(spark: SparkSession, folder: str) -> DataFrame:
    found = X.fluctuation_structures(by_shot(spark, folder), keys=["shot", "length"], how="threshold", max_energy=0.99).withColumn("svs", F.size("svs"))
    return M.quality(found, max_h=0.97, min_p=0.1, min_svs=1)


def _flat(df: DataFrame, name: str = "signal") -> DataFrame:
    return df.select("series_id", "seg_id", F.posexplode(name).alias("i", name))


def bandpass(spark: SparkSession, folder: str) -> DataFrame:
    """The middle of the spectrum of each segment; bands follow the segment's own step."""
    made = X.on_arrays(by_channel(spark, folder), "signal", lambda v, dt: spectra.bandpass(v, dt, (0.1 / dt, 0.2 / dt), (0.05 / dt, 0.25 / dt)), "dt")
    return _flat(made)


def butterworth(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(X.butterworthed(by_channel(spark, folder), 3, 0.2, "highpass"))


def channel_rms(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of each shot and channel after a high pass of stretches of 4096 samples, which bounds what a task holds."""
    made = X.butterworthed(S.segment_arrays(S.segment(known(spark, folder), ["shot", "channel"], "timebase", 4096), ["shot", "channel"]), 2, 0.3, "highpass")
    return made.select("shot", "channel", F.explode("signal").alias("v")).groupBy("shot", "channel").agg(F.stddev_pop("v").alias("rms"), F.count("*").alias("n"))


def spectrogram(spark: SparkSession, folder: str) -> DataFrame:
    return X.spectrograms(by_channel(spark, folder), ["series_id"], 32, 16)


def spectral_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """The three strongest components of each segment, in order of frequency."""
    made = X.on_arrays(by_channel(spark, folder), "signal", lambda v, dt: np.array(sorted(sorted(spectra.spectral_peaks(v, dt), key=lambda x: -x[1])[:3])).ravel(), "dt", to="found")
    k = F.sequence(F.lit(0), F.expr("size(found) div 2 - 1"))
    return made.where("size(found) > 0").select("series_id", "seg_id", F.explode(F.transform(k, lambda i: F.struct(F.get("found", 2 * i).alias("freq"), F.get("found", 2 * i + 1).alias("amp")))).alias("x")).select("series_id", "seg_id", "x.freq", "x.amp")


def phase(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(X.on_arrays(by_channel(spark, folder), "signal", lambda v: spectra.analytic_phase(v - v.mean())))


def coherence(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.segment_arrays(S.segment(known(spark, folder), ["shot", "channel"], "timebase", N), ["shot", "channel"])
    z = X.spectral_powers(rows, ["shot"], "channel", N)
    names = sorted(r["channel"] for r in table(spark, folder, "channels").select("channel").collect())  # the list of channels, a fixed table
    return X.coherence(z, ["shot"], "channel", list(zip(names, names[1:] + names[:1], strict=True)))


def damping(spark: SparkSession, folder: str) -> DataFrame:
    """Damping and frequency at the greatest of the pseudo-spectrum of each segment."""
    d, w = np.linspace(0.0, 0.2, 5), np.linspace(0.05, 3.1, 62)

    def best(v: np.ndarray) -> np.ndarray:
        p = spectra.damped_music(v - v.mean(), min(4, len(v) // 4), min(24, len(v) // 2), d, w)
        i, j = np.unravel_index(int(p.argmax()), p.shape)
        return np.array([d[i], w[j]])

    made = X.on_arrays(by_channel(spark, folder), "signal", best, to="x")
    return made.select("series_id", "seg_id", F.get("x", F.lit(0)).alias("damping"), F.get("x", F.lit(1)).alias("omega"))


def pulses(spark: SparkSession, folder: str) -> DataFrame:
    """The pulse of each stretch of 1024 samples of each series: start, end, and the fraction of its peak above which it is one run."""
    rows = S.segment_arrays(S.segment(known(spark, folder).withColumn("signal", F.abs("signal")), ["series_id"], "timebase", 1024), ["series_id"])

    def find(v: np.ndarray, t0: float, dt: float | None) -> np.ndarray:
        found = sweeps.longest_low(t0 + np.arange(len(v)) * (dt or 0.0), v)
        return np.array(found if found else [])

    made = X.on_arrays(rows.where("dt is not null"), "signal", find, "t0", "dt", to="x").where("size(x) = 3")
    return made.select("series_id", "seg_id", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("t_start", "t_end", "fraction"))])


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Polynomials of degree 5 over each segment as a profile, with their error."""

    def fit(v: np.ndarray) -> np.ndarray:
        c, e = sweeps.profile_quality(np.linspace(-1, 1, len(v)), v, np.full(len(v), 1 / max(np.abs(v).max(), 1e-300)))
        return np.r_[e, c if c is not None else []]

    made = X.on_arrays(by_channel(spark, folder), "signal", fit, to="x")
    return made.select("series_id", "seg_id", F.get("x", F.lit(0)).alias("error"), F.slice("x", 2, 6).alias("coefficients")).where("error < 9")


QUERIES = {f"sig_{f.__name__}": f for f in (structures, good_structures, stft_features, bandpass, butterworth, channel_rms, spectrogram, spectral_peaks, phase, coherence, damping, pulses, profiles)}
SQL: dict[str, str] = {}
