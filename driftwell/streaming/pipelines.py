"""Streams of readings: windows with late data, sessions, and segments to fluctuation structures as they fill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.functions.spectra import peak_frequency


def event_time(df: DataFrame, column: str) -> DataFrame:
    """The column as a timestamp with zone, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed(df: DataFrame, *, time: str, keys: list[str], value: str, length: str, step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, keys, n, mean, lowest, highest of tumbling or sliding windows; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, length, step) if step else F.window(time, length)
    out = event_time(df, time).withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "mean", "lowest", "highest")


def sessions(df: DataFrame, *, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """start, end, keys, n of runs of rows with no pause of ``gap``."""
    out = event_time(df, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def segment_features(df: DataFrame, *, key: str, time: str, value: str, n: int) -> DataFrame:
    """key, t0, mean, rms, freq of each n samples of a key as they come; what is left over waits in the state, at most n - 1 samples.

    Samples count in order of arrival, and of time within a batch.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, v = (list(x) for x in state.get) if state.exists else ([], [])
        for b in batches:
            b = b.sort_values(time)
            t += b[time].astype(float).tolist()
            v += b[value].astype(float).tolist()
        out = []
        while len(v) >= n:
            x, s = np.array(v[:n]), np.array(t[:n])
            dt = (s[-1] - s[0]) / (n - 1) if n > 1 else 0.0
            freq = peak_frequency(x - x.mean(), dt)[0] if dt > 0 else float("nan")
            out.append((k[0], float(s[0]), float(x.mean()), float(np.sqrt(np.mean((x - x.mean()) ** 2))), freq))
            t, v = t[n:], v[n:]
        state.update((t, v))
        yield pd.DataFrame(out, columns=[key, "t0", "mean", "rms", "freq"])

    rows = df.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select(key, time, value)
    return rows.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, t0 double, mean double, rms double, freq double", "t array<double>, v array<double>", "append", GroupStateTimeout.NoTimeout)
