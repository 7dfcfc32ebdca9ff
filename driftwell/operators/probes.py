"""Swept-probe fits: quality, density, power, clipping, and per-shot summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.fitting import fit_curve, fit_probe
from driftwell.operators.mining import finite

#: Electron charge over the square root of the ion mass, as used for the ion saturation current: density in 1e18 m**-3 of area in m**2.
SATURATION = 1.0 / (1.602e-19 * 0.6 * math.sqrt(1.602e-19 / 1.673e-27) * 1e18)
MU0 = 4e-7 * math.pi
PROTON = 1.67262192e-27


def good_fits(fits: DataFrame, *, lpf: float = 100.0) -> DataFrame:
    """Fits with a small residual that ended by themselves, and with sane parameters; NaN or null parameters are not good."""
    te, vf, resid = finite("te"), finite("vf"), finite("resid")
    ok = (resid < 0.7 * math.sqrt(lpf / 100)) & (F.col("nits") < F.col("maxits")) & (F.abs(vf) < 200) & (F.abs(te) < 200) & (finite("i0") > 4e-4)
    return fits.where(ok)


def density(i0: Column, te: Column, area: float) -> Column:
    """Density in 1e18 m**-3 from the ion saturation current."""
    return F.when(te > 0, F.lit(SATURATION / area) * i0 / F.sqrt(te))


def power(i0: Column, vf: Column, te: Column, sin_theta: float = 1.0) -> Column:
    return i0 * (vf + 4 * te) * sin_theta


def alfven_speed(b: Column, ne18: Column) -> Column:
    """Speed in m/s at field b (T) and density ne18 (1e18 m**-3)."""
    return F.when(ne18 > 0, b / F.sqrt(ne18 * (MU0 * 1e18 * PROTON)))


def summary(df: DataFrame, keys: Sequence[str], value: str, time: str, *, percent: float = 97.0) -> DataFrame:
    """One row a key: peak, raw peak and its time, signed peak, spread, mean, integral, number.

    The peak is the magnitude below which ``percent`` of them lie: element n - 1 - round((100 - percent) / 100 * n) in ascending order.
    """
    v = finite(value)
    rows = df.select(*keys, F.col(time).alias("__t"), v.alias("__v")).where("__v is not null and __t is not null")
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy(F.abs("__v"), "__t")) - 1).withColumn("__n", F.count("*").over(w)).withColumn("__d", F.lead("__t").over(w.orderBy("__t", "__v")) - F.col("__t"))
    at = F.greatest(F.lit(0), F.col("__n") - 1 - F.floor((100.0 - percent) / 100.0 * F.col("__n") + 0.5))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("__i") == at, F.abs("__v"))).alias("peak"), F.max(F.abs("__v")).alias("raw_peak"), F.max_by("__t", F.struct(F.abs("__v"), -F.col("__t"))).alias("t_peak"),
        F.max_by("__v", F.struct(F.abs("__v"), -F.col("__t"))).alias("signed_peak"), F.stddev_pop("__v").alias("std"), F.avg("__v").alias("average"), (F.avg("__d") * F.sum("__v")).alias("integral"),
    )


def calibration(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Straight line of y on x of each key: slope, intercept, residual (rms)."""
    rows = df.select(*keys, finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), (F.regr_syy("y", "x")).alias("__y"), F.regr_sxy("y", "x").alias("__xy"), F.regr_sxx("y", "x").alias("__x"))
    rss = F.col("__y") - F.when(F.col("__x") > 0, F.col("__xy") * F.col("__xy") / F.col("__x")).otherwise(0.0)
    return s.select(*keys, "n", "slope", "intercept", F.sqrt(F.greatest(F.lit(0.0), rss) / F.col("n")).alias("residual"))


def clip_limits(df: DataFrame, keys: Sequence[str], value: str, *, bins: int = 50, factor: float = 3.0) -> DataFrame:
    """keys, low, high: ends beyond which samples are clipped; an end bin fuller than ``factor`` times its neighbour is one of clipped samples."""
    v = df.select(*keys, finite(value).alias("v")).where("v is not null")
    ends = v.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("v").alias("__a"), F.max("v").alias("__b"))
    b = F.least(F.floor((F.col("v") - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins), F.lit(bins - 1)).cast("int")
    at = v.join(ends, [F.col(k) == F.col(f"__{k}") for k in keys]).withColumn("__i", F.when(F.col("__b") > F.col("__a"), b).otherwise(0))
    n = lambda i: F.sum((F.col("__i") == i).cast("long"))
    s = at.groupBy(*keys, "__a", "__b").agg(n(0).alias("n0"), n(1).alias("n1"), n(bins - 2).alias("n2"), n(bins - 1).alias("n3"))
    step = (F.col("__b") - F.col("__a")) / bins
    low, high = F.when(F.col("n0") > factor * F.col("n1"), F.col("__a") + step).otherwise(F.col("__a")), F.when(F.col("n3") > factor * F.col("n2"), F.col("__b") - step).otherwise(F.col("__b"))
    return s.select(*keys, low.alias("low"), high.alias("high"))


def saturation_level(df: DataFrame, keys: Sequence[str], value: str, *, bins: int = 20) -> DataFrame:
    """keys, level: from the fullest bin of the values below their mean outwards, the first bin below a third of it, at its upper edge."""
    v = df.select(*keys, finite(value).alias("v")).where("v is not null")
    means = v.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.avg("v").alias("__m"), F.min("v").alias("__a"))
    low = v.join(means, [F.col(k) == F.col(f"__{k}") for k in keys]).where((F.col("v") <= F.col("__m")) & (F.col("__m") > F.col("__a")))
    at = low.withColumn("i", F.least(F.floor((F.col("v") - F.col("__a")) / (F.col("__m") - F.col("__a")) * bins), F.lit(bins - 1)).cast("int"))
    n = at.groupBy(*keys, "i").agg(F.count("*").alias("n"), F.min(F.col("__a") + (F.col("i") + 1) * (F.col("__m") - F.col("__a")) / bins).alias("edge"))
    w = Window.partitionBy(*keys)
    top = n.withColumn("__p", F.max("n").over(w)).withColumn("__pi", F.max_by("i", F.struct("n", "i")).over(w))
    return top.where((F.col("i") < F.col("__pi")) & (F.col("n") < F.col("__p") / 3)).groupBy(*keys).agg(F.max("edge").alias("level"))


def fit_sweeps(samples: DataFrame, keys: Sequence[str], *, voltage: str, current: str, norm: float = 2.0) -> DataFrame:
    """One fit of each key's samples: te, vf, i0, errors, resid, nits. A key is one sweep of one channel, of bounded length; a key that cannot be fitted gives nulls."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    names = ["te", "vf", "i0", "e_te", "e_vf", "e_i0", "resid"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in names), "nits int"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        try:
            f = fit_probe(pdf[voltage].to_numpy(dtype=float), pdf[current].to_numpy(dtype=float), norm=norm)
        except (ValueError, ArithmeticError):
            f = {**dict.fromkeys(names), "nits": None}
        return pd.DataFrame([{**head, **f}])[[*keys, *names, "nits"]].astype({"nits": "Int32"})

    return samples.select(*keys, voltage, current).groupBy(*keys).applyInPandas(work, schema)


def fit_curves(samples: DataFrame, keys: Sequence[str], name: str, *, x: str, y: str) -> DataFrame:
    """keys, parameters, residual of a named curve (see fitting.CURVES) for each key's bounded set of points; nulls where it cannot be fitted."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        p = pdf.sort_values(x)
        try:
            q, r = fit_curve(name, p[x].to_numpy(dtype=float), p[y].to_numpy(dtype=float))
            return pd.DataFrame([{**head, "parameters": q.tolist(), "residual": r}])
        except (ValueError, ArithmeticError):
            return pd.DataFrame([{**head, "parameters": None, "residual": None}])

    return samples.select(*keys, x, y).groupBy(*keys).applyInPandas(work, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "parameters array<double>", "residual double"]))
