"""Time-series operators on long rows: (keys, index or time, value), each a function from DataFrame to DataFrame.

``keys`` name a stretch of samples, ``order`` is the column that orders them. All operators keep to one exchange by the keys; chained
operators with the same keys reuse it. Null values are missing samples: aggregates skip them, differences with them are null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


#: The cheap transform lengths up to 2**31.
NICE = sorted({(m << p) // 16 for p in range(32) for m in (16, 18, 20, 24, 27) if (m << p) % 16 == 0 and (m << p) // 16 <= 1 << 31})


def over(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _rounded(x: Column, digits: int) -> Column:
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def calibrate(samples: DataFrame, channels: DataFrame, *, value: str = "signal", channel: str = "channel", full_scale: str = "full_scale", gain: str | None = None) -> DataFrame:
    """Values times their channel's gain, null where NaN or beyond twice the full scale. Channels that are not listed are left as they are.

    The channel table is one row a channel; the optimiser broadcasts it if it is small.
    """
    c = channels.select(F.col(channel).alias("__ch"), F.col(full_scale).alias("__fs"), (F.col(gain) if gain else F.lit(1.0)).alias("__gain"))
    v = F.col(value) * F.coalesce("__gain", F.lit(1.0))
    ok = v.isNotNull() & ~F.isnan(v) & (F.col("__fs").isNull() | (F.abs(v) <= 2 * F.col("__fs")))
    return samples.join(c, F.col(channel) == F.col("__ch"), "left").withColumn(value, F.when(ok, v)).drop("__ch", "__fs", "__gain")


def reduce_time(samples: DataFrame, t0: float, t1: float, *, time: str = "timebase") -> DataFrame:
    """Samples with t0 <= time < t1."""
    return samples.where((F.col(time) >= t0) & (F.col(time) < t1))


def reduce_to_nice(samples: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first samples of each stretch, as many as the largest cheap transform length that it holds."""
    w = over(keys, order)
    n = F.count("*").over(Window.partitionBy(*keys))
    nice = F.lit(1)
    for k in NICE:
        nice = F.when(n >= k, F.lit(k)).otherwise(nice)
    return samples.withColumn("__i", F.row_number().over(w)).withColumn("__n", nice).where(F.col("__i") <= F.col("__n")).drop("__i", "__n")


def downsample(samples: DataFrame, keys: Sequence[str], order: str, skip: int) -> DataFrame:
    """Every ``skip``-th sample, beginning with the first; no filtering before."""
    return samples.withColumn("__i", F.row_number().over(over(keys, order)) - 1).where(F.col("__i") % skip == 0).drop("__i")


def decimate(samples: DataFrame, keys: Sequence[str], order: str, *, limit: int | None = None, fraction: float | None = None) -> DataFrame:
    """Regular decimation to about ``limit`` samples a stretch (step = max(n // limit, 1)) or to a fraction (step = 1 // fraction)."""
    step = F.lit(int(1 / fraction)) if fraction else F.greatest(F.floor(F.count("*").over(Window.partitionBy(*keys)) / F.lit(limit or 500)), F.lit(1))
    return samples.withColumn("__s", step).withColumn("__i", F.row_number().over(over(keys, order)) - 1).where(F.col("__i") % F.col("__s") == 0).drop("__i", "__s")


def segment(samples: DataFrame, keys: Sequence[str], order: str, n: int, *, overlap: float = 1.0) -> DataFrame:
    """Rows with seg_id and seg_i: windows of n samples that begin at int(k * n / overlap + 0.5); the last windows may be short."""
    if n < 1 or overlap < 1:
        raise ValueError("n and overlap are at least 1")
    step = n / overlap
    i = F.col("__i")
    first = F.greatest(F.lit(0), F.floor((i - n) / F.lit(step)))
    rows = samples.withColumn("__i", F.row_number().over(over(keys, order)) - 1).withColumn("seg_id", F.explode(F.sequence(first.cast("long"), F.floor((i + 1) / F.lit(step)).cast("long"))))
    start = F.floor(F.col("seg_id") * F.lit(step) + 0.5)
    return rows.withColumn("seg_i", i - start).where((F.col("seg_i") >= 0) & (F.col("seg_i") < n)).drop("__i")


def segment_arrays(segmented: DataFrame, keys: Sequence[str], *, channel: str | None = None, time: str = "timebase", value: str = "signal") -> DataFrame:
    """One row a segment: keys, seg_id, t0, dt, n, and signal as an array, or with ``channel`` as one array a channel in order of names."""
    by = [*keys, "seg_id"]
    one = segmented.groupBy(*by, *([channel] if channel else [])).agg(
        F.sort_array(F.collect_list(F.struct("seg_i", F.col(time).alias("t"), F.col(value).alias("v")))).alias("__r")
    )
    t = lambda r, k: F.element_at(r, k)["t"]
    one = one.select(
        *by, *([channel] if channel else []), t(F.col("__r"), 1).alias("t0"), F.size("__r").alias("n"),
        F.when(F.size("__r") > 1, (t(F.col("__r"), -1) - t(F.col("__r"), 1)) / (F.size("__r") - 1)).alias("dt"), F.transform("__r", lambda x: x["v"]).alias("signal"),
    )
    if not channel:
        return one
    return one.groupBy(*by).agg(
        F.min("t0").alias("t0"), F.avg("dt").alias("dt"), F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct(channel, "signal"))).alias("__c")
    ).select(*by, "t0", "dt", "n", F.transform("__c", lambda x: x[channel]).alias("channels"), F.transform("__c", lambda x: x["signal"]).alias("signal"))


def contiguous(samples: DataFrame, keys: Sequence[str], *, time: str = "timebase", tolerance: float = 0.1) -> DataFrame:
    """Stretches whose steps all lie within ``tolerance`` steps of the first one; the others are dropped whole."""
    d = F.col(time) - F.lag(time).over(over(keys, time))
    rows = samples.withColumn("__d", d)
    stats = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by("__d", F.when(F.col("__d").isNotNull(), F.col(time))).alias("__s"), F.max("__d").alias("__hi"), F.min("__d").alias("__lo"))
    good = stats.where((F.greatest(F.abs(F.col("__hi") - F.col("__s")), F.abs(F.col("__lo") - F.col("__s"))) < tolerance * F.col("__s")) | F.col("__s").isNull())
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return samples.join(good, on, "left_semi")


def subtract_mean(samples: DataFrame, keys: Sequence[str], *, value: str = "signal") -> DataFrame:
    return samples.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def normalise(samples: DataFrame, keys: Sequence[str], *, channel: str = "channel", value: str = "signal", method: str | None = "rms", separate: bool = False) -> DataFrame:
    """Values over the rms, peak or variance of their channel, or (not ``separate``) over the greatest of any channel of the keys; '0' leaves them."""
    if method in ("0", 0):
        return samples
    v = F.col(value)
    of = {"rms": F.sqrt(F.avg(v * v)), "peak": F.max(F.abs(v)), "var": F.var_pop(v)}
    by = [*keys, channel]
    # One row a channel, summed in the tasks first, so that a shot that holds much of the table is never brought together.
    norm = samples.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(of[method or "rms"].alias("__n"))
    if not separate:
        norm = norm.withColumn("__n", F.max("__n").over(Window.partitionBy(*[f"__{k}" for k in keys])))
    rows = samples.join(norm, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    return rows.withColumn(value, F.when(F.col("__n") != 0, v / F.col("__n"))).drop("__n", *[f"__{k}" for k in by])


def integrate(samples: DataFrame, keys: Sequence[str], *, time: str = "timebase", value: str = "signal") -> DataFrame:
    """Running sum times the mean step."""
    whole = Window.partitionBy(*keys)
    step = (F.max(time).over(whole) - F.min(time).over(whole)) / F.nullif(F.count("*").over(whole) - 1, F.lit(0))
    return samples.withColumn("integral", F.sum(value).over(over(keys, time).rowsBetween(Window.unboundedPreceding, 0)) * step)


def remove_baseline(samples: DataFrame, keys: Sequence[str], *, ends: float, time: str = "timebase", value: str = "signal") -> DataFrame:
    """Minus the straight line through the mean points of the first and last ``ends`` of time (closed at both)."""
    whole = Window.partitionBy(*keys)
    t, v = F.col(time), F.col(value)
    rows = samples.withColumn("__a", F.min(time).over(whole)).withColumn("__b", F.max(time).over(whole))
    head, tail = t <= F.col("__a") + ends, t >= F.col("__b") - ends
    mean = lambda c, cond: F.avg(F.when(cond, c)).over(whole)
    rows = rows.withColumn("__t0", mean(t, head)).withColumn("__t1", mean(t, tail)).withColumn("__v0", mean(v, head)).withColumn("__v1", mean(v, tail))
    slope = F.when(F.col("__t1") > F.col("__t0"), (F.col("__v1") - F.col("__v0")) / (F.col("__t1") - F.col("__t0"))).otherwise(0.0)
    return rows.withColumn(value, v - (F.col("__v0") + slope * (t - F.col("__t0")))).drop("__a", "__b", "__t0", "__t1", "__v0", "__v1")


def remove_level(samples: DataFrame, keys: Sequence[str], *, t0: float, t1: float, time: str = "timebase", value: str = "signal") -> DataFrame:
    """Minus the mean over t0 <= time <= t1; null where there is no sample in it."""
    inside = (F.col(time) >= t0) & (F.col(time) <= t1)
    return samples.withColumn(value, F.col(value) - F.avg(F.when(inside, F.col(value))).over(Window.partitionBy(*keys)))


def remove_tilt(samples: DataFrame, keys: Sequence[str], *, first: tuple[float, float], last: tuple[float, float], time: str = "timebase", value: str = "signal") -> DataFrame:
    """Minus the straight line through the mean points of two stretches of time (closed at both ends); null where one of them has no sample."""
    whole = Window.partitionBy(*keys)
    t, v = F.col(time), F.col(value)
    mean = lambda c, span: F.avg(F.when((t >= span[0]) & (t <= span[1]) & v.isNotNull(), c)).over(whole)
    rows = samples.withColumns({"__t0": mean(t, first), "__t1": mean(t, last), "__v0": mean(v, first), "__v1": mean(v, last)})
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) / F.nullif(F.col("__t1") - F.col("__t0"), F.lit(0.0)) * (t - F.col("__t0"))
    return rows.withColumn(value, v - line).drop("__t0", "__t1", "__v0", "__v1")


def smooth(samples: DataFrame, keys: Sequence[str], order: str, n: int, *, value: str = "signal", mode: str = "valid", times: int = 1) -> DataFrame:
    """Top-hat mean of n samples, ``times`` times. 'valid': only full windows; 'causal': of the last n; 'keep': all samples, cut windows at the ends."""
    lo, hi = (-(n - 1), 0) if mode == "causal" else (-((n - 1) // 2), n // 2)
    for _ in range(times):
        w = over(keys, order).rowsBetween(lo, hi)
        samples = samples.withColumn("__c", F.count("*").over(w)).withColumn(value, F.avg(value).over(w))
        samples = (samples if mode == "keep" else samples.where(F.col("__c") == n)).drop("__c")
    return samples


def cross_correl(pairs: DataFrame, keys: Sequence[str], order: str, n: int, x: str, y: str) -> DataFrame:
    """smooth(xy) / sqrt(smooth(xx) smooth(yy)) over windows of n."""
    w = over(keys, order).rowsBetween(-((n - 1) // 2), n // 2)
    a, b = F.col(x), F.col(y)
    d = F.sqrt(F.avg(a * a).over(w) * F.avg(b * b).over(w))
    return pairs.withColumn("__c", F.count("*").over(w)).withColumn("correlation", F.when(d > 0, F.avg(a * b).over(w) / d)).where(F.col("__c") == n).drop("__c")


def derivative(samples: DataFrame, keys: Sequence[str], *, time: str = "timebase", value: str = "signal") -> DataFrame:
    """t_mid and ddt between each sample and the next."""
    w = over(keys, time)
    dt = F.lead(time).over(w) - F.col(time)
    return samples.select(*keys, (F.col(time) + dt / 2).alias("t_mid"), F.when(dt != 0, (F.lead(value).over(w) - F.col(value)) / dt).alias("ddt")).where("t_mid is not null")


def second_derivative(samples: DataFrame, keys: Sequence[str], *, time: str = "timebase", value: str = "signal", factor: float = 4e-6) -> DataFrame:
    """t_mid and ddt2 = factor * value * |slope|, with the slope between each sample and the next over the mean step of the stretch."""
    w, whole = over(keys, time), Window.partitionBy(*keys)
    step = (F.max(time).over(whole) - F.min(time).over(whole)) / F.nullif(F.count("*").over(whole) - 1, F.lit(0))
    slope = (F.lead(value).over(w) - F.col(value)) / F.nullif(step, F.lit(0.0))
    return samples.select(*keys, ((F.col(time) + F.lead(time).over(w)) / 2).alias("t_mid"), (F.lit(factor) * F.col(value) * F.abs(slope)).alias("ddt2")).where("t_mid is not null")


def unwrap(samples: DataFrame, keys: Sequence[str], order: str, *, phase: str) -> DataFrame:
    """Phases without jumps of more than pi: 2 pi is added after a fall of more than pi and taken away after such a rise."""
    d = F.col(phase) - F.lag(phase).over(over(keys, order))
    turn = F.when(d < -math.pi, 2 * math.pi).when(d > math.pi, -2 * math.pi).otherwise(0.0)
    return samples.withColumn("__k", turn).withColumn(phase, F.col(phase) + F.sum("__k").over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("__k")


def find_peaks(samples: DataFrame, keys: Sequence[str], order: str, *, value: str = "signal", min_ratio: float = 0.0) -> DataFrame:
    """Samples where the slope turns from up to down; a flat top counts once, at its first sample. Values at or below min_ratio * max are none."""
    w = over(keys, order)
    runs = samples.where(F.col(value).isNotNull()).withColumn("__p", F.lag(value).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(value)))
    runs = runs.withColumn("__n", F.lead(value).over(w)).withColumn("__m", F.max(value).over(Window.partitionBy(*keys)))
    return runs.where((F.col("__p") < F.col(value)) & (F.col("__n") < F.col(value)) & (F.col(value) > min_ratio * F.col("__m"))).drop("__p", "__n", "__m")


def fold(samples: DataFrame, keys: Sequence[str], order: str, period: float, *, value: str = "signal", offset: int = 0) -> DataFrame:
    """Synchronous average: samples folded by a period, which may be fractional, and averaged at each place of the whole period."""
    i = F.row_number().over(over(keys, order)) - 1 - offset
    rows = samples.withColumn("__i", i).where(F.col("__i") >= 0).withColumn("place", (F.col("__i") - F.floor(F.floor(F.col("__i") / F.lit(period)) * F.lit(period))).cast("int"))
    return rows.where(F.col("place") < int(period)).groupBy(*keys, "place").agg(F.avg(value).alias("folded"), F.count(value).alias("n"))


def shift(samples: DataFrame, keys: Sequence[str], order: str, by: int, *, value: str = "signal") -> DataFrame:
    """Each value moved ``by`` samples later; the first are null."""
    return samples.withColumn(value, F.lag(value, by).over(over(keys, order)) if by >= 0 else F.lead(value, -by).over(over(keys, order)))


def delta_decode(samples: DataFrame, keys: Sequence[str], order: str, *, value: str, start: Column | float = 0.0, quantum: Column | float = 1.0) -> DataFrame:
    """start + quantum * running sum of the differences."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return samples.withColumn(value, as_col(start) + as_col(quantum) * F.sum(value).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def regular_times(samples: DataFrame, keys: Sequence[str], order: str, *, time: str, digits: int = 6) -> DataFrame:
    """Repairs times: x0 + k * step with each stretch's commonest step; ``repaired`` and ``off`` (in steps) are added."""
    w = over(keys, order)
    d = samples.withColumn("__d", _rounded(F.col(time) - F.lag(time).over(w), digits)).withColumn("__k", F.row_number().over(w) - 1)
    common = d.where("__d is not null").groupBy(*keys, "__d").count()
    best = common.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by("__d", F.struct("count", -F.col("__d"))).alias("__step"))
    rows = d.withColumn("__x0", F.first(time).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(best, [F.col(k) == F.col(f"__{k}") for k in keys])
    fixed = F.col("__x0") + F.col("__k") * F.col("__step")
    return rows.withColumn("repaired", fixed).withColumn("off", F.when(F.col("__step") != 0, F.abs(F.col(time) - fixed) / F.col("__step"))).drop("__d", "__k", "__x0", "__step", *[f"__{k}" for k in keys])


def step_counts(samples: DataFrame, keys: Sequence[str], *, time: str, digits: int = 5, top: int = 5) -> DataFrame:
    """The commonest steps of time of each stretch: step, n, place."""
    d = samples.select(*keys, _rounded(F.col(time) - F.lag(time).over(over(keys, time)), digits).alias("step")).where("step is not null")
    n = d.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(over(keys, F.desc("n"), "step"))).where(F.col("place") <= top)


def crossings(pairs: DataFrame, keys: Sequence[str], *, time: str, a: str, b: str) -> DataFrame:
    """Times where curve a crosses curve b, by straight lines between the samples."""
    d = F.col(a) - F.col(b)
    rows = pairs.where(d.isNotNull()).select(*keys, F.col(time).alias("__t"), d.alias("__d")).withColumn("__pt", F.lag("__t").over(over(keys, "__t"))).withColumn("__pd", F.lag("__d").over(over(keys, "__t")))
    hit = (F.col("__pd") * F.col("__d") < 0) | ((F.col("__d") == 0) & (F.col("__pd") != 0))
    return rows.where(hit).select(*keys, (F.col("__pt") + (F.col("__t") - F.col("__pt")) * F.col("__pd") / (F.col("__pd") - F.col("__d"))).alias("t_cross"))


def trapezoid(samples: DataFrame, keys: Sequence[str], *, x: str, y: str) -> DataFrame:
    """Integral of y over x by trapezoids; null and NaN points are left out."""
    good = samples.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    w = over(keys, x, y)
    part = (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2
    return good.select(*keys, part.alias("__p")).groupBy(*keys).agg(F.coalesce(F.sum("__p"), F.lit(0.0)).alias("integral"))


def pulse_times(samples: DataFrame, keys: Sequence[str], *, time: str = "timebase", value: str = "signal", n: int = 8, threshold: float = 0.5, part: float = 0.7) -> DataFrame:
    """t_start, t_end: first and last time about which the signal is on: its rms without the slow part, over n samples, exceeds ``threshold`` of
    its mean power in more than ``part`` of the 2 * n samples around.
    """
    w = over(keys, time).rowsBetween(-((n - 1) // 2), n // 2)
    rows = samples.where(F.col(value).isNotNull()).withColumn("__f", F.col(value) - F.avg(value).over(w)).withColumn("__p", F.avg(F.col("__f") * F.col("__f")).over(w))
    rows = rows.withColumn("__m", F.avg("__p").over(Window.partitionBy(*keys)))
    twice = over(keys, time).rowsBetween(-n, n - 1)
    rows = rows.withColumn("__on", F.avg(F.when(F.col("__p") > threshold * F.col("__m"), 1.0).otherwise(0.0)).over(twice))
    return rows.where(F.col("__on") > part).groupBy(*keys).agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count("*").alias("n_on"))


def flat_top(samples: DataFrame, keys: Sequence[str], *, time: str = "timebase", value: str = "signal", fraction: float = 0.9) -> DataFrame:
    """t_from, t_to: the longest run in which the magnitude stays at or above ``fraction`` of the 95th percentile of magnitudes."""
    v = F.abs(F.col(value))
    top = samples.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.percentile(v, 0.95).alias("__top"))
    rows = samples.where(F.col(value).isNotNull()).join(top, [F.col(k) == F.col(f"__{k}") for k in keys]).withColumn("__on", v >= fraction * F.col("__top"))
    w = over(keys, time)
    rows = rows.withColumn("__g", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__on")
    runs = rows.groupBy(*keys, "__g").agg(F.min(time).alias("t_from"), F.max(time).alias("t_to"), F.count("*").alias("n"))
    return runs.withColumn("__r", F.row_number().over(over(keys, F.desc("n"), "t_from"))).where("__r = 1").drop("__r", "__g")


def islands(samples: DataFrame, keys: Sequence[str], order: str, on: Column) -> DataFrame:
    """Rows where ``on`` holds, with ``island``: the number of their unbroken run."""
    w = over(keys, order)
    edge = F.when(on & ~F.coalesce(F.lag(on).over(w), F.lit(False)), 1).otherwise(0)
    return samples.withColumn("__on", on).withColumn("__e", edge).withColumn("island", F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__on").drop("__on", "__e")


def gated_means(samples: DataFrame, keys: Sequence[str], *, time: str, clock: str, values: Sequence[str]) -> DataFrame:
    """Means of time and values over each interval in which the clock is above its own mean, by more than rounding."""
    rows = samples.withColumn("__high", F.coalesce(F.col(clock) - 1e-9 > F.avg(clock).over(Window.partitionBy(*keys)), F.lit(False)))
    return islands(rows, keys, time, F.col("__high")).groupBy(*keys, "island").agg(F.avg(time).alias("t_mean"), *[F.avg(v).alias(f"{v}_mean") for v in values], F.count("*").alias("n"))
