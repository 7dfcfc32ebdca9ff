"""Queries of the time-series operators over all readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import series as S
from driftwell.sources import table

KEYS = ["series_id"]


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Each reading once, calibrated, with a known time; brought together by series, which all operators on series then keep to."""
    r = table(spark, folder, "timeseries").select("sample_id", "series_id", "shot", "channel", "i", "timebase", "signal").where("timebase is not null")
    r = r.repartition("series_id").dropDuplicates(["series_id", "sample_id"])
    return S.calibrate(r, table(spark, folder, "channels"))


def known(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).where("signal is not null")


def f32(name: str, to: str | None = None):
    """A sum in single precision, so that the order of summing doesn't show."""
    return F.col(name).cast("float").alias(to or name)


def calibrated(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).groupBy("channel").agg(F.count("*").alias("n"), F.count("signal").alias("n_known"), F.min("signal").alias("lowest"), F.max("signal").alias("highest"))


def reduce_time(spark: SparkSession, folder: str) -> DataFrame:
    return S.reduce_time(readings(spark, folder), -0.25, 0.25).select("sample_id", "signal")


def reduce_to_nice(spark: SparkSession, folder: str) -> DataFrame:
    return S.reduce_to_nice(readings(spark, folder), KEYS, "timebase").groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("timebase").alias("t_end"))


def downsample(spark: SparkSession, folder: str) -> DataFrame:
    return S.downsample(readings(spark, folder), KEYS, "timebase", 8).select("sample_id", "signal")


def decimate(spark: SparkSession, folder: str) -> DataFrame:
    return S.decimate(readings(spark, folder), KEYS, "timebase", limit=50).select("sample_id", "signal")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.segment(readings(spark, folder), KEYS, "timebase", 64, overlap=1.5)
    return rows.groupBy(*KEYS, "seg_id").agg(F.count("*").alias("n"), F.min("timebase").alias("t0"), F.avg("signal").cast("float").alias("mean"), F.min("seg_i").alias("first_i"))


def segment_arrays(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.segment_arrays(S.segment(readings(spark, folder), KEYS, "timebase", 64), KEYS)
    return rows.select("series_id", "seg_id", "t0", "n", f32("dt"), F.element_at("signal", 1).alias("first_value"), F.element_at("signal", -1).alias("last_value"))


def contiguous(spark: SparkSession, folder: str) -> DataFrame:
    return S.contiguous(readings(spark, folder), KEYS, tolerance=1.5).groupBy(*KEYS).agg(F.count("*").alias("n"))


def subtract_mean(spark: SparkSession, folder: str) -> DataFrame:
    return S.subtract_mean(readings(spark, folder), KEYS).select("sample_id", (F.round("signal", 5) + 0.0).alias("signal"))


def normalise(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for method in ("rms", "peak", "var"):
        for separate in (True, False):
            part = S.normalise(known(spark, folder), ["shot"], method=method, separate=separate).groupBy("shot", "channel").agg(F.max("signal").cast("float").alias("highest"))
            part = part.select(F.lit(f"{method}/{separate}".lower()).alias("method"), "shot", "channel", "highest")
            out = part if out is None else out.unionByName(part)
    return out


def integrate(spark: SparkSession, folder: str) -> DataFrame:
    return S.integrate(readings(spark, folder), KEYS).select("sample_id", f32("integral"))


def remove_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return S.remove_baseline(known(spark, folder), KEYS, ends=0.02).select("sample_id", (F.round("signal", 4) + 0.0).alias("signal"))


def smooth(spark: SparkSession, folder: str) -> DataFrame:
    r = known(spark, folder)
    parts = [S.smooth(r, KEYS, "timebase", 7, mode=m).select(F.lit(m).alias("mode"), "sample_id", f32("signal")) for m in ("valid", "causal", "keep")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def smooth_twice(spark: SparkSession, folder: str) -> DataFrame:
    return S.smooth(known(spark, folder), KEYS, "timebase", 5, times=2).select("sample_id", f32("signal"))


def cross_correl(spark: SparkSession, folder: str) -> DataFrame:
    r = known(spark, folder).withColumn("late", F.lag("signal", 3).over(S.over(KEYS, "timebase"))).where("late is not null")
    return S.cross_correl(r, KEYS, "timebase", 16, "signal", "late").select("sample_id", F.round("correlation", 5).alias("correlation"))


def derivative(spark: SparkSession, folder: str) -> DataFrame:
    return S.derivative(known(spark, folder), KEYS).select("series_id", "t_mid", f32("ddt"))


def remove_level(spark: SparkSession, folder: str) -> DataFrame:
    return S.remove_level(known(spark, folder), KEYS, t0=-0.5, t1=0.25).select("sample_id", (F.round("signal", 4) + 0.0).alias("signal"))


def remove_tilt(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.remove_tilt(known(spark, folder), KEYS, first=(-0.5, 0.1), last=(0.3, 0.6))
    return rows.groupBy("series_id").agg(F.count("signal").alias("n"), (F.round(F.max("signal"), 3) + 0.0).alias("highest"))


def second_derivative(spark: SparkSession, folder: str) -> DataFrame:
    return S.second_derivative(known(spark, folder), KEYS).select("series_id", "t_mid", f32("ddt2"))


def unwrap(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "features").where("fs_time is not null").select("indx", "shot", "campaign", "fs_time", F.get("phases", F.lit(0)).cast("double").alias("phase")).where("phase is not null")
    f = f.withColumn("at", F.struct("fs_time", "indx"))
    return S.unwrap(f, ["shot", "campaign"], "at", phase="phase").select("indx", F.round("phase", 4).alias("phase"))


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    return S.find_peaks(known(spark, folder), KEYS, "timebase", min_ratio=0.5).select("sample_id", "signal")


def fold(spark: SparkSession, folder: str) -> DataFrame:
    return S.fold(known(spark, folder), KEYS, "timebase", 16.5).select("series_id", "place", f32("folded"), "n")


def shift(spark: SparkSession, folder: str) -> DataFrame:
    return S.shift(readings(spark, folder), KEYS, "timebase", 3).select("sample_id", "signal")


def delta_decode(spark: SparkSession, folder: str) -> DataFrame:
    r = known(spark, folder).withColumn("delta", F.round((F.col("signal") - F.lag("signal").over(S.over(KEYS, "timebase"))) * 1000).cast("long")).withColumn("delta", F.coalesce("delta", F.lit(0)))
    return S.delta_decode(r, KEYS, "timebase", value="delta", quantum=1).select("sample_id", "delta")


def regular_times(spark: SparkSession, folder: str) -> DataFrame:
    return S.regular_times(readings(spark, folder), KEYS, "timebase", time="timebase", digits=4).select("sample_id", f32("repaired"), f32("off"))


def step_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.step_counts(readings(spark, folder), KEYS, time="timebase", digits=4)


def crossings(spark: SparkSession, folder: str) -> DataFrame:
    r = known(spark, folder).withColumn("level", F.avg("signal").over(S.over(KEYS, "timebase").rowsBetween(-15, 0)))
    return S.crossings(r, KEYS, time="timebase", a="signal", b="level").groupBy(*KEYS).agg(F.count("*").alias("n"), f32_of_sum("t_cross"))


def f32_of_sum(name: str):
    return F.round(F.sum(name), 4).alias(f"sum_{name}")


def trapezoid(spark: SparkSession, folder: str) -> DataFrame:
    return S.trapezoid(readings(spark, folder), KEYS, x="timebase", y="signal").select("series_id", F.round("integral", 5).alias("integral"))


def pulse_times(spark: SparkSession, folder: str) -> DataFrame:
    return S.pulse_times(readings(spark, folder), KEYS)


def flat_top(spark: SparkSession, folder: str) -> DataFrame:
    return S.flat_top(readings(spark, folder), KEYS).select("series_id", "t_from", "t_to", "n")


def gated_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.gated_means(known(spark, folder), KEYS, time="timebase", clock="signal", values=["signal"])
    return rows.select("series_id", "island", f32("t_mean"), f32("signal_mean"), "n")


QUERIES = {f"ts_{f.__name__}": f for f in (
    calibrated, reduce_time, reduce_to_nice, downsample, decimate, segments, segment_arrays, contiguous, subtract_mean, normalise, integrate, remove_baseline, smooth, smooth_twice,
    cross_correl, derivative, remove_level, remove_tilt, second_derivative, unwrap, peaks, fold, shift, delta_decode, regular_times, step_counts, crossings, trapezoid, pulse_times, flat_top, gated_means,
)}

_C = """WITH c AS (SELECT DISTINCT sample_id, series_id, shot, channel, i, timebase,
    CASE WHEN signal IS NOT NULL AND NOT isnan(signal) AND abs(signal) <= 2 * full_scale THEN signal END AS signal
    FROM timeseries JOIN channels USING (channel) WHERE timebase IS NOT NULL), k AS (SELECT * FROM c WHERE signal IS NOT NULL)"""
_W = "PARTITION BY series_id ORDER BY timebase"
_I = f"row_number() OVER ({_W}) - 1"
#: Lengths 2**p * {16, 18, 20, 24, 27} / 16 and powers of two.
_NICE = "SELECT DISTINCT CAST(x AS BIGINT) m FROM (SELECT pow(2, p) * f / 16.0 x FROM range(0, 24) t(p), (VALUES (16), (18), (20), (24), (27)) u(f)) WHERE x = floor(x)"

SQL = {
    "ts_calibrated": f"{_C} SELECT channel, count(*) n, count(signal) n_known, min(signal) lowest, max(signal) highest FROM c GROUP BY channel",
    "ts_reduce_time": f"{_C} SELECT sample_id, signal FROM c WHERE timebase >= -0.25 AND timebase < 0.25",
    "ts_downsample": f"{_C}, n AS (SELECT *, {_I} j FROM c) SELECT sample_id, signal FROM n WHERE j % 8 = 0",
    "ts_decimate": f"{_C}, n AS (SELECT *, {_I} j, greatest(count(*) OVER (PARTITION BY series_id) // 50, 1) s FROM c) SELECT sample_id, signal FROM n WHERE j % s = 0",
    "ts_segments": f"""{_C}, n AS (SELECT *, {_I} j FROM c),
        x AS (SELECT *, unnest(range(greatest(0, CAST(floor((j - 64) / (64 / 1.5)) AS BIGINT)), CAST(floor((j + 1) / (64 / 1.5)) AS BIGINT) + 1)) seg_id FROM n),
        y AS (SELECT *, j - CAST(floor(seg_id * (64 / 1.5) + 0.5) AS BIGINT) seg_i FROM x)
        SELECT series_id, seg_id, count(*) n, min(timebase) t0, CAST(avg(signal) AS FLOAT) mean, min(seg_i) first_i FROM y WHERE seg_i >= 0 AND seg_i < 64 GROUP BY ALL""",
    "ts_segment_arrays": f"""{_C}, n AS (SELECT *, ({_I}) // 64 seg_id FROM c)
        SELECT series_id, seg_id, min(timebase) t0, count(*) n, CAST(CASE WHEN count(*) > 1 THEN (max(timebase) - min(timebase)) / (count(*) - 1) END AS FLOAT) dt,
        (array_agg(signal ORDER BY timebase))[1] first_value, (array_agg(signal ORDER BY timebase))[-1] last_value FROM n GROUP BY ALL""",
    "ts_contiguous": f"""{_C}, d AS (SELECT *, timebase - lag(timebase) OVER ({_W}) d FROM c),
        g AS (SELECT series_id, count(*) n, arg_min(d, timebase) FILTER (WHERE d IS NOT NULL) s, max(d) hi, min(d) lo FROM d GROUP BY ALL)
        SELECT series_id, n FROM g WHERE s IS NULL OR greatest(abs(hi - s), abs(lo - s)) < 1.5 * s""",
    "ts_subtract_mean": f"{_C} SELECT sample_id, round(signal - avg(signal) OVER (PARTITION BY series_id), 5) + 0.0 AS signal FROM c",
    "ts_normalise": f"""{_C}, g AS (SELECT shot, channel, [sqrt(avg(signal * signal)), max(abs(signal)), var_pop(signal)] ns, max(signal) hi FROM k GROUP BY shot, channel),
        a AS (SELECT shot, channel, unnest(['rms', 'peak', 'var']) m, unnest(ns) n, hi FROM g),
        b AS (SELECT *, max(n) OVER (PARTITION BY shot, m) w FROM a)
        SELECT m || '/true' AS method, shot, channel, CAST(CASE WHEN n <> 0 THEN hi / n END AS FLOAT) highest FROM b
        UNION ALL SELECT m || '/false', shot, channel, CAST(CASE WHEN w <> 0 THEN hi / w END AS FLOAT) FROM b""",
    "ts_integrate": f"""{_C}, n AS (SELECT *, (max(timebase) OVER p - min(timebase) OVER p) / (count(*) OVER p - 1) dt FROM c WINDOW p AS (PARTITION BY series_id))
        SELECT sample_id, CAST(sum(signal) OVER ({_W} ROWS UNBOUNDED PRECEDING) * dt AS FLOAT) integral FROM n""",
    "ts_remove_baseline": f"""{_C}, n AS (SELECT *, min(timebase) OVER p a, max(timebase) OVER p b FROM k WINDOW p AS (PARTITION BY series_id)),
        m AS (SELECT *, avg(CASE WHEN timebase <= a + 0.02 THEN timebase END) OVER p t0, avg(CASE WHEN timebase >= b - 0.02 THEN timebase END) OVER p t1,
            avg(CASE WHEN timebase <= a + 0.02 THEN signal END) OVER p v0, avg(CASE WHEN timebase >= b - 0.02 THEN signal END) OVER p v1 FROM n WINDOW p AS (PARTITION BY series_id))
        SELECT sample_id, round(signal - (v0 + CASE WHEN t1 > t0 THEN (v1 - v0) / (t1 - t0) ELSE 0 END * (timebase - t0)), 4) + 0.0 AS signal FROM m""",
    "ts_smooth": f"""{_C}, n AS (SELECT *, avg(signal) OVER mid s, count(*) OVER mid m, avg(signal) OVER back cs, count(*) OVER back cm FROM k
            WINDOW mid AS ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), back AS ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        SELECT 'valid' AS mode, sample_id, CAST(s AS FLOAT) signal FROM n WHERE m = 7 UNION ALL SELECT 'causal', sample_id, CAST(cs AS FLOAT) FROM n WHERE cm = 7 UNION ALL SELECT 'keep', sample_id, CAST(s AS FLOAT) FROM n""",
    "ts_smooth_twice": f"""{_C}, a AS (SELECT * REPLACE (avg(signal) OVER w AS signal), count(*) OVER w m FROM k WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        b AS (SELECT sample_id, avg(signal) OVER w s, count(*) OVER w n FROM a WHERE m = 5 WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
        SELECT sample_id, CAST(s AS FLOAT) signal FROM b WHERE n = 5""",
    "ts_cross_correl": f"""{_C}, l AS (SELECT *, lag(signal, 3) OVER ({_W}) late FROM k), f AS (SELECT * FROM l WHERE late IS NOT NULL),
        a AS (SELECT sample_id, count(*) OVER w n, avg(signal * late) OVER w xy, sqrt(avg(signal * signal) OVER w * avg(late * late) OVER w) d FROM f WINDOW w AS ({_W} ROWS BETWEEN 7 PRECEDING AND 8 FOLLOWING))
        SELECT sample_id, CASE WHEN d > 0 THEN round(xy / d, 5) END correlation FROM a WHERE n = 16""",
    "ts_derivative": f"""{_C}, n AS (SELECT *, lead(timebase) OVER ({_W}) - timebase dt, lead(signal) OVER ({_W}) - signal dv FROM k)
        SELECT series_id, timebase + dt / 2 AS t_mid, CAST(CASE WHEN dt <> 0 THEN dv / dt END AS FLOAT) ddt FROM n WHERE dt IS NOT NULL""",
    "ts_unwrap": """WITH f AS (SELECT indx, shot, campaign, fs_time, CAST(phases[1] AS DOUBLE) p FROM features WHERE fs_time IS NOT NULL AND phases[1] IS NOT NULL),
        d AS (SELECT *, p - lag(p) OVER (PARTITION BY shot, campaign ORDER BY fs_time, indx) d FROM f)
        SELECT indx, round(p + sum(CASE WHEN d < -pi() THEN 2 * pi() WHEN d > pi() THEN -2 * pi() ELSE 0 END) OVER (PARTITION BY shot, campaign ORDER BY fs_time, indx ROWS UNBOUNDED PRECEDING), 4) phase FROM d""",
    "ts_peaks": f"""{_C}, a AS (SELECT *, lag(signal) OVER ({_W}) p FROM k), r AS (SELECT * FROM a WHERE p IS NULL OR p <> signal),
        b AS (SELECT *, lead(signal) OVER ({_W}) n, max(signal) OVER (PARTITION BY series_id) m FROM r) SELECT sample_id, signal FROM b WHERE p < signal AND n < signal AND signal > 0.5 * m""",
    "ts_fold": f"""{_C}, n AS (SELECT *, {_I} j FROM k), f AS (SELECT *, CAST(j - floor(floor(j / 16.5) * 16.5) AS INTEGER) place FROM n)
        SELECT series_id, place, CAST(avg(signal) AS FLOAT) folded, count(signal) n FROM f WHERE place < 16 GROUP BY ALL""",
    "ts_shift": f"{_C} SELECT sample_id, lag(signal, 3) OVER ({_W}) signal FROM c",
    "ts_delta_decode": f"""{_C}, d AS (SELECT *, coalesce(CAST(round((signal - lag(signal) OVER ({_W})) * 1000) AS BIGINT), 0) q FROM k)
        SELECT sample_id, CAST(sum(q) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) delta FROM d""",
    "ts_regular_times": f"""{_C}, d AS (SELECT *, floor((timebase - lag(timebase) OVER ({_W})) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE d, {_I} j, first_value(timebase) OVER ({_W}) x0 FROM c),
        n AS (SELECT series_id, d, count(*) n FROM d WHERE d IS NOT NULL GROUP BY ALL), b AS (SELECT series_id, arg_max(d, (n, -d)) s FROM n GROUP BY ALL)
        SELECT sample_id, CAST(x0 + j * s AS FLOAT) repaired, CAST(CASE WHEN s <> 0 THEN abs(timebase - (x0 + j * s)) / s END AS FLOAT) off FROM d JOIN b USING (series_id)""",
    "ts_step_counts": f"""{_C}, d AS (SELECT series_id, floor((timebase - lag(timebase) OVER ({_W})) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE step FROM c), n AS (SELECT series_id, step, count(*) n FROM d WHERE step IS NOT NULL GROUP BY ALL)
        SELECT series_id, step, n, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, step) place FROM n QUALIFY place <= 5""",
    "ts_crossings": f"""{_C}, l AS (SELECT series_id, timebase t, signal - avg(signal) OVER ({_W} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) d FROM k),
        p AS (SELECT *, lag(t) OVER w pt, lag(d) OVER w pd FROM l WINDOW w AS (PARTITION BY series_id ORDER BY t))
        SELECT series_id, count(*) n, round(sum(pt + (t - pt) * pd / (pd - d)), 4) sum_t_cross FROM p WHERE pd * d < 0 OR (d = 0 AND pd <> 0) GROUP BY ALL""",
    "ts_trapezoid": f"""{_C}, p AS (SELECT series_id, (lead(timebase) OVER ({_W}) - timebase) * (lead(signal) OVER ({_W}) + signal) / 2 a FROM k) SELECT series_id, round(coalesce(sum(a), 0), 5) integral FROM p GROUP BY ALL""",
    "ts_gated_means": f"""{_C}, h AS (SELECT *, signal - 1e-9 > avg(signal) OVER (PARTITION BY series_id) o FROM k),
        e AS (SELECT *, CASE WHEN o AND NOT coalesce(lag(o) OVER ({_W}), FALSE) THEN 1 ELSE 0 END e FROM h), g AS (SELECT *, CAST(sum(e) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) island FROM e)
        SELECT series_id, island, CAST(avg(timebase) AS FLOAT) t_mean, CAST(avg(signal) AS FLOAT) signal_mean, count(*) n FROM g WHERE o GROUP BY series_id, island""",
    "ts_pulse_times": f"""{_C}, a AS (SELECT *, signal - avg(signal) OVER w f FROM k WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)),
        b AS (SELECT *, avg(f * f) OVER w p FROM a WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)), m AS (SELECT *, avg(p) OVER (PARTITION BY series_id) m FROM b),
        o AS (SELECT *, avg(CASE WHEN p > 0.5 * m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) o FROM m)
        SELECT series_id, min(timebase) t_start, max(timebase) t_end, count(*) n_on FROM o WHERE o > 0.7::DOUBLE GROUP BY ALL""",
    "ts_remove_level": f"{_C} SELECT sample_id, round(signal - avg(CASE WHEN timebase BETWEEN -0.5 AND 0.25 THEN signal END) OVER (PARTITION BY series_id), 4) + 0.0 AS signal FROM k",
    "ts_remove_tilt": f"""{_C}, n AS (SELECT *, avg(CASE WHEN timebase BETWEEN -0.5 AND 0.1 THEN timebase END) OVER p t0, avg(CASE WHEN timebase BETWEEN 0.3 AND 0.6 THEN timebase END) OVER p t1,
        avg(CASE WHEN timebase BETWEEN -0.5 AND 0.1 THEN signal END) OVER p v0, avg(CASE WHEN timebase BETWEEN 0.3 AND 0.6 THEN signal END) OVER p v1 FROM k WINDOW p AS (PARTITION BY series_id))
        SELECT series_id, count(x) n, round(max(x), 3) + 0.0 AS highest FROM (SELECT series_id, signal - (v0 + (v1 - v0) / nullif(t1 - t0, 0) * (timebase - t0)) x FROM n) GROUP BY ALL""",
    "ts_second_derivative": f"""{_C}, n AS (SELECT *, (max(timebase) OVER p - min(timebase) OVER p) / nullif(count(*) OVER p - 1, 0) st FROM k WINDOW p AS (PARTITION BY series_id)),
        d AS (SELECT *, (timebase + lead(timebase) OVER ({_W})) / 2 t_mid, lead(signal) OVER ({_W}) - signal dv FROM n)
        SELECT series_id, t_mid, CAST(4e-6::DOUBLE * signal * abs(dv / nullif(st, 0)) AS FLOAT) AS ddt2 FROM d WHERE t_mid IS NOT NULL""",
    "ts_flat_top": f"""{_C}, t AS (SELECT series_id, quantile_cont(abs(signal), 0.95) top FROM c GROUP BY ALL), o AS (SELECT k.*, abs(signal) >= 0.9 * top AS o FROM k JOIN t USING (series_id)),
        g AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) g FROM o),
        r AS (SELECT series_id, g, min(timebase) t_from, max(timebase) t_to, count(*) n FROM g WHERE o GROUP BY series_id, g)
        SELECT series_id, t_from, t_to, n FROM r QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, t_from) = 1""",
    "ts_reduce_to_nice": f"""{_C}, z AS ({_NICE}), s AS (SELECT series_id, count(*) m FROM c GROUP BY ALL), b AS (SELECT series_id, max(z.m) nice FROM s JOIN z ON z.m <= s.m GROUP BY ALL),
        n AS (SELECT c.*, {_I} j FROM c) SELECT series_id, count(*) n, max(timebase) t_end FROM n JOIN b USING (series_id) WHERE j < nice GROUP BY series_id""",
}
