"""Queries of selection, lookups and correlations over whole tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell import registry as G
from driftwell.operators import correlation as R
from driftwell.operators import lookups as L
from driftwell.operators import selection as W
from driftwell.operators import series as S
from driftwell.operators.mining import finite
from driftwell.plans.series import known
from driftwell.sources import table

BANDS = ["MP_A01", "IP_ROG", "GAS_VALVE"]
STEPS = [(0.0, 1.0), (0.1, 4.0), (0.25, 2.5), (0.4, 0.0)]
CLOCK = [(0, 1.0), (20040303000, 2.0), (20040306000, 5.0)]
SWEEPS = [(0, "sweep_a"), (20040304000, "sweep_b")]
SETTINGS = [(None, None, 0, "base"), (20040302000, 20040305000, 1, "M1"), (20040304000, 20040310000, 2, "M2"), (20040306000, None, 1, "M3")]


def _f(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features")


def channels(spark, folder):
    return W.of_channels(known(spark, folder), BANDS).select("sample_id", "channel", "signal")


def channel_places(spark, folder):
    return W.channel_places(table(spark, folder, "timeseries"))


def between(spark, folder):
    return _f(spark, folder).where(W.between(finite("freq"), 20, 40) & W.between(finite("kh"), (0.1, 0.6), closed=False)).select("indx")


def in_list(spark, folder):
    """Readings of the shots that hold any program of the catalogue's first three days."""
    days = table(spark, folder, "shot_da").where("shot_date <= 20040303").select((F.col("shot_date").cast("long") * 1000 + F.col("progid")).alias("shot"))
    return W.in_list(table(spark, folder, "timeseries").select("sample_id", "shot"), "shot", days).groupBy("shot").agg(F.count("*").alias("n"))


def where_true(spark, folder):
    rows, n = W.where_true(_f(spark, folder), (F.col("svs") >= 4) & (finite("freq") > 50), "indx")
    return rows.withColumn("n", F.lit(n))


def thinned(spark, folder):
    return W.thinned(_f(spark, folder), -500, row_id="indx").select("indx")


def extract(spark, folder):
    return W.extract(_f(spark, folder), "indx, freq, kh", where=F.col("svs") >= 2, limit=-2000, row_id="indx", mask=F.col("p") > 0.6)


def with_time(spark, folder):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = W.with_time(W.with_time(_f(spark, folder), "fs_time", 0.05), "fs_time", None, "t_plain")
    return rows.select("indx", F.round("t", 9).alias("t"), "t_plain")


def attributes(spark, folder):
    a = W.attributes(table(spark, folder, "saved_signals"))
    return table(spark, folder, "saved_signals").select(a["save_id"], (a["t_last"] - a["t_first"]).alias("length"))


def members(spark, folder):
    return W.members(_f(spark, folder), 3, row_id="indx", label="svs")


def overlapping(spark, folder):
    """Intervals that share a point with the middle half of the catalogue."""
    d = table(spark, folder, "shot_da").where("start_utc is not null and end_utc is not null")
    a, b = d.agg(F.min("start_utc")).scalar(), d.agg(F.max("end_utc")).scalar()
    quarter = F.expr("(hi - lo) div 4")
    rows = d.withColumn("lo", a).withColumn("hi", b).withColumn("q", quarter)
    return rows.where(W.overlap(F.col("start_utc"), F.col("end_utc"), F.col("lo") + F.col("q"), F.col("hi") - F.col("q"))).select("rec_id")


def rotated(spark, folder):
    return W.rotate(known(spark, folder), ["series_id"], "timebase", 7).select("sample_id", "place")


def segment_times(spark, folder):
    rows = S.segment(known(spark, folder), ["series_id"], "timebase", 64)
    return W.segment_times(rows, ["series_id"], flat=(0.0, 0.3)).select("series_id", "seg_id", F.round("t_mid", 6).alias("t_mid"), "flat_level", "place")


def sql_passthrough(spark, folder):
    return W.select_sql(spark, {"fluctuations": _f(spark, folder)}, "SELECT indx, freq FROM fluctuations WHERE rms > 0.005 AND a12 > 0.5 AND NOT isnan(rms) AND NOT isnan(freq) ORDER BY freq DESC, indx LIMIT 50")


def in_own_band(spark, folder):
    rows = _f(spark, folder).withColumn("low", F.col("svs") * 5.0).withColumn("high", F.col("svs") * 15.0)
    return W.in_own_band(rows.where(finite("freq").isNotNull()), "freq", "low", "high", F.col("p") > 0.5).select("indx")


def combined(spark, folder):
    """Campaigns put together one by one; one that cannot be loaded is left out."""
    part = lambda c: lambda: _f(spark, folder).where(F.col("campaign") == c).select("indx", "shot")
    out, errors = W.combined([part(1), lambda: spark.read.parquet(f"{folder}/no such table"), part(2), part(3)])
    assert len(errors) == 1
    return out


def joined_clashing(spark, folder):
    a, b = _f(spark, folder).select("indx", "freq", "svs"), _f(spark, folder).select("indx", (F.col("freq") * 1000).alias("freq"), "kh")
    return W.joined_clashing(a, b, "indx")


def common_columns(spark, folder):
    a, b = table(spark, folder, "timeseries"), table(spark, folder, "probe_fits")
    names = W.common_columns(a, b)
    return a.select(*names).union(b.select(*names)).distinct()


def converted(spark, folder):
    return W.converted(_f(spark, folder), {"indx": "number", "freq": "freq_hz", "kh": "kappa_h"}, scale={"freq": 1000.0})


def merged_sets(spark, folder):
    parts = [_f(spark, folder).where(c).select("indx", "freq", "phases") for c in ("svs <= 2", "svs > 2", "svs is null")]
    return W.merged_sets(parts, phases="phases").select("indx", "freq", "phorig")


def near_plane(spark, folder):
    return W.near_plane(_f(spark, folder).select((finite("kh") - 0.5).alias("y"), F.floor(finite("freq")).alias("z"), "indx").where("y is not null"), off="y", along="z", n=100).select("z", "y")


def per_shot(spark, folder):
    s = table(spark, folder, "probe_fits").groupBy("shot").agg(F.max("nits").alias("most_steps"))
    return L.per_shot(_f(spark, folder).select("indx", "shot"), s, ["most_steps"])


def combined_view(spark, folder):
    a = table(spark, folder, "probe_fits").groupBy("shot").agg(F.countDistinct("fit_id").alias("n_fits"))
    b = _f(spark, folder).groupBy("shot").agg(F.count("*").alias("n_records"))
    L.combined_view(a, b, "shot")
    return spark.sql("SELECT shot, n_fits, n_records FROM combsum")


def labels_of_shots(spark, folder):
    shots = table(spark, folder, "probe_fits").select("shot").distinct()
    return L.labels_of_shots(_f(spark, folder).select("indx", "shot", "svs"), "svs", shots)


def zipped_segments(spark, folder):
    """Segments of 32 samples of three signals of a shot beside each other."""
    rows = S.segment(known(spark, folder).where("channel in ('BOLO_3', 'B_TOR', 'I_COIL_M')"), ["shot", "channel"], "timebase", 32)
    z = L.zipped_segments({n: rows.where(F.col("channel") == c) for n, c in (("measured", "I_COIL_M"), ("corrected", "BOLO_3"), ("sweep", "B_TOR"))}, ["shot"], 32)
    return z.select("shot", "seg_id", F.array_max("measured").alias("measured_top"), F.array_min("corrected").alias("corrected_low"), F.array_max("sweep").alias("sweep_top"))


def sweep_channel(spark, folder):
    f = table(spark, folder, "probe_fits").select("shot", "channel").distinct()
    return L.sweep_channel(f, channel="channel", shot="shot", own={"LP01": "v_own"}, setting={"LP02": "v_set", "LP01": "never"}, by_shot=SWEEPS)


def valid_setting(spark, folder):
    s = spark.createDataFrame(SETTINGS, "first_shot long, last_shot long, priority int, value string")
    return L.valid_setting(_f(spark, folder).select("shot").distinct(), s, row_id="shot")


def clock(spark, folder):
    return L.step_clock(_f(spark, folder).select("shot").distinct(), CLOCK)


def puffs(spark, folder):
    return L.step_function(_f(spark, folder).select("indx", "fs_time"), STEPS, time="fs_time").select("indx", "level")


def kappa(spark, folder):
    """The ratio of the greatest coil currents of a shot."""
    return L.ratio_of(known(spark, folder), ["shot"], "channel", "signal", ("I_COIL_S", "I_COIL_M"), "kh")


def shots_of_paths(spark, folder):
    p = table(spark, folder, "probe_fits").select(F.concat(F.lit("store/ab"), F.col("shot").cast("string"), F.lit(".npz")).alias("path")).distinct()
    return L.shots_of_paths(p, "path", 2, 11)


def latest(spark, folder):
    s = table(spark, folder, "saved_signals").dropDuplicates(["save_id"]).withColumn("path", F.concat_ws("/", F.col("shot").cast("string"), "channel", F.col("save_id").cast("string")))
    return L.latest_of(s.where("n_samples is not null"), ["shot", "channel"], path="path", when="saved_at", size="n_samples")


def correct_names(spark, folder):
    files = _f(spark, folder).select("indx", "campaign", "svs", F.col("ref_channel").alias("ch"))
    sections = table(spark, folder, "channels").select(F.col("channel").alias("ch"), F.concat(F.lit("section "), "channel").alias("section"), F.explode(F.array(F.lit(1), F.lit(2))).alias("campaign"))
    return L.correct_names(files, sections, ["campaign", "ch"], file="indx", section="section")


def enriched(spark, folder):
    sections = _f(spark, folder).select(F.col("ref_channel").alias("channel")).where("channel is not null").distinct()
    return L.enriched(sections, table(spark, folder, "channels"), pattern="^(MP|LP)_", name="channel", columns=["units", "full_scale"])


def next_shots(spark, folder):
    return L.next_shot(table(spark, folder, "shot_da"), ["shot_date"], "progid")


def zero_lag(spark, folder):
    return R.zero_lag(_f(spark, folder), ["campaign"], "freq", "kh").select("campaign", "n", F.round("correlation", 6).alias("correlation"))


def regression(spark, folder):
    return R.zero_lag(_f(spark, folder), ["campaign"], "freq", "kh", ac=False, coefficient=False).select("campaign", "n", F.round("correlation", 9).alias("correlation"))


def correlation_matrix(spark, folder):
    return R.correlation_matrix(_f(spark, folder), ["campaign"], ["freq", "kh", "rms", "fs_time"]).withColumn("correlation", F.round("correlation", 6) + 0.0)


def products(spark, folder):
    return R.products(_f(spark, folder), ["shot"], "freq", "kh").select("shot", "n", F.round("product", 3).alias("product"))


def reduced(spark, folder):
    """A summary of fits by its settings."""
    f = table(spark, folder, "probe_fits").dropDuplicates(["fit_id"])
    return G.reduced(f, ["shot"], {"n": ("n", "te"), "top": ("max", "te"), "mean": ("average", "te", 4), "spread": ("rms", "resid", 5)})


def calibrated_by_settings(spark, folder):
    """Known samples times the formula of their settings."""
    return known(spark, folder).withColumn("signal", G.expression("-2.5 * signal + abs(timebase)", ["signal", "timebase"])).select("sample_id", F.col("signal").cast("float").alias("signal"))


def named_steps(spark, folder):
    """Operators applied by name."""
    df, history = G.apply(_f(spark, folder), [("low_modes", {"below": 30.0}), ("many_values", {"least": 2})])
    return df.select("indx", F.lit("; ".join(history)).alias("history"))


@G.operator
def low_modes(df, below):
    return df.where(F.col("freq") < below)


@G.operator
def many_values(df, least):
    return df.where(F.col("svs") >= least)


def there_and_back(spark, folder):
    f = _f(spark, folder).select("indx", F.lit(2.0).alias("r"), F.get("phases", F.lit(0)).cast("double").alias("phi"), "kh")
    there = G.transformed(f, "cylindrical", "cartesian", ["r", "phi", "kh"], ["x", "y", "z"])
    return G.transformed(there, "cartesian", "cylindrical", ["x", "y", "z"], ["r2", "phi2", "z2"]).select("indx", F.round("r2", 6).alias("r"), (F.round("phi2", 5) + 0.0).alias("phi"), F.col("z2").alias("z"))


QUERIES = {f"sel_{f.__name__}": f for f in (
    channels, channel_places, between, in_list, where_true, thinned, extract, with_time, attributes, members, overlapping, rotated, segment_times, sql_passthrough, in_own_band, combined,
    joined_clashing, common_columns, converted, merged_sets, near_plane, per_shot, combined_view, labels_of_shots, zipped_segments, sweep_channel, valid_setting, clock, puffs, kappa,
    shots_of_paths, latest, correct_names, enriched, next_shots, zero_lag, regression, correlation_matrix, products, reduced, calibrated_by_settings, named_steps, there_and_back,
)}

_K = """k AS (SELECT DISTINCT sample_id, series_id, shot, channel, timebase, signal FROM timeseries JOIN channels USING (channel)
    WHERE timebase IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal) AND abs(signal) <= 2 * full_scale)"""
_T = "o AS (PARTITION BY series_id ORDER BY timebase)"
_HASH = "(((indx % 2147483648) * 2654435761) % 4294967296) / 4294967296.0::DOUBLE"
_FK = "CASE WHEN NOT isnan({c}::DOUBLE) THEN {c}::DOUBLE END"
_PAIRS = " UNION ALL ".join(
    f"SELECT campaign, '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) n, round(corr(x, y), 6) + 0.0 AS correlation FROM (SELECT campaign, {_FK.format(c=a)} x, {_FK.format(c=b)} y FROM features) GROUP BY campaign"
    for i, a in enumerate(["freq", "kh", "rms", "fs_time"]) for b in ["freq", "kh", "rms", "fs_time"][i + 1 :]
)


def _steps(column: str, steps: list, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {a} THEN {v}" for a, v in sorted(steps, reverse=True)) + f" ELSE {other} END"


SQL = {
    "sel_channels": f"WITH {_K} SELECT sample_id, channel, signal FROM k WHERE channel IN ('MP_A01', 'IP_ROG', 'GAS_VALVE')",
    "sel_channel_places": "SELECT channel, CAST(row_number() OVER (ORDER BY channel) - 1 AS INTEGER) place FROM (SELECT DISTINCT channel FROM timeseries)",
    "sel_between": "SELECT indx FROM features WHERE freq BETWEEN 20 AND 40 AND kh > 0.1 AND kh < 0.6",
    "sel_in_list": "SELECT shot, count(*) n FROM timeseries WHERE shot IN (SELECT shot_date::BIGINT * 1000 + progid FROM shot_da WHERE shot_date <= 20040303) GROUP BY shot",
    "sel_where_true": "SELECT indx, CAST(count(*) OVER () AS INTEGER) n FROM features WHERE svs >= 4 AND freq > 50 AND NOT isnan(freq)",
    "sel_thinned": f"SELECT indx FROM features WHERE {_HASH} < 500.0::DOUBLE / (SELECT count(*) FROM features)",
    "sel_extract": f"""WITH x AS (SELECT * FROM features WHERE svs >= 2) SELECT indx, CASE WHEN p::DOUBLE > 0.6::DOUBLE THEN freq END freq, CASE WHEN p::DOUBLE > 0.6::DOUBLE THEN kh END kh FROM x
        WHERE {_HASH} < 2000.0::DOUBLE / (SELECT count(*) FROM x)""",
    "sel_with_time": "SELECT indx, round(fs_time - 0.05::DOUBLE, 9) t, fs_time - 0.0::DOUBLE t_plain FROM features",
    "sel_attributes": "SELECT save_id, t_last - t_first AS length FROM saved_signals",
    "sel_members": "SELECT indx FROM features WHERE svs = 3",
    "sel_overlapping": """WITH d AS (SELECT * FROM shot_da WHERE start_utc IS NOT NULL AND end_utc IS NOT NULL), r AS (SELECT min(start_utc) lo, max(end_utc) hi, (max(end_utc) - min(start_utc)) // 4 q FROM d)
        SELECT rec_id FROM d, r WHERE least(start_utc, end_utc) <= hi - q AND greatest(start_utc, end_utc) >= lo + q""",
    "sel_rotated": f"WITH {_K} SELECT sample_id, CAST((row_number() OVER o - 1 + 7) % count(*) OVER (PARTITION BY series_id) AS INTEGER) place FROM k WINDOW {_T}",
    "sel_segment_times": f"""WITH {_K}, i AS (SELECT *, row_number() OVER o - 1 i FROM k WINDOW {_T}), s AS (SELECT series_id, i // 64 seg_id, avg(timebase) t FROM i GROUP BY ALL)
        SELECT series_id, seg_id, round(t, 6) t_mid, CASE WHEN t > 0.0 AND t < 0.3 THEN 1 ELSE 0 END flat_level, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t, seg_id) AS INTEGER) place FROM s""",
    "sel_sql_passthrough": "SELECT indx, freq FROM features WHERE rms > 0.005 AND a12 > 0.5 AND NOT isnan(rms) AND NOT isnan(freq) ORDER BY freq DESC, indx LIMIT 50",
    "sel_in_own_band": "SELECT indx FROM features WHERE NOT isnan(freq) AND freq >= svs * 5.0 AND freq <= svs * 15.0 AND p > 0.5",
    "sel_combined": "SELECT indx, shot FROM features WHERE campaign IN (1, 2, 3)",
    "sel_joined_clashing": "SELECT indx, freq, svs, freq * 1000 AS freq1, kh FROM features",
    "sel_common_columns": "SELECT shot, channel FROM timeseries UNION SELECT shot, channel FROM probe_fits",
    "sel_converted": "SELECT indx AS number, freq * 1000.0::DOUBLE AS freq_hz, kh AS kappa_h FROM features",
    "sel_merged_sets": "SELECT indx, CAST(freq AS FLOAT) freq, CAST(floor(phases[1]::DOUBLE * 10) AS TINYINT) phorig FROM features",
    "sel_near_plane": f"""WITH p AS (SELECT {_FK.format(c="kh")} - 0.5::DOUBLE y, CAST(floor({_FK.format(c="freq")}) AS BIGINT) z, indx FROM features), n AS (SELECT * FROM p WHERE y IS NOT NULL AND z IS NOT NULL ORDER BY abs(y), z, y LIMIT 100)
        SELECT z, y FROM n QUALIFY row_number() OVER (PARTITION BY z ORDER BY abs(y), y) = 1""",
    "sel_per_shot": "SELECT indx, f.shot, most_steps FROM features f LEFT JOIN (SELECT shot, max(nits) most_steps FROM probe_fits GROUP BY shot) s ON f.shot = s.shot",
    "sel_combined_view": "SELECT shot, n_fits, n_records FROM (SELECT shot, count(DISTINCT fit_id) n_fits FROM probe_fits GROUP BY shot) JOIN (SELECT shot, count(*) n_records FROM features GROUP BY shot) USING (shot)",
    "sel_labels_of_shots": "SELECT indx, shot, CASE WHEN shot IN (SELECT shot FROM probe_fits WHERE shot IS NOT NULL) THEN svs END svs FROM features",
    "sel_zipped_segments": f"""WITH {_K}, i AS (SELECT *, row_number() OVER (PARTITION BY shot, channel ORDER BY timebase) - 1 i FROM k WHERE channel IN ('BOLO_3', 'B_TOR', 'I_COIL_M')),
        s AS (SELECT shot, channel, i // 32 seg_id, count(*) n, max(signal) hi, min(signal) lo FROM i GROUP BY ALL HAVING n = 32)
        SELECT shot, seg_id, max(hi) FILTER (WHERE channel = 'I_COIL_M') measured_top, max(lo) FILTER (WHERE channel = 'BOLO_3') corrected_low, max(hi) FILTER (WHERE channel = 'B_TOR') sweep_top
        FROM s GROUP BY shot, seg_id HAVING count(*) = 3""",
    "sel_sweep_channel": f"""SELECT DISTINCT shot, channel, CASE WHEN channel = 'LP01' THEN 'v_own' WHEN channel = 'LP02' THEN 'v_set' ELSE {_steps("shot", [(a, f"'{v}'") for a, v in SWEEPS], "NULL")} END vsweep FROM probe_fits""",
    "sel_valid_setting": "WITH s(a, b, p, v) AS (VALUES " + ", ".join(f"({a or 'NULL'}::BIGINT, {b or 'NULL'}::BIGINT, {p}, '{v}')" for a, b, p, v in SETTINGS) + """)
        SELECT shot, arg_max(v, p * 1000 + ascii(v)) AS value FROM (SELECT DISTINCT shot FROM features) LEFT JOIN s ON (a IS NULL OR a <= shot) AND (b IS NULL OR b >= shot) GROUP BY shot""",
    "sel_clock": f"SELECT DISTINCT shot, 1e6::DOUBLE / {_steps('shot', CLOCK, 'NULL')} AS clock FROM features",
    "sel_puffs": f"SELECT indx, CASE WHEN fs_time IS NOT NULL AND NOT isnan(fs_time) THEN CAST({_steps('fs_time', STEPS, '0.0')} AS DOUBLE) END AS level FROM features",
    "sel_kappa": f"WITH {_K} SELECT shot, max(abs(signal)) FILTER (WHERE channel = 'I_COIL_S') / nullif(max(abs(signal)) FILTER (WHERE channel = 'I_COIL_M'), 0) kh FROM k GROUP BY shot",
    "sel_shots_of_paths": "SELECT DISTINCT 'store/ab' || shot || '.npz' AS path, shot FROM probe_fits",
    "sel_latest": """WITH s AS (SELECT DISTINCT save_id, shot, channel, n_samples, min(saved_at) OVER (PARTITION BY save_id) saved_at, shot || '/' || channel || '/' || save_id AS path FROM saved_signals WHERE n_samples IS NOT NULL)
        SELECT shot, channel, arg_max(path, (saved_at, path)) AS path, count(*) n, arg_max(n_samples, (saved_at, path)) < max(n_samples) AS smaller FROM s GROUP BY shot, channel""",
    "sel_correct_names": "SELECT indx, 'section ' || ref_channel AS section FROM features WHERE campaign IN (1, 2) AND ref_channel IN (SELECT channel FROM channels)",
    "sel_enriched": "SELECT DISTINCT f.ref_channel AS channel, units, full_scale FROM features f LEFT JOIN channels c ON f.ref_channel = c.channel AND regexp_matches(f.ref_channel, '^(MP|LP)_') WHERE f.ref_channel IS NOT NULL",
    "sel_next_shots": "SELECT shot_date, progid, lead(progid) OVER (PARTITION BY shot_date ORDER BY progid) AS next FROM (SELECT DISTINCT shot_date, progid FROM shot_da)",
    "sel_zero_lag": f"SELECT campaign, count(*) n, round(corr(x, y), 6) correlation FROM (SELECT campaign, {_FK.format(c='freq')} x, {_FK.format(c='kh')} y FROM features) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY campaign",
    "sel_regression": f"SELECT campaign, count(*) n, round(avg(x * y) / avg(x * x), 9) correlation FROM (SELECT campaign, {_FK.format(c='freq')} x, {_FK.format(c='kh')} y FROM features) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY campaign",
    "sel_correlation_matrix": _PAIRS,
    "sel_reduced": f"""WITH f AS (SELECT shot, {_FK.format(c='te')} te, {_FK.format(c='resid')} resid FROM (SELECT DISTINCT ON (fit_id) * FROM probe_fits))
        SELECT shot, count(te) n, max(te) AS top, round(avg(te), 4) mean, round(sqrt(avg(resid * resid)), 5) spread FROM f GROUP BY shot""",
    "sel_calibrated_by_settings": f"WITH {_K} SELECT sample_id, CAST(-2.5::DOUBLE * signal + abs(timebase) AS FLOAT) AS signal FROM k",
    "sel_named_steps": "SELECT indx, 'low_modes(below=30.0); many_values(least=2)' AS history FROM features WHERE freq < 30 AND svs >= 2",
    "sel_there_and_back": "SELECT indx, CASE WHEN p IS NOT NULL THEN 2.0::DOUBLE END r, round(atan2(sin(p), cos(p)), 5) + 0.0 AS phi, kh AS z FROM (SELECT indx, phases[1]::DOUBLE p, kh FROM features)",
    "sel_products": f"SELECT shot, count(x * y) n, round(sum(x * y), 3) product FROM (SELECT shot, {_FK.format(c='freq')} x, {_FK.format(c='kh')} y FROM features) GROUP BY shot",
}
