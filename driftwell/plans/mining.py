"""Queries of the feature-table operators over all records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import circular as C
from driftwell.operators import lookups as L
from driftwell.operators import mining as M
from driftwell.sources import table
from driftwell.sources import text as X
from driftwell.streaming import pipelines as P

ANGLES = [0.0, math.pi / 4, math.pi / 2, 3 * math.pi / 4]
MODES = [(n, [round(x, 6) for x in C.ideal_modes([n], ANGLES)[0]], [1.0, 1.0, 0.8, 0.8], 1.5) for n in (-2, -1, 1, 2)]
CENTRE = [0.5, -0.5, 1.5, -1.5]


def _f(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features")


def quality(spark, folder):
    return M.quality(_f(spark, folder), max_h=0.3, min_p=0.5, min_svs=2).select("indx")


def deadband(spark, folder):
    return _f(spark, folder).select("indx", F.posexplode(C.deadband(F.col("phases"), 0.2)).alias("k", "phase"))


def phase_differences(spark, folder):
    return _f(spark, folder).select("indx", F.posexplode(C.neighbour_differences(F.col("phases"))).alias("k", "delta")).withColumn("delta", F.round("delta", 4))


def value_counts(spark, folder):
    return M.value_counts(_f(spark, folder), "svs").withColumn("percent", F.round("percent", 6))


def top_values(spark, folder):
    return M.value_counts(_f(spark, folder), "ref_channel", top=5).select("value", "n")


def column_info(spark, folder):
    return M.column_info(_f(spark, folder), ["freq", "kh", "rms", "fs_time", "p", "svs"])


def histogram(spark, folder):
    return M.histogram(_f(spark, folder), "freq", 24, percent=97.0).select("bin", "n")


def histogram_nd(spark, folder):
    return M.histogram_nd(_f(spark, folder), "phases", 6)


def density_leaders(spark, folder):
    rows = M.density_leaders(M.histogram_nd(_f(spark, folder), "phases", 4), top=200, min_count=2, radius=1.5)
    return spark.createDataFrame(rows, "leader string, cells int, n long")


def circular_stats(spark, folder):
    s = M.circular_stats(_f(spark, folder), ["campaign"], "phases")
    return s.select("campaign", "k", "n", F.round("mu", 6).alias("mu"), F.round("r", 8).alias("r"), F.round("kappa", 8).alias("kappa"))


def mode_labels(spark, folder):
    return M.match_modes(_f(spark, folder), "phases", MODES).where("mode_id is not null").select("indx", "mode_id")


def template_distance(spark, folder):
    return _f(spark, folder).select("indx", F.round(C.template_distance(F.col("phases"), CENTRE), 5).alias("distance"))


def nearest_rows(spark, folder):
    return M.nearest_rows(_f(spark, folder), {"freq": 60.0, "kh": 0.5, "rms": 0.01}, {"freq": 30.0, "kh": 0.3, "rms": 0.02}, 20, row_id="indx").select("indx", F.round("distance", 8).alias("distance"))


def chirps(spark, folder):
    rows = M.chirp_lines(_f(spark, folder).where("not isnan(freq) and not isnan(fs_time)"), ["shot"], time="fs_time", freq="freq", row_id="indx", time_scale=1000.0, max_distance=30.0, min_length=3)
    return rows.select("indx", "lead_id", "length", F.col("dfdt").cast("float").alias("dfdt"))


def band_join(spark, folder):
    f = _f(spark, folder)
    few = f.where("svs < 4").withColumnRenamed("indx", "other")
    return M.band_join(f.where("svs >= 4"), few, key="shot", time="fs_time", freq="freq", dt=0.002, df=2.0, left_id="indx", right_id="other")


def split_phases(spark, folder):
    return M.split_vector(_f(spark, folder).select("indx", "phases"), "phases", 4)


def masked(spark, folder):
    return M.masked(_f(spark, folder).select("indx", "freq", "kh", "p"), ["freq", "kh"], F.col("p") > 0.6).select("indx", M.finite("freq").alias("freq"), M.finite("kh").alias("kh"))


def bits(spark, folder):
    f = _f(spark, folder).select("indx", C.bit_mask(F.sequence(F.lit(0), F.col("svs") - 1)).alias("mask"))
    return f.select("indx", "mask", F.size(C.bit_list(F.col("mask"))).alias("n_bits"), F.bit_count("mask").alias("count"))


def closed_loops(spark, folder):
    return _f(spark, folder).select("indx", F.posexplode(C.close_loop(F.transform("phases", lambda x: x.cast("double")))).alias("k", "phase")).where("k = 4").select("indx", F.round("phase", 5).alias("phase"))


def flipped(spark, folder):
    return M.flip_by_sign(_f(spark, folder), "phases", F.col("kh") - 0.5).select("indx", F.get("phases", F.lit(0)).alias("first"))


def locking(spark, folder):
    low = _f(spark, folder).where("not isnan(freq) and not isnan(rms)")
    return M.locked_shots(low, "shot", "freq", below=60.0, low=35.0, also=F.col("rms") > 0.0005, least=3)


def contingency(spark, folder):
    """Records of each campaign and number of singular values, whatever numbers there are."""
    return M.counts_by(_f(spark, folder), ["campaign", "svs"])


def coverage(spark, folder):
    labels = M.match_modes(_f(spark, folder), "phases", MODES)
    return labels.rollup("campaign", "mode_id").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def trimmed(spark, folder):
    return M.trim_members(_f(spark, folder), "phases", CENTRE, row_id="indx", tolerance=1.2, least=10).select("indx")


def _slow(spark, folder):
    """Every usable reading once; records take those of their own slow channel."""
    return table(spark, folder, "timeseries").select("sample_id", "shot", "channel", "timebase", "signal").where("timebase is not null and signal is not null and not isnan(signal)").dropDuplicates(["sample_id"])


def interpolated(spark, folder):
    f = _f(spark, folder).select("indx", "shot", "ref_channel", "fs_time").where("ref_channel is not null")
    keys = [("shot", "shot"), ("ref_channel", "channel")]
    return M.interpolate_at(f, _slow(spark, folder), keys=keys, left_time="fs_time", right_time="timebase", left_id="indx", value="signal").select("indx", F.col("signal").cast("float").alias("signal"))


def last_before(spark, folder):
    f = _f(spark, folder).select("indx", "shot", "ref_channel", "fs_time").where("ref_channel is not null")
    keys = [("shot", "shot"), ("ref_channel", "channel")]
    return M.interpolate_at(f, _slow(spark, folder), keys=keys, left_time="fs_time", right_time="timebase", left_id="indx", value="signal", step=True)


def shot_of_time(spark, folder):
    runs = table(spark, folder, "shot_da")
    middle = runs.where("end_utc >= start_utc").select(F.col("rec_id").alias("point"), F.expr("start_utc + (end_utc - start_utc) div 2").alias("at"))
    return M.points_in_intervals(middle, runs, point_id="point", at="at", interval_id="rec_id", start="start_utc", end="end_utc", cell=60_000_000_000)


def shot_runs(spark, folder):
    return M.compact_runs(table(spark, folder, "shot_da"), ["shot_date"], "progid")


def touching(spark, folder):
    return M.coalesce_touching(table(spark, folder, "shot_da").select("shot_date", "progid", "start_utc", "end_utc"), ["shot_date", "progid"], "start_utc", "end_utc")


def shots_between(spark, folder):
    """Programs from (20040303, 100) on, up to but without (20040308, 20), in order of date and program."""
    rows = L.within(table(spark, folder, "shot_da"), [F.lit(20040303), F.lit(100)], ["shot_date", "progid"], [F.lit(20040308), F.lit(20)])
    return rows.select("shot_date", "progid").distinct()


def last_shot(spark, folder):
    return L.last_of(table(spark, folder, "timeseries").where("signal is not null and not isnan(signal)"), ["channel"], "shot")


def missing_shots(spark, folder):
    """Programs of the catalogue without a probe fit."""
    programs = table(spark, folder, "shot_da").select((F.col("shot_date").cast("long") * 1000 + F.col("progid")).alias("shot"))
    return L.missing_from(programs, table(spark, folder, "probe_fits"), "shot")


def neighbours(spark, folder):
    return M.neighbours(table(spark, folder, "features").where("svs = 5 and freq < 30").select("indx"), "indx")


def parameter_versions(spark, folder):
    """The version of the signal file saved before each later save of the same shot and channel."""
    return L.versions_before(table(spark, folder, "saved_signals").dropDuplicates(["save_id"]), ["shot", "channel"], when="saved_at", row_id="save_id", version="version")


def json_paths(spark, folder):
    e = X.json_fields(table(spark, folder, "events"), "props", {"k": "$.k", "b": "$.a.b"}).withColumn("k", F.col("k").cast("int"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.count("b").alias("n_nested"))


def tumbling(spark, folder):
    w = P.windowed(table(spark, folder, "events"), time="ts", keys=["event_type"], value="value", length="1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "lowest", "highest")


def sessions(spark, folder):
    s = P.sessions(table(spark, folder, "events"), time="ts", keys=["user_id"], gap="10 minutes")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


QUERIES = {f"fs_{f.__name__}": f for f in (
    quality, deadband, phase_differences, value_counts, top_values, column_info, histogram, histogram_nd, density_leaders, circular_stats, mode_labels, template_distance, nearest_rows,
    chirps, band_join, split_phases, masked, bits, closed_loops, flipped, locking, contingency, coverage, trimmed, interpolated, last_before, shot_of_time, shot_runs, touching,
    shots_between, last_shot, missing_shots, neighbours, parameter_versions, json_paths, tumbling, sessions,
)}


def _wrap(x: str) -> str:
    return f"({x} - 2 * pi() * floor(({x} + pi()) / (2 * pi())))"


def _distance(centre, spread=None) -> str:
    s = spread or [1.0] * len(centre)
    terms = [_wrap(f"(phases[{i + 1}]::DOUBLE - ({c}::DOUBLE))") + f" / {w}::DOUBLE" for i, (c, w) in enumerate(zip(centre, s, strict=True))]
    return f"sqrt(({' + '.join(f'pow({t}, 2)' for t in terms)}) / {len(centre)})"


_MODE = "CASE " + " ".join(f"WHEN {_distance(c, s)} < {t} THEN {m}" for m, c, s, t in reversed(MODES)) + " END"
_KNOWN = "fs_time IS NOT NULL AND freq IS NOT NULL AND NOT isnan(fs_time) AND NOT isnan(freq)"
_SLOW = "r AS (SELECT DISTINCT sample_id, shot, channel, timebase t, signal v FROM timeseries WHERE timebase IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal))"

SQL = {
    "fs_quality": "SELECT indx FROM features WHERE h::DOUBLE < 0.3 AND p::DOUBLE > 0.5 AND svs >= 2",
    "fs_deadband": "SELECT indx, k - 1 AS k, CASE WHEN abs(phases[k]) < 0.2::DOUBLE THEN 0.0 ELSE phases[k]::DOUBLE END AS phase FROM (SELECT indx, phases, unnest(range(1, len(phases) + 1)) k FROM features)",
    "fs_phase_differences": f"SELECT indx, k - 1 AS k, round({_wrap('(phases[k + 1]::DOUBLE - phases[k]::DOUBLE)')}, 4) AS delta FROM (SELECT indx, phases, unnest(range(1, len(phases))) k FROM features)",
    "fs_value_counts": "SELECT svs AS value, count(*) n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) percent FROM features GROUP BY svs",
    "fs_top_values": "SELECT ref_channel AS value, count(*) n FROM features GROUP BY ALL ORDER BY n DESC, value NULLS FIRST LIMIT 5",
    "fs_column_info": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) n, count(x) n_valid, count(DISTINCT x) n_distinct FROM (SELECT CASE WHEN NOT isnan({c}::DOUBLE) THEN {c}::DOUBLE END x FROM features)" for c in ("freq", "kh", "rms", "fs_time", "p", "svs")),
    "fs_histogram": """WITH v AS (SELECT freq v FROM features WHERE freq IS NOT NULL AND NOT isnan(freq)), e AS (SELECT quantile_disc(abs(v), 0.97) e FROM v), w AS (SELECT v FROM v, e WHERE abs(v) <= e),
        m AS (SELECT min(v) a, max(v) b FROM w) SELECT CAST(least(floor((v - a) / (b - a) * 24), 23) AS INTEGER) bin, count(*) n FROM w, m GROUP BY ALL""",
    "fs_histogram_nd": "WITH c AS (SELECT indx, string_agg(CAST(floor((phases[k]::DOUBLE + pi()) * 6 / (2 * (pi() + 1e-6))) AS INTEGER)::VARCHAR, ',' ORDER BY k) cell FROM (SELECT indx, phases, unnest(range(1, len(phases) + 1)) k FROM features) GROUP BY indx) SELECT cell, count(*) n FROM c GROUP BY cell",
    "fs_circular_stats": """WITH x AS (SELECT campaign, k - 1 AS k, phases[k]::DOUBLE x FROM (SELECT campaign, phases, unnest(range(1, len(phases) + 1)) k FROM features)),
        s AS (SELECT campaign, k, count(*) n, avg(sin(x)) s, avg(cos(x)) c FROM x WHERE x IS NOT NULL GROUP BY ALL), r AS (SELECT *, sqrt(s * s + c * c) r FROM s)
        SELECT campaign, k, n, round(atan2(s, c), 6) mu, round(r, 8) r, round(CASE WHEN r < 0.53 THEN 2 * r + r * r * r + 5 * r * r * r * r * r / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (2 * (1 - r)) END, 8) kappa FROM r""",
    "fs_mode_labels": f"SELECT * FROM (SELECT indx, {_MODE} AS mode_id FROM features) WHERE mode_id IS NOT NULL",
    "fs_template_distance": f"SELECT indx, round({_distance(CENTRE)}, 5) AS distance FROM features",
    "fs_nearest_rows": "WITH d AS (SELECT indx, sqrt(pow((freq - 60) / 30, 2) + pow((kh - 0.5) / 0.3, 2) + pow((rms - 0.01) / 0.02, 2)) d FROM features) SELECT indx, round(d, 8) distance FROM d WHERE d IS NOT NULL AND NOT isnan(d) ORDER BY d, indx LIMIT 20",
    "fs_chirps": f"""WITH f AS (SELECT shot, fs_time t, freq, indx FROM features WHERE {_KNOWN}),
        n AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w = 0 OR sqrt(pow(freq - lag(freq) OVER w, 2) + pow((t - lag(t) OVER w) * 1000, 2)) >= 30 THEN 1 ELSE 0 END nw FROM f WINDOW w AS (PARTITION BY shot ORDER BY t, indx)),
        l AS (SELECT *, sum(nw) OVER (PARTITION BY shot ORDER BY t, indx ROWS UNBOUNDED PRECEDING) line FROM n),
        s AS (SELECT *, count(*) OVER (PARTITION BY shot, line) length, first_value(indx) OVER w lead_id, coalesce((lead(freq) OVER w - freq) / (lead(t) OVER w - t), 0) s FROM l WINDOW w AS (PARTITION BY shot, line ORDER BY t, indx)),
        b AS (SELECT *, lag(s) OVER (PARTITION BY shot, line ORDER BY t, indx) b FROM s)
        SELECT indx, lead_id, length, CAST(CASE WHEN b IS NULL THEN s ELSE (s + b) / 2 END AS FLOAT) dfdt FROM b WHERE length >= 3""",
    "fs_band_join": f"""WITH a AS (SELECT indx, shot, fs_time t, freq f FROM features WHERE svs >= 4), b AS (SELECT indx other, shot, fs_time t, freq f FROM features WHERE svs < 4 AND {_KNOWN}),
        h AS (SELECT a.indx, count(*) n, min(other) o FROM a JOIN b ON a.shot = b.shot AND a.t > b.t - 0.0021 AND a.t < b.t + 0.0021 WHERE abs(a.t - b.t) < 0.002 AND abs(a.f - b.f) < 2 GROUP BY a.indx)
        SELECT a.indx, coalesce(n, 0) matches, CASE WHEN n = 1 THEN o END AS other FROM a LEFT JOIN h USING (indx)""",
    "fs_split_phases": "SELECT indx, phases[1] phases_0, phases[2] phases_1, phases[3] phases_2, phases[4] phases_3 FROM features",
    "fs_masked": "SELECT indx, CASE WHEN p::DOUBLE > 0.6 AND NOT isnan(freq) THEN freq END freq, CASE WHEN p::DOUBLE > 0.6 AND NOT isnan(kh) THEN kh END kh FROM features",
    "fs_bits": "SELECT indx, CAST(pow(2, svs) - 1 AS BIGINT) mask, svs AS n_bits, svs AS count FROM features",
    "fs_closed_loops": "SELECT indx, round(phases[1]::DOUBLE + 2 * pi(), 5) AS phase FROM features",
    "fs_flipped": "SELECT indx, CASE WHEN NOT isnan(kh) AND kh - 0.5 < 0 THEN -phases[1] ELSE phases[1] END AS first FROM features",
    "fs_locking": "SELECT shot, count(*) n, CAST(sum(CASE WHEN freq < 35 THEN 1 ELSE 0 END) AS BIGINT) n_low FROM features WHERE freq < 60 AND rms > 0.0005 AND NOT isnan(rms) AND NOT isnan(freq) GROUP BY shot HAVING n_low >= 3",
    "fs_contingency": "SELECT campaign, svs, count(*) n FROM features GROUP BY campaign, svs",
    "fs_coverage": f"WITH m AS (SELECT campaign, {_MODE} mode_id FROM features) SELECT campaign, mode_id, count(*) n, CAST(grouping_id(campaign, mode_id) AS BIGINT) level FROM m GROUP BY ROLLUP (campaign, mode_id)",
    "fs_trimmed": f"WITH d AS (SELECT indx, {_distance(CENTRE)} d FROM features) SELECT indx FROM d WHERE d < 1.2 UNION (SELECT indx FROM d WHERE d IS NOT NULL ORDER BY d, indx LIMIT 10)",
    "fs_interpolated": f"""WITH {_SLOW}, f AS (SELECT indx, shot, ref_channel AS channel, fs_time t FROM features WHERE fs_time IS NOT NULL AND NOT isnan(fs_time)),
        b AS (SELECT f.*, r.t ta, r.v va FROM f ASOF JOIN r ON f.shot = r.shot AND f.channel = r.channel AND f.t >= r.t), a AS (SELECT b.*, r.t tb, r.v vb FROM b ASOF JOIN r ON b.shot = r.shot AND b.channel = r.channel AND b.t <= r.t)
        SELECT indx, CAST(CASE WHEN ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END AS FLOAT) AS signal FROM a""",
    "fs_last_before": f"""WITH {_SLOW}, f AS (SELECT indx, shot, ref_channel AS channel, fs_time t FROM features WHERE fs_time IS NOT NULL AND NOT isnan(fs_time))
        SELECT indx, v AS signal FROM f ASOF JOIN r ON f.shot = r.shot AND f.channel = r.channel AND f.t >= r.t""",
    "fs_shot_of_time": """WITH p AS (SELECT rec_id point, start_utc + (end_utc - start_utc) // 2 a FROM shot_da WHERE end_utc >= start_utc), i AS (SELECT rec_id, start_utc s, end_utc e FROM shot_da WHERE end_utc >= start_utc),
        h AS (SELECT point, count(*) n, min(rec_id) rec_id FROM p JOIN i ON a >= s AND a <= e GROUP BY point) SELECT point, rec_id FROM h WHERE n = 1""",
    "fs_shot_runs": """WITH d AS (SELECT DISTINCT shot_date, progid FROM shot_da WHERE progid IS NOT NULL), g AS (SELECT *, progid - row_number() OVER (PARTITION BY shot_date ORDER BY progid) g FROM d),
        r AS (SELECT shot_date, g, min(progid) a, max(progid) b FROM g GROUP BY ALL) SELECT shot_date, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) runs FROM r GROUP BY shot_date""",
    "fs_touching": """WITH r AS (SELECT shot_date, progid, start_utc s, end_utc e FROM shot_da WHERE end_utc >= start_utc),
        m AS (SELECT *, max(e) OVER (PARTITION BY shot_date, progid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM r),
        g AS (SELECT *, sum(CASE WHEN pe >= s THEN 0 ELSE 1 END) OVER (PARTITION BY shot_date, progid ORDER BY s, e) k FROM m)
        SELECT shot_date, progid, min(s) start_utc, max(e) end_utc, count(*) n FROM g GROUP BY shot_date, progid, k""",
    "fs_shots_between": "SELECT DISTINCT shot_date, progid FROM shot_da WHERE shot_date::BIGINT * 1000 + progid >= 20040303100 AND shot_date::BIGINT * 1000 + progid < 20040308020",
    "fs_last_shot": "SELECT channel, max(shot) last_shot, count(DISTINCT shot) n_shots FROM timeseries WHERE signal IS NOT NULL AND NOT isnan(signal) GROUP BY channel",
    "fs_missing_shots": "SELECT DISTINCT shot_date::BIGINT * 1000 + progid AS shot FROM shot_da WHERE shot_date::BIGINT * 1000 + progid NOT IN (SELECT shot FROM probe_fits WHERE shot IS NOT NULL)",
    "fs_neighbours": "WITH i AS (SELECT indx FROM features WHERE svs = 5 AND freq < 30 AND NOT isnan(freq)) SELECT DISTINCT x AS indx FROM (SELECT unnest([indx - 1, indx, indx + 1]) x FROM i), (SELECT min(indx) a, max(indx) b FROM i) WHERE x BETWEEN a AND b",
    "fs_parameter_versions": """WITH s AS (SELECT DISTINCT save_id, shot, channel, version, min(saved_at) OVER (PARTITION BY save_id) saved_at FROM saved_signals),
        v AS (SELECT save_id, lag(version) OVER (PARTITION BY shot, channel ORDER BY saved_at, save_id) earlier_version FROM s) SELECT * FROM v WHERE earlier_version IS NOT NULL""",
    "fs_json_paths": "SELECT event_type, count(k) n, CAST(sum(k) AS BIGINT) total, count(json_extract(props, '$.a.b')) n_nested FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) k FROM events) GROUP BY event_type",
    "fs_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(value) n, round(avg(value), 6) mean, min(value) lowest, max(value) highest FROM events GROUP BY ALL",
    "fs_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END n FROM events),
        s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM e) SELECT min(ts) AS start, user_id, count(*) n FROM s GROUP BY user_id, s""",
}
