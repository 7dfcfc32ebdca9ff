"""Queries of the operators on shots, scans and shapes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import circular as C
from driftwell.operators import mining as M
from driftwell.operators import series as S
from driftwell.operators import shots as H
from driftwell.plans.series import known
from driftwell.sources import table

CENTRE = [0.5, -0.5, 1.5, -1.5]


def _fits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "probe_fits").dropDuplicates(["fit_id"])


def varied_blocks(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "features").where("kh is not null and freq is not null and not isnan(kh) and not isnan(freq)").select("campaign", "indx", F.floor(F.col("kh") * 4).alias("a"), F.floor(F.col("freq") / 15).alias("b"))
    return H.varied_blocks(f, ["indx"], "a", "b", keys=["campaign"])


def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return H.first_seen(table(spark, folder, "features").select("shot", "campaign", F.struct("campaign", "indx").alias("o")), "shot", "campaign", "o")


def paths(spark: SparkSession, folder: str) -> DataFrame:
    return H.path_globs(table(spark, folder, "probe_fits").select("shot").distinct(), "shot", "data/%d/*.parquet")


def wildcard(spark: SparkSession, folder: str) -> DataFrame:
    d = H.by_wildcard(_fits(spark, folder), ["shot"], "channel", "vf", "^LP0[1-9]$")
    return d.select("shot", "min", "max", *[F.col(c).cast("float").alias(c) for c in ("sum", "average", "std", "rms")])


def ratios(spark: SparkSession, folder: str) -> DataFrame:
    means = known(spark, folder).groupBy("shot", "channel").agg(F.max("signal").alias("peak"))
    return H.ratios(means, ["shot"], "channel", "peak", "I_COIL_M").where("ratio is not null").select("shot", "channel", F.col("ratio").cast("float").alias("ratio"))


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "features").where("kh is not null and not isnan(kh)").select("indx", F.get("phases", F.lit(0)).cast("double").alias("phi"), "kh")
    r = H.horner([0.1, -0.2, 1.3], F.col("kh"))
    xyz = f.select("indx", *H.cylinder_to_xyz(r, F.col("phi"), F.col("kh")))
    return xyz.select("indx", *H.rotated(F.col("x"), F.col("y"), math.pi / 6), "z").select("indx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "z")


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "features").select("svs", F.posexplode("phases").alias("k", "a"))
    c = H.circular_centroid(x, ["svs", "k"], "a")
    return c.select("svs", "k", "n", F.col("cost").cast("float").alias("cost"))


def distances(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of distances from a template and what exceeds an even background."""
    d = table(spark, folder, "features").select(F.floor(C.template_distance(F.col("phases"), CENTRE) * 10).cast("int").alias("bin")).where("bin is not null")
    return H.background(d.groupBy("bin").agg(F.count("*").alias("n")), 4).select("bin", "n", F.round("excess", 4).alias("excess"))


def running_coherence(spark: SparkSession, folder: str) -> DataFrame:
    r = known(spark, folder).withColumn("late", F.lag("signal", 2).over(S.over(["series_id"], "timebase"))).where("late is not null")
    return H.running_coherence(r, ["series_id"], "timebase", 24, "signal", "late").select("sample_id", F.round("coherence", 4).alias("coherence"))


def upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Records of few singular values, with p of the one record of many that lies near, and the records of many that lie near none."""
    f = table(spark, folder, "features").select("indx", "shot", "fs_time", "freq", "p", "svs")
    left, right = f.where("svs >= 4"), f.where("svs < 4").withColumnRenamed("indx", "other")
    m = M.band_join(left, right, key="shot", time="fs_time", freq="freq", dt=0.002, df=2.0, left_id="indx", right_id="other")
    return H.upsert_matched(right, left, m, left_id="indx", right_id="other", columns=["p"]).select("other", "shot", "svs", "p")


def same_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the fits that differ from themselves without repeats, by all columns but the time of writing."""
    f = table(spark, folder, "probe_fits")
    names = [c for c in f.columns if c != "written_at"]
    return H.differing_rows(f, f.dropDuplicates(names), but=["written_at"]).select("fit_id", "t_mid", "side", "times")


QUERIES = {f"sh_{f.__name__}": f for f in (varied_blocks, first_seen, paths, wildcard, ratios, coordinates, centroids, distances, running_coherence, upserted, same_tables)}

_C = """c AS (SELECT DISTINCT sample_id, series_id, shot, channel, timebase, signal FROM timeseries JOIN channels USING (channel)
    WHERE timebase IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal) AND abs(signal) <= 2 * full_scale)"""
_WRAP = "({x} - 2 * pi() * floor(({x} + pi()) / (2 * pi())))"
_DIST = "sqrt((" + " + ".join("pow(" + _WRAP.format(x=f"(phases[{i + 1}]::DOUBLE - ({c}::DOUBLE))") + ", 2)" for i, c in enumerate(CENTRE)) + ") / 4)"
SQL = {
    "sh_varied_blocks": """WITH f AS (SELECT campaign, indx, floor(kh * 4) a, floor(freq / 15) b, row_number() OVER (PARTITION BY campaign ORDER BY indx) - 1 i FROM features WHERE kh IS NOT NULL AND freq IS NOT NULL AND NOT isnan(kh) AND NOT isnan(freq)),
        x AS (SELECT *, unnest(range(greatest(0, CAST(floor((i - 20) / 10.0) AS BIGINT) + 1), CAST(floor(i / 10.0) AS BIGINT) + 1)) block FROM f)
        SELECT campaign, CAST(block AS INTEGER) block, count(*) n, count(DISTINCT a) n_a, count(DISTINCT b) n_b, min(a) a_low, max(a) a_high, min(b) b_low, max(b) b_high FROM x GROUP BY campaign, block
        HAVING n = 20 AND n_a BETWEEN 2 AND 5 AND n_b BETWEEN 2 AND 10""",
    "sh_first_seen": "SELECT shot, arg_min(campaign, (campaign, indx)) campaign FROM features GROUP BY shot",
    "sh_paths": "SELECT DISTINCT 'data/' || shot || '/*.parquet' AS path FROM probe_fits",
    "sh_wildcard": """SELECT shot, min(v) AS min, max(v) AS max, CAST(sum(v) AS FLOAT) AS sum, CAST(avg(v) AS FLOAT) average, CAST(stddev_pop(v) AS FLOAT) std, CAST(sqrt(avg(v * v)) AS FLOAT) rms
        FROM (SELECT DISTINCT ON (fit_id) shot, channel, vf::DOUBLE v FROM probe_fits) WHERE regexp_matches(channel, '^LP0[1-9]$') AND v IS NOT NULL AND NOT isnan(v) GROUP BY shot""",
    "sh_ratios": f"""WITH {_C}, m AS (SELECT shot, channel, max(signal) peak FROM c GROUP BY ALL), b AS (SELECT shot, peak base FROM m WHERE channel = 'I_COIL_M')
        SELECT shot, channel, CAST(peak / base AS FLOAT) ratio FROM m JOIN b USING (shot) WHERE base <> 0""",
    "sh_coordinates": """WITH f AS (SELECT indx, phases[1]::DOUBLE phi, kh, (0.1::DOUBLE * kh - 0.2::DOUBLE) * kh + 1.3::DOUBLE r FROM features WHERE kh IS NOT NULL AND NOT isnan(kh))
        SELECT indx, round(r * cos(phi) * cos(pi() / 6) - r * sin(phi) * sin(pi() / 6), 5) x, round(r * cos(phi) * sin(pi() / 6) + r * sin(phi) * cos(pi() / 6), 5) y, kh z FROM f""",
    "sh_centroids": """WITH x AS (SELECT svs, k - 1 AS k, phases[k]::DOUBLE a FROM (SELECT svs, phases, unnest(range(1, len(phases) + 1)) k FROM features)), a AS (SELECT svs, k, a - 2 * pi() * floor(a / (2 * pi())) a FROM x WHERE a IS NOT NULL),
        r AS (SELECT svs, k, count(*) OVER p n, sum(a) OVER p s, sum(a * a) OVER p q, row_number() OVER o j, sum(a) OVER (o ROWS UNBOUNDED PRECEDING) r FROM a WINDOW p AS (PARTITION BY svs, k), o AS (PARTITION BY svs, k ORDER BY a))
        SELECT svs, CAST(k AS INTEGER) k, max(n) n, CAST(min(greatest(0, q + 4 * pi() * r + 4 * pi() * pi() * j - pow(s + 2 * pi() * j, 2) / n)) AS FLOAT) AS cost FROM r GROUP BY svs, k""",
    "sh_distances": f"""WITH b AS (SELECT CAST(floor({_DIST} * 10) AS INTEGER) bin, count(*) n FROM features GROUP BY bin), s AS (SELECT *, pow(bin + 0.5, 3) s, bin >= max(bin) OVER () / 2.0 h FROM b WHERE bin IS NOT NULL)
        SELECT bin, n, round(n - s * (sum(CASE WHEN h THEN n * s END) OVER () / sum(CASE WHEN h THEN s * s END) OVER ()), 4) excess FROM s""",
    "sh_upserted": """WITH l AS (SELECT indx, shot, fs_time t, freq f, p, svs FROM features WHERE svs >= 4), r AS (SELECT indx other, shot, fs_time t, freq f, p, svs FROM features WHERE svs < 4),
        h AS (SELECT l.indx, count(*) n, min(other) o FROM l JOIN r ON l.shot = r.shot WHERE NOT isnan(l.t) AND NOT isnan(l.f) AND NOT isnan(r.t) AND NOT isnan(r.f) AND abs(l.t - r.t) < 0.002 AND abs(l.f - r.f) < 2 GROUP BY l.indx),
        m AS (SELECT o, min(indx) i FROM h WHERE n = 1 GROUP BY o), q AS (SELECT o, l.p FROM m JOIN l ON l.indx = m.i)
        SELECT other, shot, svs, coalesce(q.p, r.p) p FROM r LEFT JOIN q ON o = other UNION ALL SELECT NULL, shot, svs, p FROM l WHERE indx NOT IN (SELECT indx FROM h)""",
    "sh_same_tables": """WITH f AS (SELECT fit_id, shot, shot_date, progid, channel, t_mid, te, vf, i0, resid, nits, maxits, ne18, count(*) n FROM probe_fits GROUP BY ALL)
        SELECT fit_id, t_mid, 'a' AS side, n - 1 AS times FROM f WHERE n > 1""",
}
