"""Queries of probe fits and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import clustering as C
from driftwell.operators import probes as P
from driftwell.operators.mining import finite
from driftwell.sources import table

KEYS = ["shot", "channel"]
AREA = 1e-6


def fits(spark: SparkSession, folder: str) -> DataFrame:
    """Each fit once; written again under one id it is the same fit."""
    return table(spark, folder, "probe_fits").dropDuplicates(["fit_id"])


def good(spark: SparkSession, folder: str) -> DataFrame:
    return P.good_fits(fits(spark, folder)).select("fit_id")


def density(spark: SparkSession, folder: str) -> DataFrame:
    return P.good_fits(fits(spark, folder)).select("fit_id", P.density(finite("i0"), finite("te"), AREA).cast("float").alias("ne18"))


def power(spark: SparkSession, folder: str) -> DataFrame:
    d = P.good_fits(fits(spark, folder))
    return d.select("fit_id", P.power(finite("i0"), finite("vf"), finite("te"), 0.5).cast("float").alias("power"), (finite("ne18") * finite("te")).cast("float").alias("pressure"))


def alfven(spark: SparkSession, folder: str) -> DataFrame:
    return fits(spark, folder).select("fit_id", P.alfven_speed(F.lit(1.25), finite("ne18")).cast("float").alias("v_a"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    s = P.summary(fits(spark, folder), KEYS, "vf", "t_mid")
    return s.select(*KEYS, "n", "peak", "raw_peak", "t_peak", "signed_peak", F.round("std", 6).alias("std"), F.round("average", 6).alias("average"), F.col("integral").cast("float").alias("integral"))


def wide_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row a shot with the mean electron temperature of the good fits of each probe, whichever probes there are."""
    te = F.struct("channel", F.col("te").cast("float").alias("te"))
    g = P.good_fits(fits(spark, folder)).groupBy("shot", "channel").agg(F.avg("te").alias("te")).groupBy("shot").agg(F.map_from_entries(F.sort_array(F.collect_list(te))).alias("te"))
    return g.select("shot", F.explode("te").alias("channel", "te"))


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    c = P.calibration(fits(spark, folder), KEYS, "i0", "ne18")
    return c.select(*KEYS, "n", *[F.col(x).cast("float").alias(x) for x in ("slope", "intercept", "residual")])


def clip_limits(spark: SparkSession, folder: str) -> DataFrame:
    return P.clip_limits(fits(spark, folder), ["channel"], "vf").select("channel", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def saturation(spark: SparkSession, folder: str) -> DataFrame:
    return P.saturation_level(fits(spark, folder), ["channel"], "vf").select("channel", F.round("level", 6).alias("level"))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of good fits in slices of 0.1 s of each shot and probe."""
    d = P.good_fits(fits(spark, folder)).withColumn("slice", F.floor(F.col("t_mid") * 10).cast("long"))
    return d.groupBy(*KEYS, "slice").agg(F.avg("te").cast("float").alias("te"), F.count("*").alias("n"))


def decay(spark: SparkSession, folder: str) -> DataFrame:
    """A falling exponential through the good fits of each shot and probe."""
    return P.fit_curves(P.good_fits(fits(spark, folder)), KEYS, "exponential", x="t_mid", y="te")


def sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """Characteristics of 48 voltages made from each shot and probe's median fit, and fitted anew."""
    m = P.good_fits(fits(spark, folder)).groupBy(*KEYS).agg(F.percentile_approx("te", 0.5).alias("a"), F.percentile_approx("vf", 0.5).alias("b"), F.percentile_approx("i0", 0.5).alias("c"))
    v = m.withColumn("v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: -60.0 + 2.0 * k)))
    return P.fit_sweeps(v.withColumn("i", F.col("c") * (1 - F.exp((F.col("v") - F.col("b")) / F.col("a")))), KEYS, voltage="v", current="i")


def _angles(spark: SparkSession, folder: str) -> DataFrame:
    return C.vectors(table(spark, folder, "features"), "indx", angles="phases", length=4)


def circle_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return C.circle_kmeans(_angles(spark, folder), 6)


def periodic_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return C.periodic_kmeans(_angles(spark, folder), 6)[1]


def von_mises(spark: SparkSession, folder: str) -> DataFrame:
    return C.fit_mixture(_angles(spark, folder), 4, angles=4)[1]


def gaussians(spark: SparkSession, folder: str) -> DataFrame:
    return C.fit_mixture(C.vectors(table(spark, folder, "features"), "indx", numbers=["freq", "kh", "p"]), 4, angles=0)[1]


def joint_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return C.cluster(table(spark, folder, "features"), "EM_VMM_GMM", 4, row_id="indx", angles="phases", length=4, numbers=["freq"])


def whitened_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return C.whitened_kmeans(table(spark, folder, "features"), ["freq", "kh", "p"], 4, row_id="indx")


def mode_list(spark: SparkSession, folder: str) -> DataFrame:
    """Centres and spreads of the circular fit of each svs number, as if it were a clustering."""
    s = C.von_mises_of(table(spark, folder, "features"), F.col("svs"), "phases")
    return C.mode_list(s, min_kappa=0.0)


def compared(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "features").select(F.col("indx").alias("id"), "svs", "campaign")
    return C.contingency(f.select("id", F.col("svs").alias("cluster")), f.select("id", F.col("campaign").alias("cluster")))


QUERIES = {f"lp_{f.__name__}": f for f in (good, density, power, alfven, summary, wide_summary, calibration, clip_limits, saturation, profile, decay, sweeps)} | {
    f"cl_{f.__name__}": f for f in (circle_kmeans, periodic_kmeans, von_mises, gaussians, joint_mixture, whitened_kmeans, mode_list, compared)
}

_F = "WITH f AS (SELECT DISTINCT ON (fit_id) * FROM probe_fits)"
_GOOD = """resid IS NOT NULL AND NOT isnan(resid) AND te IS NOT NULL AND NOT isnan(te) AND resid < 0.7 AND nits < maxits AND abs(vf::DOUBLE) < 200 AND abs(te) < 200 AND i0::DOUBLE > 4e-4 AND NOT isnan(vf) AND NOT isnan(i0)"""
_G = f"{_F}, g AS (SELECT * FROM f WHERE {_GOOD})"

SQL = {
    "lp_good": f"{_G} SELECT fit_id FROM g",
    "lp_density": f"{_G} SELECT fit_id, CAST(CASE WHEN te > 0 THEN {P.SATURATION / AREA!r}::DOUBLE * i0::DOUBLE / sqrt(te) END AS FLOAT) ne18 FROM g",
    "lp_power": f"{_G} SELECT fit_id, CAST(i0::DOUBLE * (vf::DOUBLE + 4 * te) * 0.5::DOUBLE AS FLOAT) power, CAST(ne18::DOUBLE * te AS FLOAT) pressure FROM g",
    "lp_alfven": f"{_F} SELECT fit_id, CAST(CASE WHEN ne18 > 0 AND NOT isnan(ne18) THEN 1.25::DOUBLE / sqrt(ne18::DOUBLE * {P.MU0 * 1e18 * P.PROTON!r}::DOUBLE) END AS FLOAT) v_a FROM f",
    "lp_summary": f"""{_F}, v AS (SELECT shot, channel, t_mid t, vf::DOUBLE v FROM f WHERE vf IS NOT NULL AND NOT isnan(vf) AND t_mid IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY shot, channel ORDER BY abs(v), t) - 1 i, count(*) OVER (PARTITION BY shot, channel) n, lead(t) OVER (PARTITION BY shot, channel ORDER BY t, v) - t d FROM v)
        SELECT shot, channel, count(*) n, max(CASE WHEN i = greatest(0, n - 1 - CAST(floor(0.03::DOUBLE * n + 0.5) AS BIGINT)) THEN abs(v) END) peak, max(abs(v)) raw_peak,
        arg_max(t, (abs(v), -t)) t_peak, arg_max(v, (abs(v), -t)) signed_peak, round(stddev_pop(v), 6) std, round(avg(v), 6) average, CAST(avg(d) * sum(v) AS FLOAT) integral FROM r GROUP BY shot, channel""",
    "lp_wide_summary": f"{_G} SELECT shot, channel, CAST(avg(te) AS FLOAT) te FROM g WHERE channel IS NOT NULL GROUP BY shot, channel",
    "lp_calibration": f"""{_F}, r AS (SELECT shot, channel, i0::DOUBLE x, ne18::DOUBLE y FROM f WHERE i0 IS NOT NULL AND ne18 IS NOT NULL AND NOT isnan(i0) AND NOT isnan(ne18))
        SELECT shot, channel, count(*) n, CAST(regr_slope(y, x) AS FLOAT) slope, CAST(regr_intercept(y, x) AS FLOAT) intercept,
        CAST(sqrt(greatest(0, regr_syy(y, x) - CASE WHEN regr_sxx(y, x) > 0 THEN pow(regr_sxy(y, x), 2) / regr_sxx(y, x) ELSE 0 END) / count(*)) AS FLOAT) residual FROM r GROUP BY ALL""",
    "lp_clip_limits": f"""{_F}, v AS (SELECT channel, vf::DOUBLE v FROM f WHERE vf IS NOT NULL AND NOT isnan(vf)), m AS (SELECT channel, min(v) a, max(v) b FROM v GROUP BY ALL),
        i AS (SELECT *, CASE WHEN b > a THEN least(floor((v - a) / (b - a) * 50), 49) ELSE 0 END i FROM v JOIN m USING (channel)),
        n AS (SELECT channel, a, b, (b - a) / 50 s, count(*) FILTER (WHERE i = 0) n0, count(*) FILTER (WHERE i = 1) n1, count(*) FILTER (WHERE i = 48) n2, count(*) FILTER (WHERE i = 49) n3 FROM i GROUP BY ALL)
        SELECT channel, round(CASE WHEN n0 > 3 * n1 THEN a + s ELSE a END, 6) low, round(CASE WHEN n3 > 3 * n2 THEN b - s ELSE b END, 6) high FROM n""",
    "lp_saturation": f"""{_F}, v AS (SELECT channel, vf::DOUBLE v FROM f WHERE vf IS NOT NULL AND NOT isnan(vf)), m AS (SELECT channel, avg(v) m, min(v) a FROM v GROUP BY ALL),
        i AS (SELECT *, CAST(least(floor((v - a) / (m - a) * 20), 19) AS INTEGER) i FROM v JOIN m USING (channel) WHERE v <= m AND m > a),
        n AS (SELECT channel, i, count(*) n, min(a + (i + 1) * (m - a) / 20) edge FROM i GROUP BY channel, i), t AS (SELECT *, max(n) OVER (PARTITION BY channel) p, arg_max(i, (n, i)) OVER (PARTITION BY channel) pi FROM n)
        SELECT channel, round(max(edge), 6) AS level FROM t WHERE i < pi AND n < p / 3.0 GROUP BY channel""",
    "lp_profile": f"{_G} SELECT shot, channel, CAST(floor(t_mid * 10) AS BIGINT) AS slice, CAST(avg(te) AS FLOAT) te, count(*) n FROM g GROUP BY ALL",
    "cl_compared": """WITH n AS (SELECT svs cluster_a, campaign cluster_b, count(*) n FROM features GROUP BY ALL), b AS (SELECT cluster_a, arg_max(cluster_b, (n, -cluster_b)) b FROM n GROUP BY ALL)
        SELECT cluster_a, cluster_b, n, cluster_b = b AS best FROM n JOIN b USING (cluster_a)""",
}
