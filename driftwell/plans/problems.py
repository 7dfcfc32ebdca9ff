"""Queries of the data problems 3 to 6 on their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators.conversion import to_common_units
from driftwell.operators.gridding import regular_grid
from driftwell.operators.implausible import implausible
from driftwell.operators.intervals import continuous_periods
from driftwell.sources import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return continuous_periods(table(spark, folder, "shot_da"), ["shot_date", "progid"], "start_utc", "end_utc")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "channels").select("channel", "dt_s")
    readings = table(spark, folder, "timeseries").select("sample_id", "series_id", "channel", "timebase", "signal").join(steps, "channel")
    return regular_grid(readings, source="series_id", time="timebase", value="signal", step="dt_s", reading_id="sample_id")


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell of every series with its filled level, weighted mean, coverage and number of readings; sums in single precision, for comparing."""
    return _grid(spark, folder).select("series_id", "cell_no", "level", F.col("mean").cast("float").alias("mean"), F.col("coverage").cast("float").alias("coverage"), "n_readings")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where("n_readings = 0").select("series_id", "cell_no")


def p5_converted(spark: SparkSession, folder: str) -> DataFrame:
    """Every saved signal with its times in seconds and its peak in the common unit."""
    return to_common_units(
        table(spark, folder, "saved_signals"), record_id="save_id", quantity="quantity", value="peak_raw", units="units", text="params", scales="scales",
        time_unit="time_unit_in_seconds", times=["t_first", "t_last"], common=table(spark, folder, "common_units"),
    ).withColumnRenamed("record_id", "save_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    whole = lambda x, by: F.round(F.col(x) * by).cast("long")
    cases = p5_converted(spark, folder).where(F.col("converted") & F.col("unit").isNotNull())
    return cases.select("save_id", whole("t_last_s", 1_000_000).alias("t_last_us"), whole("value_common", 1000).alias("peak_milli"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """All three measurements as one list of readings, so that one exchange and one pass of forests serves them."""
    scale = table(spark, folder, "channels").select("channel", "full_scale")
    series = table(spark, folder, "timeseries").select("sample_id", "series_id", "channel", "timebase", "signal").join(scale, "channel", "left")
    fits = table(spark, folder, "probe_fits").select("fit_id", "shot", "channel", "t_mid", "te", "resid")

    def part(df: DataFrame, kind: int, a: str, b: Column, rec: str, time: str, value: str, no: Column) -> DataFrame:
        v = F.col(value).cast("double")
        return df.select(
            F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), b.alias("b"), F.concat(F.lit(f"{kind}/"), F.coalesce("channel", F.lit(""))).alias("ch"),
            (F.col(rec).cast("long") * 4 + kind).alias("rec"), F.col(time).alias("t"), v.alias("v"), no.alias("no"),
        )

    none = F.lit(None).cast("string")
    te, resid = F.col("te"), F.col("resid")
    rows = (
        part(series, 0, "series_id", none, "sample_id", "timebase", "signal", F.abs("signal") > 2 * F.col("full_scale"))
        .unionByName(part(fits, 1, "shot", F.col("channel"), "fit_id", "t_mid", "te", (te <= 0) | (te > 10_000)))
        .unionByName(part(fits, 2, "shot", F.col("channel"), "fit_id", "t_mid", "resid", (resid < 0) | (resid > 100)))
    )
    return implausible(rows, source=[F.col("kind"), F.col("a"), F.col("b")], time="t", value="v", reading_id="rec", impossible=F.col("no"), channel=F.col("ch"))


def _named(judged: DataFrame) -> DataFrame:
    kind = F.expr("cast(pmod(reading_id, 4) as int)")
    names = F.when(kind == 0, F.lit("timeseries")).otherwise("probe_fits").alias("rec_table")
    fields = F.when(kind == 0, F.lit("signal")).when(kind == 1, "te").otherwise("resid").alias("rec_field")
    return judged.select(names, fields, F.expr("(reading_id - pmod(reading_id, 4)) div 4").alias("rec_id"), "score", "flagged")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _named(_judged(spark, folder).where("flagged")).select("rec_table", "rec_field", "rec_id")


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading with the score of its source's forest and whether it is flagged."""
    return _named(_judged(spark, folder))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_grid": p4_grid, "p5_found": p5_found, "p5_converted": p5_converted, "p6_found": p6_found, "p6_scores": p6_scores}

SQL = {
    "p3_found": """
        WITH r AS (SELECT DISTINCT shot_date, progid, start_utc s, end_utc e FROM shot_da WHERE end_utc >= start_utc),
        m AS (SELECT *, max(e) OVER (PARTITION BY shot_date, progid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM r),
        g AS (SELECT *, sum(CASE WHEN pe >= s THEN 0 ELSE 1 END) OVER (PARTITION BY shot_date, progid ORDER BY s, e) k FROM m),
        p AS (SELECT shot_date, progid, k, min(s) s, max(e) e FROM g GROUP BY ALL),
        n AS (SELECT *, lead(s) OVER (PARTITION BY shot_date, progid ORDER BY s) ns FROM p)
        SELECT shot_date, progid, 'period' AS kind, s AS start_utc, e AS end_utc FROM p
        UNION ALL SELECT shot_date, progid, 'gap', e, ns FROM n WHERE ns IS NOT NULL""",
    "p4_found": """
        WITH r AS (SELECT DISTINCT series_id, CAST(floor(timebase / dt_s) AS BIGINT) c FROM timeseries JOIN channels USING (channel)
                   WHERE timebase IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal)),
        n AS (SELECT *, lead(c) OVER (PARTITION BY series_id ORDER BY c) nc FROM r)
        SELECT series_id, unnest(range(c + 1, nc)) AS cell_no FROM n WHERE nc > c + 1""",
    "p4_grid": """
        WITH r AS (SELECT DISTINCT series_id, sample_id, timebase t, signal v, dt_s d, CAST(floor(timebase / dt_s) AS BIGINT) c
                   FROM timeseries JOIN channels USING (channel) WHERE timebase IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal)),
        n AS (SELECT *, lead(t, 1, t) OVER (PARTITION BY series_id ORDER BY t, v, sample_id) nt FROM r),
        x AS (SELECT *, unnest(range(c, greatest(c, CAST(floor(nt / d) AS BIGINT)) + 1)) AS cell_no FROM n),
        h AS (SELECT *, greatest(0, least(nt, t + d, cell_no * d + d) - greatest(t, cell_no * d)) w FROM x)
        SELECT series_id, cell_no, arg_max(v, (t, v)) AS level, CAST(CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) END AS FLOAT) AS mean,
               CAST(least(1.0, sum(w) / max(d)) AS FLOAT) AS coverage, sum(CASE WHEN c = cell_no THEN 1 ELSE 0 END) AS n_readings
        FROM h GROUP BY series_id, cell_no""",
}
