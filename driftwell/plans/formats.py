"""Queries that send the tables through formats and back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.operators import fluctuations as X
from driftwell.operators import probes as P
from driftwell.operators import series as S
from driftwell.plans import probes
from driftwell.plans.series import known
from driftwell.session import scratch
from driftwell.sinks import writers
from driftwell.sources import archive, binary, table, text


def sine(spark: SparkSession, folder: str) -> DataFrame:
    """A made signal of one period, at the full scale of each channel."""
    c = table(spark, folder, "channels").select("channel", "full_scale")
    wave = text.sine(spark, n=64, t0=0.0, sample_freq=64.0, amplitude=1.0, frequency=1.0)
    return c.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).join(wave, "i").select("channel", F.col("i").cast("int").alias("i"), F.round(F.col("full_scale") * F.col("signal"), 6).alias("signal"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Feature records written as lines and read again."""
    f = table(spark, folder, "features").where("fs_time is not null and freq is not null and rms is not null and not isnan(freq) and not isnan(rms) and not isnan(fs_time)")
    out = text.fluctuation_lines(f.select("shot", F.col("fs_time").alias("t_mid"), "svs", "freq", F.col("rms").alias("amp"), "a12", "p", "h", "phases"))
    good, _ = text.parse_fluctuation_lines(out, phases=4)
    return good.groupBy("shot").agg(F.count("*").alias("n"), F.round(F.sum("freq"), 3).alias("freq"), F.sum("svs").alias("svs"), F.round(F.sum(F.get("phases", F.lit(0))), 2).alias("first_phase"))


def quantised(spark: SparkSession, folder: str) -> DataFrame:
    """Segments in whole numbers and back: the greatest error against their range."""

    def worst(v: np.ndarray) -> np.ndarray:
        q = binary.quantise(v)
        e = np.abs(binary.dequantise(q["start"], q["quantum"], q["raw"]) - v).max()
        return np.array([e / max(np.ptp(v), np.abs(v).max(), 1e-300), q["raw"].itemsize])

    rows = S.segment_arrays(S.segment(known(spark, folder), ["series_id"], "timebase", 256), ["series_id"])
    made = X.on_arrays(rows, "signal", worst, to="x")
    return made.select("series_id", "seg_id", (F.get("x", F.lit(0)) <= 3e-6).alias("exact"), F.get("x", F.lit(1)).cast("int").alias("bytes"))


def arff(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "features").select("indx", "svs", "campaign", "phases")
    _, rows = writers.arff_lines(f, "features", {"phases": 4})
    return rows.select(F.split("value", ",").alias("p")).select(F.get("p", F.lit(0)).cast("long").alias("indx"), F.size("p").alias("n_fields"))


def parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the events' properties."""
    e = table(spark, folder, "events").select("event_id", "props")
    return text.parameter_names(e, "props", "event_id").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("value").try_cast("long")).alias("total"))


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen columns and rows saved and read."""
    to = scratch(spark, "saved")
    writers.save(table(spark, folder, "features"), to, columns=["indx", "freq", "phases"], where=F.col("svs") >= 3)
    return spark.read.parquet(to).select("indx", "freq", F.get("phases", F.lit(3)).alias("last_phase"))


def added(spark: SparkSession, folder: str) -> DataFrame:
    """A column added to a saved table by id."""
    f = table(spark, folder, "features")
    to = scratch(spark, "added")
    writers.save(writers.with_added(f.select("indx", "svs"), f.select("indx", (F.col("svs") * 2).alias("twice"))), to)
    return spark.read.parquet(to)


def replaced(spark: SparkSession, folder: str) -> DataFrame:
    """A summary by shot, in which the shots of campaign 2 are then replaced by new rows."""
    f = table(spark, folder, "features").select("indx", "campaign", "svs", "shot")
    to = scratch(spark, "replaced")
    writers.replace_shots(f.withColumn("bucket", F.col("campaign")), to, by="bucket")
    writers.replace_shots(f.where("campaign = 2 and svs > 2").withColumn("svs", -F.col("svs")).withColumn("bucket", F.col("campaign")), to, by="bucket")
    return spark.read.parquet(to).groupBy("campaign").agg(F.count("*").alias("n"), F.sum("svs").alias("svs"))


def csv(spark: SparkSession, folder: str) -> DataFrame:
    """Records as CSV with columns for their phases, read again."""
    to = scratch(spark, "csv")
    writers.write_csv(table(spark, folder, "features").select("indx", "svs", "kh", "phases"), to, about={"rows": "features"}, lengths={"phases": 2})
    back = text.inferred(spark.read.option("header", True).csv(f"{to}/rows"), ["indx", "svs", "kh", "phases_0", "phases_1"])
    return back.select("indx", "svs", (F.round("phases_1", 5) + 0.0).alias("phases_1"))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and settings saved and loaded."""
    to = scratch(spark, "clusters")
    writers.save_clusters(table(spark, folder, "features").select("indx", F.col("svs").alias("cluster")), {"method": "given", "k": 5}, to)
    labels, settings = writers.load_clusters(spark, to)
    return labels.withColumn("k", F.lit(int(settings["k"])))


def shot_list(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue as JSON and back; each program's begin, where it has one record."""
    to = scratch(spark, "shots")
    d = table(spark, folder, "shot_da").select(F.col("shot_date").alias("date"), "progid", "start_utc", "end_utc", F.col("comment_txt").alias("comment"))
    writers.save_shot_list(d, to)
    s = archive.shot_catalogue(spark, to)
    return archive.program_times(s, s.select("date", "progid").distinct()).where("n = 1 and start_utc is not null")


def sample_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Known samples in a partitioned cache, of which one diagnostic is read."""
    to = scratch(spark, "samples")
    k = known(spark, folder).join(table(spark, folder, "channels").select("channel", F.col("diag").alias("diag_name")), "channel")
    writers.save_samples(k.select(F.lit("D").alias("device"), F.expr("shot div 100000").alias("shot"), F.col("diag_name").alias("diag"), "sample_id", "channel", "signal"), to)
    one = table(spark, folder, "channels").agg(F.min("diag")).first()[0]
    shots = [r[0] for r in table(spark, folder, "timeseries").select(F.expr("shot div 100000")).distinct().limit(1000).collect()]  # months
    return archive.cached(spark, to, device="D", shots=shots, diag=one).select("sample_id", "channel", "signal")


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """Structures and their phase pairs as two tables of one result, joined again."""
    to = scratch(spark, "objects")
    f = table(spark, folder, "features")
    writers.save_objects({"structures": f.select("indx", "shot", "svs"), "pairs": f.select("indx", F.posexplode("phases").alias("k", "phase"))}, to)
    pairs = spark.read.parquet(f"{to}/pairs").groupBy("indx").agg(F.count("phase").alias("n_pairs"))
    return spark.read.parquet(f"{to}/structures").join(pairs, "indx")


def fit_records(spark: SparkSession, folder: str) -> DataFrame:
    """Good fits with their density, saved for analysis and read."""
    to = scratch(spark, "fits")
    good = P.good_fits(table(spark, folder, "probe_fits").dropDuplicates(["fit_id"]))
    writers.save(good.select("fit_id", "channel", "nits", "te"), to)
    return spark.read.parquet(to).select("fit_id", "channel", "nits")


@F.pandas_udf(T.BinaryType())
def _packed(t: pd.Series, v: pd.Series) -> pd.Series:
    kind = np.dtype([("t", "<f8"), ("v", "<f8")])
    return pd.Series([np.array(list(zip(a, b, strict=True)), dtype=kind).tobytes() for a, b in zip(t, v, strict=True)])


def _arrays(spark: SparkSession, folder: str) -> DataFrame:
    """series_id, and its samples in pieces of 256 as two arrays."""
    rows = S.segment(known(spark, folder), ["series_id"], "timebase", 256).groupBy("series_id", "seg_id").agg(F.sort_array(F.collect_list(F.struct("seg_i", "timebase", "signal"))).alias("r"))
    return rows.select("series_id", "seg_id", F.transform("r", lambda x: x["timebase"]).alias("t"), F.transform("r", lambda x: x["signal"]).alias("v"))


def binary_records(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as files of fixed records, decoded again."""
    path = F.concat_ws("/", F.col("series_id").cast("string"), F.col("seg_id").cast("string"))
    back = binary.records_of(_arrays(spark, folder).select(path.alias("path"), _packed("t", "v").alias("content")), [("timebase", "<f8"), ("signal", "<f8")])
    return back.select(F.split_part("file", F.lit("/"), F.lit(1)).cast("long").alias("series_id"), "timebase", "signal")


@F.pandas_udf(T.BinaryType())
def _npz(t: pd.Series, v: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(t, v, strict=True):
        f = io.BytesIO()
        np.savez(f, timebase=np.asarray(a, dtype=float), signal=np.asarray(b, dtype=float))
        out.append(f.getvalue())
    return pd.Series(out)


def npz(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as .npz files with a channel that was wired the other way round, decoded again."""
    files = _arrays(spark, folder).select(F.col("series_id").cast("string").alias("path"), _npz("t", "v").alias("content"))
    a = binary.signs_turned(binary.npz_arrays_of(files), ["signal"]).where("name = 'signal'")
    return a.groupBy(F.col("file").cast("long").alias("series_id")).agg(F.sum(F.size("values")).alias("n"), F.min(F.array_min("values")).alias("lowest"))


@F.pandas_udf(T.BinaryType())
def _zip(v: pd.Series) -> pd.Series:
    out = []
    for b in v:
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("a.txt", "# values\n" + "\n".join(repr(float(x)) for x in b))
        out.append(f.getvalue())
    return pd.Series(out)


def zipped_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as zip files of text arrays, read again."""
    files = _arrays(spark, folder).select(F.col("series_id").cast("string").alias("path"), _zip("v").alias("content"))
    return binary.zipped_text_arrays(files, {"a.txt": "signal"}).groupBy(F.col("file").cast("long").alias("series_id"), "name").agg(F.count("*").alias("n"), F.max("value").alias("highest"))


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of coordinates among comments and broken lines."""
    f = table(spark, folder, "features").where("freq is not null and kh is not null and not isnan(freq) and not isnan(kh)")
    lines = f.select(F.explode(F.array(F.format_string("%d, %.17g  %.17g", "indx", "freq", "kh"), F.lit("# x y z"), F.lit("1 two"))).alias("value"))
    return text.coordinates(lines).select(F.col("x").cast("long").alias("indx"), "y", "z")


def delimited(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as lines of a time and two values, saved and read."""
    to = scratch(spark, "delimited")
    known(spark, folder).select(F.format_string("%.17g  %.17g\t%d", "timebase", "signal", "sample_id").alias("value")).write.text(to)
    d = text.delimited_samples(spark, to, channels=["signal", "sample_id"])
    w = d.groupBy("i", "timebase").agg(F.max(F.when(F.col("channel") == "signal", F.col("signal"))).alias("value"), F.max(F.when(F.col("channel") == "sample_id", F.col("signal"))).cast("long").alias("sample_id"))
    return w.select("sample_id", "timebase", "value")


def archive_json(spark: SparkSession, folder: str) -> DataFrame:
    """Archive answers in short words for each series, saved and decoded."""
    to = scratch(spark, "archive")
    a = _arrays(spark, folder).where("seg_id = 0").select(
        F.transform("t", lambda x: F.round(x * 1e9).cast("long")).alias("dimensions"), F.transform("v", lambda x: F.floor(x).cast("double")).alias("values"), F.lit("short").alias("datatype"), F.col("series_id").cast("string").alias("label"), F.lit("V").alias("unit"),
    )
    a.select(F.to_json(F.struct(*a.columns)).alias("value")).write.text(to)
    s = spark.read.schema(archive.ARCHIVE).json(to)
    d = archive.decoded(s.withColumn("file", F.lit("")), short_scale=0.5)
    return d.groupBy(F.col("label").cast("long").alias("series_id")).agg(F.count("*").alias("n"), F.max("signal").alias("highest"))


def times(spark: SparkSession, folder: str) -> DataFrame:
    """Program dates as text in two spellings, to ns."""
    d = table(spark, folder, "shot_da").select("rec_id", F.col("shot_date").cast("string").alias("d"))
    spelt = F.when(F.col("rec_id") % 2 == 0, F.col("d")).otherwise(F.concat_ws("-", F.substring("d", 1, 4), F.substring("d", 5, 2), F.substring("d", 7, 2)))
    return d.select("rec_id", text.time_ns(spelt).alias("ns"))


def polar(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "features").select("indx", F.cos(F.get("phases", F.lit(0)).cast("double")).alias("re"), F.sin(F.get("phases", F.lit(0)).cast("double")).alias("im"))
    return writers.magnitude_phase(f, "re", "im", "z").select("indx", F.round("mag_z", 6).alias("mag"), (F.round("phase_z", 4) + 0.0).alias("phase"))


QUERIES = {f"io_{f.__name__}": f for f in (
    sine, lines, quantised, arff, parameters, saved, added, replaced, csv, clusters, shot_list, sample_cache, objects, fit_records, binary_records, npz, zipped_arrays, coordinates, delimited,
    archive_json, times, polar,
)}
_OK = "fs_time IS NOT NULL AND freq IS NOT NULL AND rms IS NOT NULL AND NOT isnan(freq) AND NOT isnan(rms) AND NOT isnan(fs_time)"
_K = """k AS (SELECT DISTINCT sample_id, series_id, shot, channel, timebase, signal FROM timeseries JOIN channels USING (channel)
    WHERE timebase IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal) AND abs(signal) <= 2 * full_scale)"""
SQL = {
    "io_saved": "SELECT indx, freq, phases[4] AS last_phase FROM features WHERE svs >= 3",
    "io_added": "SELECT indx, svs, svs * 2 AS twice FROM features",
    "io_replaced": "SELECT campaign, count(*) n, CAST(sum(CASE WHEN campaign = 2 THEN -svs ELSE svs END) AS BIGINT) svs FROM features WHERE campaign <> 2 OR svs > 2 GROUP BY campaign",
    "io_csv": "SELECT indx, svs::BIGINT AS svs, round(phases[2]::DOUBLE, 5) + 0.0 AS phases_1 FROM features",
    "io_clusters": "SELECT indx, svs AS cluster, 5 AS k FROM features",
    "io_shot_list": "SELECT shot_date AS date, progid, min(start_utc) start_utc, count(*) n FROM shot_da WHERE shot_date IS NOT NULL AND progid IS NOT NULL GROUP BY ALL HAVING count(*) = 1 AND min(start_utc) IS NOT NULL",
    "io_sample_cache": f"WITH {_K} SELECT sample_id, channel, signal FROM k JOIN channels USING (channel) WHERE diag = (SELECT min(diag) FROM channels)",
    "io_objects": "SELECT indx, shot, svs, len(phases) AS n_pairs FROM features",
    "io_binary_records": f"WITH {_K} SELECT series_id, timebase, signal FROM k",
    "io_npz": f"WITH {_K} SELECT series_id, count(*) n, -max(signal) lowest FROM k GROUP BY series_id",
    "io_zipped_arrays": f"WITH {_K} SELECT series_id, 'signal' AS name, count(*) n, max(signal) highest FROM k GROUP BY series_id",
    "io_coordinates": "SELECT indx, freq AS y, kh AS z FROM features WHERE NOT isnan(freq) AND NOT isnan(kh)",
    "io_delimited": f"WITH {_K} SELECT sample_id, timebase, signal AS value FROM k",
    "io_archive_json": f"""WITH {_K}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timebase) i FROM k)
        SELECT series_id, count(*) n, max(floor(signal) * 0.5::DOUBLE) highest FROM i WHERE i <= 256 GROUP BY series_id""",
    "io_fit_records": f"{probes._G} SELECT fit_id, channel, nits FROM g",
    "io_times": "SELECT rec_id, epoch_ns(strptime(shot_date::VARCHAR, '%Y%m%d')) AS ns FROM shot_da",
    "io_polar": "SELECT indx, round(sqrt(pow(cos(p), 2) + pow(sin(p), 2)), 6) mag, round(atan2(sin(p), cos(p)), 4) + 0.0 AS phase FROM (SELECT indx, phases[1]::DOUBLE p FROM features)",
    "io_sine": "SELECT channel, CAST(i AS INTEGER) i, round(full_scale * sin(2 * pi() * i / 64), 6) AS signal FROM channels, range(64) t(i)",
    "io_lines": f"SELECT shot, count(*) n, round(sum(freq), 3) freq, CAST(sum(svs) AS BIGINT) svs, round(sum(phases[1]::DOUBLE), 2) first_phase FROM features WHERE {_OK} GROUP BY shot",
    "io_arff": "SELECT indx, 7 AS n_fields FROM features",
    "io_parameters": "SELECT 'k' AS key, count(*) n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) total FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
}
