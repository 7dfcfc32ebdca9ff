"""JSON archives of signals, shot catalogues, cached signals, and the registry of named readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.sources.config import nearest_names

ARCHIVE = "dimensions array<long>, values array<double>, datatype string, label string, unit string"


def json_signals(spark: SparkSession, path: str, *, short_scale: float = 1 / 3277.24) -> DataFrame:
    """file, label, utc_ns, signal of archive answers {dimensions, values}: short words are scaled; values beyond the times are dropped."""
    return decoded(spark.read.schema(ARCHIVE).json(path, multiLine=True).withColumn("file", F.input_file_name()), short_scale=short_scale)


def decoded(a: DataFrame, *, short_scale: float = 1 / 3277.24) -> DataFrame:
    """The same for answers that are read already: file and the columns of ARCHIVE."""
    pairs = a.select("file", "label", "datatype", F.posexplode(F.arrays_zip("dimensions", "values")).alias("i", "x")).select("file", "label", "i", F.col("x.dimensions").alias("utc_ns"), F.col("x.values").alias("v"), "datatype")
    return pairs.where("utc_ns is not null").select("file", "label", "i", "utc_ns", F.when(F.lower("datatype") == "short", F.col("v") * short_scale).otherwise(F.col("v")).alias("signal"))


def shot_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date int, progid int, start_utc long, end_utc long, comment string").json(path)


def program_times(shots: DataFrame, wanted: DataFrame) -> DataFrame:
    """date, progid, start_utc: of a program; program 0 begins at midnight, 999 and more at the next one; LookupError material (n > 1) has n.

    Days are counted in UTC.
    """
    s = shots.groupBy("date", "progid").agg(F.count("*").alias("n"), F.min("start_utc").alias("s"))
    midnight = F.unix_micros(F.to_timestamp(F.col("date").cast("string"), "yyyyMMdd")) * 1000
    out = F.when(F.col("n") == 1, F.col("s")).when(F.col("n").isNull() & (F.col("progid") == 0), midnight).when(F.col("n").isNull() & (F.col("progid") >= 999), midnight + F.lit(86_400_000_000_000))
    return wanted.join(s, ["date", "progid"], "left").select("date", "progid", out.alias("start_utc"), F.coalesce("n", F.lit(0)).alias("n"))


def cached(spark: SparkSession, folder: str, *, device: str, shots: list[int], diag: str) -> DataFrame:
    """Samples of a partitioned cache device=/shot=/diag=; only the wanted partitions are read."""
    return spark.read.parquet(folder).where((F.col("device") == device) & F.col("shot").isin(shots) & (F.col("diag") == diag))


def shot_number(date: Column, progid: Column) -> Column:
    return date.cast("long") * 1000 + progid


class Registry:
    """Readers by name. A reader takes (spark, shots, **settings) and gives a DataFrame; names come from configuration, code never does."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def keep(reader: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self._readers[name] = reader
            return reader

        return keep

    def getdata(self, spark: SparkSession, name: str, shots: int | list[int], *, missing_ok: bool = False, **settings) -> DataFrame | None:
        """Data of one shot or several, put together; an unknown name raises LookupError with the nearest names, or gives None."""
        if name not in self._readers:
            if missing_ok:
                return None
            raise LookupError(f"no source {name}; nearest: {', '.join(nearest_names(name, list(self._readers)))}")
        out = None
        for shot in [shots] if isinstance(shots, int) else shots:
            one = self._readers[name](spark, shot, **settings).withColumn("shot", F.lit(shot).cast("long"))
            out = one if out is None else out.unionByName(one)
        return out


registry = Registry()
