"""Choosing rows and columns: ranges, lists, channels, extracts, random thinning, names, order."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def of_channels(samples: DataFrame, names: str | Sequence[str], channel: str = "channel") -> DataFrame:
    """Samples of one or several channels; LookupError if a name is given twice."""
    names = [names] if isinstance(names, str) else list(names)
    if len(set(names)) < len(names):
        raise LookupError(f"channels named twice: {names}")
    return samples.where(F.col(channel).isin(names))


def channel_places(samples: DataFrame, channel: str = "channel") -> DataFrame:
    """channel, place: each channel's place in the order of names."""
    return samples.select(channel).distinct().withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(channel)) - 1)  # one row a channel


def between(value: Column, lower: float | tuple[float, float], upper: float | None = None, closed: bool = True) -> Column:
    """Whether a value lies between two bounds, which may be given as a pair; ends included if ``closed``. Null stays null."""
    low, high = lower if upper is None else (lower, upper)
    return (value >= low) & (value <= high) if closed else (value > low) & (value < high)


def in_list(df: DataFrame, column: str, values: DataFrame | Sequence) -> DataFrame:
    """Rows whose value is in a list, or in the first column of a table (a semi join)."""
    if isinstance(values, DataFrame):
        listed = values.select(F.col(values.columns[0]).alias("__listed"))
        return df.join(listed, F.col(column) == F.col("__listed"), "left_semi")
    return df.where(F.col(column).isin(list(values)))


def where_true(df: DataFrame, condition: Column, row_id: str) -> tuple[DataFrame, int]:
    """(ids of the rows where the condition holds, how many)."""
    rows = df.where(condition).select(row_id)
    return rows, rows.count()


def _share(row_id: str, seed: int) -> Column:
    """A number in [0, 1) from a row's id, spread evenly by a multiplicative hash."""
    return F.pmod(F.pmod(F.col(row_id), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(1 << 32)) / F.lit(float(1 << 32))


def thinned(df: DataFrame, limit: int, *, row_id: str, seed: int = 0) -> DataFrame:
    """About |limit| rows, each with the same chance. A negative limit always takes the same ones, a positive one those of ``seed``."""
    n = F.greatest(df.agg(F.count("*")).scalar(), F.lit(1))
    return df.where(_share(row_id, 0 if limit < 0 else seed) < F.lit(float(abs(limit))) / n)


def extract(df: DataFrame, names: str | Sequence[str], *, where: Column | None = None, limit: int | None = None, row_id: str | None = None, mask: Column | None = None, seed: int = 0) -> DataFrame:
    """Columns (a list, or text with commas) of the rows that are asked for, at random about ``limit`` of them, null where the mask does not hold."""
    columns = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    out = df.where(where) if where is not None else df
    if limit is not None:
        if row_id is None:
            raise ValueError("a limit needs row_id")
        out = thinned(out, limit, row_id=row_id, seed=seed)
    return out.select(*[F.when(mask, F.col(c)).alias(c) if mask is not None and c != row_id else F.col(c) for c in columns])


def with_time(df: DataFrame, t_mid: str, t_zero: float | Column | None = None, name: str = "t") -> DataFrame:
    """df with the time counted from ``t_zero``; 0 with a warning where that is not known."""
    if t_zero is None:
        warnings.warn("no t_zero: 0 is taken", stacklevel=2)
        t_zero = 0.0
    return df.withColumn(name, F.col(t_mid) - (t_zero if isinstance(t_zero, Column) else F.lit(float(t_zero))))


def attributes(df: DataFrame) -> dict[str, Column]:
    """Each column under its name, in order."""
    return {c: F.col(c) for c in df.columns}


def members(labelled: DataFrame, cluster: int, *, row_id: str, label: str = "cluster") -> DataFrame:
    """Ids of one cluster's rows; LookupError if there is no such cluster."""
    rows = labelled.where(F.col(label) == cluster).select(row_id)
    if not rows.take(1):
        raise LookupError(f"no cluster {cluster}")
    return rows


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two closed intervals have a point in common, whichever way their ends are given."""
    low = lambda a, b: F.least(a, b)
    high = lambda a, b: F.greatest(a, b)
    return (low(a_start, a_end) <= high(b_start, b_end)) & (low(b_start, b_end) <= high(a_start, a_end))


def rotate(samples: DataFrame, keys: Sequence[str], order: str, by: int) -> DataFrame:
    """samples with place: their place in each stretch after a circular shift by ``by`` samples."""
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return samples.withColumn("place", F.pmod(i + by, n).cast("int"))


def segment_times(segmented: DataFrame, keys: Sequence[str], *, time: str = "timebase", flat: tuple[float, float] | None = None) -> DataFrame:
    """keys, seg_id, t_mid (mean of the times), flat_level (1 inside the flat top, ends excluded), place of each segment of its keys in order of t_mid."""
    rows = segmented.groupBy(*keys, "seg_id").agg(F.avg(time).alias("t_mid"))
    inside = F.lit(1) if flat is None else F.when((F.col("t_mid") > flat[0]) & (F.col("t_mid") < flat[1]), 1).otherwise(0)
    return rows.withColumn("flat_level", inside).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("t_mid", "seg_id")))


def select_sql(spark: SparkSession, views: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """The result of SQL over tables under the names given, order and limit included."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def in_own_band(df: DataFrame, value: str, low: str, high: str, *also: Column) -> DataFrame:
    """Rows whose value lies in the band that the row itself names, and for which all other conditions hold."""
    out = df.where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high)))
    for condition in also:
        out = out.where(condition)
    return out


def combined(loaders: Sequence[Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[str]]:
    """(rows of all parts that can be loaded, what went wrong with the others)."""
    out, errors = None, []
    for load in loaders:
        try:
            part = load()
            out = part if out is None else out.unionByName(part)
        except Exception as e:  # a part that fails is left out and named
            errors.append(str(e).splitlines()[0] if str(e) else type(e).__name__)
    return out, errors


def joined_clashing(a: DataFrame, b: DataFrame, on: str, suffix: str = "1") -> DataFrame:
    """All columns of both by key; a name that both have gets a suffix on the right side."""
    names = {c: c + suffix if c in a.columns else c for c in b.columns if c != on}
    return a.join(b.select(on, *[F.col(c).alias(n) for c, n in names.items()]), on)


def common_columns(*tables: DataFrame) -> list[str]:
    """Names that all tables have, in the order of the first."""
    return [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]


def converted(df: DataFrame, names: Mapping[str, str], *, scale: Mapping[str, float] | None = None) -> DataFrame:
    """Columns under new names ('old': 'new'), some of them times a factor; others are left out."""
    by = dict(scale or {})
    return df.select(*[(F.col(old) * by[old] if old in by else F.col(old)).alias(new) for old, new in names.items()])


def merged_sets(parts: Sequence[DataFrame], *, phases: str | None = None, narrow: bool = True) -> DataFrame:
    """Rows of several feature sets with equal columns; doubles become floats, and ``phorig`` holds ten times the first phase as a small number."""
    first = set(parts[0].columns)
    for p in parts[1:]:
        if set(p.columns) != first:
            raise KeyError(f"columns differ: {sorted(first ^ set(p.columns))}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if phases:
        out = out.withColumn("phorig", F.floor(F.get(phases, F.lit(0)).cast("double") * 10).cast("byte"))
    return out.select(*[F.col(f.name).cast("float").alias(f.name) if narrow and f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema])


def near_plane(points: DataFrame, *, off: str, along: str, n: int = 100) -> DataFrame:
    """The ``n`` points nearest a plane (smallest magnitude of ``off``), one for each place along it."""
    near = points.where(F.col(off).isNotNull() & F.col(along).isNotNull()).orderBy(F.abs(off), along, off).limit(n)
    return near.withColumn("__r", F.row_number().over(Window.partitionBy(along).orderBy(F.abs(off), off))).where("__r = 1").drop("__r")


def slope_profile(points: DataFrame, *, along: str, across: str, degree: int = 12) -> DataFrame:
    """along, slope, sin_alpha of a polynomial through at most some hundred points, which are fitted on the driver."""
    import numpy as np

    p = points.select(F.col(along).cast("double"), F.col(across).cast("double")).orderBy(along).limit(10_000).toPandas().dropna().to_numpy()
    x = p[:, 0] if len(p) else np.zeros(0)
    fit = np.polynomial.Polynomial.fit(x, p[:, 1], min(degree, max(0, len(x) - 1))) if len(x) else None
    slope = fit.deriv()(x) if fit is not None else x
    rows = [(float(a), float(b), float(b / np.hypot(1.0, b))) for a, b in zip(x, slope, strict=True)]
    return points.sparkSession.createDataFrame(rows, "along double, slope double, sin_alpha double").withColumnRenamed("along", along)
