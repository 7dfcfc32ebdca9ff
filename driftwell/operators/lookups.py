"""Joins with small tables: settings by shot and time of validity, names, clocks, steps, files; segments and channels that belong together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_shot(df: DataFrame, summary: DataFrame, columns: Sequence[str], shot: str = "shot") -> DataFrame:
    """df with scalars of its shot; null where the shot is not in the summary. One row a shot: repeated ones raise no copies, the first by value counts."""
    one = summary.groupBy(F.col(shot).alias("__s")).agg(*[F.min(c).alias(c) for c in columns])
    return df.join(one, F.col(shot) == F.col("__s"), "left").drop("__s")


def combined_view(a: DataFrame, b: DataFrame, on: str, name: str = "combsum") -> DataFrame:
    """The inner join of two summaries, also under a name for SQL."""
    both = a.join(b, on)
    both.createOrReplaceTempView(name)
    return both


def labels_of_shots(df: DataFrame, label: str, shots: DataFrame, shot: str = "shot") -> DataFrame:
    """df with labels kept for the listed shots and null for the others."""
    listed = shots.select(F.col(shot).alias("__s")).distinct().withColumn("__in", F.lit(True))
    return df.join(listed, F.col(shot) == F.col("__s"), "left").withColumn(label, F.when(F.col("__in"), F.col(label))).drop("__s", "__in")


def zipped_segments(parts: Mapping[str, DataFrame], keys: Sequence[str], n: int) -> DataFrame:
    """keys, seg_id, and an array a part: segments of several signals side by side by number; a segment shorter than ``n`` in any of them is left out.

    Each part has keys, seg_id, seg_i and signal.
    """
    rows = None
    for name, p in parts.items():
        one = p.select(*keys, "seg_id", F.lit(name).alias("__part"), F.struct("seg_i", "signal").alias("__x"))
        rows = one if rows is None else rows.unionByName(one)
    arrays = [F.transform(F.sort_array(F.collect_list(F.when(F.col("__part") == name, F.col("__x")))), lambda x: x["signal"]).alias(name) for name in parts]
    out = rows.groupBy(*keys, "seg_id").agg(*arrays)
    for name in parts:
        out = out.where(F.size(name) == n)
    return out


def sweep_channel(df: DataFrame, *, channel: str, shot: str, own: Mapping[str, str], setting: Mapping[str, str], by_shot: Sequence[tuple[int, str]]) -> DataFrame:
    """df with vsweep: a channel's own sweep, else what its setting says, else the default of its range of shots (first shot, name)."""
    pick = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(channel)) if m else F.lit(None).cast("string")
    default = F.lit(None).cast("string")
    for first, name in sorted(by_shot):
        default = F.when(F.col(shot) >= first, F.lit(name)).otherwise(default)
    return df.withColumn("vsweep", F.coalesce(pick(own), pick(setting), default))


def valid_setting(df: DataFrame, settings: DataFrame, *, shot: str = "shot", row_id: str, name: str = "value") -> DataFrame:
    """row_id and the setting (first_shot, last_shot, priority, value) valid for its shot; the one of the highest priority, null if there is none.

    Settings are few rows by their nature; null bounds are open.
    """
    s = settings.select(F.col("first_shot").alias("__a"), F.col("last_shot").alias("__b"), F.col("priority").alias("__p"), F.col("value").alias("__v"))
    on = (F.col("__a").isNull() | (F.col("__a") <= F.col(shot))) & (F.col("__b").isNull() | (F.col("__b") >= F.col(shot)))
    return df.join(F.broadcast(s), on, "left").groupBy(row_id).agg(F.max_by("__v", F.struct("__p", "__v")).alias(name)) if settings.limit(10_001).count() <= 10_000 else df.join(s, on, "left").groupBy(row_id).agg(F.max_by("__v", F.struct("__p", "__v")).alias(name))


def step_clock(df: DataFrame, steps: Sequence[tuple[int, float]], *, shot: str = "shot", base: float = 1e6, name: str = "clock") -> DataFrame:
    """df with the sampling clock of its shot: ``base`` over the divider that holds from a shot on (first shot, divider); null before the first."""
    divider = F.lit(None).cast("double")
    for first, by in sorted(steps):
        divider = F.when(F.col(shot) >= first, F.lit(float(by))).otherwise(divider)
    return df.withColumn(name, F.lit(base) / divider)


def step_function(df: DataFrame, steps: Sequence[tuple[float, float]], *, time: str, name: str = "level", before: float = 0.0) -> DataFrame:
    """df with the level of a list of steps (time, level) at each row's time; ``before`` ahead of the first, null for an unknown time."""
    level = F.lit(float(before))
    for at, value in sorted(steps):
        level = F.when(F.col(time) >= at, F.lit(float(value))).otherwise(level)
    return df.withColumn(name, F.when(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")), level))


def ratio_of(df: DataFrame, keys: Sequence[str], name: str, value: str, over: tuple[str, str], out: str) -> DataFrame:
    """keys and the ratio of the greatest magnitudes of two named quantities (numerator, denominator); null where one is missing or 0."""
    top = lambda n: F.max(F.when(F.col(name) == n, F.abs(value)))
    rows = df.groupBy(*keys).agg(top(over[0]).alias("__a"), top(over[1]).alias("__b"))
    return rows.select(*keys, F.when(F.col("__b") != 0, F.col("__a") / F.col("__b")).alias(out))


def shots_of_paths(paths: DataFrame, path: str, start: int, length: int) -> DataFrame:
    """path, shot: the number in a file's name at a fixed place; paths without a number there are left out."""
    name = F.element_at(F.split(path, "/"), -1)
    return paths.select(path, F.substring(name, start + 1, length).try_cast("long").alias("shot")).where("shot is not null")


def latest_of(files: DataFrame, keys: Sequence[str], *, path: str, when: str, size: str) -> DataFrame:
    """keys, path, n, smaller: the newest of the files of a name, how many there are, and whether it is smaller than the largest of them."""
    newest = F.max_by(F.struct(path, size), F.struct(when, path))
    rows = files.groupBy(*keys).agg(newest.alias("__n"), F.count("*").alias("n"), F.max(size).alias("__largest"))
    return rows.select(*keys, F.col(f"__n.{path}").alias(path), "n", (F.col(f"__n.{size}") < F.col("__largest")).alias("smaller"))


def correct_names(files: DataFrame, sections: DataFrame, keys: Sequence[str], *, file: str, section: str) -> DataFrame:
    """file, section: the one section of the settings with the file's parameters; files that match none or several are left out."""
    hits = files.join(sections.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(section).alias("__section")), [F.col(k) == F.col(f"__{k}") for k in keys])
    return hits.groupBy(file).agg(F.count("*").alias("n"), F.min("__section").alias(section)).where("n = 1").drop("n")


def enriched(sections: DataFrame, values: DataFrame, *, pattern: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Sections with the columns of the row that bears their name; only sections whose name matches the pattern get any."""
    v = values.select(F.col(name).alias("__n"), *columns)
    out = sections.join(v, (F.col(name) == F.col("__n")) & F.col(name).rlike(pattern), "left")
    return out.drop("__n")


def versions_before(df: DataFrame, keys: Sequence[str], *, when: str, row_id: str, version: str) -> DataFrame:
    """row_id, earlier_version: the version of the row before, in order of time, of the same keys."""
    w = Window.partitionBy(*keys).orderBy(when, row_id)
    return df.select(row_id, F.lag(version).over(w).alias("earlier_version")).where("earlier_version is not null")


def within(df: DataFrame, low: Sequence[Column], at: Sequence[str], high: Sequence[Column]) -> DataFrame:
    """Rows from one shot (a date and a number, say) on, up to but without another, in the order of all the parts."""
    s = F.struct(*[F.col(c) for c in at])
    return df.where((s >= F.struct(*low)) & (s < F.struct(*high)))


def last_of(df: DataFrame, keys: Sequence[str], shot: str) -> DataFrame:
    """keys, last_shot, n_shots."""
    return df.groupBy(*keys).agg(F.max(shot).alias("last_shot"), F.countDistinct(shot).alias("n_shots"))


def missing_from(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that the other table has not."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().join(other.select(column).distinct(), column, "left_anti")


def next_shot(shots: DataFrame, keys: Sequence[str], shot: str) -> DataFrame:
    """keys, shot, next: each distinct shot and the one after it of the same keys; null at the end."""
    return shots.select(*keys, shot).distinct().withColumn("next", F.lead(shot).over(Window.partitionBy(*keys).orderBy(shot)))
