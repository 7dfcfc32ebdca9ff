"""Operators on the feature table: selection, statistics, templates, lines of chirps, density and joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.circular import remap, resultant_to_kappa, template_distance


def finite(name: str) -> Column:
    """The column as a double, null where NaN."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None))


def locked_shots(df: DataFrame, shot: str, freq: str, *, below: float, low: float, also: Column, least: int) -> DataFrame:
    """shot, n, n_low: shots whose modes may have locked: at least ``least`` records under ``low`` among those under ``below`` for which ``also`` holds."""
    rows = df.where((F.col(freq) < below) & also)
    return rows.groupBy(shot).agg(F.count("*").alias("n"), F.count_if(F.col(freq) < low).alias("n_low")).where(F.col("n_low") >= least)


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns, n: rows of each combination; null is a value."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def quality(features: DataFrame, *, max_h: float, min_p: float, min_svs: int) -> DataFrame:
    return features.where((F.col("h") < max_h) & (F.col("p") > min_p) & (F.col("svs") >= min_svs))


def value_counts(df: DataFrame, column: str, *, top: int | None = None) -> DataFrame:
    """value, n, percent of each value, most frequent first; null is a value."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    out = n.select("value", "n", (100.0 * F.col("n") / n.agg(F.sum("n")).scalar()).alias("percent"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def column_info(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, n_valid, n_distinct: one row a column, from a single aggregation."""
    one = df.agg(F.count("*").alias("n"), *[F.count(finite(c)).alias(f"v{i}") for i, c in enumerate(columns)], *[F.countDistinct(finite(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = ", ".join(f"'{c}', n, v{i}, d{i}" for i, c in enumerate(columns))
    return one.selectExpr(f"stack({len(columns)}, {rows}) as (column, n, n_valid, n_distinct)")


def histogram(df: DataFrame, column: str, bins: int, *, percent: float = 100.0) -> DataFrame:
    """bin, lower, n over the values whose magnitude is within the given percentile of magnitudes, to one part in 100,000 of their number (a mergeable sketch)."""
    v = df.select(finite(column).alias("v")).where("v is not null")
    if percent < 100.0:
        v = v.where(F.abs("v") <= v.agg(F.percentile_approx(F.abs("v"), percent / 100.0, 100_000)).scalar())
    low, high = v.agg(F.min("v")).scalar(), v.agg(F.max("v")).scalar()
    ends = v.select("v", low.alias("__a"), high.alias("__b"))
    b = F.least(F.floor((F.col("v") - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins), F.lit(bins - 1)).cast("int")
    binned = ends.select(F.when(F.col("__b") > F.col("__a"), b).otherwise(0).alias("bin"), "__a", "__b")
    return binned.groupBy("bin").agg(F.min(F.col("__a") + F.col("bin") * (F.col("__b") - F.col("__a")) / bins).alias("lower"), F.count("*").alias("n"))


def histogram_nd(df: DataFrame, phases: str, bins: int, *, eps: float = 1e-6) -> DataFrame:
    """cell, n: counts of the occupied cells of a grid over all phases; cell is the list of cell numbers as text."""
    cell = F.transform(phases, lambda x: F.floor((x.cast("double") + math.pi) * bins / (2 * (math.pi + eps))).cast("int"))
    return df.where(F.col(phases).isNotNull()).groupBy(F.array_join(cell.cast("array<string>"), ",").alias("cell")).agg(F.count("*").alias("n"))


def density_leaders(cells: DataFrame, *, top: int, min_count: int, radius: float) -> list[dict]:
    """Greedy grouping of the ``top`` fullest cells: the fullest takes every remaining cell within ``radius`` cells, and so on.

    Only ``top`` rows come to the driver, whatever the table's size.
    """
    rows = cells.where(F.col("n") >= min_count).orderBy(F.desc("n"), "cell").limit(top).collect()
    left = [(tuple(map(int, r["cell"].split(","))), r["n"]) for r in rows]
    out = []
    while left:
        lead = left[0][0]
        mine = [c for c in left if math.dist(c[0], lead) <= radius]
        left = [c for c in left if math.dist(c[0], lead) > radius]
        out.append({"leader": ",".join(map(str, lead)), "cells": len(mine), "n": sum(n for _, n in mine)})
    return out


def circular_stats(df: DataFrame, keys: Sequence[str], phases: str) -> DataFrame:
    """keys, k (place in the array), n, mu, r, kappa: circular mean, mean resultant length, and von Mises concentration."""
    x = df.select(*keys, F.posexplode(phases).alias("k", "x")).where("x is not null").withColumn("x", F.col("x").cast("double"))
    s = x.groupBy(*keys, "k").agg(F.count("*").alias("n"), F.avg(F.sin("x")).alias("s"), F.avg(F.cos("x")).alias("c"))
    s = s.withColumn("r", F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")))
    return s.select(*keys, "k", "n", F.atan2("s", "c").alias("mu"), "r", resultant_to_kappa(F.col("r")).alias("kappa"))


def match_modes(df: DataFrame, phases: str, modes: Sequence[tuple[int, Sequence[float], Sequence[float], float]]) -> DataFrame:
    """df with mode_id: the last mode (id, centre, spread, threshold) within whose threshold the phases lie; null for none.

    Templates are few by their nature and become expressions: no join, one pass.
    """
    best = F.lit(None).cast("int")
    for mode, centre, spread, threshold in modes:
        best = F.when(template_distance(F.col(phases), centre, spread) < threshold, F.lit(mode)).otherwise(best)
    return df.withColumn("mode_id", best)


def nearest_rows(df: DataFrame, like: dict[str, float], scale: dict[str, float], k: int, *, row_id: str) -> DataFrame:
    """The k rows nearest to a template in scaled distance over its columns; rows with an unknown one are left out."""
    d = None
    for c, x in like.items():
        e = (finite(c) - F.lit(x)) / F.lit(scale[c])
        d = e * e if d is None else d + e * e
    return df.select(row_id, F.sqrt(d).alias("distance")).where("distance is not null").orderBy("distance", row_id).limit(k)


def chirp_lines(df: DataFrame, keys: Sequence[str], *, time: str, freq: str, row_id: str, time_scale: float, max_distance: float, min_length: int) -> DataFrame:
    """row_id, lead_id, length, dfdt: points in order of time belong to one line while they stay close; lines of ``min_length`` points count.

    A new line begins where the time is that of the point before, or sqrt(df**2 + (dt * time_scale)**2) reaches ``max_distance``. dfdt
    is the mean of the slopes to the next point (0 at a line's last) and from the point before; the first point has its own only.
    """
    w = Window.partitionBy(*keys).orderBy(time, row_id)
    rows = df.where(F.col(time).isNotNull() & F.col(freq).isNotNull()).select(*keys, time, freq, row_id)
    dt, df_ = F.col(time) - F.lag(time).over(w), F.col(freq) - F.lag(freq).over(w)
    new = F.lag(time).over(w).isNull() | (dt == 0) | (F.sqrt(df_ * df_ + dt * time_scale * dt * time_scale) >= max_distance)
    rows = rows.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("__line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy(*keys, "__line")
    within = line.orderBy(time, row_id)
    slope = F.coalesce((F.lead(freq).over(within) - F.col(freq)) / (F.lead(time).over(within) - F.col(time)), F.lit(0.0))
    rows = rows.withColumn("length", F.count("*").over(line)).withColumn("lead_id", F.first(row_id).over(within)).withColumn("__s", slope)
    before = F.lag("__s").over(within)
    return rows.withColumn("dfdt", F.when(before.isNull(), F.col("__s")).otherwise((F.col("__s") + before) / 2)).where(F.col("length") >= min_length).select(row_id, "lead_id", "length", "dfdt")


def band_join(left: DataFrame, right: DataFrame, *, key: str, time: str, freq: str, dt: float, df: float, left_id: str, right_id: str) -> DataFrame:
    """left_id, matches, right_id: how many right rows of the key lie within dt and df, and which if it is one.

    Time is cut into steps of dt; right rows are sent to their own step and both neighbours, so the join is on equal keys.
    """
    a = left.select(F.col(left_id).alias("__l"), F.col(key).alias("__k"), F.col(time).alias("__t"), F.col(freq).alias("__f"))
    at = lambda t: F.floor(t / F.lit(dt)).cast("long")
    known = a.where("__k is not null and __t is not null and __f is not null and not isnan(__t) and not isnan(__f)").withColumn("__b", at(F.col("__t")))
    b = right.select(F.col(right_id).alias("__r"), F.col(key).alias("__k2"), F.col(time).alias("__t2"), F.col(freq).alias("__f2")).where("__t2 is not null and __f2 is not null and not isnan(__t2) and not isnan(__f2)")
    b = b.withColumn("__b2", F.explode(F.sequence(at(F.col("__t2")) - 1, at(F.col("__t2")) + 1)))
    on = (F.col("__k") == F.col("__k2")) & (F.col("__b") == F.col("__b2")) & (F.abs(F.col("__t") - F.col("__t2")) < dt) & (F.abs(F.col("__f") - F.col("__f2")) < df)
    hits = known.join(b, on).groupBy("__l").agg(F.count("*").alias("__n"), F.min("__r").alias("__one"))
    out = a.select("__l").join(hits, "__l", "left")
    return out.select(F.col("__l").alias(left_id), F.coalesce("__n", F.lit(0)).alias("matches"), F.when(F.col("__n") == 1, F.col("__one")).alias(right_id))


def interpolate_at(left: DataFrame, right: DataFrame, *, keys: Sequence[tuple[str, str]], left_time: str, right_time: str, left_id: str, value: str, step: bool = False) -> DataFrame:
    """left_id, value: right values at the left rows' times: by straight lines between the readings around, or (``step``) the last one before.

    Beyond a key's first or last reading there is no value. Both tables are united and sorted once by key and time.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    a = left.select(*[F.col(x).alias(n) for (x, _), n in zip(keys, k, strict=True)], F.col(left_time).cast("double").alias("__t"), F.lit(1).alias("__side"), F.col(left_id).alias("__id"), F.lit(None).cast("double").alias("__v"))
    b = right.select(*[F.col(y).alias(n) for (_, y), n in zip(keys, k, strict=True)], F.col(right_time).cast("double").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema[left_id].dataType).alias("__id"), F.col(value).cast("double").alias("__v"))
    b = b.where("__t is not null and __v is not null and not isnan(__v)")
    both = a.where("__t is not null and not isnan(__t)").unionByName(b)
    hit = F.when(F.col("__side") == 0, F.struct("__t", "__v"))
    back = Window.partitionBy(*k).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*k).orderBy(F.desc("__t"), "__side", F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__a", F.last(hit, ignorenulls=True).over(back)).withColumn("__b", F.last(hit, ignorenulls=True).over(ahead)).where("__side = 1")
    ta, va, tb, vb = F.col("__a.__t"), F.col("__a.__v"), F.col("__b.__t"), F.col("__b.__v")
    line = F.when(ta == tb, va).otherwise(va + (vb - va) * (F.col("__t") - ta) / (tb - ta))
    out = va if step else F.when(ta.isNotNull() & tb.isNotNull(), line)
    return rows.select(F.col("__id").alias(left_id), out.alias(value)).where(F.col(value).isNotNull())


def points_in_intervals(points: DataFrame, intervals: DataFrame, *, point_id: str, at: str, interval_id: str, start: str, end: str, cell: int) -> DataFrame:
    """point_id, interval_id: the interval that holds each point, if exactly one does (ends included); both are cut into cells of ``cell``."""
    p = points.where(F.col(at).isNotNull()).select(F.col(point_id).alias("__p"), F.col(at).cast("long").alias("__at")).withColumn("__c", F.expr(f"__at div {int(cell)}"))
    i = intervals.where(F.col(end) >= F.col(start)).select(F.col(interval_id).alias("__i"), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"))
    i = i.withColumn("__c2", F.explode(F.sequence(F.expr(f"__s div {int(cell)}"), F.expr(f"__e div {int(cell)}"))))
    hits = p.join(i, (F.col("__c") == F.col("__c2")) & F.col("__at").between(F.col("__s"), F.col("__e")))
    return hits.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__one")).where("__n = 1").select(F.col("__p").alias(point_id), F.col("__one").alias(interval_id))


def compact_runs(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """keys, runs: the distinct numbers of each key as text, runs as first-last."""
    d = df.where(F.col(number).isNotNull()).select(*keys, number).distinct()
    w = Window.partitionBy(*keys).orderBy(number)
    g = d.withColumn("__g", F.col(number) - F.row_number().over(w)).groupBy(*keys, "__g").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return g.withColumn("__x", text).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "__x"))), lambda x: x["__x"]), ",").alias("runs"))


def coalesce_touching(df: DataFrame, keys: Sequence[str], start: str, end: str, *, delta: int = 0) -> DataFrame:
    """Adjacent intervals put together where the next begins exactly ``delta`` after this one's end (or within it)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where(F.col(end) >= F.col(start)).withColumn("__n", F.when(top.isNull() | (F.col(start) > top + delta), 1).otherwise(0)).withColumn("__g", F.sum("__n").over(w))  # equal rows share a number
    return rows.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__g")


def trim_members(df: DataFrame, phases: str, centre: Sequence[float], *, row_id: str, tolerance: float, least: int) -> DataFrame:
    """row_id, distance: members nearest a fixed centre, the farthest dropped until all are within the tolerance or ``least`` are left."""
    d = df.select(row_id, template_distance(F.col(phases), centre).alias("distance")).where("distance is not null")
    inside = d.where(F.col("distance") < tolerance)
    nearest = d.orderBy("distance", row_id).limit(least)
    return inside.unionByName(nearest).distinct()


def split_vector(df: DataFrame, column: str, length: int) -> DataFrame:
    """An array column as scalars column_0, column_1, ..."""
    return df.select("*", *[F.get(column, F.lit(i)).alias(f"{column}_{i}") for i in range(length)]).drop(column)


def masked(df: DataFrame, columns: Sequence[str], mask: Column) -> DataFrame:
    """The columns as null where the mask doesn't hold."""
    return df.withColumns({c: F.when(mask, F.col(c)) for c in columns})


def legal_names(df: DataFrame) -> DataFrame:
    """Column names without the characters * - ( ) [ ]."""
    return df.toDF(*[c.translate({ord(x): None for x in "*-()[]"}) for c in df.columns])


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; KeyError unless both have the same columns."""
    if set(a.columns) != set(b.columns):
        raise KeyError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b)


def update_columns(df: DataFrame, other: DataFrame, row_id: str) -> DataFrame:
    """df with the columns of ``other`` for equal ids; columns that both have are taken from ``other``."""
    new = [c for c in other.columns if c != row_id]
    keep = [c for c in df.columns if c not in new]
    return df.select(*keep).join(other.dropDuplicates([row_id]), row_id, "left")


def lag_matched(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Number of rows, rows with the flag, and longest run of rows with it, of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "__g").agg(F.count("*").alias("n"), F.sum(F.col("__f").cast("int")).alias("k"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("flagged"), F.max("k").alias("longest"))


def neighbours(df: DataFrame, index: str) -> DataFrame:
    """A set of indices with those beside them, but none below its least or above its greatest."""
    wide = df.select(F.explode(F.array(F.col(index) - 1, F.col(index), F.col(index) + 1)).alias(index)).distinct()
    return wide.where(F.col(index).between(df.agg(F.min(index)).scalar(), df.agg(F.max(index)).scalar()))


def flip_by_sign(df: DataFrame, phases: str, field: Column) -> DataFrame:
    """Phases with their sign turned where the field is negative."""
    return df.withColumn(phases, F.when(field < 0, F.transform(phases, lambda x: -x)).otherwise(F.col(phases)))


def wrapped(df: DataFrame, phases: str) -> DataFrame:
    return df.withColumn(phases, F.transform(phases, lambda x: remap(x.cast("double"))))
