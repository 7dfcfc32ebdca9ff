"""Operators on shots, scans, channels and shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.circular import TWO_PI
from driftwell.operators.mining import finite


def scan_details(scans: DataFrame, names: Sequence[str]) -> DataFrame:
    """shot, t0, t1 of the named scans, in the order of the names given."""
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return scans.where(F.col("name").isin(list(names))).withColumn("place", F.element_at(order, F.col("name")))


def first_seen(rows: DataFrame, item: str, name: str, order: str) -> DataFrame:
    """item, name: the scan in which each shot is first listed."""
    return rows.groupBy(item).agg(F.min_by(name, order).alias(name))


def path_globs(shots: DataFrame, shot: str, template: str) -> DataFrame:
    """A path for each shot from a template with %d."""
    return shots.select(F.format_string(template, F.col(shot)).alias("path"))


def varied_blocks(df: DataFrame, order: Sequence[str], a: str, b: str, *, run: int = 20, overlap: int = 1, a_range: tuple[int, int] = (2, 5), b_range: tuple[int, int] = (2, 10), keys: Sequence[str] = ()) -> DataFrame:
    """Blocks of ``run`` successive rows, each half (by overlap) on from the last, in which both settings take a number of values within the ranges."""
    step = max(1, run // (overlap + 1))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.withColumn("__i", i)
    blocks = rows.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("__i") - run) / step) + 1).cast("int"), F.floor(F.col("__i") / step).cast("int"))))
    s = blocks.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.countDistinct(a).alias("n_a"), F.countDistinct(b).alias("n_b"), F.min(a).alias("a_low"), F.max(a).alias("a_high"), F.min(b).alias("b_low"), F.max(b).alias("b_high"))
    return s.where((F.col("n") == run) & F.col("n_a").between(*a_range) & F.col("n_b").between(*b_range))


def by_wildcard(df: DataFrame, keys: Sequence[str], name: str, value: str, pattern: str) -> DataFrame:
    """keys, sum, average, min, max, std, rms of the values whose name matches a pattern; all six reducers at once."""
    v = finite(value)
    return df.where(F.col(name).rlike(pattern) & v.isNotNull()).groupBy(*keys).agg(
        F.sum(v).alias("sum"), F.avg(v).alias("average"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms")
    )


def ratios(df: DataFrame, keys: Sequence[str], name: str, value: str, reference: str) -> DataFrame:
    """keys, name, ratio of each value to the reference's value of its key."""
    base = F.max(F.when(F.col(name) == reference, F.col(value))).over(Window.partitionBy(*keys))
    return df.select(*keys, name, F.when(base != 0, F.col(value) / base).alias("ratio"))


def horner(coefficients: Sequence[float], x: Column) -> Column:
    """A polynomial, highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def cylinder_to_xyz(r: Column, phi: Column, z: Column) -> list[Column]:
    return [(r * F.cos(phi)).alias("x"), (r * F.sin(phi)).alias("y"), z.alias("z")]


def rotated(x: Column, y: Column, angle: float) -> list[Column]:
    c, s = math.cos(angle), math.sin(angle)
    return [(x * c - y * s).alias("x"), (x * s + y * c).alias("y")]


def along_line(distance: Column, a: Sequence[float], b: Sequence[float]) -> list[Column]:
    """x, y, z at a distance from point a towards point b."""
    length = math.dist(a, b)
    return [(F.lit(p) + distance * F.lit((q - p) / length)).alias(n) for n, p, q in zip("xyz", a, b, strict=True)]


def energy_of(svs: Column, indices: Column) -> Column:
    """Sum of the squares of the chosen singular values (from 0)."""
    return F.aggregate(F.transform(indices, lambda i: F.get(svs, i)), F.lit(0.0), lambda a, x: a + x * x)


def differing_rows(a: DataFrame, b: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    """Rows, without the columns in ``but``, that one of two tables has more often: side ('a' or 'b') and times; none if they are equal.

    One aggregation over both tables; null equals null.
    """
    columns = [c for c in a.columns if c not in but]
    both = a.select(*columns, F.lit(1).alias("__n")).unionByName(b.select(*columns, F.lit(-1).alias("__n")))
    n = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n != 0")
    return n.select(*columns, F.when(F.col("__n") > 0, "a").otherwise("b").alias("side"), F.abs("__n").alias("times"))


def upsert_matched(right: DataFrame, left: DataFrame, matches: DataFrame, *, left_id: str, right_id: str, columns: Sequence[str]) -> DataFrame:
    """right with the columns of its one match on the left, and the left rows without a match added; rows with several are left as they are."""
    first = matches.where("matches = 1").groupBy(right_id).agg(F.min(left_id).alias(left_id))  # of several the first
    one = first.join(left.select(left_id, *[F.col(c).alias(f"__{c}") for c in columns]), left_id).drop(left_id)
    changed = right.join(one, right_id, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])
    alone = left.join(matches.where("matches = 0").select(left_id), left_id, "left_semi")
    return changed.unionByName(alone.select(*[F.col(c) for c in left.columns if c in right.columns]), allowMissingColumns=True)


def cutoff_members(labels: DataFrame, stats: DataFrame, *, min_kappa: float | None = None, max_sigma: float | None = None, min_weight: float | None = None) -> DataFrame:
    """Members of clusters whose mean concentration, or mean spread 1 / sqrt(kappa), passes the cutoffs, and whose own weight does."""
    s = stats.groupBy("cluster").agg(F.avg("kappa").alias("__k"), F.avg(1 / F.sqrt("kappa")).alias("__s"))
    if min_kappa is not None:
        s = s.where(F.col("__k") >= min_kappa)
    if max_sigma is not None:
        s = s.where(F.col("__s") <= max_sigma)
    out = labels.join(s.select("cluster"), "cluster", "left_semi")
    return out.where(F.col("weight") >= min_weight) if min_weight is not None else out


def circular_centroid(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """keys, n, centre, cost: the angle of least sum of squared wrapped distances, exactly.

    With the angles sorted in [0, 2 pi), the best centre is the mean after the first k of them were moved on by a turn, for some k; running sums give the
    cost of every k at once.
    """
    a = df.select(*keys, (F.col(angle).cast("double") - TWO_PI * F.floor(F.col(angle).cast("double") / TWO_PI)).alias("__a")).where("__a is not null and not isnan(__a)")
    w = Window.partitionBy(*keys)
    k = F.row_number().over(w.orderBy("__a")).cast("double")
    run = F.sum("__a").over(w.orderBy("__a").rowsBetween(Window.unboundedPreceding, 0))
    n, s, q = F.count("*").over(w).cast("double"), F.sum("__a").over(w), F.sum(F.col("__a") * F.col("__a")).over(w)
    rows = a.select(*keys, "__a", k.alias("__k"), run.alias("__r"), n.alias("__n"), s.alias("__s"), q.alias("__q"))
    total = F.col("__s") + TWO_PI * F.col("__k")
    square = F.col("__q") + 2 * TWO_PI * F.col("__r") + TWO_PI * TWO_PI * F.col("__k")
    cost = F.greatest(F.lit(0.0), square - total * total / F.col("__n"))
    mean = total / F.col("__n")
    best = rows.withColumn("__c", cost).withColumn("__m", mean - TWO_PI * F.floor((mean + math.pi) / TWO_PI))
    return best.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("__m", F.struct(F.round("__c", 9), "__k")).alias("centre"), F.min("__c").alias("cost"))


def equal_count_edges(template: Sequence[float], spread: Sequence[float], bins: int, *, draws: int = 20_000, seed: int = 1) -> list[float]:
    """Edges of template distance that hold equal numbers of rows with random phases."""
    x = np.random.default_rng(seed).uniform(-math.pi, math.pi, (draws, len(template)))
    d = np.mod(x - np.asarray(template) + math.pi, TWO_PI) - math.pi
    r = np.sqrt(np.mean((d / np.asarray(spread)) ** 2, axis=1))
    return [float(v) for v in np.quantile(r, np.linspace(0, 1, bins + 1))]


def background(counts: DataFrame, dims: int) -> DataFrame:
    """bin, n, excess of a histogram of distances: what is left when n ~ r**(dims - 1) is fitted to its outer half and taken off."""
    r = (F.col("bin") + 0.5).cast("double")
    shape = F.pow(r, F.lit(float(dims - 1)))
    w = Window.partitionBy(F.lit(1))  # one row a bin
    half = F.max("bin").over(w) / 2
    rows = counts.withColumn("__s", shape).withColumn("__h", F.col("bin") >= half)
    k = F.sum(F.when(F.col("__h"), F.col("n") * F.col("__s"))).over(w) / F.sum(F.when(F.col("__h"), F.col("__s") * F.col("__s"))).over(w)
    return rows.select("bin", "n", (F.col("n") - k * F.col("__s")).alias("excess"))


def with_noise(df: DataFrame, value: str, keys: Sequence[str], snr_db: float, *, seed: int = 1) -> DataFrame:
    """White noise at a signal-to-noise ratio in dB against each key's mean power."""
    power = F.avg(F.col(value) * F.col(value)).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.col(value) + F.sqrt(power / (10 ** (snr_db / 10))) * F.randn(seed))


def running_coherence(pairs: DataFrame, keys: Sequence[str], order: str, n: int, x: str, y: str) -> DataFrame:
    """Magnitude of the correlation over the last n samples, their means taken off; null where one of the two does not vary."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    both = F.covar_pop(x, y).over(w)
    power = F.var_pop(x).over(w) * F.var_pop(y).over(w)
    rows = pairs.withColumn("__n", F.count(F.col(x) + F.col(y)).over(w)).withColumn("coherence", F.when(power > 0, F.abs(both) / F.sqrt(power)))
    return rows.where(F.col("__n") == n).drop("__n")


def sweep_of(channels: DataFrame, sweeps: DataFrame, default: Column) -> DataFrame:
    """channel, sweep: the channel's own sweep voltage, else its section's, else a default."""
    return channels.join(sweeps.select("channel", F.col("sweep").alias("__s")), "channel", "left").withColumn("sweep", F.coalesce("__s", "section_sweep", default)).drop("__s")
