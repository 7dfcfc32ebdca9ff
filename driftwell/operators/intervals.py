"""Overlapping, nested and gapped intervals made continuous (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Start times are bundled by this many units (an hour of ns); each bundle of a key is merged by itself.
BUNDLE = 3_600_000_000_000


def _sessions(df: DataFrame, keys: Sequence[str], bundle: int) -> DataFrame:
    """keys, __b, __s, __e: the intervals of each key and bundle of start times merged by session_window with a duration of each row's own.

    Times are counted from the bundle's own begin and doubled, and the end is moved by one, so that touching intervals overlap in the
    window's time and a distance of one unit stays a distance, whichever way the window treats its open end. Within a bundle no start
    lies further than two bundles, so longer durations are cut there in the window's time; the true end is the greatest of the session.
    """
    rows = df.withColumn("__b", F.expr(f"__s div {int(bundle)}L"))
    length = F.least(F.coalesce(F.try_subtract("__e", "__s"), F.lit(2 * bundle)), F.lit(2 * bundle)) * 2 + 1
    gap = F.make_interval(secs=(length.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    window = F.session_window(F.timestamp_micros((F.col("__s") - F.col("__b") * bundle) * 2), gap)
    merged = rows.groupBy(*keys, "__b", window.alias("__w")).agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    return merged.select(*keys, "__b", "__s", "__e")


def continuous_periods(df: DataFrame, keys: Sequence[str], start: str, end: str, *, bundle: int = BUNDLE) -> DataFrame:
    """One row for each longest continuous stretch of each key ('period') and each stretch between two of them ('gap').

    Intervals that overlap, nest or touch are continuous; a distance of one unit is a gap. Intervals are merged within bundles of start
    times, which spreads a hot key over many tasks. What crosses bundles goes through a table of one row a bundle: the latest end of
    all bundles before tells which stretches of a bundle go on from an earlier one, and the last stretch of a bundle ends where
    the next bundle that begins a new one says so. No key is ever sorted as a whole.

    Defined cases: rows with a null bound or with end before start are ignored; an empty interval
    (start = end) is a period of no length unless another covers or touches it; null keys form a key of their own; repeated rows count
    once; an empty input gives an empty result; other columns are ignored whatever their names.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e")).where(F.col("__e") >= F.col("__s"))
    parts = _sessions(rows, names, bundle)
    by = [*names, "__b"]
    before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy(*by).agg(F.max("__e").alias("__m")).select(*[F.col(c).alias(f"{c}c") for c in by], F.max("__m").over(before).alias("__c"))
    on: Column = F.col("__b") == F.col("__bc")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}c"))
    known = parts.join(carried, on).select(*by, "__s", "__e", "__c", (F.col("__c").isNull() | (F.col("__s") > F.col("__c"))).alias("__new"))
    inner = known.withColumn("__next", F.lead("__s").over(Window.partitionBy(*by).orderBy("__s"))).where("__new and __next is not null").select(*names, "__s", "__e", "__next")
    new = F.when(F.col("__new"), F.struct("__s", "__e"))
    edge = known.groupBy(*by).agg(F.min(new).alias("__first"), F.max(new).alias("__last"), F.max("__e").alias("__m"), F.greatest(F.max("__c"), F.max(F.when(~F.col("__new"), F.col("__e")))).alias("__upto"))
    # Backwards, as the bundles after one are then those before it.
    after = Window.partitionBy(*names).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("__first").isNotNull(), F.struct(F.col("__first.__s").alias("s"), F.col("__upto").alias("upto"))), ignorenulls=True).over(after)
    edge = edge.withColumn("__f", following).withColumn("__rest", F.max("__m").over(after)).where("__last is not null")
    until = F.when(F.col("__f").isNotNull(), F.greatest(F.col("__last.__e"), F.col("__f.upto"))).otherwise(F.greatest(F.col("__last.__e"), F.col("__rest")))
    ends = edge.select(*names, F.col("__last.__s").alias("__s"), until.alias("__e"), F.col("__f.s").alias("__next"))
    pieces = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("__s").alias("a"), F.col("__e").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("__e").alias("a"), F.col("__next").alias("b")),
    )
    both = inner.unionByName(ends).select(*names, F.explode(F.filter(pieces, lambda x: x["b"].isNotNull())).alias("__x"))
    return both.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("__x.kind").alias("kind"), F.col("__x.a").alias(start), F.col("__x.b").alias(end))
