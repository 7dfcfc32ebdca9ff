"""Records of two tables matched by nearest time (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(
    left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_entity: list[Column], right_entity: list[Column], left_time: str, right_time: str,
    tolerance: str, slice_width: float = 256.0,
) -> DataFrame:
    """left_id, right_id, distance: for each left row the right row of its entity that is nearest in time, if within its tolerance.

    Both tables are united and sorted by entity and time; the last right row before and the next one after are carried onto each left
    row, and the nearer of the two is taken. ``tolerance`` is a column of both tables, the same for an entity.

    Time is cut into slices of ``slice_width`` tolerances. A right row within one tolerance of a slice's border is also sent to the slice
    beyond (two in ``slice_width`` of the rows), so that each slice of each entity is sorted by itself and a hot entity spreads over as
    many tasks as it has slices.

    Defined cases: a null id, null or NaN or infinite time, a null part of the entity, or a null, NaN or negative tolerance make a row
    match nothing; at equal distances the earlier reading wins, at equal times the smaller right id; a time equal on both sides matches
    at distance 0; repeated left ids are each answered, and identical answers come out once for each distinct left id and time; empty
    tables give an empty result; other columns are ignored whatever their names.
    """
    big = float("inf")

    def rows(df: DataFrame, entity: list[Column], rid: str, time: str, side: int) -> DataFrame:
        t, tol = F.col(time).cast("double"), F.col(tolerance).cast("double")
        d = df.select(*[e.alias(f"__e{i}") for i, e in enumerate(entity)], t.alias("__t"), tol.alias("__tol"), F.col(rid).alias("__id"), F.lit(side).cast("byte").alias("__side"))
        d = d.where(F.col("__id").isNotNull() & F.col("__t").isNotNull() & ~F.isnan("__t") & (F.abs("__t") < big) & (F.col("__tol") >= 0) & ~F.isnan("__tol"))
        for i in range(len(entity)):
            d = d.where(F.col(f"__e{i}").isNotNull())
        return d

    keys = [f"__e{i}" for i in range(len(left_entity))]
    width = F.greatest(F.col("__tol") * slice_width, F.lit(1e-9))
    at = lambda x: F.floor(x / width).cast("long")
    a = rows(left, left_entity, left_id, left_time, 1).withColumn("__slice", at(F.col("__t")))
    b = rows(right, right_entity, right_id, right_time, 0)
    # A reading serves its own slice and any neighbour that a left row within the tolerance may lie in; a little more allows for rounding.
    reach = F.col("__tol") * 1.001
    b = b.withColumn("__slice", F.explode(F.sequence(at(F.col("__t") - reach), at(F.col("__t") + reach))))
    both = a.unionByName(b)
    # Right ids are carried, so both ids need one type; the left id travels beside it.
    both = both.select(*keys, "__slice", "__t", "__side", "__id", "__tol")
    hit = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), F.col("__id").alias("id")))
    back = Window.partitionBy(*keys, "__slice").orderBy("__t", "__side", F.desc("__id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys, "__slice").orderBy(F.desc("__t"), "__side", F.desc("__id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("__before", F.last(hit, ignorenulls=True).over(back)).withColumn("__after", F.last(hit, ignorenulls=True).over(ahead)).where("__side = 1")
    db, da = F.col("__t") - F.col("__before.t"), F.col("__after.t") - F.col("__t")
    first = da.isNull() | (db <= da)
    best = F.when(db.isNotNull() & first, F.struct(F.col("__before.id").alias("id"), db.alias("d"))).otherwise(F.struct(F.col("__after.id").alias("id"), da.alias("d")))
    found = carried.select(F.col("__id").alias(left_id), "__tol", best.alias("__best"))
    return found.where(F.col("__best.d") <= F.col("__tol")).select(left_id, F.col("__best.id").alias(right_id), F.col("__best.d").alias("distance"))
