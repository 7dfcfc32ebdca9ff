"""Quantities recorded in different units brought to common units (problem 5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.units import BRACKETS, fits, mentioned, parse, to_common

_RESULT = T.StructType([T.StructField("unit", T.StringType()), T.StructField("stated_in", T.StringType()), T.StructField("factor", T.DoubleType()), T.StructField("offset", T.DoubleType())])


@F.pandas_udf(_RESULT)
def _value_unit(units: pd.Series, text: pd.Series, quantity: pd.Series, common: pd.Series) -> pd.DataFrame:
    out = []
    for u, t, q, c in zip(units, text, quantity, common, strict=True):
        row = (None, None, None, None)
        if isinstance(q, str) and isinstance(c, str):
            for said, unit in (("units", u.strip(BRACKETS) if isinstance(u, str) else None), ("text", mentioned(t, q) if isinstance(t, str) else None)):
                if unit and (change := to_common(unit, q, c)) is not None:
                    row = (unit, said, *change)
                    break
        out.append(row)
    return pd.DataFrame(out, columns=["unit", "stated_in", "factor", "offset"]).astype({"factor": "float64", "offset": "float64"})


@F.pandas_udf(T.DoubleType())
def _time_unit(text: pd.Series) -> pd.Series:
    def seconds(t: object) -> float | None:
        unit = mentioned(t, "time") if isinstance(t, str) else None
        parsed = parse(unit, "time") if unit else None
        factor = fits(parsed, "time")
        return parsed.factor * factor if parsed is not None and factor is not None else None

    return text.map(seconds).astype("float64")


def product(factors: Column) -> Column:
    """Product of an array; 1 for a null or empty one. Null elements count as 1."""
    return F.coalesce(F.aggregate(factors, F.lit(1.0), lambda a, x: a * F.coalesce(x, F.lit(1.0))), F.lit(1.0))


def to_common_units(
    records: DataFrame, *, record_id: str, quantity: str, value: str, units: str, text: str, scales: str, time_unit: str, times: list[str], common: DataFrame,
) -> DataFrame:
    """record_id, each time in seconds, the value in the quantity's common unit, and how they were found.

    Columns: record_id, seconds_per_unit, <time>_s for each of ``times``, scale, unit, stated_in ('units' or 'text'), factor, offset,
    value_common = value * scale * factor + offset, and converted: whether time, unit or scale ask for a change.

    ``common`` holds (quantity, common_unit). The unit comes from ``units`` where that spells one of the quantity, else from what the
    free text states, else it is unknown and value_common is null. Unit strings are segmented by dynamic programming over tries of
    prefixes, roots and exponents; a decomposition into another dimension than the quantity's costs more. Times: a positive finite
    ``time_unit`` holds, else what the text says, else seconds. The exchange-free plan parses each distinct string of a task once.

    Defined cases: rows with a null id are dropped, repeated rows of one id count once; a null, NaN value or time gives a null result;
    null or empty scales are 1; an unknown quantity has no common unit; an empty input gives an empty result; other columns are ignored.
    """
    c = common.select(F.col("quantity").alias("__q"), F.col("common_unit").alias("__common")).dropDuplicates(["__q"])
    r = records.where(F.col(record_id).isNotNull()).select(
        F.col(record_id).alias("record_id"), F.col(quantity).alias("__quantity"), F.col(value).cast("double").alias("__v"), F.col(units).alias("__u"), F.col(text).alias("__text"),
        product(F.col(scales)).alias("scale"), F.col(time_unit).cast("double").alias("__tu"), *[F.col(t).cast("double").alias(f"__t{i}") for i, t in enumerate(times)],
    )
    r = r.dropDuplicates(["record_id"]).join(c, F.col("__quantity") == F.col("__q"), "left")
    given = (F.col("__tu") > 0) & ~F.isnan("__tu") & (F.col("__tu") < float("inf"))
    r = r.withColumn("__x", _value_unit("__u", "__text", "__quantity", "__common")).withColumn("__said", _time_unit("__text"))
    per = F.when(given, F.col("__tu")).otherwise(F.coalesce("__said", F.lit(1.0)))
    r = r.withColumn("seconds_per_unit", per)
    changed = (F.col("seconds_per_unit") != 1.0) | (F.col("__x.factor") != 1.0) | (F.col("__x.offset") != 0.0) | (F.abs(F.col("scale") - 1.0) > 1e-12)
    return r.select(
        "record_id", "seconds_per_unit", *[F.nanvl(F.col(f"__t{i}") * F.col("seconds_per_unit"), F.lit(None)).alias(f"{t}_s") for i, t in enumerate(times)], "scale",
        F.col("__x.unit").alias("unit"), F.col("__x.stated_in").alias("stated_in"), F.col("__x.factor").alias("factor"), F.col("__x.offset").alias("offset"),
        F.nanvl(F.col("__v") * F.col("scale") * F.col("__x.factor") + F.col("__x.offset"), F.lit(None)).alias("value_common"), F.coalesce(changed, F.lit(False)).alias("converted"),
    )
