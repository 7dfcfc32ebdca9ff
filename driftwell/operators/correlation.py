"""Correlations of pairs of columns and of channels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators.mining import finite


def zero_lag(df: DataFrame, keys: Sequence[str], x: str, y: str, *, ac: bool = True, coefficient: bool = True) -> DataFrame:
    """keys, n, correlation of two columns at lag 0 over the rows where both are known.

    ``ac`` takes the means off; ``coefficient`` gives sum(xy) / sqrt(sum(xx) sum(yy)), else sum(xy) / sum(xx). Null where the denominator is 0.
    """
    rows = df.select(*keys, finite(x).alias("__x"), finite(y).alias("__y")).where("__x is not null and __y is not null")
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), *_sums(F.col("__x"), F.col("__y"), ac))
    return s.select(*keys, "n", _ratio(coefficient).alias("correlation"))


def _sums(x: Column, y: Column, ac: bool) -> list[Column]:
    if ac:
        return [F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy")]
    return [F.avg(x * y).alias("xy"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy")]


def _ratio(coefficient: bool) -> Column:
    below = F.sqrt(F.col("xx") * F.col("yy")) if coefficient else F.col("xx")
    return F.when(below > 0, F.col("xy") / below)


def correlation_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, a, b, n, correlation of every pair of columns, each over the rows where both are known; one aggregation."""
    v = {c: finite(c) for c in columns}
    out = []
    for a, b in combinations(columns, 2):
        both = v[a].isNotNull() & v[b].isNotNull()
        out.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), F.corr(F.when(both, v[a]), F.when(both, v[b])).alias("correlation")))
    return df.groupBy(*keys).agg(F.array(*out).alias("__p")).select(*keys, F.inline("__p"))


def products(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, product: the sum of products of two signals of one length, which is their correlation where they overlap wholly."""
    rows = df.select(*keys, finite(x).alias("__x"), finite(y).alias("__y"))
    return rows.groupBy(*keys).agg(F.count(F.col("__x") * F.col("__y")).alias("n"), F.sum(F.col("__x") * F.col("__y")).alias("product"))
