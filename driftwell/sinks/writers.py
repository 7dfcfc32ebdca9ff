"""Feature tables to files: parquet with added columns, shots replaced in place, ARFF, CSV with a JSON preamble, JDBC."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save(df: DataFrame, path: str, *, columns: Sequence[str] | None = None, where: Column | None = None, mode: str = "errorifexists", by: Sequence[str] = ()) -> None:
    """Chosen columns and rows as parquet; an existing table is an error unless said otherwise."""
    out = df.where(where) if where is not None else df
    out = out.select(*columns) if columns else out
    out.write.mode(mode).partitionBy(*by).parquet(path) if by else out.write.mode(mode).parquet(path)


def with_added(df: DataFrame, extra: DataFrame, row_id: str = "indx") -> DataFrame:
    """df with the new columns of ``extra`` by id; ValueError if any id of one is missing in the other or a column is already there."""
    clash = (set(extra.columns) & set(df.columns)) - {row_id}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    n = df.select(F.lit(1).alias("a"), row_id).join(extra.select(F.lit(1).alias("b"), row_id), row_id, "full").where("a is null or b is null").limit(1).count()
    if n:
        raise ValueError("ids differ")
    return df.join(extra, row_id)


def replace_shots(df: DataFrame, path: str, by: str = "shot") -> None:
    """Rows take the place of all rows of their shots; other shots stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _scalars(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            out += [F.get(f.name, F.lit(i)).alias(f"{f.name}_{i}") for i in range(lengths.get(f.name, 0))]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def arff_lines(df: DataFrame, name: str, lengths: dict[str, int] | None = None) -> tuple[list[str], DataFrame]:
    """(header lines, rows as lines) of a table; arrays become columns, unknown values '?'."""
    flat = _scalars(df, lengths or {})
    kind = lambda t: "NUMERIC" if isinstance(t, T.NumericType) else "STRING"
    head = [f"@RELATION {name}", *(f"@ATTRIBUTE {f.name} {kind(f.dataType)}" for f in flat.schema), "@DATA"]
    text = [F.when(F.isnan(f.name), F.lit("?")).otherwise(F.col(f.name).cast("string")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("string") for f in flat.schema]
    return head, flat.select(F.concat_ws(",", *[F.coalesce(x, F.lit("?")) for x in text]).alias("value"))


def write_csv(df: DataFrame, path: str, *, about: dict, lengths: dict[str, int] | None = None) -> None:
    """Arrays as columns, with a side file of what the table is about."""
    _scalars(df, lengths or {}).write.mode("errorifexists").option("header", True).csv(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/about")


def to_jdbc(df: DataFrame, url: str, name: str, *, rows: int | None = None, chunk: int = 10_000, lengths: dict[str, int] | None = None, **options: str) -> None:
    """Rows to a database: NaN as NULL, arrays as columns, ``chunk`` rows a statement."""
    flat = _scalars(df, lengths or {})
    flat = flat.select(*[F.nanvl(f.name, F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in flat.schema])
    (flat.limit(rows) if rows else flat).write.format("jdbc").options(url=url, dbtable=name, batchsize=chunk, **options).mode("append").save()


def save_clusters(labels: DataFrame, settings: dict, path: str) -> None:
    """Labels of a clustering as parquet, with its settings as JSON beside them."""
    labels.write.mode("errorifexists").parquet(f"{path}/labels")
    labels.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/settings")


def load_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(labels, settings) as saved by save_clusters."""
    return spark.read.parquet(f"{path}/labels"), json.loads(spark.read.text(f"{path}/settings").first()[0])


def save_shot_list(shots: DataFrame, path: str) -> None:
    """A shot catalogue as lines of JSON, which sources.archive.shot_catalogue reads."""
    shots.write.mode("errorifexists").json(path)


def save_samples(samples: DataFrame, path: str, by: Sequence[str] = ("device", "shot", "diag")) -> None:
    """Samples as a partitioned cache, which sources.archive.cached reads; rows are brought together by partition first, so that each has one file."""
    samples.repartition(*by).write.mode("errorifexists").partitionBy(*by).parquet(path)


def save_objects(objects: dict[str, DataFrame], path: str) -> None:
    """Several tables of one result (structures, pairs, settings) each under its name."""
    for name, df in objects.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def magnitude_phase(df: DataFrame, re: str, im: str, name: str) -> DataFrame:
    return df.withColumns({f"mag_{name}": F.hypot(re, im), f"phase_{name}": F.atan2(im, re)})
