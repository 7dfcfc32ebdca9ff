"""Text formats: delimited samples, headed ASCII, fluctuation lines, logs, parameter trees, pages of links."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def delimited_samples(spark: SparkSession, path: str, *, channels: Sequence[str], sep: str = r"\s+", comment: str = "#") -> DataFrame:
    """i, timebase, channel, signal from lines of a time and one value a channel. Lines that don't hold enough numbers are left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.split(F.trim("value"), sep).alias("p"), F.trim("value").alias("v"))
    rows = lines.where(~F.col("v").startswith(comment) & (F.size("p") >= len(channels) + 1))
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.get("p", F.lit(k + 1)).try_cast("double").alias("signal")) for k, c in enumerate(channels)])
    return rows.select("i", F.get("p", F.lit(0)).try_cast("double").alias("timebase"), F.inline(pairs)).where("timebase is not null")


def coordinates(lines: DataFrame, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Numbers of lines of coordinates, apart by spaces or commas; comments and lines that don't hold enough numbers are left out."""
    p = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.where(~F.trim("value").startswith("#")).select(*[F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])
    return rows.where(" and ".join(f"{n} is not null" for n in names))


def headed_ascii(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(header, rows) of files with '# key = value' lines and comma-separated numbers; columns are named by the header's ValName and DimName."""
    lines = spark.read.text(path)
    head = {r["k"].strip().lower(): r["x"].strip().strip("'\"") for r in lines.where("value like '#%=%'").select(F.regexp_extract("value", r"#\s*([^=]+?)\s*=", 1).alias("k"), F.regexp_extract("value", r"=\s*(.*)$", 1).alias("x")).limit(1000).collect()}
    names = [n.strip().strip("'\"") for key in ("dimname", "valname") for n in head.get(key, "").split(",") if n.strip()]
    p = F.split("value", ",")
    rows = lines.where("value not like '#%' and trim(value) != ''").select(*[F.trim(F.get(p, F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(names)])
    return head, rows


#: Columns of a fluctuation line, before its phases.
LINE = ["shot", "t_mid", "svs", "freq", "amp", "a12", "p", "h"]


def fluctuation_lines(df: DataFrame, phases: str = "phases") -> DataFrame:
    """value: records as fixed-width lines, shot first and the phases last."""
    fmt = "%d %10.6f %d %9.4f %10.4g %6.3f %6.3f %6.3f %s"
    p = F.array_join(F.transform(phases, lambda x: F.format_string("%.2f", x.cast("double"))), " ")
    return df.select(F.format_string(fmt, *[F.col(c) if c in ("shot", "svs") else F.col(c).cast("double") for c in LINE], p).alias("value"))


def parse_fluctuation_lines(lines: DataFrame, *, phases: int, header: str = "^Shot ") -> tuple[DataFrame, DataFrame]:
    """(records, bad lines): bad ones have too few columns or words for numbers; header and comment lines are neither."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").rlike(header) & ~F.col("value").rlike(r"^\s*(#|$)")).select("value", p.alias("p"))
    kinds = {"shot": "long", "svs": "long"}
    cast = rows.select("value", *[F.get("p", F.lit(i)).try_cast(kinds.get(c, "double")).alias(c) for i, c in enumerate(LINE)], F.transform(F.slice("p", len(LINE) + 1, phases), lambda x: x.try_cast("double")).alias("phases"))
    good = (F.size("phases") == phases) & ~F.exists("phases", lambda x: x.isNull())
    for c in LINE:
        good = good & F.col(c).isNotNull()
    return cast.where(good).drop("value"), cast.where(~F.coalesce(good, F.lit(False))).select("value")


def line_faults(records: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """records with fault: 2 where the shot changes within a file, 4 where time runs backwards, 0 else; the same line twice is kept once."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag("shot").over(w) != F.col("shot"), 2).otherwise(0)
    back = F.when((F.lag("t_mid").over(w) > F.col("t_mid")) & (F.lag("shot").over(w) == F.col("shot")), 4).otherwise(0)
    return records.withColumn("fault", change + back).dropDuplicates([c for c in records.columns if c != order])


def json_fields(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """df with a text column for each path into a JSON column."""
    return df.withColumns({name: F.get_json_object(column, path) for name, path in paths.items()})


def event_log(lines: DataFrame) -> DataFrame:
    """event, time, comment, leader of lines 'event; time; comment; leader'."""
    p = F.split("value", r"\s*;\s*")
    return lines.where(F.size(p) >= 2).select(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("event", "time", "comment", "leader"))])


def linked_intervals(html: DataFrame) -> DataFrame:
    """from_utc, upto_utc of links with from= and upto= in a page's text."""
    hits = html.select(F.explode(F.regexp_extract_all("value", F.lit(r"from=\d+(?:&amp;|&)upto=\d+"), F.lit(0))).alias("x"))
    return hits.select(F.regexp_extract("x", r"from=(\d+)", 1).cast("long").alias("from_utc"), F.regexp_extract("x", r"upto=(\d+)", 1).cast("long").alias("upto_utc"))


def page_links(html: DataFrame) -> DataFrame:
    """date, topic, href of links whose text or address holds a date."""
    hits = html.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?i)<a[^>]*href=[\"'][^\"']+[\"'][^>]*>[^<]*"), F.lit(0))).alias("x"))
    href, topic = F.regexp_extract("x", r"(?i)href=[\"']([^\"']+)", 1), F.regexp_extract("x", r">([^<]*)$", 1)
    date = F.regexp_extract(F.concat_ws(" ", topic, href), r"((?:19|20)\d\d)[-/_.]?(\d\d)[-/_.]?(\d\d)", 0)
    return hits.select(F.regexp_replace(date, r"\D", "").alias("date"), F.trim(topic).alias("topic"), href.alias("href")).where("date != ''")


def parameter(tree: Column, path: str, default: str | None = None) -> Column:
    """The value at a/b/c of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(tree, "$." + ".".join(path.split("/"))), F.lit(default))


def parameter_names(df: DataFrame, tree: str, row_id: str) -> DataFrame:
    """row_id, key, value of the top level of a JSON object of any shape."""
    return df.select(row_id, F.explode(F.from_json(tree, "map<string,string>")).alias("key", "value"))


def key_values(text: Column, pair: str = ",", sep: str = "=") -> Column:
    """A map of 'a=1,b=2'."""
    return F.str_to_map(text, F.lit(pair), F.lit(sep))


def inferred(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """String columns as long, double or string, by one pass over all rows that sees whether every value fits."""
    whole, real = r"^\s*[-+]?\d{1,18}\s*$", r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
    stats = df.agg(*[F.bool_and(F.col(c).rlike(whole) | F.col(c).isNull() | (F.trim(c) == "")).alias(f"{c}__w") for c in columns], *[F.bool_and(F.col(c).rlike(real) | F.col(c).isNull() | (F.trim(c) == "")).alias(f"{c}__r") for c in columns]).first()
    kind = lambda c: "long" if stats[f"{c}__w"] else "double" if stats[f"{c}__r"] else None
    return df.withColumns({c: F.trim(c).try_cast(kind(c)) for c in columns if kind(c)})


def time_ns(text: Column) -> Column:
    """ns since 1970 (UTC) of texts as '20040301', '20040301 12:30:00' or '2004-03-01 12:30:00.25'; null where none fits."""
    formats = ["yyyyMMdd HH:mm:ss", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.unix_micros(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])) * 1000


def sine(spark: SparkSession, *, n: int, t0: float, sample_freq: float, amplitude: float, frequency: float) -> DataFrame:
    """i, timebase, signal of A sin(2 pi f t)."""
    t = F.lit(t0) + F.col("id") / F.lit(sample_freq)
    return spark.range(n).select(F.col("id").alias("i"), t.alias("timebase"), (F.lit(amplitude) * F.sin(2 * math.pi * frequency * t)).alias("signal"))


def many_modes(spark: SparkSession, *, channels: int, n: int, step: float, modes: Sequence[tuple[float, float, int, float]], noise: float = 0.0, seed: int = 3) -> DataFrame:
    """Samples of channels around a ring that sees modes (amplitude, frequency, mode number, phase), with even noise."""
    c, i = F.expr(f"id div {n}"), F.col("id") % n
    t, theta = i * F.lit(step), 2 * math.pi * c / F.lit(channels)
    v = F.lit(noise) * 2 * (F.rand(seed) - 0.5)
    for a, f, m, p in modes:
        v = v + F.lit(a) * F.cos(2 * math.pi * f * t + m * theta + p)
    return spark.range(channels * n).select(F.format_string("ch_%02d", c.cast("int")).alias("channel"), i.alias("i"), t.alias("timebase"), v.alias("signal"))
