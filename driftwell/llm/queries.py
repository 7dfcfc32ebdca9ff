"""Queries of the training-data problems on their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.clusters import Field, cluster_records, describe_clusters, successive_members
from driftwell.llm.leaks import find_leaks
from driftwell.llm.mixing import mix_sources
from driftwell.llm.nearest import nearest_in_time
from driftwell.llm.spam import spam_pages
from driftwell.sources import table


def p1_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of features with its campaign's group, -1 for none."""
    fields = [Field("freq"), Field("kh"), Field("rms", log10=True)]
    return cluster_records(table(spark, folder, "features"), record_id="indx", part=F.col("campaign"), fields=fields)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return successive_members(p1_labelled(spark, folder)).select(F.col("a").alias("indx_a"), F.col("b").alias("indx_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each group's size and most typical records."""
    return describe_clusters(p1_labelled(spark, folder))


def p2_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of features that has a reading of its slow channel near enough, with the distance in time."""
    tol = table(spark, folder, "channels").select("channel", "match_tol_s")
    records = table(spark, folder, "features").select("indx", "shot", "ref_channel", "fs_time").join(tol, F.col("ref_channel") == F.col("channel"))
    readings = table(spark, folder, "timeseries").where(F.col("signal").isNotNull() & ~F.isnan("signal")).select("sample_id", "shot", "channel", "timebase").join(tol, "channel")
    return nearest_in_time(
        records, readings, left_id="indx", right_id="sample_id", left_entity=[F.col("shot"), F.col("ref_channel")], right_entity=[F.col("shot"), F.col("channel")],
        left_time="fs_time", right_time="timebase", tolerance="match_tol_s",
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_matched(spark, folder).select("indx", "sample_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each text that holds an evaluation passage, with how much of it."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", passage="passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), doc_id="doc_id", source="source", text="text")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Each text that the mix uses, how often, and its tokens."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source gives against its target."""
    return _mix(spark, folder)[1]


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the vote of the trees, its host's rate of spam and the smoothed score."""
    return spam_pages(table(spark, folder, "documents"), page_id="doc_id", text="text", host="site")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_scores(spark, folder).where("score > 0.5").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p1_labelled": p1_labelled, "p2_found": p2_found, "p2_matched": p2_matched, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores}

_NEAR = """
    WITH r AS (SELECT DISTINCT sample_id, shot, channel, timebase t FROM timeseries WHERE timebase IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal)),
    f AS (SELECT indx, shot, ref_channel AS channel, fs_time t, match_tol_s tol FROM features JOIN channels ON ref_channel = channel WHERE fs_time IS NOT NULL AND NOT isnan(fs_time)),
    b AS (SELECT f.indx, f.tol, f.t - r.t AS d, r.sample_id FROM f ASOF JOIN r ON f.shot = r.shot AND f.channel = r.channel AND f.t >= r.t),
    a AS (SELECT f.indx, f.tol, r.t - f.t AS d, r.sample_id FROM f ASOF JOIN r ON f.shot = r.shot AND f.channel = r.channel AND f.t <= r.t),
    u AS (SELECT *, 0 AS o FROM b UNION ALL SELECT *, 1 FROM a)
    SELECT indx, arg_min(sample_id, (d, o)) AS sample_id, min(d) AS distance FROM u GROUP BY indx HAVING min(d) <= any_value(tol)"""

SQL = {"p2_found": f"SELECT indx, sample_id FROM ({_NEAR})", "p2_matched": _NEAR}
