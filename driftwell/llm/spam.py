"""Keyword-stuffed pages, link lists and product tags told from running text (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.pages import NAMES, features

#: Labelled pages that the trees learn from, at most, of each class: those with the smallest hashes of their ids.
LEARN = 10_000
TREES = 60
DEPTH = 8


def page_features(pages: DataFrame, page_id: str, text: str, host: str) -> DataFrame:
    """page_id, host, x: the features of each page by content and links; x is null for a text without words."""
    kind = pages.schema[page_id].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "host": b["host"], "x": [None if (v := features(t)) is None else v.tolist() for t in b["text"]]}, columns=["page_id", "host", "x"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return rows.mapInPandas(work, f"page_id {kind}, host string, x array<double>")


def weak_label(x: Column) -> Column:
    """1 for pages of the plainest spam, 0 for the plainest pages that are none, null for all others, which the trees decide by what these teach.

    Each rule is a label of one kind of page at its extreme: a page that is next to all links, offers or hashtags, few words over and over,
    spaced or leetspeak words, or one long row of repeated words; and prose, tables of numbers, code, and listings of channels.
    """
    f = {n: x[i] for i, n in enumerate(NAMES)}
    enough = F.exp(f["log_words"]) - 1 >= 15
    few = (f["top_words"] > 0.7) & (f["small_words"] < 0.01) & (f["numbers"] < 0.03) & (f["identifiers"] < 0.01)
    disguised = (f["single_letters"] > 0.6) | (f["mixed_digits"] > 0.5)
    nothing_else = (f["prose"] < 0.02) & ((f["link_chars"] > 0.9) | (f["lines_of_links"] > 0.98) | (f["offers"] > 0.97) | (f["hashtags"] > 0.8) | few | disguised)
    row = (f["words_a_segment"] > 60) & (f["repeated"] > 0.8) & (f["numbers"] < 0.03) & (f["identifiers"] < 0.02)
    channels = (f["identifiers"] > 0.06) & (f["numbers"] > 0.25) & (f["offers"] < 0.05)
    none = (f["prose"] > 0.95) | ((f["numbers"] > 0.7) & (f["offers"] < 0.05)) | (f["code"] > 0.6) | channels
    return F.when(none, 0.0).when(enough & (nothing_else | row), 1.0)


def spam_pages(pages: DataFrame, *, page_id: str, text: str, host: str, weight: float = 0.25, prior: float = 20.0, seed: int = 11) -> DataFrame:
    """page_id, content, host_rate, score: how likely each page is keywords, links or tags in the main.

    ``content`` is the vote of bagged decision trees on content and link features. The trees learn from the plainest pages of each
    class, which weak labels name, at most LEARN of each class, drawn by hash from all pages; everything else is computed over all pages. ``host_rate`` is the rate of spam
    among the other pages of the host, drawn towards the rate of all pages as if by ``prior`` pages. ``score`` moves the odds of the vote by
    ``weight`` times the host's log-odds against those of all pages: it decides between close votes and leaves clear ones.

    Defined cases: a null or empty text, or one without words, has score 0; a null host has no rate of its own and is not smoothed; copies
    score alike but for their hosts; an empty input, or one where the labels name no page of one class, gives the labels themselves (0 or 1, 0 where
    there is none); repeated ids are scored each; other columns are ignored.
    """
    f = page_features(pages, page_id, text, host).persist(StorageLevel.MEMORY_AND_DISK)
    f.count()  # made once, before two stages ask for them at the same time
    labelled = f.where("x is not null").select("x", weak_label(F.col("x")).alias("label"), F.xxhash64("page_id", F.lit(seed)).alias("h")).where("label is not null")
    some = [labelled.where(F.col("label") == c).orderBy("h").limit(LEARN).select(array_to_vector("x").alias("features"), "label") for c in (0.0, 1.0)]
    learn = some[0].union(some[1]).coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    known = f.where("x is not null")
    if len(counts) < 2:
        voted = known.select("page_id", "host", F.coalesce(weak_label(F.col("x")), F.lit(0.0)).alias("content"))
    else:
        trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=3, seed=seed).fit(learn)
        voted = trees.transform(known.select("page_id", "host", array_to_vector("x").alias("features"))).select("page_id", "host", vector_to_array("probability")[1].alias("content"))
    learn.unpersist()
    hosts = voted.where("host is not null").groupBy("host").agg(F.sum("content").alias("s"), F.count("*").alias("n"))
    every = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = float(np.clip((every["s"] or 0.0) / max(1, every["n"] or 0), 1e-3, 1 - 1e-3))
    rate = (F.col("s") - F.col("content") + F.lit(prior * mean)) / (F.col("n") - 1 + F.lit(prior))
    odds = lambda p: F.log(p / (1 - p))
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("content")))
    joined = voted.join(hosts, "host", "left").withColumn("host_rate", F.when(F.col("host").isNotNull(), F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), rate))))
    moved = odds(p) + F.coalesce(F.lit(weight) * (odds(F.col("host_rate")) - F.lit(float(np.log(mean / (1 - mean))))), F.lit(0.0))
    scored = joined.select("page_id", "content", "host_rate", (1 / (1 + F.exp(-moved))).alias("score"))
    none = f.where("x is null").select("page_id", F.lit(0.0).alias("content"), F.lit(None).cast("double").alias("host_rate"), F.lit(0.0).alias("score"))
    return scored.unionByName(none).withColumnRenamed("page_id", page_id)
