"""Sources mixed to target shares of tokens (problem 8)."""

from __future__ import annotations

import base64
import importlib.util
import math
import os
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slices of the order of keys; only the slice in which a source's budget ends is sorted.
SLICES = 4096
#: A word of the tokenizer's own pattern: GPT-2's, for files without one.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary file lies: DRIFTWELL_TOKENIZERS, the installed package of tokenizer files, or /opt/tokenizers."""
    folder = os.environ.get("DRIFTWELL_TOKENIZERS")
    if not folder and (spec := importlib.util.find_spec("public_tokenizers")) and spec.submodule_search_locations:
        folder = next(iter(spec.submodule_search_locations))
    return os.path.join(folder or "/opt/tokenizers", name)


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a whole text in the tokenizer of a vocabulary file, which goes to the executors with the job; 0 for a null or empty text."""
    where = os.path.realpath(path or tokenizer_file())
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = PATTERN
    SparkSession.active().sparkContext.addFile(where)
    name = os.path.basename(where)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(SparkFiles.get(name), pattern)
        return texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


def source_name(source: Column) -> Column:
    """A source's name without variants of case, spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def text_quality(text: Column) -> Column:
    """Weight of a text in drawing, 0.05 to 1: the square of its part of letters and spaces."""
    part = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.length(text)
    return F.greatest(F.lit(0.05), F.coalesce(part * part, F.lit(0.05)))


@dataclass(frozen=True)
class Budget:
    """What one source gives: whole epochs and then a part of one."""

    source: str
    target: float
    aim: float
    most: int
    available: int
    tokens: float
    epochs: int
    rest: float


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> list[Budget]:
    """Tokens of each source for ``total`` tokens, or for the largest total in which every source that is there keeps its share.

    Sources without texts leave their share to the others in proportion. With a total given, sources that cannot fill their share within
    their most repeats give all they have.
    """
    there = {s: t for s, (t, most) in targets.items() if t > 0 and most > 0 and available.get(s, 0) > 0}
    whole = sum(there.values())
    aim = {s: t / whole for s, t in there.items()}
    if total is None:
        total = min((available[s] * targets[s][1] / a for s, a in aim.items()), default=0.0)
    out = []
    for s, (target, most) in sorted(targets.items()):
        have = available.get(s, 0)
        tokens = min(aim.get(s, 0.0) * total, float(have * most))
        epochs = min(most, math.floor(tokens / have + 1e-9)) if have else 0
        out.append(Budget(s, target, aim.get(s, 0.0), most, have, tokens, epochs, max(0.0, tokens - epochs * have) if epochs < most else 0.0))
    return out


def _counted(documents: DataFrame, targets: DataFrame, doc_id: str, source: str, text: str, path: str | None, seed: int) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").collect():
        wanted[r["s"]] = (max(0.0, float(r["target_share"] or 0.0)), max(0, int(r["max_repeats"] or 0)))
    live = [s for s, (t, most) in wanted.items() if t > 0 and most > 0]
    d = documents.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("__id"), source_name(F.col(source)).alias("__source"), F.col(text).alias("__text"))
    d = d.where(F.col("__source").isin(live)) if live else d.where(F.lit(False))
    # Counted and weighed where they are read: texts are never shuffled. Copies of a text within a source count once, so that no text
    # comes more often than the source's most repeats.
    d = d.select("__id", "__source", F.md5("__text").alias("__md5"), token_count(F.col("__text"), path).alias("__n"), text_quality(F.col("__text")).alias("__q"))
    ones = d.groupBy("__source", "__md5").agg(F.min("__id").alias("__id"), F.max("__n").alias("__n"), F.max("__q").alias("__q"))
    u = (F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    rows = ones.select("__id", "__source", "__n", (-F.log(u) / F.col("__q")).alias("__key"))
    return rows.where("__n > 0").withColumn("__slice", F.floor(F.col("__key") / (1 + F.col("__key")) * SLICES).cast("int")).persist(StorageLevel.MEMORY_AND_DISK), wanted


def mix_sources(
    documents: DataFrame, targets: DataFrame, *, doc_id: str, source: str, text: str, total_tokens: float | None = None, tokenizer_path: str | None = None, seed: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): doc_id, source, copies, tokens of each text that is used; and what each source gives.

    ``targets`` (source, target_share, max_repeats) is small by its nature and is read on the driver. Each text has an exponential key,
    -ln(u) / quality with u from a hash of its id (Efraimidis and Spirakis' weighted sampling without replacement). A source is used in
    whole epochs as far as its budget goes; the rest of the budget takes the texts of smallest keys up to the number of tokens. Prefix
    sums run over slices of the keys, summed in the tasks first; only the one slice in which a source's budget ends is sorted row by row,
    so a source that holds a third of all rows is never brought together. The last text is taken if more than half of it fits.

    shares: source, target_share, reachable_share (the target among sources that are there), max_repeats, available_tokens, used_tokens,
    epochs, actual_share, short (whether it gives less than its reachable share).

    Defined cases: names of sources are compared without case, spaces and hyphens; null sources, sources without a target, and targets of
    0 or null (or 0 repeats) are not used; null and empty texts have no tokens and are not used; copies of a text within a source
    count once, under the smallest id; an empty input gives no selection and shares of 0; other columns are ignored.
    """
    rows, wanted = _counted(documents, targets, doc_id, source, text, tokenizer_path, seed)
    spark = documents.sparkSession
    have = {r["__source"]: int(r["n"]) for r in rows.groupBy("__source").agg(F.sum("__n").alias("n")).collect()}
    plan = budgets(have, wanted, total_tokens)
    schema = "source string, target_share double, reachable_share double, max_repeats int, available_tokens long, budget double, epochs int, rest double"
    small = spark.createDataFrame([(b.source, b.target, b.aim, b.most, b.available, b.tokens, b.epochs, b.rest) for b in plan], schema)
    # At most sources * SLICES rows.
    slices = rows.groupBy("__source", "__slice").agg(F.sum("__n").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(F.col("__source").alias("__s"), F.col("__slice").alias("__l"), "__sum", F.coalesce(before, F.lit(0)).alias("__before"))
    slices = slices.join(F.broadcast(small), F.col("__s") == F.col("source")).select("__s", "__l", "__before", "epochs", "rest", (F.col("__before") + F.col("__sum") <= F.col("rest")).alias("__all"), (F.col("__before") >= F.col("rest")).alias("__none"))
    at = rows.join(F.broadcast(slices), (F.col("__source") == F.col("__s")) & (F.col("__slice") == F.col("__l")))
    clear = at.where("__all or __none").select("__id", "__source", "__n", (F.col("epochs") + F.when(F.col("__all"), 1).otherwise(0)).alias("copies"))
    close = at.where("not (__all or __none)")
    w = Window.partitionBy("__source").orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = close.withColumn("__to", F.col("__before") + F.sum("__n").over(w)).select("__id", "__source", "__n", (F.col("epochs") + F.when(F.col("__to") - F.col("__n") / 2 <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    chosen = clear.unionByName(close).where("copies > 0")
    selection = chosen.select(F.col("__id").alias(doc_id), F.col("__source").alias("source"), F.col("copies").cast("int").alias("copies"), F.col("__n").alias("tokens"))
    used = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"))
    shares = small.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    every = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    actual = F.when(every > 0, F.col("used_tokens") / every).otherwise(0.0)
    shares = shares.select("source", "target_share", "reachable_share", "max_repeats", "available_tokens", "used_tokens", "epochs", actual.alias("actual_share"), (actual < F.col("reachable_share") * 0.98).alias("short"))
    return selection, shares
