"""Evaluation passages found in training text through a positional inverted index (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different terms of a passage in one band of offsets that make a candidate; fewer only for passages of fewer.
NEED = 24
#: Words of 64 bits in which the terms that hit are marked; longer passages keep them in sets.
MARKS_AT_MOST = 32
#: Terms of all passages, counted, up to which they are broadcast; beyond that they are joined by shuffling.
BROADCAST_TERMS = 500_000
#: Candidate pairs, counted, up to which they are broadcast to the texts; beyond that they are joined by shuffling.
BROADCAST_PAIRS = 1_000_000

# What is taken out of a text before it is cut into words, in this order (pattern, replacement). Texts that don't hold a MARK
# need only what is in PLAIN.
MARKS = "[&\\\\<\\u00AD\\u200B-\\u200D\\u2060\\uFEFF\\u00A0\\u2010\\u2011]|\\]\\(|=\\r?\\n|=20|-[ \\t]*\\r?\\n"
MARKED = [
    # nothing: invisible characters, soft line breaks of mail, quotes as entities or escapes, markup within words
    ("[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]|=\\r?\\n|&(?:quot|apos|#39|#[xX]27|#34|#[xX]22|shy);|\\\\u(?!00[aA2]0)[0-9a-fA-F]{4}|\\\\[\"'/\\\\]"
     "|(?i:</?(?:b|i|em|strong|span|u|s|a|code|font|sub|sup|mark|small|tt)\\b[^<>]*>)", ""),
    # words cut at a line's end, whatever quotes the next line
    ("(?<=[\\p{L}\\p{N}])[-\\u2010\\u2011][ \\t]*\\r?\\n[>\\s|#*]*(?=[\\p{L}\\p{N}])", ""),
    # a space: other entities, escapes and markup, links of markdown
    ("=20(?=\\r?\\n)|&(?:[a-zA-Z]{2,8}|#\\d{1,6}|#[xX][0-9a-fA-F]{1,5});|\\u00A0|\\\\(?:[nrt]|u00[aA2]0)|<[!/]?[A-Za-z][^<>]{0,300}>|\\]\\([^)\\s]*\\)", " "),
]
PLAIN = [
    # a space for dashes and for marks without a space after them
    ("[\\u2012-\\u2015/|]|[,;:!?](?=[\\p{L}\\p{N}])|\\.(?=\\p{L})", " "),
    # punctuation, also within words
    ("[^\\p{L}\\p{N}\\s]+", ""),
]


def words(text: Column) -> Column:
    """The words of a text, without case, punctuation, line breaks, hyphenation, markup, quoting and escaping; null for a null text."""

    def clean(patterns: list[tuple[str, str]]) -> Column:
        t = text
        for pattern, replacement in patterns:
            t = F.regexp_replace(t, F.lit(pattern), F.lit(replacement))
        return t

    t = F.when(F.rlike(text, F.lit(MARKS)), clean([*MARKED, *PLAIN])).otherwise(clean(PLAIN))
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def _terms(words_: str) -> Column:
    """The terms of a list of words: each word with the next one, and each with the next but one, as hashes with the place of the first."""
    w = F.col(words_)

    def pairs(gap: int) -> Column:
        n = F.greatest(F.size(w) - gap, F.lit(0))
        hashes = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b))
        return F.transform(hashes, lambda h, i: F.struct(i.cast("int").alias("pos"), F.lit(gap).cast("byte").alias("gap"), h.alias("term")))

    return F.concat(pairs(1), pairs(2))


def positional_index(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """term, doc, pos: every pair of successive words, and of words with one between, of every text, as a hash, with its place. Store it partitioned by term to search it often."""
    texts = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), words(F.col(text)).alias("__w"))
    return texts.select("doc", F.inline(_terms("__w"))).select("term", "doc", "pos")


def align(passage: list[str], text: list[str]) -> tuple[int, int]:
    """(matched, run): most words of the passage found in order with no gap of more than one word on either side, and most found without any gap."""
    where: dict[str, list[int]] = {}
    for k, w in enumerate(passage):
        where.setdefault(w, []).append(k)
    matched = run = 0
    before: dict[int, tuple[int, int]] = {}  # matches at the last word of the text: place in the passage -> (matched, run)
    before2: dict[int, tuple[int, int]] = {}
    none = (0, 0)
    for w in text:
        now: dict[int, tuple[int, int]] = {}
        for k in where.get(w, ()):
            m1, r1 = before.get(k - 1, none)
            m = 1 + max(m1, before.get(k - 2, none)[0], before2.get(k - 1, none)[0], before2.get(k - 2, none)[0])
            now[k] = (m, r1 + 1)
            matched, run = max(matched, m), max(run, r1 + 1)
        before2, before = before, now
    return matched, run


def find_leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, passage: str, run: int = 16, share: float = 0.5, index: DataFrame | None = None,
) -> DataFrame:
    """doc_id, item_id, matched, share, longest_run: each text that holds a passage wholly or in part.

    A text holds a passage if ``run`` consecutive words of it stand there, or at least ``share`` of its words in order with only single
    words altered, replaced, dropped or added between. A passage of fewer than ``run`` words is held where all its words stand together.

    1. The texts' positional index, whose terms are pairs of words next to each other or with one between, gives the frequency of the
       passages' terms over all texts.
    2. Words found in order with at most one odd word between them are pairs of this kind on both sides, so a text that holds a passage has at
       least as many of its terms as such words follow each other. All but so many of each passage's terms search, the rarest ones, that NEED of
       them still hit: by the pigeonhole principle no text is missed. Postings less their place in the passage are brought together by text,
       passage and band of offsets, twice as wide as offsets can drift; NEED different terms in one band make a candidate.
    3. Candidates are aligned word by word.

    Whole texts are indexed, and no text or candidate is left out. The passages' terms, and the candidates, are broadcast only if counted to
    be at most BROADCAST_TERMS and BROADCAST_PAIRS, else the same joins shuffle. ``index`` may be a stored positional_index of the same documents.

    Defined cases: null or empty texts and passages match nothing, nor do passages of one word; copies of a text are each reported; repeated rows of one pair of ids come out
    once; empty tables give an empty result; other columns are ignored.
    """
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("__text"))
    tests = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).alias("item"), words(F.col(passage)).alias("__p")).where(F.size("__p") > 1)
    length = F.size("__p")
    exact = 2 * F.least(F.lit(run), length) - 3
    altered = F.when(length >= run, F.ceil(length * F.lit(share)) - 1).otherwise(exact)
    least = F.greatest(F.lit(1), F.least(exact, altered))  # terms that a text holding the passage has at least
    terms = tests.select("item", length.alias("__l"), least.cast("int").alias("__least"), F.inline(_terms("__p"))).withColumnRenamed("pos", "ipos")
    small = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda df: df)
    marks = 1 + 2 * (tests.agg(F.max(length)).first()[0] or 0) // 64
    postings = index if index is not None else positional_index(docs, "doc", "__text")
    # Only postings of the passages' terms go on; they are kept, as both the counts and the search need them.
    postings = postings.join(small(terms.select("term").distinct()), "term").persist(StorageLevel.MEMORY_AND_DISK)
    postings.count()  # made once, before several stages ask for them at the same time
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    ranked = terms.join(counts, "term", "left").withColumn("__r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(F.coalesce("n", F.lit(0))), "ipos", "gap")))
    need = F.least(F.lit(NEED), F.col("__least"))
    searching = ranked.where(F.col("__r") > F.col("__least") - need).select("term", "item", (F.col("ipos") * 2 + F.col("gap") - 1).alias("__k"), "ipos", "__l", need.alias("__need"))
    hits = postings.join(small(searching), "term")
    # Texts with too few hits of a passage anywhere go first, by a bare count; only the others are brought together by bands.
    enough = hits.groupBy("doc", "item").agg(F.count("*").alias("__n"), F.first("__need").alias("__least")).where(F.col("__n") >= F.col("__least")).select("doc", "item").persist(StorageLevel.MEMORY_AND_DISK)
    narrow = F.broadcast if enough.count() <= BROADCAST_PAIRS else (lambda df: df)
    hits = hits.join(narrow(enough), ["doc", "item"]).select("doc", "item", "__k", (F.col("pos") - F.col("ipos")).alias("__d"), (2 * F.col("__l")).alias("__w"), "__need")
    # Bands overlap by half, so that offsets that drift over a border still meet.
    bands = F.array(F.floor(F.col("__d") / F.col("__w")) * 2, F.floor((F.col("__d") + F.col("__l2")) / F.col("__w")) * 2 + 1)
    hits = hits.withColumn("__l2", F.expr("__w div 2")).select("doc", "item", "__k", "__need", F.explode(bands).alias("__band"))
    by = hits.groupBy("doc", "item", "__band", "__need")
    if marks <= MARKS_AT_MOST:
        bit = F.expr("shiftleft(1L, cast(__k % 64 as int))")
        found = by.agg(*[F.bit_or(F.when(F.floor(F.col("__k") / 64) == m, bit).otherwise(F.lit(0).cast("long"))).alias(f"__m{m}") for m in range(marks)])
        n_hits = sum((F.bit_count(f"__m{m}") for m in range(1, marks)), F.bit_count("__m0"))
    else:
        found, n_hits = by.agg(F.collect_set("__k").alias("__set")), F.size("__set")
    near = found.where(n_hits >= F.col("__need"))
    pairs = near.select("doc", "item").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    postings.unpersist()
    enough.unpersist()
    rows = docs.join(few(pairs), "doc").join(small(tests), "item").select("doc", "item", "__p", words(F.col("__text")).alias("__t"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, item, p, t in zip(b["doc"], b["item"], b["__p"], b["__t"], strict=True):
                matched, longest = align(list(p), list(t))
                if longest >= min(run, len(p)) or (matched >= share * len(p) and len(p) >= run):
                    out.append((doc, item, matched, longest, matched / len(p)))
            yield pd.DataFrame(out, columns=["doc", "item", "matched", "longest_run", "share"])

    ids = {"doc": docs.schema["doc"].dataType.simpleString(), "item": tests.schema["item"].dataType.simpleString()}
    found = rows.mapInPandas(verify, f"doc {ids['doc']}, item {ids['item']}, matched int, longest_run int, share double").dropDuplicates(["doc", "item"])
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "matched", "share", "longest_run")
