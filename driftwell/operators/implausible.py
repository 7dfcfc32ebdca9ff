"""Readings that their own source cannot plausibly have produced (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.forest import drawn, mixed, scores

#: Readings to each side whose median is the level around a reading: the nearer of both medians counts, so that more than three odd readings in a row are a level of their own.
REACHES = (5, 3)
#: Distance at which a reading is compared with those before and after it: beyond any row of three odd ones.
STEP = 3
#: Lags tried for the seasonal feature.
LAGS = (8, 16, 32)
#: What a piece of a long source sees of its neighbours, in readings: more than any feature looks at.
BESIDE = 64
#: Where the features level, difference, season (in scatters) and run length begin to rise: log(1 + (x / RISE) ** STEEP), at most TOP.
RISE = np.array([5.2, 5.2, 5.2, 6.3])
STEEP, TOP = 12, 4.0
#: How far beyond all that a tree has learnt its splits may fall: about six scatters, and eight equal readings, for a source that knows none.
MARGIN = np.full(4, 1.8)
#: How often each feature is split. Run length alone tells stuck readings, the three others tell spikes together.
WEIGHT = np.array([2.0, 1.0, 1.0, 4.0])
#: Steps of the features, and of the logarithms to base 2 that medians are taken of.
FINE, BINS = 32, 64
#: Rows worked on at once in a task; whole sources, so a little more.
BATCH = 60_000
#: Channels at rest up to which their names are broadcast; beyond that they are joined by shuffling.
BROADCAST_CHANNELS = 10_000
NOTHING = -(1 << 20)


@dataclass(frozen=True)
class Forest:
    """Parameters of the forests."""

    trees: int = 32
    sample: int = 32  #: readings that a tree learns from, drawn by hash of their ids from all of the source
    suspicion: float = 0.5  #: score from which a reading is flagged
    doubt: float = 0.42  #: score from which a reading that the first forest learnt from is kept from the second


def _around(v: np.ndarray, start: np.ndarray, stop: np.ndarray, reach: int) -> np.ndarray:
    """Median of the readings up to ``reach`` away within the source; windows are cut at its ends."""
    n = len(v)
    i = np.arange(n)
    m = np.empty((n, 2 * reach + 1))
    for k, off in enumerate(range(-reach, reach + 1)):
        j = i + off
        ok = (j >= start) & (j < stop)
        # What lies outside counts as very high and very low in turn, which leaves the median of what lies inside.
        m[:, k] = np.where(ok, v[np.clip(j, 0, n - 1)], np.inf if off & 1 else -np.inf)
    m.partition(reach, axis=1)
    return m[:, reach]


@dataclass
class Local:
    """What is known of readings from those around them; rows are sorted by group and time."""

    group: np.ndarray
    first: np.ndarray
    level: np.ndarray
    difference: np.ndarray
    seasons: np.ndarray  # a column a lag
    run: np.ndarray
    head: np.ndarray  # first reading of a run: forests learn one reading of each, what is stuck is no more usual for being long
    bins: list[np.ndarray]  # magnitudes whose medians are asked for, in BINS steps to a doubling
    counted: list[np.ndarray]  # the rows that count in each


def _bin(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.round(np.log2(np.where(x > 0, x, 1.0)) * BINS), NOTHING).astype(np.int64)


def _of_bin(q: np.ndarray) -> np.ndarray:
    return np.where(q > NOTHING, np.exp2(np.clip(q, -1000 * BINS, 1000 * BINS) / BINS), 0.0)


def local(key: np.ndarray, v: np.ndarray) -> Local:
    n = len(v)
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, n])
    start, stop = np.repeat(first, size), np.repeat(first + size, size)
    head = new | np.r_[True, v[1:] != v[:-1]]
    heads = np.flatnonzero(head)
    length = np.diff(np.r_[heads, n])
    run = np.repeat(length, length)
    off, nearer = (np.abs(v - _around(v, start, stop, r)) for r in REACHES)
    i = np.arange(n)
    at = lambda k: v[np.clip(i + k, 0, n - 1)]
    back, ahead = i - STEP >= start, i + STEP < stop
    both = np.where(back & ahead, np.abs(v - (at(-STEP) + at(STEP)) / 2), np.inf)
    difference = np.minimum(both, np.minimum(np.where(back, np.abs(v - at(-STEP)), np.inf), np.where(ahead, np.abs(v - at(STEP)), np.inf)))
    difference = np.where(np.isfinite(difference), difference, off)
    seasons = np.empty((n, len(LAGS)))
    for k, lag in enumerate(LAGS):
        d = np.minimum(np.where(i - lag >= start, np.abs(v - at(-lag)), np.inf), np.where(i + lag < stop, np.abs(v - at(lag)), np.inf))
        seasons[:, k] = np.where(np.isfinite(d), d, off)
    free = run < RISE[3]  # stuck readings would make the scatter small
    inner = free & (i > start) & (i + 1 < stop)
    second = np.abs(at(-1) - 2 * v + at(1))
    every = np.ones(n, dtype=bool)
    return Local(group, first, np.minimum(off, nearer), difference, seasons, run, head, [_bin(off), _bin(second), *map(_bin, seasons.T)], [free, inner, *[every] * len(LAGS)])


def _medians(part: Local, own: np.ndarray) -> np.ndarray:
    """groups x magnitudes: the lower median bin of each, NOTHING where there is none."""
    n_groups = len(part.first)
    out = np.full((n_groups, len(part.bins)), NOTHING, dtype=np.int64)
    for k, (q, counted) in enumerate(zip(part.bins, part.counted, strict=True)):
        rows = np.flatnonzero(counted & own)
        g = part.group[rows]
        order = np.lexsort((q[rows], g))
        size = np.bincount(g, minlength=n_groups)
        has = size > 0
        out[has, k] = q[rows][order][((np.cumsum(size) - size) + (size - 1) // 2)[has]]
    return out


def _usual(medians: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scatter, lag number) of sources. Second differences show the scatter on a steep slope, where the level is the reading itself."""
    size = _of_bin(medians)
    return np.maximum(1.4826 * size[:, 0], 1.4826 / np.sqrt(6) * size[:, 1]), size[:, 2:].argmin(axis=1)


def _features(part: Local, scatter: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Level, difference, season and run length of each reading as whole numbers of FINE steps. A source without scatter has no spikes."""
    s = scatter[part.group]
    season = np.minimum(part.level, part.seasons[np.arange(len(s)), lag[part.group]])  # a reading that its level explains is in season
    x = np.column_stack([np.where((s > 0)[:, None], np.column_stack([part.level, part.difference, season]) / np.where(s > 0, s, 1.0)[:, None], 0.0), part.run])
    return np.round(FINE * np.minimum(TOP, np.log1p(np.minimum(x / RISE, 9.0) ** STEEP))).astype(np.int64)


def _distinct(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, features, number of each row) of the different rows; groups stay in order."""
    w = int(FINE * TOP) + 1
    key = group.astype(np.int64)
    for k in range(x.shape[1]):
        key = key * w + x[:, k]
    u, where = np.unique(key, return_inverse=True)
    cols = []
    for _ in range(x.shape[1]):
        cols.append(u % w)
        u = u // w
    return u, np.column_stack(cols[::-1]), where


def _sampled(where: np.ndarray, n: int, ids: np.ndarray, chance: np.ndarray, may: np.ndarray, trees: int) -> np.ndarray:
    rows = np.flatnonzero(may)
    return np.column_stack([np.bincount(where[rows[drawn(ids[rows], chance[rows], t)]], minlength=n) for t in range(trees)])


def _scored(group: np.ndarray, x: np.ndarray, n_groups: int, learnt: np.ndarray, seeds: np.ndarray, f: Forest) -> np.ndarray:
    """Scores of different rows by two forests: the second learns from the sample less what the first holds doubtful, so that faults don't count as usual."""
    go = lambda rows: scores(x / FINE, group, n_groups, rows, seeds, MARGIN, WEIGHT, sample=f.sample)
    return go(np.where((go(learnt) < f.doubt)[:, None], learnt, 0))


def judge(key: np.ndarray, v: np.ndarray, ids: np.ndarray, f: Forest) -> np.ndarray:
    """Scores of readings sorted by source and time, of whole sources, without impossible values."""
    if not len(v):
        return np.zeros(0)
    part = local(key, v)
    x = _features(part, *_usual(_medians(part, np.ones(len(v), dtype=bool))))
    group, ux, where = _distinct(part.group, x)
    chance = f.sample / np.maximum(np.bincount(part.group[part.head], minlength=len(part.first)), 1)
    learnt = _sampled(where, len(group), ids, chance[part.group], part.head, f.trees)
    return _scored(group, ux, len(part.first), learnt, mixed(key[part.first].astype(np.uint64)), f)[where]


def implausible(
    readings: DataFrame, *, source: list[Column], time: str, value: str, reading_id: str, impossible: Column, channel: Column, forest: Forest | None = None, longest: int = 250_000,
) -> DataFrame:
    """Readings with reading_id, score, flagged: an isolation forest per source on level, difference, season and run length, and rules for limits.

    A reading is flagged if its source's forest gives it a score of ``suspicion`` or more, or if it breaks the explicit rule
    ``impossible`` (a physical limit; its score is 1). Features are in usual scatters of the source and rise steeply about where faults
    begin; the level is taken so that more than three odd readings in a row are a change of level. Channels that rest on a few fixed
    levels, which is told from all readings of the channel, have only the rule.

    Scatter and lag are taken from all readings of a source; its trees learn from ``sample`` readings each, drawn by hash of the id.
    Sources are brought together by one exchange and sorted; whole sources are worked on in numpy batches of bounded size. A source of
    more than ``longest`` readings is cut into pieces of that number, by rank; medians are put together from counts of the
    pieces and the trees learn from the readings drawn in all of them, so that the verdicts are those of the uncut source.

    Defined cases: rows with a null id, null time, or null or NaN value are no readings (an infinite value is impossible where the rule
    says so, else it scores 1 and is not flagged); repeated rows of one id and time count once; readings at one time are ordered by id; a source of readings all alike has
    scatter 0 and no spikes, one of a single reading scores 0; an empty input gives an empty result; other columns are ignored whatever their names.
    """
    f = forest or Forest()
    r = readings.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(time).isNotNull() & F.col(reading_id).isNotNull()).select(
        F.xxhash64(*source, channel).alias("__src"), channel.cast("string").alias("__ch"), F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"),
        F.col(reading_id).cast("long").alias("__id"), F.coalesce(impossible, F.lit(False)).alias("__no"),
    )
    # One row a source: channels at rest have few different values for their number of readings; long sources are cut.
    of = r.groupBy("__src", "__ch").agg(F.count("*").alias("__n"), F.count_if(~F.col("__no")).alias("__ok"), F.approx_count_distinct(F.when(~F.col("__no"), F.col("__v")), 0.1).alias("__d"))
    of = of.persist(StorageLevel.MEMORY_AND_DISK)
    rest = of.groupBy("__ch").agg((F.sum("__d") < 0.5 * F.sum("__ok")).alias("__rests")).where("__rests").select(F.col("__ch").alias("__rch"), "__rests")
    long = of.where(F.col("__n") > longest).select(F.col("__src").alias("__lsrc"))
    some = long.limit(1).count() > 0
    if rest.limit(BROADCAST_CHANNELS + 1).count() <= BROADCAST_CHANNELS:
        rest = F.broadcast(rest)
    r = r.join(rest, F.col("__ch").eqNullSafe(F.col("__rch")), "left").select("__src", "__t", "__v", "__id", "__no", F.coalesce("__rests", F.lit(False)).alias("__rests"))
    short = r.join(long, F.col("__src") == F.col("__lsrc"), "left_anti") if some else r
    short = short.repartition("__src").sortWithinPartitions("__src", "__t", "__id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finish(kept: list[dict[str, np.ndarray]]) -> pd.DataFrame:
            rows = {c: np.concatenate([k[c] for k in kept]) for c in kept[0]}
            src, ids, t = rows["__src"], rows["__id"], rows["__t"]
            once = np.r_[True, (ids[1:] != ids[:-1]) | (src[1:] != src[:-1]) | (t[1:] != t[:-1])]
            src, v, no, rests, ids = src[once], rows["__v"][once], rows["__no"][once], rows["__rests"][once], ids[once]
            fit = ~no & np.isfinite(v)
            score = np.ones(len(v))
            score[fit] = judge(src[fit], v[fit], ids[fit], f)
            return pd.DataFrame({"reading_id": ids, "score": score, "flagged": no | (fit & ~rests & (score >= f.suspicion))})

        kept: list[dict[str, np.ndarray]] = []
        held = 0
        for b in batches:
            rows = {c: b[c].to_numpy() for c in b.columns}
            kept.append(rows)
            held += len(b)
            # The last source may go on in the next batch.
            change = np.flatnonzero(np.diff(rows["__src"])) if held >= BATCH else []
            if len(change):
                end = change[-1] + 1
                yield finish([*kept[:-1], {c: a[:end] for c, a in rows.items()}])
                kept, held = [{c: a[end:] for c, a in rows.items()}], len(b) - end
        if held:
            yield finish(kept)

    done = short.mapInPandas(work, "reading_id long, score double, flagged boolean")
    if some:
        done = done.unionByName(_of_long(r.join(long, F.col("__src") == F.col("__lsrc"), "left_semi"), f, longest))
    return done


def _of_long(r: DataFrame, f: Forest, longest: int) -> DataFrame:
    """Readings of long sources, in pieces by rank that see BESIDE readings beyond their borders."""
    kept = "__src long, __t double, __v double, __id long, __no boolean, __rests boolean"

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        part, last, n = task.partitionId() if task else 0, None, (None, 0)
        for b in batches:
            src, t, ids = b["__src"].to_numpy(), b["__t"].to_numpy(), b["__id"].to_numpy()
            prev = last or (None, None, None)
            same = np.r_[src[0] == prev[0] and t[0] == prev[1] and ids[0] == prev[2], (src[1:] == src[:-1]) & (t[1:] == t[:-1]) & (ids[1:] == ids[:-1])].astype(bool)
            last = (src[-1], t[-1], ids[-1])
            b = b[~same & np.isfinite(b["__v"].to_numpy()) | (~same & b["__no"].to_numpy())]
            src, fit = b["__src"].to_numpy(), ~b["__no"].to_numpy()
            at = np.zeros(len(b), dtype=np.int64)
            for s in np.unique(src):  # few: sources are long
                mine = src == s
                at[mine] = (n[1] if n[0] == s else 0) + np.cumsum(fit[mine])
            if len(b):
                n = (src[-1], at[-1])
                yield b.assign(__part=part, __at=at - 1)

    # Ranks: ranges of the whole order, rows counted within each, and the counts before added.
    ranged = r.select("__src", "__t", "__v", "__id", "__no", "__rests").repartitionByRange("__src", "__t", "__id").sortWithinPartitions("__src", "__t", "__id")
    ranged = ranged.mapInPandas(ranked, kept + ", __part int, __at long").persist(StorageLevel.MEMORY_AND_DISK)
    w = Window.partitionBy("__bsrc").orderBy("__bpart").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(F.col("__src").alias("__bsrc"), F.col("__part").alias("__bpart")).agg((F.max("__at") + 1).alias("__m")).withColumn("__before", F.coalesce(F.sum("__m").over(w), F.lit(0)))
    fit = ranged.where("not __no").join(before, (F.col("__src") == F.col("__bsrc")) & (F.col("__part") == F.col("__bpart"))).withColumn("__at", F.col("__at") + F.col("__before"))
    piece = lambda by: F.floor((F.col("__at") + by) / longest).cast("long")
    fit = fit.select("__src", "__at", "__v", "__id", "__rests", piece(0).alias("__mine"), F.explode(F.array_distinct(F.array(piece(-BESIDE), piece(0), piece(BESIDE)))).alias("__p")).where("__p >= 0")

    def part_of(b: pd.DataFrame) -> tuple[pd.DataFrame, Local, np.ndarray]:
        b = b.sort_values("__at", ignore_index=True)
        return b, local(b["__src"].to_numpy(), b["__v"].to_numpy()), (b["__mine"] == b["__p"]).to_numpy()

    def count(b: pd.DataFrame) -> pd.DataFrame:
        b, part, own = part_of(b)
        out = [pd.DataFrame(np.column_stack([np.full(len(q), k), q, n]), columns=["k", "q", "n"]) for k, (x, c) in enumerate(zip(part.bins, part.counted, strict=True)) for q, n in [np.unique(x[c & own], return_counts=True)]]
        out.append(pd.DataFrame({"k": [-1], "q": [0], "n": [int((part.head & own).sum())]}))
        return pd.concat(out).assign(src=b["__src"].iloc[0])[["src", "k", "q", "n"]]

    bins = fit.groupBy("__src", "__p").applyInPandas(count, "src long, k int, q long, n long").groupBy("src", "k", "q").agg(F.sum("n").alias("n"))
    upto, every = Window.partitionBy("src", "k").orderBy("q"), Window.partitionBy("src", "k")
    middle = bins.withColumn("c", F.sum("n").over(upto)).withColumn("a", F.sum("n").over(every)).where((F.col("c") * 2 >= F.col("a")) & ((F.col("c") - F.col("n")) * 2 < F.col("a")))
    usual = middle.groupBy(F.col("src").alias("__usrc")).agg(
        F.max(F.when(F.col("k") == -1, F.col("a"))).alias("__heads"), *[F.coalesce(F.max(F.when(F.col("k") == k, F.col("q"))), F.lit(NOTHING)).cast("long").alias(f"__q{k}") for k in range(2 + len(LAGS))]
    )
    names = [f"__q{k}" for k in range(2 + len(LAGS))]
    fit = fit.join(usual, F.col("__src") == F.col("__usrc")).drop("__usrc")

    def features(b: pd.DataFrame) -> tuple[pd.DataFrame, Local, np.ndarray, np.ndarray]:
        b, part, own = part_of(b)
        return b, part, own, _features(part, *_usual(b[names].iloc[:1].to_numpy(dtype=np.int64)))

    def learn(b: pd.DataFrame) -> pd.DataFrame:
        b, part, own, x = features(b)
        group, ux, where = _distinct(part.group, x)
        n = _sampled(where, len(group), b["__id"].to_numpy(), np.full(len(b), f.sample / max(1, b["__heads"].iloc[0])), part.head & own, f.trees)
        row, tree = np.nonzero(n)
        return pd.DataFrame({"src": b["__src"].iloc[0], "x": pd.Series(ux[row].tolist(), dtype=object), "tree": tree.astype("int32"), "n": n[row, tree]})

    # At most about trees * sample rows a source; every piece gets those of its source.
    learnt = fit.groupBy("__src", "__p").applyInPandas(learn, "src long, x array<long>, tree int, n long").groupBy("src", "x", "tree").agg(F.sum("n").alias("n"))
    pieces = fit.select(F.col("__src").alias("__psrc"), F.col("__p").alias("p")).distinct()
    learnt = learnt.join(pieces, F.col("src") == F.col("__psrc")).select("src", "p", "x", "tree", "n")

    def score(b: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({"reading_id": [], "score": [], "flagged": []})
        b, part, own, x = features(b)
        known = np.stack(model["x"].to_numpy()) if len(model) else np.zeros((0, x.shape[1]), dtype=np.int64)
        group, ux, where = _distinct(np.zeros(len(known) + len(x), dtype=np.int64), np.concatenate([known, x]))
        rows = np.zeros((len(group), f.trees), dtype=np.int64)
        np.add.at(rows, (where[: len(known)], model["tree"].to_numpy(dtype=np.int64)), model["n"].to_numpy(dtype=np.int64))
        s = _scored(group, ux, 1, rows, mixed(b["__src"].iloc[:1].to_numpy().astype(np.uint64)), f)[where[len(known) :]]
        return pd.DataFrame({"reading_id": b["__id"], "score": s, "flagged": ~b["__rests"].to_numpy() & (s >= f.suspicion)})[own]

    judged = fit.groupBy("__src", "__p").cogroup(learnt.groupBy("src", "p")).applyInPandas(score, "reading_id long, score double, flagged boolean")
    return judged.unionByName(ranged.where("__no").select(F.col("__id").alias("reading_id"), F.lit(1.0).alias("score"), F.lit(True).alias("flagged")))
