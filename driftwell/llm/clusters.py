"""Records divided into clusters of mutually similar ones (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from math import lgamma

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field of the feature vector: a numeric one is scaled by ``weight`` over its spread, a string one counts as a token."""

    name: str
    weight: float = 1.0
    log10: bool = False
    text: bool = False


@dataclass(frozen=True)
class Settings:
    """Parameters of the clustering. What is kept on the driver is bounded by parts * (centres + peaks) and the clusters that there are."""

    centres: int = 48  #: centres of k-means in each part to begin with; touching ones are put together, and clusters split or added where these were too few
    pieces: int = 32  #: centres by which a cluster is tried for being several crowds; what comes out is tried again
    rounds: int = 5  #: rounds of parallel seeding, each taking about 2 * centres candidates
    passes: int = 12  #: passes of Lloyd's algorithm at most
    slots: int = 32  #: length of the hashed vectors
    cells: int = 20  #: cells per scaled range of a field, in which crowding is counted
    scales: tuple[int, ...] = (5, 10, 20, 40, 80, 160)  #: the same for the search among records left over; crowds of any extent show at one of them
    peaks: int = 200  #: densest places of a part that a round of that search looks at; rounds go on until one finds nothing
    apart: float = 10.0  #: squared distance of means, in summed covariances, from which crowds are apart
    reach: float = 16.5  #: squared distance, in a cluster's own spreads, up to which a record may belong to it
    least: int = 10  #: a cluster's least number of records
    typical: int = 5  #: most typical members reported of each cluster
    parts_at_once: int = 1000  #: parts beyond this are worked on after them


def _columns(dims: int) -> list[str]:
    return [f"__x{i}" for i in range(dims)]


def vectorise(df: DataFrame, fields: Sequence[Field], slots: int) -> tuple[DataFrame, list[int], int]:
    """Adds __x0, __x1, ..., the used slots of the hashed weighted feature vector, to df; null where a field is null, NaN, or not positive under a logarithm.

    Each field's name (and, for a string, its value) is hashed to a slot and its weighted value is added there. Numeric fields get slots of
    their own: on a clash the next seed is taken. Numbers are scaled by the range between the 1st and 99th percentile over all rows, taken by
    one mergeable sketch. Returns the places of the numeric fields among the used slots, and the number of these, as well.
    """
    numeric = [f for f in fields if not f.text]
    for seed in range(1000):
        taken = [_slot(f"{seed}/{f.name}", slots) for f in numeric]
        if len(set(taken)) == len(taken):
            break
    else:
        raise ValueError("more numeric fields than slots")

    def value(f: Field) -> Column:
        c = F.col(f.name).cast("double")
        ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(ok & (c > 0), F.log10(c)) if f.log10 else F.when(ok, c)

    df = df.select("*", *[value(f).alias(f"__v{i}") for i, f in enumerate(numeric)])
    q = df.agg(*[F.percentile_approx(f"__v{i}", [0.01, 0.99], 1000).alias(f"q{i}") for i in range(len(numeric))]).first() if numeric else None
    parts = []
    for i, f in enumerate(numeric):
        lo, hi = (q[f"q{i}"] or (0.0, 1.0)) if q else (0.0, 1.0)
        spread = (hi - lo) or 1.0
        parts.append((taken[i], (F.col(f"__v{i}") - F.lit(lo)) * F.lit(f.weight / spread)))
    texts = [(F.pmod(F.xxhash64(F.lit(f.name), F.col(f.name)), F.lit(slots)).cast("int"), f.weight) for f in fields if f.text]
    slot = []
    for s in range(slots):
        terms = [e for t, e in parts if t == s] + [F.when(at == s, F.lit(w)).otherwise(F.lit(0.0)) for at, w in texts]
        slot.append(sum(terms[1:], terms[0]) if terms else None)
    used = [s for s in range(slots) if slot[s] is not None]
    known = None
    for i in range(len(numeric)):
        known = F.col(f"__v{i}").isNotNull() if known is None else known & F.col(f"__v{i}").isNotNull()
    for f in fields:
        if f.text:
            known = F.col(f.name).isNotNull() if known is None else known & F.col(f.name).isNotNull()
    out = df.select("*", *[F.when(known, slot[at].cast("double")).alias(f"__x{k}") for k, at in enumerate(used)]).drop(*[f"__v{i}" for i in range(len(numeric))])
    return out, [used.index(t) for t in taken], len(used)


def _slot(name: str, slots: int) -> int:
    h = 1469598103934665603
    for b in name.encode():
        h = ((h ^ b) * 1099511628211) & (2**64 - 1)
    return (h ^ (h >> 29)) % slots


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    d = np.zeros((len(x), len(c)))
    for k in range(x.shape[1]):
        d += (x[:, k : k + 1] - c[None, :, k]) ** 2
    return d


def _by_part(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, rows, matrix) of a batch."""
    if not len(pdf):
        return
    part = pdf["__part"].to_numpy()
    x = np.column_stack([pdf[c].to_numpy() for c in pdf.columns if c.startswith("__x")])
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        yield int(p), rows, x[rows]


def _seed(points: DataFrame, parts: list[int], s: Settings, seed: int, dims: int) -> dict[int, np.ndarray]:
    """k-means||: rounds of oversampled candidates by squared distance, then a weighted choice of centres among the candidates.

    A round is one pass: each record has an exponential key over its squared distance, tasks keep their smallest keys, and the smallest
    of all are a draw without replacement by that distance.
    """
    rng = np.random.default_rng(seed)
    cols = _columns(dims)
    first = points.groupBy("__part").agg(F.min_by(F.array(*cols), F.xxhash64("__id")).alias("x")).collect()
    cand = {r["__part"]: np.array([r["x"]]) for r in first}
    wanted = 2 * s.centres
    fields = "part int, key double, " + ", ".join(f"{c} double" for c in cols)

    def draw(batches, now, salt):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for p, rows, x in _by_part(b):
                d = _sq(x, now[p]).min(axis=1)
                u = np.mod(b["__u"].to_numpy()[rows] * 1_000_003.0 + salt * 0.6180339887498949, 1.0)
                with np.errstate(divide="ignore"):
                    key = np.where(d > 0, -np.log(np.maximum(u, 1e-300)) / np.where(d > 0, d, 1.0), np.inf)
                if p in best:
                    key, x = np.concatenate([best[p][0], key]), np.concatenate([best[p][1], x])
                keep = np.argsort(key, kind="stable")[:wanted]
                best[p] = key[keep], x[keep]
        for p, (key, x) in best.items():
            ok = np.isfinite(key)
            yield pd.DataFrame({"part": np.full(ok.sum(), p, "int32"), "key": key[ok]} | {c: x[ok, i] for i, c in enumerate(cols)})

    for r in range(s.rounds):
        now = dict(cand)
        drawn = points.mapInPandas(lambda it, now=now, r=r: draw(it, now, r + 1), fields)
        more = drawn.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("key", *cols))).where(F.col("r") <= wanted).collect()
        for p in parts:
            new = [[x[c] for c in cols] for x in more if x["part"] == p]
            if new:
                cand[p] = np.unique(np.concatenate([cand[p], np.array(new)]), axis=0)
    now = dict(cand)

    def weigh(batches):
        total = {p: np.zeros(len(c)) for p, c in now.items()}
        for b in batches:
            for p, _, x in _by_part(b):
                total[p] += np.bincount(_sq(x, now[p]).argmin(axis=1), minlength=len(now[p]))
        for p, t in total.items():
            i = np.flatnonzero(t)
            yield pd.DataFrame({"part": np.full(len(i), p, "int32"), "i": i.astype("int32"), "w": t[i]})

    weights = points.mapInPandas(weigh, "part int, i int, w double").groupBy("part", "i").agg(F.sum("w").alias("w")).collect()
    out = {}
    for p in parts:
        c, w = cand[p], np.zeros(len(cand[p]))
        for x in weights:
            if x["part"] == p:
                w[x["i"]] = x["w"]
        chosen = [int(w.argmax())]
        far = _sq(c, c[chosen]).min(axis=1)
        while len(chosen) < min(s.centres, len(c), 1 + int(w.sum()) // max(1, s.least // 2)):  # a part holds no more clusters than its records over ``least``
            chance = np.sqrt(w) * far  # the root keeps one huge crowd from taking all centres
            if chance.sum() <= 0:
                break
            chosen.append(int(rng.choice(len(c), p=chance / chance.sum())))
            far = np.minimum(far, _sq(c, c[chosen[-1:]])[:, 0])
        out[p] = c[chosen]
    return out


def _lloyd(points: DataFrame, centres: dict[int, np.ndarray], passes: int) -> dict[int, np.ndarray]:
    for _ in range(passes):
        now = dict(centres)

        def sums(batches, now=now):
            total = {p: np.zeros((len(c), c.shape[1] + 1)) for p, c in now.items()}
            for b in batches:
                for p, _, x in _by_part(b):
                    near = _sq(x, now[p]).argmin(axis=1)
                    t = total[p]
                    t[:, 0] += np.bincount(near, minlength=len(t))
                    for k in range(x.shape[1]):
                        t[:, k + 1] += np.bincount(near, weights=x[:, k], minlength=len(t))
            for p, t in total.items():
                i = np.flatnonzero(t[:, 0])
                if len(i):
                    yield pd.DataFrame({"part": np.full(len(i), p, "int32"), "i": i.astype("int32"), "s": [list(v) for v in t[i]]})

        width = len(next(iter(now.values()))[0]) + 1
        rows = points.mapInPandas(sums, "part int, i int, s array<double>").groupBy("part", "i").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)]).collect()
        moved = 0.0
        new = {p: c.copy() for p, c in now.items()}
        for r in rows:
            mean = np.array([r[f"s{k}"] for k in range(1, width)]) / r["s0"]
            moved = max(moved, float(np.abs(mean - now[r["part"]][r["i"]]).max()))
            new[r["part"]][r["i"]] = mean
        centres = new
        if moved < 1e-3:
            break
    return centres


def _joined(sums: dict[int, np.ndarray], apart: float) -> dict[int, int]:
    """For each centre the number of its cluster, from the sums (n, sum, sum of squares) of its records.

    Slices of one crowd lie closer than their own extents: for cuts through any even or bell-shaped crowd the squared distance of the
    means, in the summed covariances, stays below 6. Crowds set apart have far more, so pairs below ``apart`` are joined, closest first,
    and the sums of what is joined are compared again.
    """
    dims = next(len(v) for v in sums.values())
    dims = int((np.sqrt(1 + 4 * (dims - 1)) - 1) / 2 + 0.5)
    live = dict(sums)
    up = {k: k for k in sums}

    def shape(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = v[1 : 1 + dims] / v[0]
        return mean, v[1 + dims :].reshape(dims, dims) / v[0] - np.outer(mean, mean)

    pool = sum(shape(v)[1] * v[0] for v in live.values()) / sum(v[0] for v in live.values())
    blend = lambda v: (shape(v)[1] * v[0] + pool * (dims + 1)) / (v[0] + dims + 1) + np.eye(dims) * 1e-9
    shapes = {k: (shape(v)[0], blend(v)) for k, v in live.items()}
    gap = lambda i, j: float((d := shapes[i][0] - shapes[j][0]) @ np.linalg.solve(shapes[i][1] + shapes[j][1], d))
    pairs = {(i, j): gap(i, j) for i in live for j in live if i < j}
    while pairs:
        (i, j), least = min(pairs.items(), key=lambda x: (x[1], x[0]))
        if least >= apart:
            break
        live[i] = live[i] + live.pop(j)
        shapes[i] = (shape(live[i])[0], blend(live[i]))
        up = {k: i if r == j else r for k, r in up.items()}
        pairs = {(x, y): v for (x, y), v in pairs.items() if not {x, y} & {i, j}}
        pairs |= {(min(i, k), max(i, k)): gap(i, k) for k in live if k != i}
    return up


def _merged(sums: dict[int, np.ndarray], apart: float) -> dict[int, np.ndarray]:
    """The sums of the clusters that centres, or clusters so far, belong to."""
    out: dict[int, np.ndarray] = {}
    for k, whose in (_joined(sums, apart) if sums else {}).items():
        out[whose] = out.get(whose, 0) + sums[k]
    return out


def _sums(points: DataFrame, assign, dims: int, parts: Sequence[int]) -> dict[int, dict[int, np.ndarray]]:
    """n, sum and sum of squares of the vectors of each cluster under assign(part, x) -> cluster number or -1; one pass, summed in the tasks first."""

    def members(p: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        g = assign(p, x)
        for k in np.unique(g[g >= 0]):
            yield int(k), x[g == k]

    return _summed(points, members, dims, parts)


def _summed(points: DataFrame, members, dims: int, parts: Sequence[int]) -> dict[int, dict[int, np.ndarray]]:
    """The same for members(part, x) -> (cluster number, its vectors), which may overlap."""

    def sums(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for p, _, x in _by_part(b):
                for k, y in members(p, x):
                    total[(p, k)] = total.get((p, k), 0) + np.r_[len(y), y.sum(axis=0), (y.T @ y).ravel()]
        if total:
            yield pd.DataFrame([(p, k, list(map(float, v))) for (p, k), v in total.items()], columns=["part", "k", "s"])

    width = 1 + dims + dims * dims
    rows = points.mapInPandas(sums, "part int, k int, s array<double>").groupBy("part", "k").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect()
    out: dict[int, dict[int, np.ndarray]] = {p: {} for p in parts}
    for r in rows:
        out[r["part"]][r["k"]] = np.array([r[f"s{i}"] for i in range(width)])
    return out


def _near(shapes: dict[int, dict[int, tuple]], bound: float):
    """members(part, x): the vectors within the squared distance of each shape, in its own spreads."""
    ready = {p: [(k, mean, np.linalg.inv(cov + np.eye(len(mean)) * 1e-9)) for k, (_, mean, cov) in sorted(g.items())] for p, g in shapes.items()}

    def members(p: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k, mean, inverse in ready.get(p, []):
            y = x - mean
            inside = ((y @ inverse) * y).sum(axis=1) <= bound
            if inside.any():
                yield k, x[inside]

    return members


def _shape(v: np.ndarray, dims: int) -> tuple:
    """(n, mean, covariance) from sums."""
    n, mean = v[0], v[1 : 1 + dims] / v[0]
    return n, mean, v[1 + dims :].reshape(dims, dims) / n - np.outer(mean, mean)


def _membership(shapes: dict[int, dict[int, tuple]], reach: float, *, plain: bool = False):
    """assign(part, x): the nearest centroid, in each cluster's own spreads, or (``plain``) by distance among the clusters that reach so far; -1 beyond reach. Distances come with it."""
    ready = {}
    for p, groups in shapes.items():
        ready[p] = [(k, mean, np.linalg.inv(cov + np.eye(len(mean)) * 1e-9)) for k, (n, mean, cov) in sorted(groups.items())]

    def assign(p: int, x: np.ndarray, distances: bool = False):
        best, who = np.full(len(x), np.inf), np.full(len(x), -1, dtype=np.int64)
        for k, mean, inverse in ready.get(p, []):
            y = x - mean
            d = ((y @ inverse) * y).sum(axis=1)
            d = np.where(d <= reach, (y * y).sum(axis=1) if plain else d, np.inf)
            nearer = d < best
            best, who = np.where(nearer, d, best), np.where(nearer, k, who)
        return (who, best) if distances else who

    return assign


def cluster_records(df: DataFrame, *, record_id: str, part: Column, fields: Sequence[Field], settings: Settings | None = None, seed: int = 7) -> DataFrame:
    """record_id, part, cluster, distance: the cluster of each record, -1 for records of none; distance is that from the cluster's centroid.

    1. Records become hashed weighted vectors (see vectorise).
    2. Records that stand where no crowd is - their cell and its neighbours along each axis hold hardly more than a thin scatter would put
       there - take no part in seeding and centring, so that strays draw no centres.
    3. Centres are seeded in parallel by oversampling (k-means||) and moved by Lloyd's passes, every pass one aggregation summed in the
       tasks. All parts are worked on at once. Centres whose records are slices of one crowd are joined.
    4. The number of centres is fitted: each cluster is tried by centres of its own and split where it holds several crowds, and the
       records beyond reach of all are searched for crowds that stand out from what lies around them, whatever the size of the part; both
       until nothing is found (see _split and _left_over). Clusters of fewer than ``least`` records are none.
    5. Lloyd's passes run again from the fitted centres over all records. Every record goes to its nearest centroid; those that lie
       beyond ``reach`` of a cluster's own spreads are none of its records, so that strays stay out and move no centroid.

    No record is sampled away: each pass runs over all rows. The driver holds parts * centres vectors, whatever the number of rows; parts
    are worked on ``parts_at_once`` at a time.

    Defined cases: a null, NaN or infinite field (or one that is not positive where its logarithm is taken), or a null part, makes a record of no cluster
    (-1, distance null); repeated ids are records of their own; equal records share a cluster; an empty input gives an empty
    result; other columns are ignored.
    """
    s = settings or Settings()
    base = df.select(F.col(record_id).alias("__id"), part.cast("int").alias("__part"), *[F.col(f.name) for f in fields])
    vectors, axes, dims = vectorise(base, fields, s.slots)
    cols = _columns(dims)
    known = F.col("__part").isNotNull() & F.col("__x0").isNotNull()
    whole = vectors.where(known).select("__id", "__part", *cols).persist(StorageLevel.MEMORY_AND_DISK)
    none = vectors.where(~known).select(F.col("__id").cast("long").alias("record_id"), F.col("__part").alias("part"), F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("distance"))
    last = None
    while True:
        rest = whole if last is None else whole.where(F.col("__part") > last)
        counts = {r["__part"]: r["n"] for r in rest.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").limit(s.parts_at_once).collect()}
        if counts:
            some = whole if last is None and len(counts) < s.parts_at_once else whole.where(F.col("__part").between(min(counts), max(counts)))
            none = none.unionByName(_labelled(some, axes, dims, counts, s, seed))
            last = max(counts)
        if len(counts) < s.parts_at_once:
            return none


def _labelled(whole: DataFrame, axes: list[int], dims: int, counts: dict[int, int], s: Settings, seed: int) -> DataFrame:
    cols, parts = _columns(dims), sorted(counts)
    points = _crowded(whole, axes, counts, s).withColumn("__u", F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)).persist(StorageLevel.MEMORY_AND_DISK)
    present = [r["__part"] for r in points.select("__part").distinct().collect()]
    big = lambda g: {k: _shape(v, dims) for k, v in g.items() if v[0] >= s.least}
    shapes: dict[int, dict[int, tuple]] = {p: {} for p in parts}
    if present:
        centres = _lloyd(points, _seed(points, present, s, seed, dims), s.passes)
        near = lambda p, x: _sq(x, centres[p]).argmin(axis=1) if p in centres else np.full(len(x), -1)
        shapes = {p: big(_merged(g, s.apart)) for p, g in _sums(points, near, dims, parts).items()}
        for _ in range(2):
            shapes = {p: big(_merged(g, s.apart)) for p, g in _sums(whole, _membership(shapes, s.reach), dims, parts).items()}
    points.unpersist()
    while True:
        shapes = _split(whole, shapes, dims, s, seed)
        before = sum(map(len, shapes.values()))
        shapes = _left_over(whole, axes, shapes, dims, s)
        if sum(map(len, shapes.values())) == before:
            break
    shrunk = _below(s.reach, dims + 2) / _below(s.reach, dims)  # what cutting at ``reach`` takes from a crowd's spreads
    whole_spread = lambda g: {k: (n, m, c / shrunk) for k, (n, m, c) in big(g).items()}
    for _ in range(s.passes):
        moved = {p: whole_spread(g) for p, g in _sums(whole, _membership(shapes, s.reach, plain=True), dims, parts).items()}
        far = max((float(np.abs(m - shapes[p][k][1]).max()) for p, g in moved.items() for k, (_, m, _) in g.items()), default=0.0)
        same, shapes = all(moved[p].keys() == shapes[p].keys() for p in parts), moved
        if same and far < 1e-3:
            break
    number = {p: {k: i for i, k in enumerate(sorted(g, key=lambda k: (-g[k][0], k)))} for p, g in shapes.items()}
    assign = _membership(shapes, s.reach, plain=True)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cluster, distance = np.full(len(b), -1, "int32"), np.full(len(b), np.nan)
            for p, rows, x in _by_part(b):
                who, d = assign(p, x, True)
                cluster[rows] = [number[p].get(int(k), -1) for k in who]
                distance[rows] = np.where(who >= 0, np.sqrt(d), np.nan)
            yield pd.DataFrame({"record_id": b["__id"], "part": b["__part"], "cluster": cluster, "distance": distance})

    found = whole.select("__id", "__part", *cols).mapInPandas(label, "record_id long, part int, cluster int, distance double")
    return found.withColumn("distance", F.nanvl("distance", F.lit(None)))


def _crowded(whole: DataFrame, axes: list[int], counts: dict[int, int], s: Settings) -> DataFrame:
    """The records that stand in crowds: their cell and the cells one step along each numeric axis hold enough of the part's records."""
    if not axes:
        return whole
    at = F.array(*[F.floor(F.col(f"__x{a}") * s.cells).cast("int") for a in axes])
    cell = whole.select("__part", at.alias("__c"))
    n = cell.groupBy("__part", "__c").agg(F.count("*").alias("__n"))
    step = [F.transform(F.array(*[F.col("__c")[i] + (d if i == j else 0) for i in range(len(axes))]), lambda x: x.cast("int")) for j in range(len(axes)) for d in (-1, 1)]
    around = n.select("__part", F.explode(F.array(F.col("__c"), *step)).alias("__c"), "__n").groupBy("__part", "__c").agg(F.sum("__n").alias("__near"))
    total = F.create_map(*[F.lit(v) for p, c in counts.items() for v in (p, c)])
    # A quarter of what the whole part would put there if it were scattered evenly, and never fewer than four records.
    even = F.element_at(total, F.col("__part")) * 0.25 * (len(step) + 1) / float(s.cells ** len(axes))
    kept = around.where(F.col("__near") >= F.greatest(F.lit(4.0), even)).select("__part", "__c")
    return whole.withColumn("__c", at).join(kept, ["__part", "__c"], "left_semi").drop("__c")


def _split(whole: DataFrame, shapes: dict[int, dict[int, tuple]], dims: int, s: Settings, seed: int) -> dict[int, dict[int, tuple]]:
    """shapes with the clusters that hold several crowds replaced by these.

    Each cluster is clustered by itself like a part, all of them at once; clumped ones by more and more pieces until they come apart. A round takes up only parts that the last one gave more clusters,
    so it ends.
    """
    cols = _columns(dims)
    wide = ", ".join(f"{c} double" for c in cols)
    shapes = {p: dict(g) for p, g in shapes.items()}
    searched = sorted(shapes)
    while searched:
        taken = _membership(shapes, s.reach)
        names = [(p, k) for p in searched for k, v in sorted(shapes[p].items()) if v[0] >= 2 * s.least]
        if not names:
            break
        place = {p: {} for p in searched}
        for i, (p, k) in enumerate(names):
            place[p][k] = i

        frames = [(v[1], np.linalg.inv(np.linalg.cholesky(v[2] + np.eye(dims) * 1e-9)), 0.5 if v[0] < 1000 else 0.25) for p, k in names for v in [shapes[p][k]]]

        def inside(batches, taken=taken, place=place, frames=frames):
            for b in batches:
                for p, rows, x in _by_part(b):
                    at = np.array([place[p].get(int(k), -1) for k in taken(p, x)], dtype="int32")
                    cell = np.zeros(len(x), dtype="int64")
                    for i in np.unique(at[at >= 0]):
                        mean, inverse, h = frames[i]
                        for y in np.floor((x[at == i] - mean) @ inverse.T / h).astype("int64").T:
                            cell[at == i] = cell[at == i] * 1_000_003 + y
                    yield b.iloc[rows[at >= 0]][["__id", *cols]].assign(__part=at[at >= 0], __c=cell[at >= 0])

        own = whole.where(F.col("__part").isin(searched)).select("__id", "__part", *cols).mapInPandas(inside, f"__id long, __part int, {wide}, __c long")
        own = own.withColumn("__u", F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)).persist(StorageLevel.MEMORY_AND_DISK)
        # Pairs of different vectors in one cell: clearly more than in one crowd of the cluster's own mean and spreads tell that it is clumped.
        pairs = own.select("__part", "__c", *cols).distinct().groupBy("__part", "__c").agg(F.count("*").cast("double").alias("n")).groupBy("__part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("m")).collect()
        clumped = {r["__part"]: r["m"] > 3 * r["n"] * (r["n"] - 1) * (frames[r["__part"]][2] / np.sqrt(4 * np.pi)) ** dims for r in pairs}
        present, pieces = sorted(clumped), s.pieces
        got: dict[int, dict[int, np.ndarray]] = {}
        while present:
            some = own.where(F.col("__part").isin(present))
            centres = _lloyd(some, _seed(some, present, replace(s, centres=pieces, rounds=2), seed, dims), 5)
            for i, g in _sums(some, lambda p, x, centres=centres: _sq(x, centres[p]).argmin(axis=1), dims, present).items():
                got[i] = _merged(g, s.apart)
            # A clumped cluster that does not come apart holds more crowds than pieces.
            pieces *= 4
            present = [i for i in present if clumped[i] and sum(v[0] >= s.least for v in got[i].values()) < 2 and shapes[names[i][0]][names[i][1]][0] * 4 > pieces * (s.least // 2)]
        own.unpersist()
        tried = {p: dict(shapes[p]) for p in searched}
        for i, g in got.items():
            p, k = names[i]
            crowds = [_shape(v, dims) for v in g.values() if v[0] >= s.least]
            if len(crowds) > 1:
                del tried[p][k]
                tried[p] |= {max(tried[p] | shapes[p]) + 1 + j: c for j, c in enumerate(crowds)}
        searched = [p for p in searched if len(tried[p]) > len(shapes[p])]
        tried = {p: tried[p] for p in searched}
        for _ in range(2 if searched else 0):
            sums = _sums(whole.where(F.col("__part").isin(searched)), _membership(tried, s.reach), dims, searched)
            tried = {p: {k: _shape(v, dims) for k, v in _merged(g, s.apart).items() if v[0] >= s.least} for p, g in sums.items()}
        searched = [p for p in searched if len(tried[p]) > len(shapes[p])]
        shapes |= {p: tried[p] for p in searched}
    return shapes


def _peaks(left: DataFrame, axes: list[int], dims: int, s: Settings) -> dict[int, list[tuple[float, np.ndarray]]]:
    """(cell width, place) of the cells that hold far more records than the wider cells around them would put there, most striking first, by part.

    Cells of several widths are counted, each with its neighbours along each axis, against the rest of blocks of four cells a side. Of
    cells that touch only the most striking one is kept.
    """
    d = len(axes)
    step = lambda c: F.array(c, *[F.transform(F.array(*[F.get(c, F.lit(i)) + (by if i == j else 0) for i in range(d)]), lambda x: x.cast("int")) for j in range(d) for by in (-1, 1)])
    grids = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.array(*[F.floor(F.col(f"__x{a}") * m).cast("int") for a in axes]).alias("c")) for m in s.scales]))
    cols = _columns(dims)
    cells = left.select("__part", *cols, grids.alias("g")).select("__part", "g.m", "g.c", *cols).groupBy("__part", "m", "c")
    n = cells.agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("x"))
    near = n.select("__part", "m", F.explode(step(F.col("c"))).alias("c"), "n").groupBy("__part", "m", "c").agg(F.sum("n").alias("near"))
    block = F.transform("c", lambda x: F.floor(x / 4).cast("int"))
    wide = n.select("__part", "m", block.alias("b"), "n").groupBy("__part", "m", "b").agg(F.sum("n").alias("n"))
    wide = wide.select("__part", "m", F.explode(step(F.col("b"))).alias("b"), "n").groupBy("__part", "m", "b").agg(F.sum("n").alias("wide"))
    seen = n.join(near, ["__part", "m", "c"]).withColumn("b", block).join(wide, ["__part", "m", "b"])
    # Neighbours may lie outside the blocks, so the rest may come out below 0.
    usual = F.greatest(F.col("wide") - F.col("near"), F.lit(0)) / float(4**d - 1)
    over = (F.col("near") - usual) / F.sqrt(usual + 1)
    rows = seen.where((F.col("near") >= 0.6 * s.least) & (F.col("near") > usual + 5 * F.sqrt(usual) + 4)).withColumn("over", over)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("over"), "m", "c"))).where(F.col("r") <= 20 * s.peaks)
    out: dict[int, list[tuple[float, np.ndarray]]] = {}
    for r in rows.select("__part", "m", "x", "r").orderBy("__part", "r").collect():
        kept, width, x = out.setdefault(r["__part"], []), 1.0 / r["m"], np.array(r["x"])
        if len(kept) < s.peaks and all(np.abs(x - y)[axes].max() > 2 * min(w, width) for w, y in kept):
            kept.append((width, x))
    return out


def _ball(dims: int) -> float:
    """Volume of the unit ball."""
    return float(np.pi ** (dims / 2) / np.exp(lgamma(dims / 2 + 1)))


def _below(c: float, dims: int) -> float:
    """The part of a normal crowd of so many dimensions whose squared distance is at most c."""
    t = term = np.exp(dims / 2 * np.log(c / 2) - c / 2 - lgamma(dims / 2 + 1))
    for k in range(1, 200):
        term *= c / 2 / (dims / 2 + k)
        t += term
    return float(min(t, 1.0))


def _chance(n: float, usual: float) -> float:
    """The chance of n or more where ``usual`` are usual, of independent events."""
    return 1.0 if n <= usual else _below(2 * usual, 2 * int(n)) if usual > 0 else 0.0


def _left_over(whole: DataFrame, axes: list[int], shapes: dict[int, dict[int, tuple]], dims: int, s: Settings) -> dict[int, dict[int, tuple]]:
    """shapes with the crowds that are found among the records beyond reach of all of them.

    A round looks at the places where such records are densest. Mean and spreads are taken over the records near each, freed of the
    cut at a core's border, each place by itself. A crowd is new if it has ``least`` records of no cluster, which stand at least three times as
    densely as all records of the part, those of clusters too, stand in the shell around it, by more than chance, and as densely as records of
    no cluster stand on the whole, so that the scatter itself is no crowd; of places that come to lie in
    one crowd the most striking one counts.
    Where clusters hold most of the records within reach there is none, so the thin tails around a large cluster are no crowd.
    """
    if not axes:
        return shapes
    shapes = {p: dict(g) for p, g in shapes.items()}
    cols = _columns(dims)
    core, shell = 2.1 * dims, 2.25 * s.reach
    shrunk = _below(core, dims + 2) / _below(core, dims)
    around = (shell ** (dims / 2) - s.reach ** (dims / 2)) or 1.0
    searched = sorted(shapes)
    while searched:
        taken = _membership(shapes, s.reach)

        def beyond(batches, taken=taken):
            for b in batches:
                for p, rows, x in _by_part(b):
                    yield b.iloc[rows[taken(p, x) < 0]][["__part", *cols]]

        left = whole.where(F.col("__part").isin(searched)).select("__part", *cols).mapInPandas(beyond, "__part int, " + ", ".join(f"{c} double" for c in cols)).persist(StorageLevel.MEMORY_AND_DISK)
        new: dict[int, dict[int, tuple]] = {}
        for p, places in _peaks(left, axes, dims, s).items():
            start = lambda w: np.diag([(0.6 * w) ** 2 if i in axes else 0.25 for i in range(dims)])
            new[p] = {k: (0, x, start(w)) for k, (w, x) in enumerate(places)}
        for _ in range(5):
            got = _summed(left, _near(new, core), dims, list(new)) if new else {}
            new = {p: {k: (n, m, c / shrunk) for k, v in g.items() if v[0] >= 0.6 * s.least for n, m, c in [_shape(v, dims)]} for p, g in got.items()}
        # How densely such records stand in all: over their own range or that of all records, whichever is wider.
        ends = [F.percentile_approx(c, [0.01, 0.99], 1000).alias(c) for c in cols]
        scattered = {r["__part"]: r["n"] / max(1.0, float(np.prod([b - a for a, b in (r[cols[i]] for i in axes)]))) for r in left.groupBy("__part").agg(F.count("*").alias("n"), *ends).collect()} if len(axes) == dims and any(new.values()) else {}
        left.unpersist()
        rings = _rings(whole, new, taken, (core, s.reach, shell)) if any(new.values()) else {}
        searched = []
        for p, g in new.items():
            found = []
            for k, (_, mean, cov) in sorted(g.items()):
                inner, within, held, ring = rings.get((p, k), (0, 0, 0, 0))
                usual = ring / around
                chance = _chance(within, usual * s.reach ** (dims / 2))
                even = scattered.get(p, 0.0) * _ball(dims) * np.sqrt(max(np.linalg.det(cov), 0.0))
                if within >= max(s.least, held) and inner > 3 * max(usual, even) * core ** (dims / 2) and chance < 1e-6:
                    found.append((chance, -within, k, mean, cov))
            kept: list[tuple] = []
            for _, n, _, mean, cov in sorted(found, key=lambda x: x[:3]):
                gap = [d @ np.linalg.solve(cov + c + np.eye(dims) * 1e-9, d) for _, m, c in kept for d in [mean - m]]
                if min(gap, default=s.apart) >= s.apart:
                    kept.append((-n, mean, cov))
            for shape in kept:
                shapes[p][max(shapes[p], default=-1) + 1] = shape
                searched = sorted({*searched, p})
    return shapes


def _rings(whole: DataFrame, shapes: dict[int, dict[int, tuple]], taken, bounds: tuple[float, float, float]) -> dict[tuple[int, int], tuple]:
    """For each shape the records of its part, of no cluster, within the first and second bound of squared distance; those of clusters within the second; all between the second and third."""
    ready = {p: [(k, mean, np.linalg.inv(cov + np.eye(len(mean)) * 1e-9)) for k, (_, mean, cov) in g.items()] for p, g in shapes.items()}

    def count(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for p, _, x in _by_part(b):
                free = taken(p, x) < 0
                for k, mean, inverse in ready.get(p, []):
                    y = x - mean
                    d = np.einsum("ij,jk,ik->i", y, inverse, y)
                    n = [(free & (d <= bounds[0])).sum(), (free & (d <= bounds[1])).sum(), (~free & (d <= bounds[1])).sum(), ((d > bounds[1]) & (d <= bounds[2])).sum()]
                    total[(p, k)] = total.get((p, k), 0) + np.array(n)
        if total:
            yield pd.DataFrame([(p, k, *map(int, v)) for (p, k), v in total.items()], columns=["part", "k", "a", "b", "c", "d"])

    rows = whole.where(F.col("__part").isin(list(ready))).mapInPandas(count, "part int, k int, a long, b long, c long, d long").groupBy("part", "k").agg(*[F.sum(c) for c in "abcd"]).collect()
    return {(r[0], r[1]): tuple(r[2:]) for r in rows}


def describe_clusters(labelled: DataFrame, typical: int = 5) -> DataFrame:
    """part, cluster, size, typical: each cluster's size and its members nearest the centroid, nearest first.

    The nearest members are found by an aggregation that keeps only ``typical`` rows a task and cluster on its way, so a huge cluster is never brought together.
    """
    rows = labelled.where("cluster >= 0")
    sizes = rows.groupBy("part", "cluster").agg(F.count("*").alias("size"))
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64("record_id"), F.lit(64)))
    order = ["distance", "record_id"]
    some = spread.withColumn("__r", F.row_number().over(Window.partitionBy("part", "cluster", "__salt").orderBy(*order))).where(F.col("__r") <= typical)
    best = some.withColumn("__r", F.row_number().over(Window.partitionBy("part", "cluster").orderBy(*order))).where(F.col("__r") <= typical)
    members = best.groupBy("part", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "record_id"))), lambda x: x["record_id"]).alias("typical"))
    return sizes.join(members, ["part", "cluster"])


def successive_members(labelled: DataFrame, *, stripe: int = 65_536) -> DataFrame:
    """part, cluster, a, b: members of one cluster that follow each other in the order of ids.

    Ids are cut into stripes that are sorted by themselves; the last member of a stripe is linked to the first of the next through one row a stripe.
    """
    rows = labelled.where("cluster >= 0").select("part", "cluster", "record_id", F.expr(f"record_id div {int(stripe)}").alias("__s"))
    inner = rows.select("part", "cluster", F.lag("record_id").over(Window.partitionBy("part", "cluster", "__s").orderBy("record_id")).alias("a"), F.col("record_id").alias("b")).where("a is not null")
    ends = rows.groupBy("part", "cluster", "__s").agg(F.min("record_id").alias("b"), F.max("record_id").alias("__last"))
    bridge = ends.select("part", "cluster", F.lag("__last").over(Window.partitionBy("part", "cluster").orderBy("__s")).alias("a"), "b").where("a is not null")
    return inner.unionByName(bridge)
