"""Clustering of angles and mixtures: k-means on circles and mixtures of von Mises and normal distributions.

Every pass is one aggregation over all rows whose sums are formed in the tasks; the driver holds clusters * dimensions numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.circular import kappa_from_resultant, log_i0
from driftwell.operators.mining import finite

TWO_PI = 2 * math.pi


def vectors(df: DataFrame, row_id: str, *, angles: str | None = None, numbers: Sequence[str] = (), length: int = 0) -> DataFrame:
    """id, x: one array of the angles and then the numbers of each row; rows with a null or NaN element are left out."""
    parts = [F.get(angles, F.lit(i)).cast("double") for i in range(length)] if angles else []
    parts += [finite(c) for c in numbers]
    known = None
    for p in parts:
        known = p.isNotNull() & ~F.isnan(p) if known is None else known & p.isNotNull() & ~F.isnan(p)
    return df.select(F.col(row_id).alias("id"), F.array(*parts).alias("x"), known.alias("__k")).where("__k").drop("__k")


def _matrix(b: pd.DataFrame) -> np.ndarray:
    return np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, 0))


def total(points: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of an array that is computed for each batch."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for b in batches:
            if len(b):
                v = of(_matrix(b)).ravel()
                acc = v if acc is None else acc + v
        if acc is not None:
            yield pd.DataFrame({"i": np.arange(len(acc), dtype="int32"), "v": acc})

    rows = points.mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + max((r["i"] for r in rows), default=-1))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def labelled(points: DataFrame, of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """id, cluster, weight: of(x) gives the cluster of each row and its probability or distance."""
    kind = points.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                k, w = of(_matrix(b))
                yield pd.DataFrame({"id": b["id"], "cluster": k.astype("int32"), "weight": w})

    return points.mapInPandas(work, f"id {kind}, cluster int, weight double")


def _start(points: DataFrame, k: int, seed: int, angles: int | None = None) -> np.ndarray:
    """k starting rows: spread out among the 50 * k rows with the smallest hashes."""
    some = np.array([r["x"] for r in points.orderBy(F.xxhash64("id", F.lit(seed))).limit(50 * k).select("x").collect()])
    if not len(some):
        raise ValueError("no rows to cluster")
    n = some.shape[1] if angles is None else angles
    scale = np.where(some[:, n:].std(axis=0) > 0, some[:, n:].std(axis=0), 1.0)
    distance = lambda c: _circular2(some[:, :n], c[:, :n])[:, 0] + (((some[:, n:] - c[:, n:]) / scale) ** 2).sum(axis=1)
    rng = np.random.default_rng(seed)
    chosen = [0]
    far = distance(some[:1])
    while len(chosen) < min(k, len(some)):
        p = far / far.sum() if far.sum() > 0 else np.full(len(some), 1 / len(some))
        chosen.append(int(rng.choice(len(some), p=p)))
        far = np.minimum(far, distance(some[chosen[-1:]]))
    return some[chosen]


def _circular2(x: np.ndarray, c: np.ndarray, manhattan: bool = False) -> np.ndarray:
    out = np.zeros((len(x), len(c)))
    for j in range(x.shape[1]):
        d = np.abs(np.mod(x[:, j : j + 1] - c[None, :, j] + math.pi, TWO_PI) - math.pi)
        out += d if manhattan else d * d
    return out


def _best_of_starts(
    points: DataFrame, starts: Sequence[np.ndarray], *, parts: Callable[[np.ndarray], np.ndarray], distance: Callable[[np.ndarray, np.ndarray], np.ndarray],
    centre: Callable[[np.ndarray, np.ndarray], np.ndarray], passes: int, tolerance: Callable[[float], float],
) -> np.ndarray:
    """The centres of least cost among k-means from several starts, all of them moved in the same passes.

    ``parts`` are what is summed over a centre's members, ``centre`` makes new centres of these sums and the number of members.
    """
    live = dict(enumerate(starts))
    before = dict.fromkeys(live, math.inf)
    best: tuple[float, int, np.ndarray] | None = None
    for _ in range(passes):

        def sums(x: np.ndarray, live: dict[int, np.ndarray] = live) -> np.ndarray:
            y = parts(x)
            out = []
            for c in live.values():
                d = distance(x, c)
                near = d.argmin(axis=1)
                columns = [d[np.arange(len(x)), near], np.ones(len(x)), *y.T]
                out.append(np.stack([np.bincount(near, weights=v, minlength=len(c)) for v in columns], axis=1).ravel())
            return np.concatenate(out)

        t = total(points, sums)
        moved, at = {}, 0
        for i, c in live.items():
            width = len(t) // sum(map(len, live.values()))
            part = t[at : at + len(c) * width].reshape(len(c), width)
            at += len(c) * width
            cost = float(part[:, 0].sum())
            if best is None or (cost, i) < best[:2]:
                best = (cost, i, c)
            if abs(before[i] - cost) > tolerance(cost):
                new = centre(part[:, 2:], part[:, 1])
                moved[i] = np.where(np.isfinite(new).all(axis=1)[:, None], new, c)
            before[i] = cost
        live = moved
        if not live:
            break
    return best[2]


def periodic_kmeans(points: DataFrame, k: int, *, starts: int = 10, passes: int = 40, tolerance: float = 0.2, manhattan: bool = False, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """(centres, labels): k-means with wrapped distances; a centre is the direction of its members' mean. The start of least cost wins."""
    points = points.persist(StorageLevel.MEMORY_AND_DISK)

    def centre(t: np.ndarray, n: np.ndarray) -> np.ndarray:
        half = t.shape[1] // 2
        full = np.hypot(t[:, :half], t[:, half:]).sum(axis=1) > 0
        return np.where(full[:, None], np.arctan2(t[:, :half], t[:, half:]), np.nan)

    centres = _best_of_starts(
        points, [_start(points, k, seed + s) for s in range(starts)], parts=lambda x: np.column_stack([np.sin(x), np.cos(x)]), distance=lambda x, c: _circular2(x, c, manhattan),
        centre=centre, passes=passes, tolerance=lambda cost: tolerance,
    )
    points.unpersist()

    def label(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _circular2(x, centres, manhattan)
        return d.argmin(axis=1), np.sqrt(d.min(axis=1))

    return centres, labelled(points, label)


def circle_kmeans(points: DataFrame, k: int, *, seed: int = 1, starts: int = 30, passes: int = 20) -> DataFrame:
    """id, cluster: k-means on the cosines and sines of the angles, the start of least cost of ``starts``."""
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    doubled = lambda x: np.column_stack([np.cos(x), np.sin(x)])

    def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        y = doubled(x)
        return np.maximum((y * y).sum(axis=1)[:, None] - 2 * y @ c.T + (c * c).sum(axis=1), 0.0)

    def centre(t: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(n[:, None] > 0, t / np.maximum(n, 1)[:, None], np.nan)

    first = [doubled(_start(points, k, seed + s)) for s in range(starts)]
    centres = _best_of_starts(points, first, parts=doubled, distance=distance, centre=centre, passes=passes, tolerance=lambda cost: 1e-4 * cost)
    points.unpersist()
    return labelled(points, lambda x: (distance(x, centres).argmin(axis=1), np.sqrt(distance(x, centres).min(axis=1)))).select("id", "cluster")


def whitened_kmeans(df: DataFrame, columns: Sequence[str], k: int, *, row_id: str, seed: int = 1) -> DataFrame:
    """id, cluster: k-means on columns divided by their standard deviations."""
    p = vectors(df, row_id, numbers=columns).select("id", array_to_vector("x").alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True).fit(p).transform(p)
    return KMeans(k=k, seed=seed).fit(scaled).transform(scaled).select("id", F.col("prediction").alias("cluster"))


@dataclass
class Mixture:
    """A mixture: von Mises over the first ``angles`` dimensions, normal over the others, all independent within a cluster."""

    angles: int
    pi: np.ndarray
    mu: np.ndarray
    width: np.ndarray  #: concentration of angles, standard deviation of numbers
    log_likelihood: float = -math.inf
    history: list[float] = field(default_factory=list)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.log(np.maximum(self.pi, 1e-300)), (len(x), 1))
        for j in range(x.shape[1]):
            if j < self.angles:
                out += self.width[:, j] * np.cos(x[:, j : j + 1] - self.mu[None, :, j]) - math.log(TWO_PI) - log_i0(self.width[:, j])
            else:
                out += -0.5 * ((x[:, j : j + 1] - self.mu[None, :, j]) / self.width[:, j]) ** 2 - np.log(self.width[:, j]) - 0.5 * math.log(TWO_PI)
        return out

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ld = self.log_densities(x)
        top = ld.max(axis=1, keepdims=True)
        e = np.exp(ld - top)
        s = e.sum(axis=1, keepdims=True)
        return e / s, (top + np.log(s))[:, 0]

    @property
    def parameters(self) -> int:
        return 2 * self.mu.size + len(self.pi) - 1

    def bic(self, n_dims: int) -> float:
        """-2 LL + 3 k ln(dimensions): not the standard criterion, kept as the tools this follows compute it."""
        return -2 * self.log_likelihood + 3 * len(self.pi) * math.log(max(2, n_dims))


def fit_mixture(
    points: DataFrame, k: int, *, angles: int, hard: bool = False, passes: int = 30, least_passes: int = 3, tied: bool = False, start: np.ndarray | None = None, starts: int = 1, seed: int = 1,
) -> tuple[Mixture, DataFrame]:
    """(mixture, labels) by expectation and maximisation; labels have the likeliest cluster and its probability.

    Concentrations stay in [0.1, 300], deviations in [0.001, 300]. It ends when means move by less than 0.01, widths by less than 0.2 and
    the likelihood by less than 1e-4 of itself, or after ``passes``. ``hard`` gives each row to one cluster, ``tied`` makes a cluster's
    deviations equal (a spherical mixture). Of several ``starts`` the likeliest wins.
    """
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    firsts = [start] if start is not None else [_start(points, k, seed + s, angles) for s in range(starts)]
    model = max((_fitted(points, mu, angles, hard, passes, least_passes, tied) for mu in firsts), key=lambda m: m.log_likelihood)
    points.unpersist()

    def label(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, _ = model.shares(x)
        return z.argmax(axis=1), z.max(axis=1)

    return model, labelled(points, label)


def _fitted(points: DataFrame, mu: np.ndarray, angles: int, hard: bool, passes: int, least_passes: int, tied: bool) -> Mixture:
    k, dims = mu.shape
    width = np.where(np.arange(dims) < angles, 2.0, 1.0) * np.ones((k, dims))
    if angles < dims:
        m = total(points, lambda x: np.r_[len(x), x[:, angles:].sum(axis=0), (x[:, angles:] ** 2).sum(axis=0)])
        spread = np.sqrt(np.maximum(m[1 + dims - angles :] / m[0] - (m[1 : 1 + dims - angles] / m[0]) ** 2, 1e-6))
        width[:, angles:] = np.clip(spread / max(1.0, k ** (1 / max(1, dims))), 1e-3, 300)
    model = Mixture(angles, np.full(k, 1 / k), mu.astype(float), width)
    for step in range(passes):

        def sums(x: np.ndarray, model: Mixture = model) -> np.ndarray:
            z, ll = model.shares(x)
            if hard:
                z = (z == z.max(axis=1, keepdims=True)).astype(float)
                z /= z.sum(axis=1, keepdims=True)
            first = np.column_stack([np.cos(x[:, :angles]), x[:, angles:]])
            second = np.column_stack([np.sin(x[:, :angles]), x[:, angles:] ** 2])
            return np.r_[ll.sum(), z.sum(axis=0), (z.T @ first).ravel(), (z.T @ second).ravel()]

        t = total(points, sums)
        ll, n = float(t[0]), np.maximum(t[1 : 1 + k], 1e-12)
        a, b = t[1 + k : 1 + k + k * dims].reshape(k, dims) / n[:, None], t[1 + k + k * dims :].reshape(k, dims) / n[:, None]
        new_mu, new_width = np.empty_like(a), np.empty_like(a)
        if angles:
            c, s = a[:, :angles], b[:, :angles]
            new_mu[:, :angles] = np.arctan2(s, c)
            new_width[:, :angles] = np.clip(kappa_from_resultant(np.minimum(np.hypot(c, s), 0.999999)), 0.1, 300)
        new_mu[:, angles:] = a[:, angles:]
        deviation = np.sqrt(np.maximum(b[:, angles:] - a[:, angles:] ** 2, 0))
        if tied and angles < dims:
            deviation = np.repeat(np.sqrt(np.mean(deviation**2, axis=1, keepdims=True)), dims - angles, axis=1)
        new_width[:, angles:] = np.clip(deviation, 1e-3, 300)
        turn = new_mu - model.mu
        turn[:, :angles] = np.mod(turn[:, :angles] + math.pi, TWO_PI) - math.pi
        done = step >= least_passes and np.abs(turn).max() < 0.01 and np.abs(new_width - model.width).max() < 0.2 and abs(ll - model.log_likelihood) < 1e-4 * abs(ll)
        model = Mixture(angles, n / n.sum(), new_mu, new_width, ll, [*model.history, ll])
        if done:
            break
    return model


def cluster_summary(labels: DataFrame) -> DataFrame:
    """cluster, n, and least, greatest, mean and spread of the members' weights."""
    w = F.col("weight")
    return labels.groupBy("cluster").agg(F.count("*").alias("n"), F.min(w).alias("least"), F.max(w).alias("greatest"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("spread"))


def von_mises_of(df: DataFrame, labels: Column, phases: str) -> DataFrame:
    """The von Mises fit of every cluster of any labelling: see mining.circular_stats."""
    from driftwell.operators.mining import circular_stats

    return circular_stats(df.withColumn("cluster", labels), ["cluster"], phases)


def mode_list(stats: DataFrame, *, min_kappa: float = 4.0) -> DataFrame:
    """cluster, centre, spread of the clusters whose every dimension is narrower than the concentration asks."""
    g = stats.groupBy("cluster").agg(F.min("kappa").alias("__k"), F.sort_array(F.collect_list(F.struct("k", "mu", "kappa"))).alias("__s"))
    return g.where(F.col("__k") > min_kappa).select("cluster", F.transform("__s", lambda s: s["mu"]).alias("centre"), F.transform("__s", lambda s: F.sqrt(1 / s["kappa"])).alias("spread"))


def contingency(a: DataFrame, b: DataFrame, row_id: str = "id") -> DataFrame:
    """cluster_a, cluster_b, n, best: rows of each pair of clusters, and whether b is a's commonest partner."""
    both = a.select(row_id, F.col("cluster").alias("cluster_a")).join(b.select(row_id, F.col("cluster").alias("cluster_b")), row_id)
    n = both.groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("n"))
    top = n.groupBy(F.col("cluster_a").alias("__a")).agg(F.max_by("cluster_b", F.struct("n", -F.col("cluster_b"))).alias("__b"))
    return n.join(top, F.col("cluster_a") == F.col("__a")).select("cluster_a", "cluster_b", "n", (F.col("cluster_b") == F.col("__b")).alias("best"))


METHODS = ("k_means", "k-means", "k_means_periodic", "EM_VMM", "EM_GMM", "EM_GMM2", "EM_VMM_GMM")


def cluster(df: DataFrame, method: str, k: int, *, row_id: str, angles: str | None = None, length: int = 0, numbers: Sequence[str] = (), **more) -> DataFrame:
    """id, cluster[, weight] by the method's name."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method in ("EM_GMM", "EM_GMM2"):
        p = vectors(df, row_id, numbers=numbers, angles=angles, length=length)
        return fit_mixture(p, k, angles=0, **more)[1]
    p = vectors(df, row_id, angles=angles, length=length, numbers=numbers if method == "EM_VMM_GMM" else ())
    if method in ("k_means", "k-means"):
        return circle_kmeans(p, k, **more)
    if method == "k_means_periodic":
        return periodic_kmeans(p, k, **more)[1]
    return fit_mixture(p, k, angles=length, **more)[1]
