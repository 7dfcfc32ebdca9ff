"""Isolation forests over many small groups at once, in numpy.

Every group (a source) has a forest of its own, but all trees of all groups of a batch grow level by level in the same array
operations, so that a group of some hundreds of rows costs no Python loop. Equal rows are held once, with the number of them.
"""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix of integers: the forests' only source of chance, so that results depend on the rows alone."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from integers."""
    return (mixed(x) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows: what a leaf of n rows still stands for."""
    n = np.asarray(n, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def drawn(ids: np.ndarray, chance: np.ndarray, tree: int) -> np.ndarray:
    """Whether a tree learns from a row: each row with its own chance, by its id alone, wherever the row is worked on."""
    return unit(mixed(ids) ^ np.uint64(tree * 7919 + 1)) < chance


def scores(x: np.ndarray, group: np.ndarray, n_groups: int, learnt: np.ndarray, seeds: np.ndarray, margin: np.ndarray, weight: np.ndarray, *, sample: int) -> np.ndarray:
    """The anomaly score, 2 ** (-mean path / usual path), of each row in the forest of its group.

    x: rows x fields. group: ascending group numbers. learnt: rows x trees, how many times each tree learns the row. seeds: one integer a
    group. margin: how far above a node's range a split of the field may fall, so that values beyond all that a forest has learnt from
    are cut off by some split (needed where the learnt rows are all alike in a field). weight: how often a field is split. sample: the
    number of rows that a tree is meant to learn from; it sets the depth. A group whose trees learn no more than a row scores 0.
    """
    n, trees = learnt.shape
    if n == 0:
        return np.zeros(0)
    depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
    nodes = (1 << (depth + 1)) - 1
    bounds = np.cumsum(weight)[:-1] / np.sum(weight)
    row, t = np.nonzero(learnt)
    tree, place, copies = group[row] * trees + t, np.zeros(len(row), dtype=np.int64), learnt[row, t]
    field = np.zeros(n_groups * trees * nodes, dtype=np.int8)
    cut = np.full(len(field), np.inf)
    inner = np.zeros(len(field), dtype=bool)
    held = np.zeros(len(field), dtype=np.int64)
    tree_seed = mixed(np.repeat(seeds.astype(np.uint64), trees) ^ mixed(np.tile(np.arange(trees, dtype=np.uint64), n_groups) + np.uint64(17)))
    for level in range(depth + 1):
        if not len(row):
            break
        node = tree * nodes + place
        order = np.argsort(node, kind="stable")
        node, row, tree, place, copies = node[order], row[order], tree[order], place[order], copies[order]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[first, len(node)])
        here = node[first]
        held[here] = np.add.reduceat(copies, first)
        if level == depth:
            break
        salt = tree_seed[tree[first]] ^ (place[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        f = np.searchsorted(bounds, unit(salt), side="right")
        v = x[row, np.repeat(f, size)]
        low, high = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first) + margin[f]
        field[here], cut[here], inner[here] = f, low + unit(salt + np.uint64(1)) * (high - low), held[here] > 1
        stay = np.repeat(inner[here], size)
        side = v >= np.repeat(cut[here], size)
        row, tree, place, copies = row[stay], tree[stay], (2 * place + 1 + side)[stay], copies[stay]
    total = np.zeros(n)
    for t in range(trees):
        root = (group.astype(np.int64) * trees + t) * nodes
        at, steps = np.zeros(n, dtype=np.int64), np.zeros(n)
        going = np.flatnonzero(inner[root])
        while len(going):
            node = root[going] + at[going]
            at[going] = 2 * at[going] + 1 + (x[going, field[node]] >= cut[node])
            steps[going] += 1
            going = going[inner[root[going] + at[going]]]
        total += steps + usual_path(held[root + at])
    usual = usual_path(held[np.arange(n_groups * trees) * nodes]).reshape(n_groups, trees).mean(axis=1)[group]
    return np.where(usual > 0, np.exp2(-(total / trees) / np.maximum(usual, 1e-9)), 0.0)
