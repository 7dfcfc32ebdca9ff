"""Plain functions on numbers and names, used on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence


def next_nice_number(n: int) -> int:
    """The smallest of 2**p * {16, 18, 20, 24, 27} / 16 that is at least n, for a cheap transform; small n as they are up to 2."""
    if n <= 2:
        return max(1, n)
    best = 1 << math.ceil(math.log2(n))
    p = 0
    while (1 << p) <= best:
        for m in (16, 18, 20, 24, 27):
            k = (1 << p) * m
            if k % 16 == 0 and k // 16 >= n:
                best = min(best, k // 16)
        p += 1
    return best


def prime_factors(n: int) -> list[int]:
    """Prime factors in ascending order; [] for numbers below 2."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1 if p == 2 else 2
    return [*out, n] if n > 1 else out


def transform_cost(n: int) -> float:
    """Relative cost of a transform of length n: n times the sum of its prime factors."""
    return float(n * sum(prime_factors(n))) if n > 1 else 1.0


def nice_length(n: int, try_more: int = 50) -> int:
    """The cheapest transform length from n to n + try_more."""
    return min(range(n, n + try_more + 1), key=lambda k: (transform_cost(k), k))


def split_names(names: Sequence[str], min_length: int = 3) -> tuple[str, list[str], str]:
    """(prefix, middles, suffix) of names: what they share at both ends is taken out, as long as ``min_length`` characters of each stay."""
    names = list(names)
    if not names:
        return "", [], ""
    shortest = min(map(len, names))
    pre = 0
    while pre < shortest - min_length and len({n[pre] for n in names}) == 1:
        pre += 1
    post = 0
    while post < shortest - min_length - pre and len({n[-1 - post] for n in names}) == 1:
        post += 1
    cut = [n[pre : len(n) - post] for n in names]
    return names[0][:pre], cut, names[0][len(names[0]) - post :]


def subdivide(points: Sequence[float], overlap: float, low: float, high: float) -> list[tuple[float, float]]:
    """Bands around sorted points: each reaches half way to its neighbours and ``overlap`` of that beyond, within [low, high]."""
    p = sorted(points)
    out = []
    for i, x in enumerate(p):
        left = (p[i - 1] + x) / 2 if i else low
        right = (x + p[i + 1]) / 2 if i + 1 < len(p) else high
        out.append((max(low, left - overlap * (x - left)), min(high, right + overlap * (right - x))))
    return out


def compact_numbers(numbers: Sequence[int]) -> str:
    """Sorted numbers with runs as first-last: 1-3,7."""
    out: list[str] = []
    ns = sorted(set(numbers))
    i = 0
    while i < len(ns):
        j = i
        while j + 1 < len(ns) and ns[j + 1] == ns[j] + 1:
            j += 1
        out.append(str(ns[i]) if i == j else f"{ns[i]}-{ns[j]}")
        i = j + 1
    return ",".join(out)


def last_where(n: int, holds) -> int:
    """The last index below n for which a predicate that is true up to some index holds, by bisection; -1 for none."""
    lo, hi = -1, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid)
    return lo
