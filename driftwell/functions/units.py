"""Unit strings taken apart by dynamic programming over tries of prefixes, roots and exponents.

A unit is a factor, an offset and a dimension: a value x of the unit is x * factor + offset of the dimension's own unit. Dimensions are
exponents over (length, time, and one symbol for each electrical or thermal root), which is all that telling units apart needs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Prefixes (symbol or word, factor).
PREFIXES = {
    "p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "h": 1e2, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12,
    "pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "deci": 1e-1, "hecto": 1e2, "kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12,
}
# Roots (spelling: factor, offset, dimension, whether a prefix may stand before it).
ROOTS = {
    "A": (1.0, 0.0, "current", True), "amp": (1.0, 0.0, "current", True), "ampere": (1.0, 0.0, "current", True),
    "V": (1.0, 0.0, "voltage", True), "volt": (1.0, 0.0, "voltage", True),
    "T": (1.0, 0.0, "field", True), "tesla": (1.0, 0.0, "field", True), "G": (1e-4, 0.0, "field", True), "gauss": (1e-4, 0.0, "field", True),
    "Pa": (1.0, 0.0, "pressure", True), "pascal": (1.0, 0.0, "pressure", True), "bar": (1e5, 0.0, "pressure", True),
    "torr": (133.322368, 0.0, "pressure", True), "mmHg": (133.322368, 0.0, "pressure", False),
    "eV": (1.0, 0.0, "energy", True), "electronvolt": (1.0, 0.0, "energy", True),
    "K": (1.0, 0.0, "heat", True), "kelvin": (1.0, 0.0, "heat", True),
    "degC": (1.0, 273.15, "heat", False), "°C": (1.0, 273.15, "heat", False), "℃": (1.0, 273.15, "heat", False), "celsius": (1.0, 273.15, "heat", False),
    "degF": (5.0 / 9.0, 459.67 * 5.0 / 9.0, "heat", False), "°F": (5.0 / 9.0, 459.67 * 5.0 / 9.0, "heat", False), "℉": (5.0 / 9.0, 459.67 * 5.0 / 9.0, "heat", False),
    "fahrenheit": (5.0 / 9.0, 459.67 * 5.0 / 9.0, "heat", False),
    "s": (1.0, 0.0, "time", True), "sec": (1.0, 0.0, "time", True), "second": (1.0, 0.0, "time", True), "sekunde": (1.0, 0.0, "time", True),
    "min": (60.0, 0.0, "time", False), "minute": (60.0, 0.0, "time", False), "h": (3600.0, 0.0, "time", False), "hr": (3600.0, 0.0, "time", False), "hour": (3600.0, 0.0, "time", False),
    "m": (1.0, 0.0, "length", True), "meter": (1.0, 0.0, "length", True), "metre": (1.0, 0.0, "length", True), "cc": (1e-6, 0.0, "length3", False),
    "J": (1.0, 0.0, "joule", True), "joule": (1.0, 0.0, "joule", True), "W": (1.0, 0.0, "power", True), "watt": (1.0, 0.0, "power", True),
    "Hz": (1.0, 0.0, "rate", True), "hertz": (1.0, 0.0, "rate", True), "ohm": (1.0, 0.0, "resistance", True), "g": (1.0, 0.0, "mass", True),
}
# What a quantity is measured in, by its dimension, in order of likelihood; the last number converts into the dimension of the first.
QUANTITIES = {
    "current": {("current", 1): 1.0}, "voltage": {("voltage", 1): 1.0}, "field": {("field", 1): 1.0}, "pressure": {("pressure", 1): 1.0},
    "temperature": {("energy", 1): 1.0, ("heat", 1): 8.617333262e-5}, "wall_temp": {("heat", 1): 1.0}, "density": {("length", -3): 1.0},
    "time": {("time", 1): 1.0}, "energy": {("joule", 1): 1.0}, "power": {("power", 1): 1.0},
}
# Spellings of a power of ten before a unit, and of an exponent after it.
TEN = re.compile(r"(?:10(?:\^|\*\*)([+-]?\d{1,2})|1?[eE]([+-]?\d{1,2}))\s*[*x·×]?\s*|1\s*(?=/)")
EXPONENT = re.compile(r"\s*(?:\^|\*\*)?\s*([+-]?[1-9])(?!\d)|([²³])|(⁻[¹²³])")

#: Costs of the steps of a decomposition; the least total wins.
COST = {"root": 1.0, "prefix": 0.6, "case": 0.35, "plural": 0.1, "exponent": 0.2, "foreign": 8.0}


class Trie:
    """Longest and shorter matches of a table's words at a place of a text."""

    def __init__(self, words: dict) -> None:
        self.top: dict = {}
        for word, value in words.items():
            node = self.top
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = (word, value)

    def at(self, text: str, i: int):
        node = self.top
        while True:
            if "" in node:
                yield i, node[""]
            if i >= len(text) or text[i] not in node:
                return
            node = node[text[i]]
            i += 1


_PREFIX = Trie(PREFIXES)
_ROOT = Trie(ROOTS)
# Words may be written with any case; symbols may not, or only at a cost.
_WORD = Trie({w.lower(): (w, *v) for w, v in ROOTS.items() if len(w) > 2})
_PREFIX_WORD = Trie({w: v for w, v in PREFIXES.items() if len(w) > 2})


@dataclass(frozen=True)
class Unit:
    factor: float
    offset: float
    dimension: tuple
    cost: float


def _one(text: str, i: int):
    """Units of one prefix and root from place i: (end, factor, offset, dimension, power, cost)."""
    low = text.lower()
    starts = [(i, 1.0, 0.0)]
    starts += [(j, f, COST["prefix"]) for j, (_, f) in _PREFIX.at(text, i)]
    starts += [(j, f, COST["prefix"]) for j, (w, f) in _PREFIX_WORD.at(low, i) if not text.startswith(w, i)]
    for j, f, cost in starts:
        found = [(k, w, v, 0.0) for k, (w, v) in _ROOT.at(text, j)]
        found += [(k, v[0], v[1:], COST["case"] * (text[j:k] != v[0])) for k, (_, v) in _WORD.at(low, j) if text[j:k] != v[0]]
        for k, word, (factor, offset, dimension, prefixed), more in found:
            if j > i and not prefixed:
                continue
            ends = [(k, 0.0)]
            if len(word) > 2 and low[k : k + 1] == "s":
                ends.append((k + 1, COST["plural"]))
            if len(word) > 2 and word.islower() and low[k : k + 1] == "n":
                ends.append((k + 1, COST["plural"]))
            for end, plural in ends:
                name, power = ("length", 3) if dimension == "length3" else (dimension, 1)
                yield end, f * factor, offset, name, power, COST["root"] + cost + more + plural


@lru_cache(maxsize=65536)
def parse(text: str, quantity: str) -> Unit | None:
    """The likeliest unit that the whole text spells, or None; decompositions of a dimension foreign to the quantity cost more."""
    text = text.strip()
    if not text:
        return None
    text = re.sub(r"\bdeg\.?\s+(?=[CFcf]\b)", "deg", text)
    scale, i = 1.0, 0
    if m := TEN.match(text):
        power = m[1] or m[2]
        if power is not None and abs(int(power)) <= 30:
            scale = 10.0 ** int(power)
            i = m.end()
        elif power is None:
            i = m.end()
    # states[i]: for each dimension so far, the cheapest (cost, factor, offset, roots) that spells text[:i]; sign -1 after "/" or "per".
    states: dict[int, dict] = {i: {((), 1): (0.0, scale, 0.0, 0)}}
    best: Unit | None = None
    own = QUANTITIES.get(quantity, {})
    for i in range(i, len(text) + 1):
        for (dims, sign), (cost, factor, offset, roots) in list(states.get(i, {}).items()):
            if i == len(text):
                if roots and sign:
                    foreign = 0.0 if dims in {((d, p),) for d, p in own} else COST["foreign"]
                    if best is None or cost + foreign < best.cost:
                        best = Unit(factor, offset, dims, cost + foreign)
                continue

            def reach(j: int, key: tuple, value: tuple) -> None:
                old = states.setdefault(j, {}).get(key)
                if old is None or value[0] < old[0]:
                    states[j][key] = value

            if m := re.compile(r"\s*/\s*|\s*\bper\s+|[\s*·.]+").match(text, i):
                if m.end() > i and not (m[0].isspace() and not roots):
                    reach(m.end(), (dims, -1 if "/" in m[0] or "per" in m[0] else sign), (cost, factor, offset, roots))
            for end, f, o, name, power, more in _one(text, i):
                exponents = [(end, 1, 0.0)]
                if m := EXPONENT.match(text, end):
                    raw = m[1] or {"²": "2", "³": "3", "⁻¹": "-1", "⁻²": "-2", "⁻³": "-3"}[m[2] or m[3]]
                    exponents = [(m.end(), int(raw), COST["exponent"])]
                for j, e, extra in exponents:
                    d = dict(dims)
                    d[name] = d.get(name, 0) + power * e * sign
                    key = tuple(sorted((k, v) for k, v in d.items() if v))
                    simple = not dims and e == 1 and sign == 1
                    reach(j, (key, sign), (cost + more + extra, factor * f ** (e * sign), (o * factor if simple else 0.0), roots + 1))
    return best


def fits(unit: Unit | None, quantity: str) -> float | None:
    """The factor from the unit's dimension into the quantity's own, None where the unit can't measure the quantity."""
    if unit is None:
        return None
    return next((f for (d, p), f in QUANTITIES.get(quantity, {}).items() if unit.dimension == ((d, p),)), None)


@lru_cache(maxsize=65536)
def to_common(text: str, quantity: str, common: str) -> tuple[float, float] | None:
    """(factor, offset) that turn a value in the unit ``text`` into the common unit; None where the text is no unit of the quantity."""
    a, b = parse(text, quantity), parse(common, quantity)
    fa, fb = fits(a, quantity), fits(b, quantity)
    if fa is None or fb is None or b is None or a is None:
        return None
    if a.factor == b.factor and a.offset == b.offset and fa == fb:
        return 1.0, 0.0
    # through the dimension's own unit
    return a.factor * fa / (b.factor * fb), (a.offset * fa - b.offset * fb) / (b.factor * fb)


CLAUSE = re.compile(r"[,;|\n]+")
BRACKETS = "()[]{}'\"` \t"


@lru_cache(maxsize=262144)
def _stated(clause: str, quantity: str) -> str | None:
    tail = clause.strip().rstrip(BRACKETS + ".")
    for start in sorted({m.end() for m in re.finditer(r"^|[\s/=:(\[{'\"]+", tail)}):
        piece, before = tail[start:], tail[:start].rstrip(BRACKETS)
        if not piece or not before or re.search(r"\d\s*[*x]?$", before):
            continue
        if fits(parse(piece, quantity), quantity) is not None:
            return piece
    return None


def mentioned(text: str, quantity: str) -> str | None:
    """The unit that free text states for the quantity, or None.

    A clause states a unit by ending in it after a word or mark: "y/mA", "calibrated to hPa", "DimUnit = ms", "t [µs]". A unit after a
    number is a remark on hardware ("isolated by 500 V"), as is one in the middle of a clause ("amp 2 x 10 V range").
    """
    return next((unit for clause in CLAUSE.split(text) if (unit := _stated(clause, quantity)) is not None), None)
