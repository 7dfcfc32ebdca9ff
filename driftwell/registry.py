"""What users can add by name: operators, coordinate transforms, reducers, and expressions from settings. Names come from settings, code never does."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[..., DataFrame]] = {}
TRANSFORMS: dict[tuple[str, str], Callable[..., list[Column]]] = {}
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "n": F.count, "rms": lambda v: F.sqrt(F.avg(v * v)), "peak": lambda v: F.max(F.abs(v)),
}


def operator(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Adds a function from DataFrame to DataFrame under its name, for ``apply``; a name is given once."""
    if function.__name__ in OPERATORS:
        raise ValueError(f"operator {function.__name__} is there already")
    OPERATORS[function.__name__] = function
    return function


def apply(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> tuple[DataFrame, list[str]]:
    """(df put through operators by name with their settings, the history of what was done); LookupError for an unknown name."""
    history = []
    for name, settings in steps:
        if name not in OPERATORS:
            raise LookupError(f"no operator {name}")
        df = df.transform(partial(OPERATORS[name], **settings))
        history.append(f"{name}({', '.join(f'{k}={v!r}' for k, v in settings.items())})")
    return df, history


def transform(source: str, target: str) -> Callable[[Callable[..., list[Column]]], Callable[..., list[Column]]]:
    """Adds a coordinate transform: a function from the columns of one system to those of another."""

    def keep(function: Callable[..., list[Column]]) -> Callable[..., list[Column]]:
        TRANSFORMS[(source, target)] = function
        return function

    return keep


@transform("cylindrical", "cartesian")
def _cylindrical(r: Column, phi: Column, z: Column) -> list[Column]:
    return [r * F.cos(phi), r * F.sin(phi), z]


@transform("cartesian", "cylindrical")
def _cartesian(x: Column, y: Column, z: Column) -> list[Column]:
    return [F.hypot(x, y), F.atan2(y, x), z]


def transformed(df: DataFrame, source: str, target: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """df with coordinates in another system; LookupError if no transform leads there."""
    if (source, target) not in TRANSFORMS:
        raise LookupError(f"no transform from {source} to {target}")
    made = TRANSFORMS[(source, target)](*[F.col(c) for c in columns])
    return df.withColumns(dict(zip(names, made, strict=True)))


def reduced(df: DataFrame, keys: Sequence[str], spec: dict[str, tuple[str, str] | tuple[str, str, int]]) -> DataFrame:
    """keys and a column for each (reducer, column[, digits]) of a summary's settings; NaN counts as unknown."""
    out = []
    for name, (reducer, column, *digits) in spec.items():
        if reducer not in REDUCERS:
            raise LookupError(f"no reducer {reducer}")
        v = REDUCERS[reducer](F.nanvl(F.col(column).cast("double"), F.lit(None)))
        out.append((F.round(v, digits[0]) if digits else v).alias(name))
    return df.groupBy(*keys).agg(*out)


#: What an expression of settings may hold: names, numbers, signs, brackets, and these functions.
EXPRESSION = re.compile(r"\s*(?:[A-Za-z_]\w*|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+|\*\*|[-+*/%(),])")
FUNCTIONS = {"abs", "sqrt", "exp", "log", "log10", "sin", "cos", "tan", "atan2", "greatest", "least", "pow"}


def expression(text: str, columns: Sequence[str]) -> Column:
    """A formula of settings on columns, as '-2.5 * signal + abs(offset)'; ValueError for anything but arithmetic on these columns."""
    at, parts = 0, []
    while at < len(text.rstrip()):
        m = EXPRESSION.match(text, at)
        if not m:
            raise ValueError(f"not allowed in an expression: {text[at:]!r}")
        word, at = m[0].strip(), m.end()
        if re.match(r"[A-Za-z_]", word):
            called = re.match(r"\s*\(", text[at:]) is not None
            if word not in (FUNCTIONS if called else columns):
                raise ValueError(f"not a {'function' if called else 'column'}: {word}")
        if word == "**":
            raise ValueError("use pow(a, b)")
        parts.append(word)
    if not parts:
        raise ValueError("empty expression")
    return F.expr(" ".join(parts))
