"""Layered INI configuration: sections ``Type:Name``, typed keys, and their use as tables."""

from __future__ import annotations

import configparser
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Types that a section may have.
TYPES = ("Device", "Diagnostic", "Acquisition", "CoordTransform")


class Config:
    """Settings from several files; later ones override earlier ones, and each state before a read can be gone back to."""

    def __init__(self, *files: str | Path) -> None:
        self.parser = self._new()
        self.history: list[str] = []
        for f in files:
            self.read(f)

    @staticmethod
    def _new() -> configparser.RawConfigParser:
        return configparser.RawConfigParser(delimiters=("=",), strict=False, interpolation=None)

    def read(self, file: str | Path) -> None:
        self.read_text(Path(file).read_text())

    def read_text(self, text: str) -> None:
        self.history.append(self.dump())
        self.parser.read_string(text)
        for s in self.parser.sections():
            if ":" in s and (s.count(":") != 1 or s.split(":")[0] not in TYPES):
                raise ValueError(f"section {s}: a section is Type:Name with a type of {TYPES}")

    def undo(self) -> None:
        text = self.history.pop() if self.history else ""
        self.parser = self._new()
        self.parser.read_string(text)

    def dump(self) -> str:
        return "".join(f"[{s}]\n" + "".join(f"{k} = {v}\n" for k, v in self.parser.items(s)) for s in self.parser.sections())

    def diff(self, other: Config) -> list[tuple[str, str, str | None, str | None]]:
        """(section, key, here, there) of all that differs."""
        a, b = self._flat(), other._flat()
        return [(s, k, a.get((s, k)), b.get((s, k))) for s, k in sorted(a.keys() | b.keys()) if a.get((s, k)) != b.get((s, k))]

    def _flat(self) -> dict[tuple[str, str], str]:
        return {(s, k): v for s in self.parser.sections() for k, v in self.parser.items(s)}

    def section(self, kind: str, name: str) -> dict[str, object]:
        """The settings of a section, typed; LookupError names the ten nearest names."""
        key = f"{kind}:{name}"
        if not self.parser.has_section(key):
            names = [s.split(":", 1)[1] for s in self.parser.sections() if s.startswith(f"{kind}:")]
            raise LookupError(f"no {kind} {name}; nearest: {', '.join(nearest_names(name, names))}")
        return {k: self.typed(k, v) for k, v in self.parser.items(key)}

    def typed(self, key: str, value: str) -> object:
        kind = self.parser.get("variabletypes", key, fallback="str") if self.parser.has_section("variabletypes") else "str"
        if kind == "float":
            return float(value)
        if kind == "int":
            return int(value)
        if kind in ("bool", "boolean"):
            return value.strip().lower() in ("1", "true", "yes", "on")
        return value

    def table(self, spark: SparkSession) -> DataFrame:
        """type, name, key, value: all settings as rows; a configuration is small."""
        rows = [(*(s.split(":", 1) if ":" in s else ("", s)), k, v) for (s, k), v in self._flat().items()]
        return spark.createDataFrame(rows, "type string, name string, key string, value string")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest_names(name: str, names: Sequence[str], n: int = 10) -> list[str]:
    return sorted(names, key=lambda x: (edit_distance(name.lower(), x.lower()), x))[:n]


def valid_for(versions: Sequence[tuple[int | None, int | None, dict]], shot: int) -> dict | None:
    """The settings whose range of shots (from, to; None is open) holds a shot: the first one in the order given."""
    return next((v for a, b, v in versions if (a is None or shot >= a) and (b is None or shot <= b)), None)
