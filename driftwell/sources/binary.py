"""Binary formats: fixed records, digitiser words, compressed arrays; and a data source for files of records."""

from __future__ import annotations

import bz2
import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def records(spark: SparkSession, path: str, dtype: Sequence[tuple[str, str]]) -> DataFrame:
    """file, i and the fields of files of fixed-length records; names end in .bz2 for packed ones. One row of Arrow batches a file."""
    return records_of(spark.read.format("binaryFile").load(path), dtype)


def records_of(files: DataFrame, dtype: Sequence[tuple[str, str]]) -> DataFrame:
    """The same for a table of path and content."""
    kind = np.dtype(list(dtype))
    spark_type = {"f": "double", "i": "long", "u": "long"}
    schema = ", ".join(["file string", "i long", *(f"{n} {spark_type[np.dtype(t).kind]}" for n, t in dtype)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, content in zip(b["path"], b["content"], strict=True):
                raw = bz2.decompress(content) if f.endswith(".bz2") else content
                a = np.frombuffer(raw, dtype=kind, count=len(raw) // kind.itemsize)
                for s in range(0, len(a), 65536):
                    part = a[s : s + 65536]
                    yield pd.DataFrame({"file": f, "i": np.arange(s, s + len(part)), **{n: part[n].astype("float64" if np.dtype(t).kind == "f" else "int64") for n, t in dtype}})

    return files.select("path", "content").mapInPandas(work, schema)


def joined_records(parts: Sequence[DataFrame]) -> DataFrame:
    """Records of several files beside each other by their number i; the first part's columns win."""
    out = parts[0].drop("file")
    for p in parts[1:]:
        out = out.join(p.select("i", *[c for c in p.columns if c not in out.columns and c != "file"]), "i")
    return out


def digitiser_volts(word: Column, bits: int, full_range: float, *, signed: bool = False) -> Column:
    """Volts of a digitiser's word: unsigned words are offset by half their range."""
    return (word - (0 if signed else 1 << (bits - 1))) * F.lit(full_range / float(1 << bits))


def npz_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, name, values (array of doubles) of the arrays in .npz files; object arrays are left out, nothing in them is run."""
    return npz_arrays_of(spark.read.format("binaryFile").load(path))


def signs_turned(arrays: DataFrame, names: Sequence[str]) -> DataFrame:
    """Arrays with the sign of the named ones turned, for channels that were wired the other way round."""
    turned = F.transform("values", lambda x: -x)
    return arrays.withColumn("values", F.when(F.col("name").isin(list(names)), turned).otherwise(F.col("values")))


def zipped_text_arrays(files: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """file, name, i, value of zip files (path, content) whose members are text arrays, one number a line or apart by spaces; ``names`` maps members to names."""
    renamed = dict(names or {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        lines = [x.split("#")[0] for x in z.read(member).decode("utf-8", "replace").splitlines()]
                        v = np.array([float(x) for line in lines for x in line.split()])
                        yield pd.DataFrame({"file": f, "name": renamed.get(member, member), "i": np.arange(len(v)), "value": v})

    return files.select("path", "content").mapInPandas(work, "file string, name string, i long, value double")


def npz_arrays_of(files: DataFrame) -> DataFrame:
    """The same for a table of path and content."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files:
                        try:
                            rows.append((f, name, np.asarray(z[name], dtype=float).ravel().tolist()))
                        except (ValueError, TypeError):
                            continue
            yield pd.DataFrame(rows, columns=["file", "name", "values"])

    return files.select("path", "content").mapInPandas(work, "file string, name string, values array<double>")


def quantise(values: np.ndarray, *, max_error: float = 3e-6) -> dict:
    """start, quantum and whole numbers of values recorded in equal steps, else of steps fine enough for ``max_error`` of their range; NaN is the greatest whole number.

    The quantum is first sought among the smallest differences and their whole parts, then halved until the error fits.
    """
    v = np.asarray(values, dtype=float)
    ok = np.isfinite(v)
    if not ok.any():
        return {"start": 0.0, "quantum": 1.0, "raw": np.full(len(v), 255, dtype=np.uint8)}
    u = np.unique(v[ok])
    start, span = float(u[0]), float(u[-1] - u[0])
    if span == 0:
        quantum = 1.0
    else:
        d = np.diff(u)
        d = d[d > span * 1e-12]
        quantum = float(d.min()) if len(d) else span
        scale = 10.0 ** np.floor(np.log10(quantum))
        for k in range(1, 10):
            if abs(quantum / scale - round(quantum / scale * k) / k) < 1e-6:
                quantum = scale * round(quantum / scale * k) / k
                break
        limit = max_error * max(span, abs(start), abs(start + span))
        for _ in range(40):
            if np.abs(start + np.rint((u - start) / quantum) * quantum - u).max() <= limit:
                break
            quantum /= 2
    whole = np.rint((np.where(ok, v, start) - start) / quantum)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if whole.max() < np.iinfo(t).max)
    raw = whole.astype(kind)
    raw[~ok] = np.iinfo(kind).max
    return {"start": start, "quantum": quantum, "raw": raw}


def dequantise(start: float, quantum: float, raw: np.ndarray) -> np.ndarray:
    return np.where(raw == np.iinfo(raw.dtype).max, np.nan, start + quantum * raw.astype(float))


#: Stored formulas of compressed signals are read, never run: start + raw * quantum in any order, and running sums.
FORMULA = re.compile(r"(?P<cum>cumsum)?\s*\(?\s*(?P<a>[-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*\+\s*(?P<raw>\w+)\s*\*\s*(?P<b>[-+]?[\d.]+(?:[eE][-+]?\d+)?)")


def read_formula(text: str) -> tuple[float, float, bool]:
    """(start, quantum, whether a running sum) of 'start + raw * quantum'; ValueError for anything else."""
    m = FORMULA.search(text)
    if not m:
        raise ValueError(f"not a formula of a compressed signal: {text[:80]}")
    return float(m["a"]), float(m["b"]), bool(m["cum"])


class RecordFiles(DataSource):
    """``spark.read.format("record_files").option("paths", "a,b").option("fields", "timebase:f8,channel_1:f8")``: one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def _fields(self) -> list[tuple[str, str]]:
        return [tuple(f.split(":")) for f in self.options["fields"].split(",")]

    def schema(self) -> str:
        return ", ".join(["i long", *(f"{n} {'double' if np.dtype(t).kind == 'f' else 'long'}" for n, t in self._fields())])

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options["paths"].split(","), self._fields())


class _RecordReader(DataSourceReader):
    def __init__(self, paths: list[str], fields: list[tuple[str, str]]) -> None:
        self.paths, self.fields = paths, fields

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kind = np.dtype(self.fields)
        with open(partition.value, "rb") as f:
            i = 0
            while chunk := f.read(kind.itemsize * 8192):
                for row in np.frombuffer(chunk, dtype=kind, count=len(chunk) // kind.itemsize):
                    yield (i, *(x.item() for x in row))
                    i += 1
