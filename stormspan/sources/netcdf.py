"""NetCDF classic files (CDF-1 and CDF-2): daily series and gridded fields read from, and series written to, any file system of the cluster.

Spark reads whole files; each is parsed on an executor with NumPy, so no library and no local path is needed. NetCDF-4
files are read by the netCDF4 library where the executors have it.
"""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormspan.sources.io import SERIES

#: External types of the format by number (fixed values).
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
FIELDS = "member string, variable string, units string, yyyymmdd string, lat double, lon double, value double"


class Variable:
    def __init__(self, dims: tuple[str, ...], attributes: dict, values: np.ndarray):
        self.dims, self.attributes, self.values = dims, attributes, values

    def unpacked(self) -> np.ndarray:
        """Values as doubles; missing ones are NaN, packed ones scaled."""
        raw = self.values.astype(float)
        for name in ("_FillValue", "missing_value"):
            if name in self.attributes:
                raw = np.where(self.values == self.attributes[name], np.nan, raw)
        return raw * float(self.attributes.get("scale_factor", 1)) + float(self.attributes.get("add_offset", 0))


class _Header:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4

    def number(self, kind: str = ">i") -> int:
        out = struct.unpack_from(kind, self.data, self.at)[0]
        self.at += struct.calcsize(kind)
        return out

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return out

    def name(self) -> str:
        return self.take(self.number()).decode()

    def entries(self, tag: int) -> int:
        found, n = self.number(), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"a list of kind {tag} is expected, {found} is there")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.entries(ATTRIBUTE)):
            name, kind, n = self.name(), self.number(), self.number()
            raw = self.take(n * np.dtype(TYPES[kind]).itemsize)
            values = np.frombuffer(raw, TYPES[kind])
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else values[0] if n == 1 else values
        return out


def parse(data: bytes) -> dict[str, Variable]:
    """The variables of a classic file by name."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("no NetCDF classic file")
    head = _Header(data)
    records = head.number()
    dims = [(head.name(), head.number()) for _ in range(head.entries(DIMENSION))]
    head.attributes()
    found = []
    for _ in range(head.entries(VARIABLE)):
        name = head.name()
        own = [head.number() for _ in range(head.number())]
        attributes, kind, size = head.attributes(), head.number(), head.number()
        found.append((name, own, attributes, np.dtype(TYPES[kind]), size, head.number(">i" if data[3] == 1 else ">q")))
    grows = [bool(own) and dims[own[0]][1] == 0 for _, own, *_ in found]
    stride = sum(f[4] for f, g in zip(found, grows, strict=True) if g)
    out = {}
    for (name, own, attributes, kind, _, begin), record in zip(found, grows, strict=True):
        shape = [dims[d][1] for d in own]
        if record:
            each = int(np.prod(shape[1:], dtype=int))
            step = each * kind.itemsize if sum(grows) == 1 else stride
            values = np.ndarray((records, each), kind, data, begin, (step, kind.itemsize)).reshape([records, *shape[1:]])
        else:
            values = np.frombuffer(data, kind, int(np.prod(shape, dtype=int)), begin).reshape(shape)
        out[name] = Variable(tuple(dims[d][0] for d in own), attributes, values)
    return out


def dates(values: np.ndarray, units: str, calendar: str = "standard") -> list[str]:
    """yyyymmdd of times such as `days since 1980-01-01`, in the calendar of the file."""
    m = re.match(r"(day|hour|minute|second)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ](\d+):(\d+))?", units)
    if not m:
        raise ValueError(f"units of time that aren't known: {units!r}")
    share = {"day": 1.0, "hour": 24.0, "minute": 1440.0, "second": 86400.0}[m[1]]
    first = (int(m[5] or 0) * 60 + int(m[6] or 0)) / 1440
    days = np.floor(np.asarray(values, float) / share + first + 1e-9).astype(int).tolist()
    year, month, day = int(m[2]), int(m[3]), int(m[4])
    if calendar == "360_day":
        total = [year * 360 + (month - 1) * 30 + day - 1 + k for k in days]
        return [f"{t // 360:04d}{t % 360 // 30 + 1:02d}{t % 30 + 1:02d}" for t in total]
    if calendar in ("365_day", "noleap"):
        start = year * 365 + (datetime.date(2001, month, day) - datetime.date(2001, 1, 1)).days
        whole = [(t // 365, datetime.date(2001, 1, 1) + datetime.timedelta(t % 365)) for t in (start + k for k in days)]
        return [f"{y:04d}{d:%m%d}" for y, d in whole]
    if calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"a calendar that isn't known: {calendar!r}")
    return [f"{d.year:04d}{d:%m%d}" for d in (datetime.date(year, month, day) + datetime.timedelta(k) for k in days)]


def main_variable(variables: dict[str, Variable], wanted: str | None) -> str:
    """The wanted variable, or the only one over time that is no bounds."""
    if wanted is not None:
        return wanted
    found = [n for n, v in variables.items() if v.dims[:1] == ("time",) and n != "time" and not n.endswith(("bnds", "bounds"))]
    if len(found) != 1:
        raise ValueError(f"a file holds the variables {found}; name one")
    return found[0]


def _batches(rows_of: Callable[[str, dict[str, Variable]], dict[str, object]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns = rows_of(path, parse(content.as_buffer().to_pybytes()))
                whole = pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
                yield from whole.to_batches(max_chunksize=100_000)

    return run


def _labels(variables: dict[str, Variable]) -> list[str]:
    time = variables["time"]
    return dates(time.values, time.attributes["units"], time.attributes.get("calendar", "standard"))


def _files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")


def read_series(spark: SparkSession, paths: Sequence[str], pattern: str = r"([^/_]+)_([^/_]+)\.nc$", variable: str | None = None) -> DataFrame:
    """Daily series, a file for each member and region; the pattern's two groups find these in a file's path."""

    def rows_of(path: str, variables: dict[str, Variable]) -> dict[str, object]:
        ensemble, region = re.search(pattern, unquote(path)).groups()
        name, labels = main_variable(variables, variable), _labels(variables)
        n = len(labels)
        return {"ensemble": [ensemble] * n, "region": [region] * n, "variable": [name] * n, "idx": np.arange(n), "yyyymmdd": labels, "year": [int(x[:4]) for x in labels], "month": [int(x[4:6]) for x in labels], "value": variables[name].unpacked().reshape(n)}

    kinds = {"idx": pa.int32(), "year": pa.int32(), "month": pa.int32(), "value": pa.float64()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in (x.split()[0] for x in SERIES.split(", "))])
    return _files(spark, paths).mapInArrow(_batches(rows_of, schema), SERIES)


def read_fields(spark: SparkSession, paths: Sequence[str], pattern: str = r"([^/]+)\.nc$", variable: str | None = None) -> DataFrame:
    """Gridded fields (time, lat, lon) in long form; the pattern's group finds the member in a file's path."""

    def rows_of(path: str, variables: dict[str, Variable]) -> dict[str, object]:
        name, labels = main_variable(variables, variable), _labels(variables)
        lat, lon = (next(variables[n].unpacked() for n in names if n in variables) for names in (("lat", "latitude"), ("lon", "longitude")))
        each, n = len(lat) * len(lon), len(labels) * len(lat) * len(lon)
        own = variables[name]
        return {"member": [re.search(pattern, unquote(path))[1]] * n, "variable": [name] * n, "units": [own.attributes.get("units")] * n, "yyyymmdd": np.repeat(np.array(labels, object), each), "lat": np.tile(np.repeat(lat, len(lon)), len(labels)), "lon": np.tile(lon, len(labels) * len(lat)), "value": own.unpacked().reshape(n)}

    kinds = {"lat": pa.float64(), "lon": pa.float64(), "value": pa.float64()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in (x.split()[0] for x in FIELDS.split(", "))])
    return _files(spark, paths).mapInArrow(_batches(rows_of, schema), FIELDS)


def encode(dims: dict[str, int], variables: dict[str, Variable]) -> bytes:
    """A CDF-1 file; a dimension of size 0 grows, and only variables that begin with it have records."""

    def padded(raw: bytes) -> bytes:
        return raw + b"\0" * (-len(raw) % 4)

    def named(name: str) -> bytes:
        return struct.pack(">i", len(name.encode())) + padded(name.encode())

    def attributes(own: dict) -> bytes:
        parts = [struct.pack(">ii", ATTRIBUTE if own else 0, len(own))]
        for name, value in own.items():
            kind, n, raw = (2, len(value.encode()), value.encode()) if isinstance(value, str) else (6, 1, struct.pack(">d", value))
            parts += [named(name), struct.pack(">ii", kind, n), padded(raw)]
        return b"".join(parts)

    numbers = {np.dtype(t): k for k, t in TYPES.items()}
    data = {n: v.values.astype(v.values.dtype.newbyteorder(">")) for n, v in variables.items()}
    grows = {n: bool(v.dims) and dims[v.dims[0]] == 0 for n, v in variables.items()}
    records = max((len(data[n]) for n in variables if grows[n]), default=0)
    size = {n: len(padded(data[n][:1].tobytes() if grows[n] else data[n].tobytes())) if len(data[n]) else 0 for n in variables}

    def header(begin: dict[str, int]) -> bytes:
        parts = [b"CDF\x01", struct.pack(">iii", records, DIMENSION, len(dims)), *(named(n) + struct.pack(">i", k) for n, k in dims.items()), struct.pack(">ii", 0, 0), struct.pack(">ii", VARIABLE, len(variables))]
        for n, v in variables.items():
            parts += [named(n), struct.pack(f">{len(v.dims) + 1}i", len(v.dims), *(list(dims).index(d) for d in v.dims)), attributes(v.attributes), struct.pack(">iii", numbers[data[n].dtype], size[n], begin[n])]
        return b"".join(parts)

    at, begin = len(header(dict.fromkeys(variables, 0))), {}
    for n in [n for n in variables if not grows[n]] + [n for n in variables if grows[n]]:
        begin[n] = at
        at += size[n]
    fixed = b"".join(padded(data[n].tobytes()) for n in variables if not grows[n])
    growing = [n for n in variables if grows[n]]
    rows = b"".join((padded(data[n][k : k + 1].tobytes()) if len(growing) > 1 else data[n][k : k + 1].tobytes()) for k in range(records) for n in growing)
    return header(begin) + fixed + rows


def write_series(series: DataFrame, path: str, units: str = "days since 1970-01-01") -> None:
    """A file for each ensemble and region, in folders ensemble=.../region=...; the dates are those of yyyymmdd."""
    first = datetime.date.fromisoformat(units.split("since ")[1][:10])

    def one(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("idx")
        time = np.array([(datetime.date(int(x[:4]), int(x[4:6]), int(x[6:])) - first).days for x in days["yyyymmdd"]], ">i4")
        made = encode({"time": 0}, {"time": Variable(("time",), {"units": units, "calendar": "standard"}, time), str(key[2]): Variable(("time",), {"_FillValue": -1e30}, days["value"].fillna(-1e30).to_numpy(">f8"))})
        return pd.DataFrame({"ensemble": [key[0]], "region": [key[1]], "content": [made]})

    files = series.groupBy("ensemble", "region", "variable").applyInPandas(one, "ensemble string, region string, content binary")
    files.select("ensemble", "region", F.col("content").cast("string").alias("content")).write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("ensemble", "region").text(path)
