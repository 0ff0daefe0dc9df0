"""Sources and sinks: series, gridded fields, configuration, regions; NetCDF where its library is installed."""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stormspan.functions.calendar import normal_label, season_months

# Workers receive the code of this package with each job that runs user functions, so a cluster needs no separate installation.
cloudpickle.register_pickle_by_value(sys.modules["stormspan"])

SERIES = "ensemble string, region string, variable string, idx int, yyyymmdd string, year int, month int, value double"


def read_series(spark: SparkSession, path: str, ensembles: Sequence[str] | None = None, regions: Sequence[str] | None = None, season: tuple[int, int] | None = None, schema: str = SERIES) -> DataFrame:
    """Series from Parquet; members, regions and months are filtered in the scan. The schema is given, so that names of folders such as 0000 stay strings."""
    out = spark.read.schema(schema).parquet(path)
    for column, wanted in (("ensemble", ensembles), ("region", regions)):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    return out.where(F.col("month").isin(*season_months(*season))) if season else out


def missing_members(series: DataFrame, ensembles: Sequence[str], regions: Sequence[str] = ()) -> DataFrame:
    """Expected members (and regions) without a row."""
    spark = series.sparkSession
    if regions:
        want, keys = spark.createDataFrame([(e, r) for e in ensembles for r in regions], "ensemble string, region string"), ["ensemble", "region"]
    else:
        want, keys = spark.createDataFrame([(e,) for e in ensembles], "ensemble string"), ["ensemble"]
    return want.join(series.select(*keys).distinct(), keys, "left_anti")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir, or else the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/scratch/{uuid.uuid4().hex}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_series(series: DataFrame, path: str) -> None:
    series.write.mode("overwrite").partitionBy("ensemble", "region").parquet(path)


def write_csv(table: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = table.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_fields(fields: DataFrame, path: str) -> None:
    """Fields as Parquet by member; only the members in `fields` are replaced, so a run can be taken up again."""
    fields.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("member").parquet(path)


def year_span(name: str) -> tuple[int, int] | None:
    """First and last year in a file name's dates (yyyymmdd, yyyymm or yyyy, the last two numbers of at least four digits), if there are any."""
    found = re.findall(r"\d{4,}", name.rsplit("/", 1)[-1])
    return (int(found[-2][:4]), int(found[-1][:4])) if len(found) >= 2 else (int(found[-1][:4]), int(found[-1][:4])) if found else None


def files_of_years(paths: Sequence[str], first: int, last: int) -> list[str]:
    """Paths whose years meet the span; names without years are kept."""
    return sorted(p for p in paths if (span := year_span(p)) is None or (span[0] <= last and span[1] >= first))


def read_fields(spark: SparkSession, paths: Sequence[str], days: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, variable: str | None = None) -> DataFrame:
    """Fields of several Parquet tables by column name; with days (member, yyyymmdd) only these.

    prepare is applied to each table as it is read. Tables with a column `variable` must hold one variable in all; if they
    hold several, one must be named.
    """
    tables = [spark.read.parquet(p) for p in paths]
    if variable is not None:
        tables = [t.where(F.col("variable") == variable) for t in tables]
    elif any("variable" in t.columns for t in tables):
        found = sorted({r[0] for t in tables if "variable" in t.columns for r in t.select("variable").distinct().limit(2).collect()})
        if len(found) > 1:
            raise ValueError(f"there are several variables, such as {found}; name one")
    tables = [prepare(t) for t in tables] if prepare else tables
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out if days is None else out.join(days.select("member", "yyyymmdd").distinct(), ["member", "yyyymmdd"], "left_semi")


def plain_yaml(text: str) -> dict:
    """YAML by PyYAML where installed, else the part of it that the configuration uses: nested maps by indentation, and lists."""
    try:
        import yaml
    except ImportError:
        pass
    else:
        return yaml.safe_load(text) or {}

    def scalar(x: str) -> object:
        x = x.strip()
        if x[:1] in "'\"" and x[-1:] == x[:1] and len(x) > 1:
            return x[1:-1]
        if x.startswith("["):
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        if re.fullmatch(r"[-+]?\d+", x):
            return int(x)
        if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?", x):
            return float(x)
        return {"true": True, "false": False, "null": None, "": None}.get(x.lower(), x)

    root: dict = {}
    stack: list[tuple[int, object, object]] = [(-1, root, None)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent and stack[-1][2] is not None):
            stack.pop()
        _, holder, key = stack[-1]
        if body.startswith("- "):
            if not isinstance(holder[key], list):
                holder[key] = []
            holder[key].append(scalar(body[2:]))
            continue
        if key is not None:
            if not isinstance(holder[key], dict):
                holder[key] = {}
            holder = holder[key]
        name, _, value = body.partition(":")
        name = scalar(name)
        holder[name] = scalar(value)
        if not value.strip():
            stack.append((indent, holder, name))
    return root


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small configuration file from any file system of the cluster."""
    return plain_yaml(spark.read.text(path, wholetext=True).first().value)


def date_selection(spark: SparkSession, selection: dict | Sequence[str], members: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """member, yyyymmdd from dates by member, or from a list that holds for all members; names maps labels to members and leaves out others."""
    if isinstance(selection, dict):
        pairs = [(str(m), str(d)) for m, ds in selection.items() for d in ds or ()]
    else:
        pairs = [(m, str(d)) for m in members for d in selection]
    if names is not None:
        pairs = [(names[m], d) for m, d in pairs if m in names]
    return spark.createDataFrame(pairs, "member string, yyyymmdd string").select("member", normal_label(F.col("yyyymmdd")).alias("yyyymmdd")).distinct()


def read_regions(spark: SparkSession, path: str, key: str = "geo_region") -> DataFrame:
    """key and geometry (as JSON text) of each feature of a GeoJSON file."""
    text = spark.read.text(path, wholetext=True)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<struct<properties:map<string,string>,geometry:string>>")
    return text.select(F.explode(features).alias("f")).select(F.element_at("f.properties", key).alias(key), F.col("f.geometry").alias("geometry"))


def array_detector(detect: Callable[[np.ndarray, int, float], np.ndarray]) -> Callable[[DataFrame, Sequence[str], object, int], DataFrame]:
    """Makes a detector of whole tables from one that maps an array of values, a spell length and a threshold to 0/1 flags.

    The array of one key is one pandas frame, so a key must hold one series (or one block of it).
    """

    def run(series: DataFrame, keys: Sequence[str], threshold: object, spell: int) -> DataFrame:
        day = series.withColumn("_limit", threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold)))

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("idx")
            flags = np.asarray(detect(frame["value"].to_numpy(float), spell, float(frame["_limit"].iloc[0])))
            if len(flags) != len(frame) or not np.isin(flags, (0, 1)).all():
                raise ValueError("a detector must give a 0 or 1 for each value")
            return frame.drop(columns="_limit").assign(event=flags.astype("int32"))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields)
        return day.groupBy(*keys).applyInPandas(one, f"{kinds}, event int")

    return run


def table_detector(detect: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Makes a detector that gives event tables (keys and the columns of schema) from a function of one key's days, which come in order."""

    def run(series: DataFrame, keys: Sequence[str]) -> DataFrame:
        keys = list(keys)

        def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            out = detect(frame.sort_values("idx"))
            return out.assign(**dict(zip(keys, key, strict=True)))[[*keys, *out.columns]]

        kinds = ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in keys)
        return series.groupBy(*keys).applyInPandas(one, f"{kinds}, {schema}")

    return run


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _NetcdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_File]:
        return [_File(p) for p in json.loads(self.options["files"])]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from netCDF4 import Dataset, num2date

        ensemble, region = re.search(self.options.get("pattern", r"([^/_]+)_([^/_]+)\.nc$"), partition.path).groups()
        with Dataset(partition.path) as nc:
            time = nc.variables["time"]
            name = self.options.get("variable") or next(n for n, v in nc.variables.items() if v.dimensions[:1] == ("time",) and n != "time" and not n.endswith("bnds"))
            values = np.ma.filled(nc.variables[name][:].astype(float), np.nan).reshape(len(time))
            days = num2date(time[:], time.units, getattr(time, "calendar", "standard"))
        n = len(values)
        rows = [[ensemble] * n, [region] * n, [name] * n, range(n), [f"{d.year:04d}{d.month:02d}{d.day:02d}" for d in days], [d.year for d in days], [d.month for d in days], values]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["ensemble", "region", "variable", "idx", "yyyymmdd", "year", "month", "value"])


class NetcdfSeries(DataSource):
    """Daily series of NetCDF files, one partition for each (option files: a JSON list; pattern: its two groups are member and region). Needs netCDF4 on the executors; dates keep the file's calendar."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_series"

    def schema(self) -> str:
        return SERIES

    def reader(self, schema) -> DataSourceReader:
        return _NetcdfReader(self.options)


def register_netcdf(spark: SparkSession) -> bool:
    """Registers the source if its library is installed."""
    try:
        import netCDF4  # noqa: F401
    except ImportError:
        return False
    spark.dataSource.register(NetcdfSeries)
    return True
