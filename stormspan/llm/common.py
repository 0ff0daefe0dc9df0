"""Shared helpers: the shared folder of a job, and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
SLICE_BYTES = 1 << 19
#: Arrow batches are cut by size too: the default of 10,000 rows of long texts takes a worker's and the JVM's memory.
BATCH_BYTES = 4 << 20


def kept() -> dict:
    """What a worker process keeps between tasks: code that comes with a job has new globals in each."""
    return sys.modules.setdefault("_stormspan_kept", types.ModuleType("_stormspan_kept")).__dict__


def forget(prefix: str) -> None:
    """Frees what a worker process has kept for another operator."""
    for key in [k for k in kept() if k.startswith(prefix)]:
        del kept()[key]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; it goes when the application ends.

    Where that is unset, a local session (tests on one machine) takes a folder of its own; a cluster gets an error, since
    executors would write to folders of their own that no other reads.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        base = f"/tmp/stormspan-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/stormspan/{uuid.uuid4().hex}"
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return path


def _files(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stormspan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing reads it any more."""
    files, where = _files(df.sparkSession, df._stormspan_path)
    files.delete(where.getParent(), True)


Batches = Iterator[pa.RecordBatch]


def arrow_map(df: DataFrame, function: Callable[[Batches], Batches], schema: object) -> DataFrame:
    """mapInArrow in batches of bounded size; a worker gives its free memory back at the end of each task.

    The bound is a setting of the session, which holds for plans that run later too; a smaller one is left.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key).rstrip("b")
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that this process doesn't use back to the system, where that can be asked for."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


class Carried:
    """A broadcast object of this package.

    Broadcasts name their classes instead of holding them, and a worker need not have this package installed. So only the
    object's attributes, which must be plain data, are broadcast; its class comes with the code of the job.
    """

    def __init__(self, spark: SparkSession, thing: object):
        self.kind, self.data = type(thing), spark.sparkContext.broadcast(vars(thing))

    @property
    def value(self) -> object:
        out = object.__new__(self.kind)
        out.__dict__ = self.data.value
        return out


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., so that no name of an input meets one of ours, and the new name of each old one."""
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return own, dict(zip(df.columns, own.columns, strict=True))


#: Stands for a null id while rows are dealt and compared: it comes after all others.
NO_ID = (1 << 63) - 1


def id_in(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(NO_ID))


def id_out(key: Column) -> Column:
    return F.when(key != NO_ID, key)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit hashes."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(MULT) + U64(seed * 0x632BE59BD9B4E019 & MASK))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """MULT ** i (or MULT ** -i) modulo 2**64 for i < n; kept between calls up to a few million."""
    key = "inverse powers" if inverse else "powers"
    have = kept().get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES * 9 // 8)
        base = pow(MULT, -1, 1 << 64) if inverse else MULT
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= SLICE_BYTES * 8:
            kept()[key] = have
    return have[:n]


def text_slices(batches: Iterator[pa.RecordBatch], key: str, text: str, limit: int = SLICE_BYTES, also: str | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole documents of about `limit` bytes: keys, their UTF-8 bytes one after another, offsets, and the column `also`.

    A null text has no bytes. Only a single document longer than the limit makes a larger run.
    """
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        more = batch.column(also).to_numpy(zero_copy_only=False) if also else None
        col = batch.column(text)
        if col.null_count:
            col = col.fill_null("")
        if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            kind = np.int64
        else:
            kind = np.int32
        _, offs, data = col.buffers()
        offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, len(keys))
            found = keys[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            yield found if more is None else (*found, more[at:to])
            at = to


def is_space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: 64-bit hash, start, end, and for each document the index of its first word (one more at the end).

    Long runs are taken block by block between white space, so only the words' own numbers grow with a text. Hashes of
    different seeds are independent.
    """
    if len(raw) <= 2 * SLICE_BYTES:
        return _words(raw, offsets, lower, seed)
    parts, at = [], 0
    for part in blocks(raw, SLICE_BYTES):
        inner = offsets[(offsets > at) & (offsets < at + len(part))] - at
        h, starts, ends, _ = _words(part, np.concatenate(([0], inner, [len(part)])), lower, seed)
        parts.append((h, starts + at, ends + at))
        at += len(part)
    h, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, starts, ends, np.searchsorted(starts, offsets)


def blocks(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text in blocks of about `most` bytes that end before ASCII white space."""
    space, at = is_space_table(), 0
    while at < len(raw):
        to = min(at + most, len(raw))
        while to < len(raw):
            found = np.flatnonzero(space[raw[to : to + (1 << 16)]])
            if len(found):
                to += int(found[0])
                break
            to = min(to + (1 << 16), len(raw))
        yield raw[at:to]
        at = to


def _words(raw: np.ndarray, offsets: np.ndarray, lower: bool, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~is_space_table()[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    data = lower_table()[raw] if lower else raw
    summed = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(seeded(256, seed)[data] * powers(len(raw)), out=summed[1:])
    h = mix((summed[ends] - summed[starts]) * powers(len(raw), True)[starts])
    return h, starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    if len(values) < n:
        return values[:0]
    size = 1
    while size * 2 <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if size < n else values


def window_hashes(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each n consecutive hashes."""
    if len(h) < n:
        return np.zeros(0, U64)
    summed = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(mix(h + U64(seed * MULT & MASK)) * powers(len(h)), out=summed[1:])
    return mix((summed[n:] - summed[:-n]) * powers(len(h), True)[: len(h) - n + 1])


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64, copy=False), pa.int64())
