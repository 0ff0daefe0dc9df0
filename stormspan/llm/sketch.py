"""Count-min sketches over hashes: partial sketches of partitions, merged by ranges of cells, carried as bits.

A sketch has DEPTH rows of saturating counters. A partition's part is sparse (its touched cells, of 2**32 possible ones), so
it is never larger than a share of the partition's own input. Parts are dealt by ranges of cells and added there. How many
cells are touched then tells how many different hashes there are, and the cells are folded (neighbours added) to the
power of two that leaves CELLS_PER_HASH or more for each, 2**most_bits at most. What leaves is one bit for each cell and
level asked for: whether the counter reaches it. These bits are broadcast, 2**most_bits / 8 bytes (32 MB, unless more is
allowed) for each row and level at most. An estimate is never too low, so no repeated hash is missed; with far more
different hashes than cells more hashes are taken for repeated, which costs work but loses nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import U64, Carried, arrow_map, discard, materialize, mix, seeded

DEPTH = 2
CELL_BITS = 32
RANGE_BITS = 22
CELLS_PER_HASH = 5
LEAST_BITS, MOST_BITS = 16, 28
MOST = 250


def cells(hashes: np.ndarray, row: int) -> np.ndarray:
    return (mix(hashes ^ seeded(DEPTH, 41)[row]) >> U64(64 - CELL_BITS)).astype(np.uint32)


def partial(hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], flush: int = 2_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        together = np.concatenate(held)
        for row in range(DEPTH):
            cell, counts = np.unique(cells(together, row), return_counts=True)
            counts = np.minimum(counts, MOST).astype(np.uint8)
            cut = np.searchsorted(cell, np.arange((1 << (CELL_BITS - RANGE_BITS)) + 1, dtype=np.uint64) << np.uint64(RANGE_BITS))
            places = cell & np.uint32((1 << RANGE_BITS) - 1)
            has = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array((row << 16) + has, pa.int32()), pa.array([places[cut[k] : cut[k + 1]].tobytes() for k in has], pa.binary()), pa.array([counts[cut[k] : cut[k + 1]].tobytes() for k in has], pa.binary())], ["part", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for h in hashes_of(batches):
            held.append(h)
            n += len(h)
            if n >= flush:
                yield from rows(held)
                held, n = [], 0
        if n:
            yield from rows(held)

    return run


def added(places: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each place once, with the sum of its counts."""
    all_places, all_counts = np.concatenate(places), np.concatenate(counts)
    order = np.argsort(all_places)
    all_places = all_places[order]
    first = np.flatnonzero(np.concatenate(([True], all_places[1:] != all_places[:-1])))
    return all_places[first], np.minimum(np.add.reduceat(all_counts[order], first, dtype=np.int64), MOST).astype(np.uint8)


def merge(batches: Iterator[pa.RecordBatch], flush: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Adds parts that come sorted by range; the touched cells of each range and their counts leave."""
    now, places, counts, size = None, [], [], 0

    def done() -> pa.RecordBatch:
        held, total = added(places, counts)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([held.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "places", "counts"])

    for batch in batches:
        for part, own, n in zip(batch.column("part").to_pylist(), batch.column("places"), batch.column("counts"), strict=True):
            if part != now:
                if now is not None:
                    yield done()
                now, places, counts, size = part, [], [], 0
            places.append(np.frombuffer(own.as_buffer(), np.uint32))
            counts.append(np.frombuffer(n.as_buffer(), np.uint8))
            size += len(places[-1])
            if size > flush:
                places, counts = ([x] for x in added(places, counts))
                size = len(places[0])
    if now is not None:
        yield done()


def folder(levels: tuple[int, ...], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bits of each range of a sketch of 2**bits cells."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (bits - CELL_BITS + RANGE_BITS)
        for batch in batches:
            for part, places, counts in zip(batch.column("part").to_pylist(), batch.column("places"), batch.column("counts"), strict=True):
                own = np.frombuffer(places.as_buffer(), np.uint32) >> np.uint32(CELL_BITS - bits)
                total = np.bincount(own, np.frombuffer(counts.as_buffer(), np.uint8), size)
                found = b"".join(np.packbits(total >= x, bitorder="little").tobytes() for x in levels)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(found, 1)], pa.binary())], ["part", "bits"])

    return fold


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """Bits of a cell's number for n different hashes."""
    return min(most, CELL_BITS, max(LEAST_BITS, (CELLS_PER_HASH * n - 1).bit_length()))


class Sketch:
    def __init__(self, levels: tuple[int, ...], cell_bits: int):
        self.levels, self.cell_bits = levels, cell_bits
        self.bits = np.zeros((len(levels), DEPTH, 1 << (cell_bits - 3)), np.uint8)

    def reaches(self, hashes: np.ndarray, level: int = 0) -> np.ndarray:
        """Whether the estimated count of each hash is at least levels[level]."""
        out = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            at = cells(hashes, row) >> np.uint32(CELL_BITS - self.cell_bits)
            out &= (self.bits[level, row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def sketch(rows: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], levels: tuple[int, ...] = (2,), most_bits: int = MOST_BITS) -> Sketch:
    """Counts all hashes that hashes_of takes from rows."""
    parts = arrow_map(rows, partial(hashes_of), "part int, places binary, counts binary").repartition("part").sortWithinPartitions("part")
    merged = materialize(arrow_map(parts, merge, "part int, n long, places binary, counts binary"), "sketch")
    bits = bits_for((merged.agg(F.sum("n")).first()[0] or 0) // DEPTH, most_bits)
    out, size = Sketch(levels, bits), 1 << (bits - CELL_BITS + RANGE_BITS - 3)
    for part, found in arrow_map(merged.select("part", "places", "counts"), folder(levels, bits), "part int, bits binary").collect():
        own = np.frombuffer(zlib.decompress(found), np.uint8)
        at = (part & 0xFFFF) * size
        for k in range(len(levels)):
            out.bits[k, part >> 16, at : at + size] = own[k * size : (k + 1) * size]
    discard(merged)
    return out


Batches = Iterator[pa.RecordBatch]


def keys_of(*columns: str) -> Callable[[Batches], Iterator[np.ndarray]]:
    """A hash of the named integer columns for each row."""

    def keys(batches: Batches) -> Iterator[np.ndarray]:
        for batch in batches:
            out = np.zeros(batch.num_rows, U64)
            for c in columns:
                out = mix(out ^ batch.column(c).to_numpy(zero_copy_only=False).view(U64))
            yield out

    return keys


class Among:
    """Sorts out rows whose keys are surely not among those of a table, by a sketch of these."""

    def __init__(self, table: DataFrame, *columns: str):
        self.keys = keys_of(*columns)
        self.model = Carried(table.sparkSession, sketch(table.select(*columns), self.keys, (1,)))

    def chosen(self, batches: Batches, wanted: bool = True) -> Batches:
        """Rows that may be among them, or (not wanted) the others."""
        for batch in batches:
            found = self.model.value.reaches(next(self.keys(iter([batch]))))
            yield batch.filter(pa.array(found if wanted else ~found))


def finished(rows: DataFrame, marks: DataFrame, finish: Callable[[Batches], Batches], schema: str, *drop: str) -> DataFrame:
    """What `finish` makes of rows (with doc_id, tid and a text) and their marks. Only rows that may have marks are shuffled to them; the others are finished where they are read."""
    marks = materialize(marks, "marks")
    among = Among(marks, "doc_id", "tid")
    none: Column = F.lit(None).cast(marks.schema["marks"].dataType)
    plain = arrow_map(rows.withColumn("marks", none), lambda batches: finish(b.drop_columns(list(drop)) for b in among.chosen(batches, False)), schema)
    # A broadcast of few marks would put both Python evaluations into one task: twice the workers, which stay in an executor's pool.
    met = arrow_map(rows, among.chosen, rows.schema).join(marks.hint("merge"), ["doc_id", "tid"], "left").drop(*drop)
    return plain.unionByName(arrow_map(met, finish, schema))
