"""Suffix-array dedup of byte strings by longest previous factors.

The longest previous factor of a position is the longest string that starts there and also at an earlier position. In
suffix order it is reached at the previous or the next smaller position, so it follows from these two and the smallest
common prefix on the way (`longest_previous`). A position whose factor has `length` bytes or more repeats earlier text.
Mode `first` removes the bytes of such factors, which keeps the first copy; mode `all` also takes longest next factors (the
same with positions reversed), which removes every copy.

Corpus-wide suffix order is found piecewise. Each string of `length` bytes selects the smallest hash of its `gram`-byte
strings; equal strings select equal anchors, so positions with different anchors never need comparing. Consecutive starts
with one anchor form a block. A count-min sketch of anchors leaves blocks whose anchor may be repeated; these go to their
anchor's task with the bytes they span. There, factors in the sparse suffix order of block starts settle blocks that occur
whole more than once; then factors in the suffix order of all starts in the anchor's remaining blocks settle the rest.

Skew: a task first merges its own equal blocks, compared byte by byte, and passes on one of them, so copies in a third of
all documents give a row for each task. Anchors estimated to occur `HOT` times or more (edges of a popular passage) are
dealt by whole string instead, as 128-bit fingerprints, again merged before they leave; two different strings of a corpus
of n such starts have equal ones with a chance of about n * n / 2**129. So an anchor's task holds few blocks.

Defined cases: null texts have no bytes; texts shorter than `length` lose nothing; rows with equal id and text are
judged alike (mode `first` takes them for one, mode `all` removes both); null ids come last; a very long text is taken in
overlapping parts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import SLICE_BYTES, U64, Carried, arrow_map, forget, id_in, id_out, longs, mix, powers, seeded, sliding_min, text_slices
from stormspan.llm.sketch import MOST_BITS, finished, sketch
from stormspan.llm.substring import changes, marked, runs

LENGTH = 200
GRAM = 48
HOT = 200
LONGEST_BLOCK = 512
FLUSH_BYTES = 12 << 20
ROW = "anchor long, doc_id long, tid long, pos int, n int, repeated boolean, done boolean, own binary"
NAMES = ["anchor", "doc_id", "tid", "pos", "n", "repeated", "done", "own"]


def longest_previous(position: np.ndarray, shared: np.ndarray, least: int = 1) -> np.ndarray:
    """For suffixes in order, of which the k-th starts at position[k] and has shared[k] bytes in common with the one before: the longest common prefix of each with any that starts at a smaller position.

    Walks to the previous and to the next smaller position by pointer jumping. Factors shorter than `least` may be given as 0.
    """

    def walk(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
        to, common = np.arange(-1, len(position) - 1), shared.copy()
        open_ = np.arange(1, len(position))
        while len(open_):
            open_ = open_[(to[open_] >= 0) & (common[open_] >= least)]
            open_ = open_[position[to[open_]] >= position[open_]]
            over = to[open_]
            common[open_], to[open_] = np.minimum(common[open_], common[over]), to[over]
        common[(to < 0) | (common < least)] = 0
        return common

    if not len(position):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], shared[1:]))
    back = np.concatenate(([0], shared[1:][::-1]))
    return np.maximum(walk(position, first), walk(position[::-1], back)[::-1])


def sums(raw: np.ndarray, seed: int) -> np.ndarray:
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(seeded(256, seed)[raw] * powers(len(raw)), out=out[1:])
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all strings of `length` bytes within a document, their anchors, and the hashes of all `gram`-byte strings."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    total = sums(raw, 51)
    grams = mix((total[gram:] - total[:-gram]) * powers(len(raw), True)[: len(raw) - gram + 1])
    least = sliding_min(grams, length - gram + 1)
    room = np.zeros(len(raw) + 1, np.int32)
    own = np.diff(offsets) >= length
    np.add.at(room, offsets[:-1][own], 1)
    np.add.at(room, offsets[1:][own] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(room)[: len(least)])
    return at, least[at], grams


def parts_of(batches: Iterator[pa.RecordBatch], length: int, also: str | None = None, limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """Runs of documents as text_slices gives them, and where the run begins in its text: a long text comes in parts that overlap by length - 1 bytes, so each string is in one of them."""
    for keys, raw, offsets, *more in text_slices(batches, "doc_id", "text", limit, also):
        if len(raw) <= 2 * limit:
            yield keys, raw, offsets, 0, *more
            continue
        for at in range(0, len(raw) - length + 1, limit):
            part = raw[at : at + limit + length - 1]
            yield keys, part, np.array([0, len(part)]), at, *more


def hasher(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, raw, offsets, _ in parts_of(batches, length):
            at, least, grams = anchors(raw, offsets, length, gram)
            # a place is an anchor if it is the smallest of some string that it is in; a text that repeats itself counts each
            n = length - gram
            most = np.zeros(len(grams) + n if len(grams) else 0, U64)
            most[n + at] = least
            yield grams[~sliding_min(~most, n + 1) == grams]

    return hashes


def emitter(model, length: int, gram: int, keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks whose anchor may be repeated: decided ones (done), and those to be ordered with blocks of other tasks."""

    def decide(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, doc, tid, pos, n, f1, f2 = (np.concatenate([x[k] for x in held]) for k in range(7))
        own = np.array([c for x in held for c in x[7]], object)
        order = np.lexsort((pos, tid, doc, f2, f1))
        same = np.zeros(len(order), bool)
        f1, f2, doc, tid, pos = f1[order], f2[order], doc[order], tid[order], pos[order]
        same[1:] = (f1[1:] == f1[:-1]) & (f2[1:] == f2[:-1])
        own = own[order]
        like = np.flatnonzero(same)
        same[like] = own[like] == own[like - 1]
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        later = (doc != doc[start]) | (tid != tid[start]) | (pos != pos[start])
        several = np.zeros(len(order), bool)
        several[start[same]] = True
        decided = later if keep_first else several[start]
        passed = ~same
        yield runs_of(doc[decided], tid[decided], pos[decided], n[order][decided])
        k = np.flatnonzero(passed)
        for at in range(0, len(k), 20_000):
            part = k[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([longs(anchor[order][part]), longs(doc[part]), longs(tid[part]), pa.array(pos[part], pa.int32()), pa.array(n[order][part], pa.int32()), pa.array(several[part] & (not keep_first)), pa.array(np.zeros(len(part), bool)), pa.array(own[part].tolist(), pa.binary())], NAMES)

    def runs_of(doc: np.ndarray, tid: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        d, t, p, n = runs(np.repeat(doc, n), np.repeat(tid, n), np.repeat(pos, n) + ramp(n))
        return pa.RecordBatch.from_arrays([longs(mix(d.view(U64) ^ p.astype(U64))), longs(d), longs(t), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(np.ones(len(d), bool)), pa.array(np.ones(len(d), bool)), pa.array([None] * len(d), pa.binary())], NAMES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoder")
        held, size = [], 0
        for keys, raw, offsets, base, tids in parts_of(batches, length, "tid"):
            at, least, _ = anchors(raw, offsets, length, gram)
            new = np.flatnonzero(changes(at, least))
            if not len(new):
                continue
            maybe, hot = model.value.reaches(least[new]), model.value.reaches(least[new], 1)
            counts = np.diff(np.append(new, len(at)))
            t1, t2, back, data = sums(raw, 52), sums(raw, 53), powers(len(raw), True), raw.tobytes()

            def prints(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return mix((t1[end] - t1[start]) * back[start] ^ (end - start).astype(U64)), mix((t2[end] - t2[start]) * back[start])

            cold = maybe & ~hot
            reps = -(-counts[cold] // LONGEST_BLOCK)
            step = ramp(reps) * LONGEST_BLOCK
            start = np.repeat(at[new[cold]], reps) + step
            n = np.minimum(np.repeat(counts[cold], reps) - step, LONGEST_BLOCK)
            f1, f2 = prints(start, start + n + length - 1)
            own = [data[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
            place = np.searchsorted(offsets, start, side="right") - 1
            held.append((np.repeat(least[new[cold]], reps), keys[place], tids[place], start - offsets[place] + base, n, f1, f2, own))
            single = np.repeat(at[new[maybe & hot]], counts[maybe & hot]) + ramp(counts[maybe & hot])
            if len(single):
                f1, f2 = prints(single, single + length)
                place = np.searchsorted(offsets, single, side="right") - 1
                marks = np.stack((f1, f2), 1).tobytes()
                held.append((f1, keys[place], tids[place], single - offsets[place] + base, np.ones(len(single), np.int64), f1, f2, [marks[k : k + 16] for k in range(0, len(marks), 16)]))
            size += sum(map(len, own)) + 80 * len(single)
            if size >= FLUSH_BYTES:
                yield from decide(held)
                held, size = [], 0
        if held:
            yield from decide(held)

    return emit


def ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) - np.repeat(total - n, n)


def repeated(position: np.ndarray, shared: np.ndarray, least: int, keep_first: bool) -> np.ndarray:
    """Which suffixes have a previous, or (not keep_first) also a next, factor of `least` bytes."""
    out = longest_previous(position, shared, least) >= least
    return out if keep_first else out | (longest_previous(-position, shared, least) >= least)


def settle(rows: list[tuple], length: int, keep_first: bool) -> list[tuple[int, int, int, int]]:
    """Repeated starts (doc, tid, pos, n) of whole anchors' blocks: (anchor, doc, tid, pos, n, repeated, own) sorted by all but the last three."""
    # Positions: in mode first, rows of equal id, text and place are one.
    new = [True, *(keep_first is False or a[1:4] != b[1:4] for a, b in zip(rows, rows[1:], strict=False))]
    place = np.cumsum(new)
    # Sparse suffix order of block starts, ties by position: a block's factor is as long as the block, or else of no use here.
    order = np.array(sorted(range(len(rows)), key=lambda k: rows[k][6]))
    texts = [rows[k][6] for k in order.tolist()]
    shared = np.array([0, *(a == b for a, b in zip(texts, texts[1:], strict=False))], np.int64)
    again = np.empty(len(rows), bool)
    again[order] = repeated(place[order], shared, 1, keep_first)
    out = [rows[k][1:5] for k in np.flatnonzero(again).tolist()] if keep_first else [r[1:5] for r, x in zip(rows, again.tolist(), strict=True) if x or r[5]]
    # One of each group stays for its anchor's other blocks; as ~k if its starts are known to be repeated.
    open_of: dict[int, list[int]] = {}
    for k in order[shared == 0].tolist():
        open_of.setdefault(rows[k][0], []).append(~k if not keep_first and (again[k] or rows[k][5]) else k)
    held: list[int] = []
    size = 0

    def dense() -> None:
        held.sort(key=lambda k: rows[max(k, ~k)][:4])
        parts, key = [], []
        for k in held:
            own = np.frombuffer(rows[max(k, ~k)][6], np.uint8)
            parts.append(np.lib.stride_tricks.sliding_window_view(own, length))
            key.append(np.stack((np.full(len(parts[-1]), max(k, ~k)), np.arange(len(parts[-1]))), 1))
        where = np.concatenate(key)
        strings = np.ascontiguousarray(np.concatenate(parts)).view(f"S{length}").ravel()
        position = np.arange(len(where))
        if keep_first:  # starts that two blocks have in common are one position
            _, position = np.unique(np.array([(*rows[k][1:3], rows[k][3] + j) for k, j in where.tolist()], np.int64), axis=0, return_inverse=True)
        order = np.lexsort((position, strings))
        sorted_bytes = strings[order].view(np.uint8).reshape(-1, length)
        unlike = sorted_bytes[1:] != sorted_bytes[:-1]
        common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), length)
        hit = np.empty(len(where), bool)
        hit[order] = repeated(position[order], np.concatenate(([0], common)), length, keep_first)
        fixed = {~k for k in held if k < 0}
        out.extend((*rows[k][1:3], rows[k][3] + j, 1) for k, j in where[hit].tolist() if k not in fixed)

    def settled(k: int) -> bool:
        """Whether no string of a block that is alone with its anchor occurs in it twice: the bytes that all share don't."""
        n, own = rows[k][4], rows[k][6]
        return n == 1 or (n <= length - 31 and own.find(own[n - 1 : n + 31], n) < 0)

    for ks in open_of.values():
        ks = [k for k in ks if len(rows[max(k, ~k)][6]) >= length]
        own = [max(k, ~k) for k in ks]
        if all(k < 0 for k in ks) or (len(ks) == 1 and settled(own[0])):
            continue
        held += ks
        size += sum(rows[k][4] for k in own)
        if size > 50_000:
            dense()
            held, size = [], 0
    if held:
        dense()
    return out


def grouper(length: int, keep_first: bool, most: int = 6 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads blocks sorted by anchor, id and position; holds whole anchors of about `most` bytes."""
        held: list[tuple] = []
        size = 0

        def found(rows: list[tuple]) -> pa.RecordBatch:
            marks = np.array(settle(rows, length, keep_first), np.int64).reshape(-1, 4)
            n = marks[:, 3]
            d, t, p, n = runs(np.repeat(marks[:, 0], n), np.repeat(marks[:, 1], n), np.repeat(marks[:, 2], n) + ramp(n))
            return pa.RecordBatch.from_arrays([longs(d), longs(t), pa.array(p, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "tid", "pos", "n"])

        for batch in batches:
            done = batch.column("done")
            known = batch.filter(done)
            yield pa.RecordBatch.from_arrays([known.column(c) for c in ("doc_id", "tid", "pos", "n")], ["doc_id", "tid", "pos", "n"])
            rest = batch.filter(pc.invert(done))
            for row in zip(*(rest.column(c).to_pylist() for c in ("anchor", "doc_id", "tid", "pos", "n", "repeated", "own")), strict=True):
                if size > most and held and held[-1][0] != row[0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6]) + 200
        if held:
            yield found(held)

    return group


def finisher(length: int, whole_characters: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            names = [n for n in whole.schema.names if n not in ("doc_id", "text", "marks")]
            for keys, raw, offsets in text_slices(iter([whole]), "doc_id", "text"):
                batch = whole.slice(at, len(keys))
                at += len(keys)
                gone = marked(batch, offsets[:-1], len(raw), length)
                if whole_characters:  # a character goes if all its bytes do
                    lead = np.flatnonzero((raw & 0xC0) != 0x80)
                    if len(lead):
                        gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(raw)))) if lead[0] == 0 else gone
                first = np.zeros(len(raw) + 1, bool)
                first[offsets] = True
                begins = gone & (~np.concatenate(([False], gone[:-1])) | first[:-1]) if len(raw) else gone
                total, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(begins)))
                kept, data = [], raw.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    kept.append(raw[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else data[a:b])
                removed, n_spans = total[offsets[1:]] - total[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(keys, pa.int64()), longs(np.diff(offsets)), longs(removed), longs(n_spans), pa.array(kept, pa.binary())], [*names, "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return finish


def _marks(rows: DataFrame, length: int, gram: int, mode: str, sketch_bits: int) -> DataFrame:
    if mode not in ("first", "all"):
        raise ValueError(f"mode is {mode!r}; it can be first or all")
    keep_first = mode == "first"
    model = Carried(rows.sparkSession, sketch(rows.select("doc_id", "text"), hasher(length, gram), (2, HOT), sketch_bits))
    blocks = arrow_map(rows.select("doc_id", "tid", "text"), emitter(model, length, gram, keep_first), ROW).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "tid", "pos")
    return arrow_map(blocks, grouper(length, keep_first), "doc_id long, tid long, pos int, n int").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("pos", "n")).alias("marks"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, mode: str = "first", id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = MOST_BITS) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans and kept, the remaining bytes. sketch_bits bounds the sketch of anchors."""
    rows = docs.select(id_in(F.col(id_col)).alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"))
    marks = _marks(rows, length, gram, mode, sketch_bits)
    return finished(rows, marks, finisher(length, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", "tid").withColumn("doc_id", id_out(F.col("doc_id")))


def remove_copies(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, sketch_bits: int = MOST_BITS) -> DataFrame:
    """docs with later copies cut out of their texts (whole characters only); all columns and rows stay.

    length_col: a column with the number of characters, which is set anew for texts that were cut.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    rows = own.select("*", id_in(F.col(f"c{names.index(id_col)}")).alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    marks = _marks(rows.select("doc_id", "tid", "text"), length, gram, "first", sketch_bits)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != text)
    rows = rows.drop(text).withColumn("was_null", F.col("text").isNull())
    done = finished(rows, marks, finisher(length, True), f"{kinds}, was_null boolean, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", "tid")
    done = done.withColumn(text, F.when(~F.col("was_null"), F.col("kept").cast("string")))
    if length_col:
        size = own.columns[names.index(length_col)]
        done = done.withColumn(size, F.when(F.col("n_removed") > 0, F.char_length(text)).otherwise(F.col(size)).cast(own.schema[size].dataType))
    return done.select(*[F.col(c).alias(n) for c, n in zip(own.columns, names, strict=True)])
