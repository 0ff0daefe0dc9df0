"""Substring dedup by word windows with a count-min prefilter.

A window is `window` consecutive words. A word is removed if a window that covers it also starts in a document with a
smaller id. Windows are judged on the input.

First pass: each window selects the smallest of its `gram`-word hashes; equal windows select equal ones, so a count-min
sketch of selected hashes overestimates every window's count, with an entry for about every 13th word only. Second pass:
windows whose estimate reaches 2 are hashed to 128 bits, 64 each from two independent hashes of their words, and grouped;
two different ones of n meet in all 128 with a chance of about n * n / 2**129. A task first decides among its own windows
and passes on those of its smallest document for each window, so a window in a third of all documents gives a row for
each task. Grouped rows are streamed in sorted order and never held together. Removed windows return to their document
as runs.

Defined cases: null texts have no words; texts shorter than a window lose nothing; rows with equal id and text are judged
alike and don't remove each other; null ids come after all others; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import U64, Carried, arrow_map, id_in, id_out, longs, mix, sliding_min, text_slices, window_hashes, words_of
from stormspan.llm.sketch import MOST_BITS, finished, sketch

WINDOW = 50
GRAM = 25
FLUSH = 2_000_000
NAMES = ["w1", "w2", "doc_id", "tid", "pos", "n", "done"]
ROW = "w1 long, w2 long, doc_id long, tid long, pos int, n int, done boolean"


def selected(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within a document, and the hash that each selects."""
    least = sliding_min(window_hashes(h, gram, 3), window - gram + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: len(least)] == doc[len(doc) - len(least) :])
    return at, least[at]


def changes(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where a value differs from that of the position before, or there is none."""
    new = np.ones(len(at), bool)
    new[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1)
    return new


def runs(doc: np.ndarray, tid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive positions: doc, tid, first position, length."""
    if not len(doc):
        return doc, tid, pos, pos
    order = np.lexsort((pos, tid, doc))
    doc, tid, pos = doc[order], tid[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], tid[at], pos[at], pos[last] - pos[at] + 1


def hasher(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, raw, offsets in text_slices(batches, "doc_id", "text"):
            h, _, _, first = words_of(raw, offsets)
            at, least = selected(h, first, window, gram)
            yield least[changes(at, least)]

    return hashes


def emitter(model, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows estimated repeated: decided runs (done), and windows to be grouped with those of other tasks."""

    def decide(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        w1, w2, doc, tid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(w1, kind="stable")
        w1, w2, doc, tid, pos = w1[order], w2[order], doc[order], tid[order], pos[order]
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = doc > least
        d, t, p, n = runs(doc[gone], tid[gone], pos[gone])
        yield pa.RecordBatch.from_arrays([longs(mix(d.view(U64) ^ p.astype(U64))), longs(np.zeros(len(d))), longs(d), longs(t), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(np.ones(len(d), bool))], NAMES)
        own = ~gone
        k = int(own.sum())
        yield pa.RecordBatch.from_arrays([longs(w1[own]), longs(w2[own]), longs(doc[own]), longs(tid[own]), pa.array(pos[own], pa.int32()), pa.array(np.ones(k), pa.int32()), pa.array(np.zeros(k, bool))], NAMES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for keys, raw, offsets, tids in text_slices(batches, "doc_id", "text", also="tid"):
            h, _, _, first = words_of(raw, offsets)
            at, least = selected(h, first, window, gram)
            new = changes(at, least)
            at = at[model.value.reaches(least[new])[np.cumsum(new) - 1]] if len(at) else at
            if len(at):
                doc = np.searchsorted(first, at, side="right") - 1
                other = words_of(raw, offsets, seed=8)[0]
                held.append((window_hashes(h, window, 11)[at], window_hashes(other, window, 12)[at], keys[doc], tids[doc], at - first[doc]))
                count += len(at)
            if count >= FLUSH:
                yield from decide(held)
                held, count = [], 0
        if held:
            yield from decide(held)

    return emit


def grouper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads windows sorted by hash and id; passes on those of all but the smallest id of each window."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        w1, w2, doc, tid, pos, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES[:-1])
        done = batch.column("done").to_numpy(zero_copy_only=False)
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | done[1:] | done[:-1]
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(w1)), 0))]
        if last is not None and last[:2] == (w1[0], w2[0]) and not done[0]:
            first = int(new[1:].argmax()) + 1 if new[1:].any() else len(w1)
            least[:first] = last[2]
        last = None if done[-1] else (w1[-1], w2[-1], least[-1])
        gone = done | (doc > least)
        yield pa.RecordBatch.from_arrays([longs(doc[gone]), longs(tid[gone]), pa.array(pos[gone], pa.int32()), pa.array(n[gone], pa.int32())], ["doc_id", "tid", "pos", "n"])


def marked(batch: pa.RecordBatch, bases: np.ndarray, total: int, reach: int) -> np.ndarray:
    """Which of the units (words or bytes) of a batch's documents, whose first ones are at `bases`, a removed window covers."""
    marks = batch.column("marks")
    flat = marks.flatten()
    edge = np.zeros(total + reach + 1, np.int32)
    if len(flat):
        counts = np.asarray(marks.value_lengths().fill_null(0))
        start = np.repeat(bases, counts) + flat.field("pos").to_numpy(zero_copy_only=False)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + flat.field("n").to_numpy(zero_copy_only=False) + reach - 1, -1)
    return np.cumsum(edge)[:total] > 0


def finisher(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for keys, raw, offsets in text_slices(iter([whole]), "doc_id", "text"):
                batch = whole.slice(at, len(keys))
                at += len(keys)
                _, _, _, first = words_of(raw, offsets)
                gone = marked(batch, first[:-1], int(first[-1]), window)
                data, kept, removed = raw.tobytes(), [], np.zeros(len(keys), np.int64)
                for k, (a, b, i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    words, own = data[a:b].split(), gone[i:j]
                    removed[k] = own.sum()
                    kept.append(b" ".join(compress(words, ~own) if removed[k] else words))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), longs(np.diff(first)), longs(removed), pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return finish


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = MOST_BITS) -> DataFrame:
    """For each row: doc_id, n_words, n_removed and text, the kept words joined by a space. sketch_bits bounds the sketch: more cells let fewer single windows of a large corpus through."""
    rows = docs.select(id_in(F.col(id_col)).alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"))
    model = Carried(docs.sparkSession, sketch(rows.select("doc_id", "text"), hasher(window, gram), most_bits=sketch_bits))
    windows = arrow_map(rows, emitter(model, window, gram), ROW).repartition("w1").sortWithinPartitions("w1", "w2", "doc_id")
    marks = arrow_map(windows, grouper, "doc_id long, tid long, pos int, n int").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("pos", "n")).alias("marks"))
    return finished(rows, marks, finisher(window), "doc_id long, n_words long, n_removed long, text string", "tid").withColumn("doc_id", id_out(F.col("doc_id")))
