"""Best-fit packing of tokenised documents by hierarchical residual packing.

A document is its token ids and an end id. Documents longer than a sequence are cut into pieces of the full capacity, the
last of which may be shorter; shorter documents are never cut. Full pieces are sequences already. The others are packed
best-fit decreasing within each partition; sequences that are nearly full are final, and all underfull ones go up a tree:
the items of `fan_in` nodes' underfull sequences meet in one node and are packed again by best fit, until one node is left.

Pieces of one length are interchangeable, so a node plans with the number of its pieces of each length, never with rows:
a node holds at most `capacity` counts, whatever its share of the corpus. A plan is a list of runs (pieces lo to hi of
a length go to consecutive sequences, `per` to each). Rows find their run by a join, and number themselves anew by plain
arithmetic when they go up, so no task holds or orders the rows of a node and no underfull sequence is ever left behind.
Each round is written to the shared folder; a lost executor repeats its tasks of one round only.

Defined cases: a null or empty text is the end id alone; a very long text is tokenised block by block between white space;
repeated rows are packed each for itself; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormspan.llm.common import arrow_map, blocks, forget, id_in, id_out, is_space_table, kept, materialize, text_slices

CAPACITY = 2048
END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, node long, rank long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("node", pa.int64()), ("rank", pa.int64())])
OUT = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: length, lo and hi tell the pieces of a run; per, bin and place where they go; up is the number of the first one in the next round, or null if the run is final.
PLAN = "node long, length long, lo long, hi long, per long, bin long, place long, up long"
PLAN_NAMES = ["node", "length", "lo", "hi", "per", "bin", "place", "up"]
BLOCK_BYTES = 2 << 20
#: Apostrophes start contractions, which the tokenizer cuts otherwise than the classes below do.
LETTER, DIGIT, SIGN, SPACE, OTHER = range(5)


def classes() -> np.ndarray:
    """Class of each byte: ASCII as the tokenizer's pattern has it, the lead byte of U+00C0 to U+00FF and all continuation bytes a letter."""
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = SIGN
    for first, last, kind in ((0x30, 0x39, DIGIT), (0x41, 0x5A, LETTER), (0x61, 0x7A, LETTER), (0x80, 0xBF, LETTER), (0xC3, 0xC3, LETTER)):
        out[first : last + 1] = kind
    out[is_space_table()] = SPACE
    out[0x27] = OTHER
    return out


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts of documents whose ids can be joined: the parts, which of them are plain, and for each document the index of its first part (one more at the end).

    The tokenizer never joins text across ASCII white space. A word of ASCII (without apostrophe) and of letters from U+00C0
    to U+00FF is plain: it is lower-cased and cut as the tokenizer cuts it, into runs of letters, single digits and
    runs of other characters. Any other word is one part, as it is.
    """
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    kind = classes()[raw]
    lead = raw == 0xC3
    second = np.concatenate(([False], lead[:-1]))
    kind[(second & ((raw == 0x97) | (raw == 0xB7))) | ((raw >= 0x80) & ~lead & ~second)] = OTHER  # multiplication and division signs, and other characters
    kind[:-1][(raw[:-1] == 0x3C) & (raw[1:] == 0x7C)] = OTHER  # special tokens
    inside = kind != SPACE
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins = inside & (np.concatenate(([True], ~inside[:-1])) | first[:-1])
    word = np.cumsum(begins, dtype=np.int32) - 1
    odd = np.zeros(int(word[-1]) + 1, bool)
    odd[word[kind == OTHER]] = True
    plain = inside & ~odd[word] if len(odd) else inside
    cut = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == DIGIT)
    starts = np.flatnonzero(begins | (plain & cut))
    low = raw.copy()
    low[plain & (((raw >= 0x41) & (raw <= 0x5A)) | (second & (raw >= 0x80) & (raw <= 0x9E)))] += 32
    data, place = low[inside], np.concatenate(([0], np.cumsum(inside, dtype=np.int32)))
    at = np.append(place[starts], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]), plain[starts], np.searchsorted(starts, offsets)


class Encoder:
    """Ids of the parts of texts.

    The ids of distinct parts are kept from batch to batch, in two generations: when the younger is full it becomes the
    older one, whose parts come back if they are met again, so frequent parts stay and memory is bounded.
    """

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of plain parts, many of them encoded together: each is one word of the tokenizer, so its last token, and no other, ends a word."""
        out: list[bytes] = []
        for at in range(0, len(parts), 20_000):
            own = parts[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, "<u4")
            data, cut = ids.tobytes(), [0, *(np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()]
            out += [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def _alone(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in parts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def of_parts(self, parts: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of each of the distinct parts, as little-endian unsigned 32-bit numbers."""
        out = list(map(self.young.get, parts))
        missing = [k for k, x in enumerate(out) if x is None]
        for k in missing:
            out[k] = self.old.get(parts[k])
        new = [k for k in missing if out[k] is None]
        for learn, own in ((self._learn, [k for k in new if plain[k]]), (self._alone, [k for k in new if not plain[k]])):
            for k, ids in zip(own, learn([parts[k] for k in own]), strict=True):
                out[k] = ids
        self.young.update((parts[k], out[k]) for k in missing if len(parts[k]) <= 48)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out

    def ids(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of documents one after another, each with its end id, and the offset of each."""
        parts, plain, first_part = units(raw, offsets)
        coded = parts.dictionary_encode()
        at = coded.indices.to_numpy()
        kind = np.zeros(len(coded.dictionary), bool)
        kind[at] = plain
        distinct = self.of_parts(coded.dictionary.to_pylist(), kind)
        flat, size = np.frombuffer(b"".join(distinct), "<u4"), np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        first, n = np.cumsum(size) - size, size[at]
        before = np.concatenate(([0], np.cumsum(n)))
        source = np.repeat(first[at] - before[:-1], n) + np.arange(before[-1])
        ends = before[first_part[1:]]
        return np.insert(flat[source], ends, end), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))


def encoder(path: str) -> Encoder:
    key = f"encoder {path}"
    if key not in kept():
        for other in ("powers", "inverse powers"):  # tables of earlier stages' hashing, some 40 MB
            forget(other)
        kept()[key] = Encoder(path)
    return kept()[key]


def cutter(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc, node, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for keys, raw, offsets in text_slices(batches, "doc_id", "text", BLOCK_BYTES):
            if len(raw) > 2 * BLOCK_BYTES:  # one long document
                parts = [enc.ids(part, np.array([0, len(part)]), end_id)[0][:-1] for part in blocks(raw, BLOCK_BYTES)]
                ids = np.concatenate([*parts, np.array([end_id], "<u4")])
                cuts = np.array([0, len(ids)])
            else:
                ids, cuts = enc.ids(raw, offsets, end_id)
            data, rows = memoryview(ids.astype("<u4", copy=False)).cast("B"), []
            for key, a, b in zip(keys.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for k, s in enumerate(range(a, b, capacity)):
                    e = min(s + capacity, b)
                    rows.append((key, k, s - a, e - s, zlib.crc32(data[4 * s : 4 * e]), node, seen[e - s]))
                    seen[e - s] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; node is its partition, rank its number among the node's pieces of its length."""
    return arrow_map(docs.select(id_in(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text")), cutter(tokenizer_path, capacity, end_id), PIECE)


Run = tuple[int, int, int, int, int, int]
Group = tuple[int, int]


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, list[Group]]]:
    """Best-fit decreasing of counts[length] pieces of each length.

    Runs (length, lo, hi, per, bin, place): pieces lo to hi of a length go to consecutive bins from `bin`, `per` to each,
    the first at `place`. And for each room the groups (first bin, number of bins) that have so many free places. Bins of one
    room are alike, so a group of them is filled at once: the tightest bin that fits stays the tightest until it is full.
    """
    runs: list[Run] = []
    rooms: dict[int, list[Group]] = {}
    free = 0  # bit r: there are bins with r free places
    made = 0
    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]
        while at < n:
            fitting = free >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, held = rooms[room].pop()
                if not rooms[room]:
                    free ^= 1 << room
            else:
                room, first, held = capacity, made, -(-(n - at) // (capacity // length))
                made += held
            per = room // length
            used = min(held, -(-(n - at) // per))
            whole = min(used, (n - at) // per)
            parts = [(first, whole, per * whole, room - per * length)]
            if used > whole:
                rest = n - at - per * whole
                parts.append((first + whole, 1, rest, room - rest * length))
            for begin, bins, some, left in parts:
                if bins:
                    runs.append((length, at, at + some, per, begin, capacity - room))
                    at += some
                    rooms.setdefault(left, []).append((begin, bins))
                    free |= 1 << left
            if held > used:
                rooms.setdefault(room, []).append((first + used, held - used))
                free |= 1 << room
    return runs, {room: groups for room, groups in rooms.items() if groups}


def planned(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[int, int, int, int, int, int, int | None]]:
    """Runs of one node, cut where sequences that go up meet final ones; slack -1: all are final."""
    runs, rooms = best_fit(counts, capacity)
    bins = sorted((first, n, room >= slack > -1) for room, groups in rooms.items() for first, n in groups)
    starts, last = np.array([b[0] for b in bins]), len(bins)
    out, passed = [], dict.fromkeys(counts, 0)
    for length, lo, hi, per, first, place in runs:
        k = int(np.searchsorted(starts, first, side="right")) - 1
        at = lo
        while at < hi:
            own, goes_up = first + (at - lo) // per, bins[k][2]
            while k + 1 < last and bins[k + 1][2] == goes_up and bins[k + 1][0] < first + -(-(hi - lo) // per):
                k += 1
            to = min(hi, lo + (bins[k][0] + bins[k][1] - first) * per)
            out.append((length, at, to, per, own, place, passed[length] if goes_up else None))
            passed[length] += (to - at) * goes_up
            at, k = to, k + 1
    return out


def planner(capacity: int, slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads rows (node, length, n) sorted by node."""
        now, counts = None, {}

        def done() -> pa.RecordBatch:
            rows = [(now, *r) for r in planned(counts, capacity, slack)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], PLAN_NAMES)

        for batch in batches:
            for node, length, n in zip(*(batch.column(c).to_pylist() for c in ("node", "length", "n")), strict=True):
                if node != now:
                    if counts:
                        yield done()
                    now, counts = node, {}
                counts[length] = n
        if counts:
            yield done()

    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int | None = None, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of docs with sequence_id and offset.

    slack: a sequence with fewer free places is nearly full (a 256th of the capacity, if it isn't given). fan_in: nodes whose underfull sequences meet in one of the next
    round.
    """
    slack = max(1, capacity // 256) if slack is None else slack
    cut = materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    full = F.col("length") == capacity
    out = cut.where(full).select(*OUT, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level = cut.where(~full), 0
    most = cut.agg(F.max("node")).first()[0]
    nodes = 1 if most is None else most + 1
    while True:
        level += 1
        last = nodes <= 1
        counts = rest.groupBy("node", "length").agg(F.count("*").alias("n"))
        dealt = counts.repartition("node").sortWithinPartitions("node")
        plan = materialize(arrow_map(dealt, planner(capacity, -1 if last else slack), PLAN), f"plan{level}")
        # Numbers in the parent node: after those of the same length from the children before.
        amount = F.sum(F.when(F.col("up").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0)).alias("amount")
        parent = F.floor(F.col("node") / fan_in).cast("long")
        sent = plan.groupBy("node", "length").agg(amount).withColumn("parent", parent)
        before = Window.partitionBy("parent", "length").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        base = sent.select("node", "length", F.coalesce(F.sum("amount").over(before), F.lit(0)).alias("base"))
        runs = plan.join(base, ["node", "length"])
        # Few rows go up, so they are joined with their runs by node and length, which adaptive execution may split.
        inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        keys = [rest[c] == runs[c] for c in ("node", "length")]
        met = rest.join(runs, [*keys, inside]).select(*[rest[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "node")], "rank", "lo", "per", "bin", "place", "up", "base")
        step = F.col("rank") - F.col("lo")
        width = 57 - max(1, nodes).bit_length()
        name = F.lit(level << 57) + F.shiftleft("node", width) + F.col("bin") + F.floor(step / F.col("per")).cast("long")
        spot = F.col("place") + F.pmod(step, F.col("per")) * F.col("length")
        placed = materialize(met.select(*OUT, name.alias("sequence_id"), spot.alias("offset"), parent.alias("node"), (F.col("up") + step + F.col("base")).alias("rank")), f"round{level}")
        out = out.unionByName(placed.where("rank IS NULL").select(*out.columns))
        if last:
            return out.withColumn("doc_id", id_out(F.col("doc_id")))
        rest, nodes = placed.where("rank IS NOT NULL").select(*OUT, "node", "rank"), -(-nodes // fan_in)
