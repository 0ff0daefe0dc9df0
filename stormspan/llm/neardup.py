"""MinHash near-duplicates: banding, signature verification, exact confirmation, alternating-star components.

1. Each text becomes its set of word shingles (64-bit hashes) and many universal hash minima, cut into bands. The number
   of bands follows from the threshold t: with `rows` minima a band, a pair at t meets in some band but for a chance of
   `miss`. Documents with equal sets are one class from here on; a class is aggregated before the shuffle, so a group of
   copies of any size is one row.
2. Classes that meet in a band bucket are linked to the bucket's smallest class (never to each other, so a bucket gives
   one row for each member) and fall into candidate components.
3. A candidate component is dealt to blocks of about `block` classes, each of which also gets the first block. In a
   block, pairs whose signatures agree well enough (`margin` standard deviations below t) are confirmed on the full
   sets, the likeliest first; pairs that are connected already need no check. Confirmed links give components.
4. Of a component of several blocks, classes outside its largest part are compared with all the component's classes in
   a grid of blocks. So each pair of the component that isn't connected has been checked, while a dense group, however
   large, is compared with one block only. A component of more than `wide` blocks (which chains of weakly alike classes
   make) isn't compared as a whole but bucket by bucket: in each bucket the classes outside the largest part with all of
   the bucket, in a grid of blocks again, since pairs that meet in no bucket are no candidates. No list of pairs is ever made.

Minima and counts of groups are written before they are joined with the groups' rows: adaptive execution can split a hot
group only if neither side of a join is an aggregation of the same dealing.

Defined cases: without a word the set is empty and linked with nothing; with fewer words than a shingle the whole
sequence is the one shingle; the graph's nodes are rows, numbered in a written copy, so rows of equal or null id are told
apart; in a component the row with the smallest id is kept (null ids come last, then the row number decides), and only
that one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import U64, arrow_map, forget, id_in, id_out, longs, materialize, mix, plain_names, seeded, text_slices, window_hashes, words_of
from stormspan.llm.components import components
from stormspan.llm.sketch import Among

ROWS = 5
MISS = 1e-6
MARGIN = 5.0
BLOCK = 512
WIDE = 16


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(keys: np.ndarray, raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Key and sorted distinct shingle hashes of each document."""
    h, _, _, first = words_of(raw, offsets, lower=True)
    long_ones = window_hashes(h, words, 5)
    for key, a, b in zip(keys.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield key, np.unique(long_ones[a : b - words + 1])
        elif b > a:
            yield key, window_hashes(h[a:b], b - a, 5)
        else:
            yield key, np.zeros(0, U64)


def signature(own: np.ndarray, n: int) -> np.ndarray:
    """n minima of multiply-shift hashes."""
    a, b = seeded(n, 21) | U64(1), seeded(n, 22)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 1024):
        np.minimum(out, ((own[at : at + 1024, None] * a + b) >> U64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def sketcher(words: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoder")
        salt = seeded(bands, 31)
        for keys, raw, offsets, docs in text_slices(batches, "row", "text", also="doc_id"):
            ids, sizes, sums, keys_out = [], [], [], []
            for key, own in shingle_sets(keys, raw, offsets, words):
                ids.append(key)
                sizes.append(len(own))
                with np.errstate(over="ignore"):
                    sums.append((mix(own + U64(1)).sum(dtype=U64), mix(own + U64(2)).sum(dtype=U64)))
                if len(own):
                    sig = signature(own, bands * rows).reshape(bands, rows).astype(U64)
                    code = salt.copy()
                    for k in range(rows):
                        code = mix(code ^ sig[:, k])
                    keys_out.append(code.view(np.int64))
                else:
                    keys_out.append(None)
            both = np.array(sums, U64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), longs(both[:, 0].copy()), longs(both[:, 1].copy()), pa.array(keys_out, pa.list_(pa.int64()))], ["row", "doc_id", "n", "s1", "s2", "bands"])

    return sketch


def setter(words: int, among: Among) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The shingle set, as bytes, of each document that may be among the wanted ones."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw, offsets in text_slices(among.chosen(batches), "row", "text"):
            own = [x.tobytes() for _, x in shingle_sets(keys, raw, offsets, words)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.binary())], ["row", "own"])

    return make


def confirmed(ids: list[int], sets: list[np.ndarray], parts: list[int], threshold: float, margin: float) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets; parts: 1 outsiders, 0 others, compared with outsiders only, if there are both; 2 all with all."""
    sizes = np.array([len(s) for s in sets])
    n_hash = 128
    sigs = np.array([signature(s, n_hash) for s in sets])
    kind = np.array(parts)
    least = threshold - margin * math.sqrt(threshold * (1 - threshold) / n_hash)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        est = (sigs[rest] == sigs[i]).mean(axis=1)
        sized = np.minimum(sizes[rest], sizes[i]) >= (threshold - 1e-9) * np.maximum(sizes[rest], sizes[i])
        hit = np.flatnonzero((est >= least) & sized & ((kind[rest] > 0) | (kind[i] > 0)))
        if len(hit):
            pairs.append((np.full(len(hit), i), hit + i + 1, est[hit]))
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    if pairs:
        a, b, est = (np.concatenate(x) for x in zip(*pairs, strict=True))
        percent = round(threshold * 100)
        for k in np.argsort(-est, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            ri, rj = find(i), find(j)
            if ri == rj:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[ri] = rj
                links.append((ids[i], ids[j]))
    return links


def confirmer(threshold: float, margin: float) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads rows sorted by block."""
        now, ids, sets, parts = None, [], [], []

        def done() -> pa.RecordBatch:
            links = confirmed(ids, sets, parts, threshold, margin)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

        for batch in batches:
            for key, row, part, own in zip(batch.column("blk").to_pylist(), batch.column("row").to_pylist(), batch.column("part").to_pylist(), batch.column("own"), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield done()
                    now, ids, sets, parts = key, [], [], []
                ids.append(row)
                parts.append(part)
                sets.append(np.frombuffer(own.as_py(), U64))
        if len(ids) > 1:
            yield done()

    return confirm


def _links(blocks: DataFrame, threshold: float, margin: float) -> DataFrame:
    dealt = blocks.repartition("blk").sortWithinPartitions("blk", "row")
    return arrow_map(dealt, confirmer(threshold, margin), "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, rows: int = ROWS, miss: float = MISS, margin: float = MARGIN, block: int = BLOCK, wide: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (smallest id of what it is linked with, itself included), kept (true for one row of each component)."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), id_in(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text")), "numbered")
    return _judged(numbered, threshold, words, rows, miss, margin, block, wide).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(rows_in: DataFrame, threshold: float = 0.8, words: int = 5, rows: int = ROWS, miss: float = MISS, margin: float = MARGIN, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """near_duplicates with the column row, over written rows (row, doc_id, text)."""
    light = materialize(arrow_map(rows_in, sketcher(words, n_bands(threshold, rows, miss), rows), "row long, doc_id long, n long, s1 long, s2 long, bands array<long>"), "sketches")
    classes = light.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("bands").alias("bands")).withColumn("rep", F.col("least.row"))
    classes = materialize(classes, "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    centres = materialize(banded.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("band", "centre"), "centres")
    candidates = components(banded.join(centres.hint("merge"), "band").where("rep > centre").select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct())
    counts = materialize(candidates.groupBy("component").agg(F.count("*").alias("members")), "counts")
    sized = materialize(candidates.join(counts, "component").select(F.col("node").alias("_rep"), F.col("component").alias("grp"), "members"), "candidates")
    # Sets of candidates are made where texts are read; only they are shuffled.
    made = arrow_map(rows_in.select("row", "text"), setter(words, Among(sized.select(F.col("_rep").alias("row")), "row")), "row long, own binary").where("length(own) > 0")
    sets = materialize(made.join(sized.hint("merge"), F.col("row") == F.col("_rep")).select("row", "grp", "members", "own"), "sets")

    # Blocks of a component: by hash, the first also with every other.
    blocks = F.ceil(F.col("members") / block).cast("long")
    own_block = F.pmod(F.xxhash64("row"), blocks)
    every = F.when(own_block == 0, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own_block))
    first = sets.select("row", "own", F.lit(2).alias("part"), "grp", F.explode(every).alias("_b")).select("row", "own", "part", F.xxhash64("grp", "_b").alias("blk"))
    links = materialize(_links(first, threshold, margin), "links")

    # Classes outside the largest part of a component of several blocks, or of its buckets, against all of it.
    wide_sets = sets.where(blocks > 1)
    large = wide_sets.select("row", "grp", "members")
    if large.limit(1).count():
        parts = components(links.join(large.select(F.col("row").alias("u")), "u", "left_semi"))
        placed = materialize(large.join(parts, F.col("row") == F.col("node"), "left").select("row", "grp", "members", F.coalesce("component", "row").alias("cc")), "placed")
        chained = F.col("members") > wide * block
        in_buckets = placed.where(chained).join(banded.join(centres.select("band"), "band", "left_semi"), F.col("row") == F.col("rep")).select("row", F.xxhash64("band", F.lit("bucket")).alias("grp"), "cc")
        cells = materialize(placed.where(~chained).select("row", "grp", "cc").unionByName(in_buckets), "cells")
        shares = cells.groupBy("grp", "cc").agg(F.count("*").alias("n"))
        main = materialize(shares.groupBy("grp").agg(F.max_by("cc", F.struct("n", "cc")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0"), "main")
        flags = cells.join(main, "grp").select(F.col("row").alias("_d"), "grp", (F.col("cc") != F.col("main")).alias("out"), "all", "outside")
        grid = wide_sets.select("row", "own").join(flags, F.col("row") == F.col("_d"))
        strips, blocks = (F.ceil(F.col(c) / block).cast("long") for c in ("outside", "all"))
        strip, col = F.pmod(F.xxhash64("row", F.lit(1)), strips), F.pmod(F.xxhash64("row", F.lit(2)), blocks)
        outs = grid.where("out").select("row", "own", F.lit(1).alias("part"), "grp", strip.alias("_r"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_c"))
        alls = grid.select("row", "own", F.lit(0).alias("part"), "grp", F.explode(F.sequence(F.lit(0).cast("long"), strips - 1)).alias("_r"), col.alias("_c"))
        second = outs.unionByName(alls).select("row", "own", "part", F.xxhash64("grp", "_r", "_c").alias("blk"))
        links = links.unionByName(materialize(_links(second, threshold, margin), "links2"))
    final = materialize(components(links).join(classes.select("rep", "least"), F.col("node") == F.col("rep")).select("node", "component", "least"), "final")
    label = materialize(final.groupBy("component").agg(F.min("least").alias("first")), "label")
    placed_reps = final.select("node", "component").join(label, "component").select("node", "first")

    named = classes.join(placed_reps, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("first", "least").alias("first"))
    out = light.select("row", "doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select("row", id_out(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), id_out(F.coalesce("first.doc_id", "doc_id")).alias("component_id"), (F.col("row") == F.coalesce("first.row", "row")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that with the smallest id."""
    own, names = plain_names(docs)
    numbered = materialize(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
    rows_in = numbered.select("row", id_in(F.col(names[id_col])).alias("doc_id"), F.col(names[text_col]).alias("text"))
    gone = _judged(rows_in, threshold, words, **options).where("NOT kept").select(F.col("row").alias("_gone"))
    return numbered.join(gone, F.col("row") == F.col("_gone"), "left_anti").drop("row").toDF(*docs.columns)
