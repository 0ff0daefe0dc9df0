"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words' log counts in 2**`bits` hash buckets, scaled to length 1, structure statistics
(standardised on the sample) and the logarithm of its length column where there is one. Score = sigmoid of a linear part
and of low-rank pairwise interactions, which take linear time by the identity
sum of pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

The machine is fitted by minibatch AdaGrad on a sample of at most about `max_train` labelled documents, half of each
label, weighted back to the labels' true shares. The sample's keys are all that is broadcast. Scoring reads every whole
text once, without a shuffle.

Defined cases: null and empty texts have zero statistics and get a score too; a document whose labels disagree isn't
learned from; without labels of both kinds all documents get the share of good labels (or 0.5); repeated rows are scored
each for itself; a null length counts as 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import Carried, arrow_map, forget, id_in, id_out, text_slices, words_of
from stormspan.llm.langid import segment_sums

BITS = 16
RANK = 8
MAX_TRAIN = 5000
STATS = 14


def byte_kinds() -> np.ndarray:
    """For each byte: upper, lower or beyond ASCII, digit, sign, white space, line end, sentence end, letters of any case."""
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b < 91), ((b >= 97) & (b < 123)) | (b >= 128), (b >= 48) & (b < 58)
    space = np.isin(b, (32, 9, 10, 11, 12, 13))
    return np.stack((upper, lower, digit, (b > 32) & (b < 127) & ~upper & ~lower & ~digit, space, b == 10, np.isin(b, (33, 46, 63))), 1).astype(np.float32)


def features(raw: np.ndarray, offsets: np.ndarray, length: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse words (document, bucket, value; sorted by document) and the statistics of each document."""
    n_docs = len(offsets) - 1
    h, starts, ends, first = words_of(raw, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    keys, counts = np.unique((doc << bits) | (h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    own, bucket, value = keys >> bits, keys & ((1 << bits) - 1), np.log1p(counts)
    norm = np.sqrt(np.bincount(own, value * value, n_docs))
    value = value / np.maximum(norm[own], 1e-9)
    kinds = np.stack([segment_sums(k[raw], offsets[:-1], offsets[1:]) for k in byte_kinds().T], 1)
    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(first), 1)
    signs = np.zeros(len(raw) + 1)
    np.cumsum(byte_kinds()[:, 3][raw], out=signs[1:])
    noisy = segment_sums((signs[ends] - signs[starts] >= 2).astype(np.float64), first[:-1], first[1:])
    short = segment_sums((ends - starts <= 1).astype(np.float64), first[:-1], first[1:])
    upper, lower, digit, sign, space, lines, stops = kinds.T
    stats = np.stack((
        upper / n_bytes, lower / n_bytes, digit / n_bytes, sign / n_bytes, space / n_bytes, np.log1p(n_bytes) / 10, np.log1p(n_words) / 10,
        (n_bytes - space) / n_words / 10, np.bincount(own, minlength=n_docs) / n_words, lines / n_words, stops / (lines + 1) / 10, noisy / n_words, short / n_words, np.log1p(np.maximum(length, 0)) / 10,
    ), 1)
    return own, bucket, value, stats


def lengths_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.nan_to_num(batch.column("length").fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        lengths, at = lengths_of(batch), 0
        for keys, raw, offsets in text_slices(iter([batch]), "doc_id", text):
            yield keys, raw, offsets, lengths[at : at + len(keys)]
            at += len(keys)


def extractor(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw, offsets, lengths in slices(batches):
            own, bucket, value, stats = features(raw, offsets, lengths, bits)
            cut = np.searchsorted(own, np.arange(len(keys) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32))), pa.array(stats.tolist(), pa.list_(pa.float64()))], ["doc_id", "ids", "vals", "stats"])

    return extract


class Machine:
    """Bias, linear weights and factors; the statistics come after the buckets."""

    def __init__(self, dim: int, rank: int, seed: int = 9):
        self.bias = 0.0
        self.w = np.zeros(dim, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (dim, rank)).astype(np.float32)
        self.mean, self.sd = np.zeros(STATS), np.ones(STATS)

    def inputs(self, n_docs: int, own: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and statistics as one sparse matrix, sorted by document."""
        scaled = np.clip((stats - self.mean) / self.sd, -4, 4) / 2
        base = len(self.w) - STATS
        doc = np.concatenate((own, np.repeat(np.arange(n_docs), STATS)))
        order = np.argsort(doc, kind="stable")
        return doc[order], np.concatenate((bucket, np.tile(np.arange(base, base + STATS), n_docs)))[order], np.concatenate((value, scaled.ravel()))[order]

    def logits(self, n_docs: int, doc: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and the sums of v x for each document."""
        cut = np.searchsorted(doc, np.arange(n_docs + 1))
        vx = self.v[ids] * x[:, None].astype(np.float32)
        sums = segment_sums(vx, cut[:-1], cut[1:])
        pairs = 0.5 * ((sums * sums).sum(axis=1) - segment_sums((vx * vx).sum(axis=1), cut[:-1], cut[1:]))
        return self.bias + segment_sums(self.w[ids] * x, cut[:-1], cut[1:]) + pairs, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], weights: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, l2: float = 1e-5, seed: int = 3) -> None:
        stats = np.array([r[2] for r in rows])
        self.mean, self.sd = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        y, rng = np.array([r[3] for r in rows], np.float64), np.random.default_rng(seed)
        gw, gv, gb = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for part in np.array_split(order, max(1, len(rows) // batch)):
                own = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
                doc, ids, x = self.inputs(len(part), own, np.concatenate([rows[k][0] for k in part]), np.concatenate([rows[k][1] for k in part]), stats[part])
                logit, sums = self.logits(len(part), doc, ids, x)
                err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) * weights[part] / len(part)
                uniq, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, err[doc] * x, len(uniq)) + l2 * self.w[uniq]
                slope = (err[doc] * x)[:, None] * (sums[doc] - self.v[ids] * x[:, None])
                dv = np.stack([np.bincount(back, s, len(uniq)) for s in slope.T], 1) + l2 * self.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                gb += err.sum() ** 2
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= rate * 0.3 * dv / np.sqrt(gv[uniq])
                self.bias -= rate * err.sum() / np.sqrt(gb)

    def score(self, n_docs: int, own: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        logit, _ = self.logits(n_docs, *self.inputs(n_docs, own, bucket, value, stats))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(rows: DataFrame, labels: DataFrame, learn: Column, bits: int = BITS, rank: int = RANK, max_train: int = MAX_TRAIN) -> Machine:
    """A machine from the labels (doc_id, label) that `learn`, a condition on doc_id, allows."""
    agreed = labels.where(learn & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").select("doc_id", "label")
    counts = {r.label: r.n for r in agreed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    machine = Machine((1 << bits) + STATS, rank)
    if len(counts) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        machine.bias, machine.v[:] = float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0
        return machine
    part = {k: min(1.0, max_train / 2 / n) for k, n in counts.items()}
    drawn = F.xxhash64(F.col("doc_id"), F.lit(13))
    sample = agreed.where(F.pmod(drawn, F.lit(1_000_000)) / 1e6 < F.when(F.col("label") == 1, part[1]).otherwise(part[0]))
    known = dict(sample.orderBy(drawn, "doc_id").limit(2 * max_train).select(F.col("doc_id").alias("_key"), "label").collect())
    if not known:
        machine.v[:] = 0
        return machine
    # As an Arrow table: a list goes through Python workers of another kind, which executors hold besides those of mapInArrow.
    keys = rows.sparkSession.createDataFrame(pa.table({"_key": pa.array(list(known), pa.int64())}))
    # One text for each label: of rows with equal id that whose text has the smallest hash.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "length")).alias("one")
    found = rows.join(F.broadcast(keys), F.col("doc_id") == F.col("_key"), "left_semi").groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.length")
    got = sorted(arrow_map(found, extractor(bits), "doc_id long, ids array<int>, vals array<float>, stats array<double>").collect(), key=lambda r: (r.doc_id, r.stats))
    if not got:
        machine.v[:] = 0
        return machine
    data = [(np.asarray(r.ids, np.int64), np.asarray(r.vals, np.float64), r.stats, known[r.doc_id]) for r in got]
    total = sum(counts.values())
    weights = np.array([counts[y] / total / max(1, sum(1 for d in data if d[3] == y)) for y in (0, 1)])
    machine.fit(data, weights[[d[3] for d in data]] * len(data))
    return machine


def scorer(model, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoder")
        for keys, raw, offsets, lengths in slices(batches):
            p = model.value.score(len(keys), *features(raw, offsets, lengths, bits))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(p, pa.float64())], ["doc_id", "score"])

    return score


def filterer(model, bits: int, least: float, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoder")
        for batch in batches:
            good = [model.value.score(len(keys), *features(raw, offsets, lengths, bits)) >= least for keys, raw, offsets, lengths in slices(iter([batch]), text)]
            if good:
                names = [n for n in batch.schema.names if n not in ("doc_id", "length")]
                yield batch.select(names).filter(pa.array(np.concatenate(good)))

    return keep


def _rows(docs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> list[Column]:
    return [id_in(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"), (F.col(length_col) if length_col else F.lit(None)).cast("double").alias("length")]


def score(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", bits: int = BITS, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id and score of each row of docs."""
    rows = docs.select(*_rows(docs, id_col, text_col, length_col))
    machine = fit(rows, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")), learn, bits, max_train=max_train)
    model = Carried(docs.sparkSession, machine)
    return arrow_map(rows, scorer(model, bits), "doc_id long, score double").withColumn("doc_id", id_out(F.col("doc_id")))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, least: float = 0.5, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", bits: int = BITS, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs with a score of at least `least`, all columns."""
    rows = docs.select(*_rows(docs, id_col, text_col, length_col))
    machine = fit(rows, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")), learn, bits, max_train=max_train)
    model = Carried(docs.sparkSession, machine)
    names = docs.columns
    both = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = dict(zip(names, both.columns, strict=True))
    key, _, size = _rows(both, own[id_col], own[text_col], own.get(length_col) if length_col else None)
    kept = arrow_map(both.select(*both.columns, key, size), filterer(model, bits, least, own[text_col]), both.schema)
    return kept.toDF(*names)
