"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased, everything that isn't a letter is a space, and n-grams of 1 to 3 characters fall into
2**`bits` hash buckets. A document's feature is the share of its n-grams in a bucket times the bucket's inverse document
frequency. Weights are trained with follow-the-regularised-leader (proximal, elastic net: L1 keeps them sparse) and the
probabilities are calibrated by one temperature, fitted on a fifth of the sample that the weights never see.

Document frequencies cover all documents that may be learned from; they leave a task as one row for each bucket. Weights
are fitted on a sample of at most about `max_train` of them, shared evenly by the languages, or of `MIN_PER_LANG` for each
language if that is more; a language adds 131 kB of weights. A prediction reads the whole
text, in time proportional to its length, and nothing but the text.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is everything if there is nothing to learn
from; every language that occurs is learned; repeated rows are predicted each for itself; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import MULT, U64, arrow_map, id_in, id_out, kept, text_slices

BITS = 15
LENGTHS = (1, 2, 3)
SCALE = 30.0
MAX_TRAIN = 2000
#: A language is learned from so many documents at least, if it has them, however many languages there are.
MIN_PER_LANG = 8
#: Weights looked up at once in a prediction.
HELD = 1 << 20

def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: lower case (a space for what isn't a letter), and whether it is a letter."""
    if "letters" not in kept():
        points = [chr(i) for i in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in points), bool, len(points))
        lower = np.full(len(points), 32, np.uint32)
        lower[letter] = [ord(points[i].lower()[0]) for i in np.flatnonzero(letter)]
        kept()["letters"] = lower, letter
    return kept()["letters"]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all documents and the offset of each."""
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
        return points, before[offsets]
    except UnicodeDecodeError:
        parts = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def buckets(points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the bucket of the n-gram that starts at each code point."""
    h = np.zeros(len(points), U64)
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(points) - n + 1] * U64(0x100000001B3) + points[n - 1 :].astype(U64) + U64(n)
        if n in LENGTHS:
            yield n, ((h * U64(MULT)) >> U64(64 - bits)).astype(np.int64)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] along the first axis; 0 where nothing is between."""
    out = np.zeros((len(starts), *values.shape[1:]), np.float64)
    has = ends > starts
    if has.any():
        padded = np.concatenate((values, np.zeros((1, *values.shape[1:]), values.dtype)))
        out[has] = np.add.reduceat(padded, np.stack((starts[has], ends[has]), 1).ravel(), axis=0, dtype=np.float64)[::2]
    return out


def document_frequencies(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_docs = np.zeros(1 << bits, np.int64), 0
        for keys, raw, offsets in text_slices(batches, "doc_id", "text"):
            points, offs = code_points(raw, offsets)
            points = tables()[0][points]
            n_docs += len(keys)
            for at in range(0, len(keys), 256):
                own = offs[at : at + 257]
                part = points[own[0] : own[-1]]
                doc = np.repeat(np.arange(len(own) - 1), np.diff(own))
                seen = np.zeros((len(own) - 1, 1 << bits), bool)
                for n, b in buckets(part, bits):
                    inside = doc[: len(b)] == doc[n - 1 :]
                    seen[doc[: len(b)][inside], b[inside]] = True
                total += seen.sum(axis=0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int32()), pa.array([n_docs, *total[held].tolist()], pa.int64())], ["bucket", "n"])

    return count


def shares(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sparse n-gram shares of the sampled documents."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = dict(zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), strict=True))
            for keys, raw, offsets in text_slices(iter([batch]), "doc_id", "text"):
                points, offs = code_points(raw, offsets)
                points = tables()[0][points]
                ids, values, docs = [], [], []
                for key, a, b in zip(keys.tolist(), offs[:-1], offs[1:], strict=True):
                    counts = sum(np.bincount(x, minlength=1 << bits) for _, x in buckets(points[a:b], bits)) if b > a + 2 else np.zeros(1 << bits)
                    held = np.flatnonzero(counts)
                    if len(held):
                        docs.append(key)
                        ids.append(held.astype(np.int32))
                        values.append((counts[held] / counts.sum()).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([langs[d] for d in docs], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "lang", "ids", "vals"])

    return extract


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 5) -> np.ndarray:
    """Weights (dim x classes) by FTRL-proximal with an elastic net."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    order = np.random.default_rng(seed)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            ids, x, y = rows[k]
            w = weights(ids)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            n_new = n[ids] + g * g
            z[ids] += g - (np.sqrt(n_new) - np.sqrt(n[ids])) / alpha * w
            n[ids] = n_new
    return weights(slice(None))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        return float(-np.log(softmax(scores / np.exp(log_t))[np.arange(len(y)), y] + 1e-12).mean())

    lo, hi, r = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, learn: Column, bits: int = BITS, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, float]:
    """Languages, weights (idf included) and temperature from the rows (doc_id, text, lang) that `learn` allows."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs = sorted(r.lang for r in found)
    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32), 1.0
    df = arrow_map(known.select("doc_id", "text"), document_frequencies(bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n_docs = sum(r.n for r in df if r.bucket < 0)
    idf = np.full(1 << bits, np.log(1 + n_docs))
    for r in df:
        if r.bucket >= 0:
            idf[r.bucket] = np.log((1 + n_docs) / (1 + r.n)) + 0.05
    each = max(MIN_PER_LANG, max_train / len(langs))
    shares_of = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in found], "_lang string, _share double")
    drawn = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(11))
    sample = known.join(F.broadcast(shares_of), F.col("lang") == F.col("_lang")).where(F.pmod(drawn, F.lit(1_000_000)) / 1e6 < F.col("_share"))
    sample = sample.orderBy(drawn, "doc_id", "lang").limit(2 * int(each * len(langs))).select("doc_id", "text", "lang")
    rows = arrow_map(sample, shares(bits), "doc_id long, lang string, ids array<int>, vals array<float>").collect()
    place = {x: i for i, x in enumerate(langs)}
    data = [(i := np.asarray(r.ids), np.asarray(r.vals, np.float64) * idf[i] * SCALE, place[r.lang]) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang))]
    keep, apart = [d for k, d in enumerate(data) if k % 5], data[::5]
    w = ftrl(keep or data, 1 << bits, len(langs))
    t = temperature(np.array([x @ w[i] for i, x, _ in apart]).reshape(len(apart), len(langs)), np.array([y for *_, y in apart], int)) if keep else 1.0
    return langs, (w * (idf * SCALE)[:, None] / t).astype(np.float32), t


def predictor(model, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w = model.value
        names = np.array([*langs, "und"], object)
        for keys, raw, offsets in text_slices(batches, "doc_id", "text", 1 << 20):
            points, offs = code_points(raw, offsets)
            lower, letter = tables()
            letters = segment_sums(letter[points].astype(np.int64), offs[:-1], offs[1:])
            scores, total = np.zeros((len(keys), len(langs))), np.zeros(len(keys))
            for n, b in buckets(lower[points], bits) if langs else ():
                ends = np.maximum(offs[1:] - n + 1, offs[:-1])
                step = max(1, HELD // len(langs))
                for at in range(0, len(b), step):  # bounded, however long a text and however many languages
                    to = min(at + step, len(b))
                    own = slice(int(np.searchsorted(ends, at, side="right")), int(np.searchsorted(offs[:-1], to)))
                    scores[own] += segment_sums(w[b[at:to]], np.clip(offs[:-1][own], at, to) - at, np.clip(ends[own], at, to) - at)
                total += ends - offs[:-1]
            best, top = np.full(len(keys), len(langs)), np.zeros(len(keys))
            has = (letters > 0) & bool(langs)
            if has.any():
                p = softmax(scores[has] / np.maximum(total[has], 1)[:, None])
                best[has], top[has] = p.argmax(axis=1), p.max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names[best], pa.string()), pa.array(np.clip(top, 0, 1), pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, learn: Column, bits: int = BITS, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score of each row of docs. learn: the rows that may be learned from, as a condition on doc_id."""
    rows = docs.select(id_in(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs, w, _ = fit(rows, learn, bits, max_train)
    model = docs.sparkSession.sparkContext.broadcast((langs, w))
    return arrow_map(rows.select("doc_id", "text"), predictor(model, bits), "doc_id long, lang_pred string, score double").withColumn("doc_id", id_out(F.col("doc_id")))
