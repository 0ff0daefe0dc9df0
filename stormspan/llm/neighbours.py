"""Approximate nearest neighbours by inner product: stable projections, kd-trees, chi-square stopping.

Vectors get one more component so that all have the largest norm; then the largest inner product is the smallest
Euclidean distance. A 2-stable (Gaussian) projection to `m` dimensions makes a projected squared distance a chi-square
variable with m degrees of freedom times the true one. The top of a kd-tree over projections, fitted on a bounded sample,
deals all vectors to cells; cells with more than `block` vectors are split further by a hash. Each block builds its own
kd-tree. A query walks its leaves in the order of their projected distance and verifies their vectors exactly, until
psi_m(next projected distance^2 / k-th distance^2) >= `sure`: then a nearer vector is yet unseen with a chance of
1 - sure at most. First a query is searched in its home block, which bounds its k-th distance; then only in blocks that
the same test doesn't rule out. So `sure` is also the expected recall.

Of equal vectors only the k + 1 smallest ids are indexed, chosen before the shuffle where that is possible; a longer list
of copies can't appear in any answer. Blocks hold a bounded number of candidates; queries stream past them.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length from most, take no
part, and null ids neither; repeated rows count once; ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormspan.llm.common import Carried, arrow_map, materialize

M = 8
SURE = 0.95
BLOCK = 8192
LEAF = 64
SAMPLE = 20_000
#: Points of the sample for each cell of the top at least; beyond that cells are split by a hash.
POINTS = 8
#: Relative error of an inner product of some thousand components in double precision, with room to spare.
SLACK = 1e-11
FOUND = "query_id long, vec_id long, score double"
FOUND_NAMES = ["query_id", "vec_id", "score"]


def psi(x: np.ndarray, m: int = M) -> np.ndarray:
    """Distribution function of chi-square with an even number m of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, m // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


class Projection:
    def __init__(self, dim: int, norm: float, m: int = M, seed: int = 17):
        self.matrix, self.norm = np.random.default_rng(seed).normal(size=(dim + 1, m)), norm

    def candidates(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]


class Top:
    """Median splits over a sample: dimension and value of each inner node of a complete tree, and the box of each cell."""

    def __init__(self, sample: np.ndarray, cells: int, m: int = M):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.axis, self.value = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        self.low, self.high = np.full((1 << self.depth, m), -np.inf), np.full((1 << self.depth, m), np.inf)
        self._split(1, sample, np.full(m, -np.inf), np.full(m, np.inf))

    def _split(self, node: int, points: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if node >= 1 << self.depth:
            self.low[node - (1 << self.depth)], self.high[node - (1 << self.depth)] = low, high
            return
        if len(points):
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            value = float(np.median(points[:, axis]))
        else:
            axis, value = 0, float(np.clip(0.0, low[0], high[0]))
        self.axis[node], self.value[node] = axis, value
        left = points[:, axis] < value
        upto, onward = high.copy(), low.copy()
        upto[axis], onward[axis] = value, value
        self._split(2 * node, points[left], low, upto)
        self._split(2 * node + 1, points[~left], onward, high)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return node - (1 << self.depth)

    def near(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each cell."""
        return box_distances(point, self.low, self.high)


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.maximum(np.maximum(low - point, point - high), 0)
    return (out * out).sum(axis=1)


class Tree:
    """kd-tree of a block's projections: vectors in leaf order, and each leaf's range and box."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projected: np.ndarray):
        order, cuts = [], [0]
        stack = [np.arange(len(ids))]
        while stack:
            own = stack.pop()
            if len(own) <= LEAF:
                order.append(own)
                cuts.append(cuts[-1] + len(own))
                continue
            p = projected[own]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            half = np.argpartition(p[:, axis], len(own) // 2)
            stack += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
        at = np.concatenate(order)
        self.norm = math.sqrt(float((x * x).sum(axis=1).max())) if len(x) else 0.0
        self.ids, self.x, self.cuts = ids[at], np.ascontiguousarray(x[at]), np.array(cuts)
        p = projected[at]
        self.low, self.high = np.minimum.reduceat(p, self.cuts[:-1]), np.maximum.reduceat(p, self.cuts[:-1])

    def search(self, query_id: int, q: np.ndarray, projected: np.ndarray, k: int, bound: float, base: float, sure: float) -> list[tuple[float, int]]:
        """(score, id) of the k best, of those that beat or tie `bound`; base - 2 score is the squared distance."""
        near = box_distances(projected, self.low, self.high)
        walk = np.argsort(near, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < len(walk):
            kth = bound if len(scores) < k else max(bound, float(np.partition(scores, -k)[-k]))
            if kth > -np.inf and psi(near[walk[at]] / max(base - 2 * kth, 1e-12)) >= sure:
                break
            rows = np.concatenate([np.arange(self.cuts[j], self.cuts[j + 1]) for j in walk[at : at + step]])
            rough = self.x[rows] @ q
            # Both sums may be off by a share of their terms' sizes; what could tie is computed again, exactly as it is returned.
            off = SLACK * math.sqrt(base)
            rows = rows[(rough >= kth - off * self.norm) & (self.ids[rows] != query_id)]
            ids = np.concatenate((ids, self.ids[rows]))
            scores = np.concatenate((scores, (self.x[rows] * q).sum(axis=1)))
            if len(scores) > 4 * k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            at, step = at + step, step * 2
        best = np.lexsort((ids, -scores))[:k]
        return [(float(scores[j]), int(ids[j])) for j in best if scores[j] >= bound]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def placer(model, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, top = (m.value for m in model)
        for batch in batches:
            x = matrix(batch.column("vec"), dim)
            query = batch.column("query").to_numpy(zero_copy_only=False)
            p = np.where(query[:, None], projection.queries(x), projection.candidates(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), batch.column("query"), pa.array(top.cells(p), pa.int64())], ["vec_id", "vec", "query", "cell"])

    return place


def searcher(model, dim: int, k: int, sure: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads rows sorted by block, candidates before queries."""
        projection = model[0].value
        now, held, tree = None, [], None
        for batch in batches:
            blocks, query = batch.column("blk").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            ids, bounds = batch.column("vec_id").to_numpy(), batch.column("bound").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("vec"), dim)
            cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (query[1:] != query[:-1]))))
            for a, b in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                if blocks[a] != now:
                    now, held, tree = blocks[a], [], None
                if not query[a]:
                    held.append((ids[a:b], x[a:b]))
                    continue
                if not held:
                    continue
                if tree is None:
                    both = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    tree = Tree(*both, projection.candidates(both[1]))
                p = projection.queries(x[a:b])
                out = []
                for j in range(a, b):
                    base = float(x[j] @ x[j]) + projection.norm**2
                    out += [(int(ids[j]), i, s) for s, i in tree.search(int(ids[j]), x[j], p[j - a], k, float(bounds[j]), base, sure)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], FOUND_NAMES)

    return search


def router(model, dim: int, sizes: dict[int, int], sure: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each other block that a query's bound doesn't rule out."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, top = (m.value for m in model)
        for batch in batches:
            x = matrix(batch.column("vec"), dim)
            p = projection.queries(x)
            bounds, homes = batch.column("bound").to_numpy(zero_copy_only=False), batch.column("blk").to_numpy()
            at, blocks = [], []
            for j in range(len(x)):
                base = float(x[j] @ x[j]) + projection.norm**2
                near = psi(top.near(p[j]) / max(base - 2 * bounds[j], 1e-12)) < sure if bounds[j] > -np.inf else np.ones(len(top.low), bool)
                own = [(c << 20) + s for c in np.flatnonzero(near).tolist() for s in range(sizes.get(c, 0)) if (c << 20) + s != homes[j]]
                at += [j] * len(own)
                blocks += own
            for s in range(0, len(at), 20_000):
                part = batch.take(pa.array(at[s : s + 20_000], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vec"), part.column("query"), part.column("bound"), pa.array(blocks[s : s + 20_000], pa.int64())], ["vec_id", "vec", "query", "bound", "blk"])

    return route


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sure: float = SURE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors for each row of queries but its own id."""

    def valid(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
        bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda v: v != 0))

    spark, known = vectors.sparkSession, valid(vectors)
    lengths = known.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("sq")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim, total, norm = lengths.d, lengths.n, math.sqrt(lengths.sq)
    known, asked = known.where(F.size("vec") == dim), valid(queries).where(F.size("vec") == dim).dropDuplicates(["vec_id", "vec"])
    copies = Window.partitionBy("vec").orderBy("vec_id")
    indexed = known.withColumn("_r", F.dense_rank().over(copies)).where(F.col("_r") <= k + 1).select("vec_id", "vec").dropDuplicates(["vec", "vec_id"])
    projection = Projection(dim, norm)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(19)), F.lit(1_000_000)) < int(min(1.0, SAMPLE / total) * 1_000_000)
    sample = known.where(draw).orderBy(F.xxhash64("vec_id", F.lit(19)), "vec_id", F.xxhash64("vec")).select("vec").limit(2 * SAMPLE).toPandas()["vec"]
    points = projection.candidates(np.stack([np.asarray(v, float) for v in sample])) if len(sample) else np.zeros((0, M))
    model = Carried(spark, projection), Carried(spark, Top(points, min(-(-total // block), max(1, len(points) // POINTS))))
    both = indexed.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)))
    placed = materialize(arrow_map(both, placer(model, dim), f"vec_id long, vec {vectors.schema[vector_col].dataType.simpleString()}, query boolean, cell long"), "placed")
    counts = placed.where("NOT query").groupBy("cell").agg(F.count("*").alias("n")).withColumn("subs", F.ceil(F.col("n") / (1.5 * block)).cast("long")).select("cell", "subs")
    sizes = {r.cell: r.subs for r in counts.collect()}
    table = F.broadcast(spark.createDataFrame(list(sizes.items()), "cell long, subs long"))
    dealt = placed.join(table, "cell", "left").withColumn("blk", F.shiftleft("cell", 20) + F.pmod(F.xxhash64("vec_id"), F.coalesce("subs", F.lit(1).cast("long")))).select("vec_id", "vec", "query", F.lit(float("-inf")).alias("bound"), "blk")
    sweep = searcher(model, dim, k, sure)
    home = materialize(arrow_map(dealt.repartition("blk").sortWithinPartitions("blk", "query"), sweep, FOUND), "home")
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("_q"), F.when(F.col("n") >= k, F.col("least")).alias("_b"))
    bounded = dealt.where("query").join(kth, F.col("vec_id") == F.col("_q"), "left").select("vec_id", "vec", "query", F.coalesce("_b", F.lit(float("-inf"))).alias("bound"), "blk")
    routed = arrow_map(bounded, router(model, dim, sizes, sure), "vec_id long, vec " + vectors.schema[vector_col].dataType.simpleString() + ", query boolean, bound double, blk long")
    away = arrow_map(dealt.where("NOT query").unionByName(routed).repartition("blk").sortWithinPartitions("blk", "query"), sweep, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(away).dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
