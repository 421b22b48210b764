"""Approximate largest inner products: few stable projections, kd-trees over them, and a chi-square stopping test.

A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query
(q, 0); then |x' - q'|^2 = M^2 + |q|^2 - 2 x.q, so the nearest is the one with
the largest inner product. PROJECTIONS Gaussian projections keep distances: the
squared projected distance over the squared true one is chi-square with as many
degrees of freedom. A search walks the leaves of a kd-tree over the projections
in order of their projected distance, and within a leaf takes only points whose
own projected distance passes the test; those are verified on the original
components. The test fails a point, and the search stops at a leaf, where a
vector as near as the k-th found so far would, with probability `sure`, have
been projected nearer.

A coarse kd-tree, fitted on a bounded sample, cuts space into cells; every row
is in one, and a cell of many rows is cut into blocks by hash. A query searches
the cell it lies in first, and then those that its k-th distance doesn't rule
out by the same test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepared, written

PROJECTIONS = 16
#: Rows of the sample that the coarse tree is fitted on, and cells at most.
SAMPLE, CELLS = 20_000, 4096
#: Rows of a block, and of a leaf in it.
BLOCK, LEAF = 4096, 256


def chi_square(x: float, m: int = PROJECTIONS) -> float:
    """Probability that a chi-square variable with an even number m of degrees of freedom is at most x."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= (x / 2) / (i + 1)
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int = PROJECTIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def _directions(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims + 1, PROJECTIONS))


def _usable(vector: str):
    """Neither null nor zero, without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Cells:
    """A coarse kd-tree: split axes and values in heap order, cells numbered from left to right."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        parts = {1: points}
        for node in range(1, 1 << depth):
            p = parts.pop(node)
            if len(p):
                axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                self.axis[node], self.value[node] = axis, np.median(p[:, axis])
            left = p[:, self.axis[node]] < self.value[node]
            parts[2 * node], parts[2 * node + 1] = p[left], p[~left]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return node - (1 << self.depth)


class _Tree:
    """A kd-tree over the projections of one block, kept as the boxes of its leaves from left to right."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> None:
        order, cuts = np.arange(len(ids)), [0]

        def build(a: int, b: int) -> None:
            if b - a <= LEAF:
                cuts.append(b)
                return
            own = points[order[a:b]]
            axis, mid = int(np.argmax(own.max(axis=0) - own.min(axis=0))), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            build(a, a + mid)
            build(a + mid, b)

        build(0, len(ids))
        self.ids, self.vectors, self.points, self.cuts = ids[order], vectors[order], points[order], cuts
        self.verified = 0  # rows whose inner product was taken, over all searches
        points = self.points
        self.squares = (points * points).sum(axis=1)
        self.low, self.high = np.minimum.reduceat(points, cuts[:-1]), np.maximum.reduceat(points, cuts[:-1])

    def search(self, q: np.ndarray, point: np.ndarray, own: int, k: int, constant: float, ruled: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and inner products of the k best. constant: M^2 + |q|^2; ruled: the chi-square quantile; bound: a k-th inner product known from elsewhere."""
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        kth, slack = bound, 1e-9 * constant
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (gap * gap).sum(axis=1)
        apart = self.squares + float(point @ point) - 2 * (self.points @ point)  # squared projected distances
        for leaf in np.argsort(far, kind="stable").tolist():
            if far[leaf] > ruled * max(constant - 2 * kth, 0.0):
                break
            a, b = self.cuts[leaf], self.cuts[leaf + 1]
            near = a + np.flatnonzero(apart[a:b] <= ruled * max(constant - 2 * kth, 0.0))
            self.verified += len(near)
            # a matrix product sums in an order of its own: it only tells which rows are worth the exact sum
            near = near[self.vectors[near] @ q >= kth - slack]
            if not len(near):
                continue
            score, ids = (self.vectors[near] * q).sum(axis=1), self.ids[near]
            keep = (score >= kth) & (ids != own)
            best_ids, best = np.concatenate([best_ids, ids[keep]]), np.concatenate([best, score[keep]])
            if len(best) >= k:
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
                kth = max(kth, float(best[-1]))
        return best_ids, best


def nearest(table: DataFrame, *, every: int = 20, k: int = 20, sure: float = 0.9, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query.

    table: vec_id, embedding. Queries are the rows whose id is divisible by
    `every`; candidates are all rows with another id. Scores are sums in double
    precision of the original components; ties go to the smaller id, and all
    candidates are returned if there are fewer than k. Vectors that are null,
    zero, or hold null or non-finite components take no part; nor do rows
    without id or with another number of components than most have (the
    smallest such number on ties). Rows that repeat an id are candidates each,
    and as queries the one whose vector sorts first stands for all. An empty
    table gives none. Other columns are ignored.
    """
    spark = table.sparkSession
    prepared(spark)
    out = "query_id long, rank int, vec_id long, score double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable("v"))
    common = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)).alias("m2")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], out)
    dims, count, m2 = common["dims"], common["n"], float(common["m2"])
    rows = rows.where(F.size("v") == dims)
    directions, ruled = _directions(dims, seed), quantile(sure)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))[:, None]], axis=1) @ directions

    share = min(1.0, SAMPLE / count)
    sample = rows.where((F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)) < share).select("v").limit(2 * SAMPLE).toPandas()
    points = lifted(np.array(sample["v"].tolist(), np.float64)) if len(sample) else np.zeros((0, PROJECTIONS))
    depth = max(0, min(int(math.log2(CELLS)), int(math.log2(max(1, count / BLOCK)))))
    tree = spark.sparkContext.broadcast(_Cells(points, depth))  # of a size that SAMPLE and CELLS bound

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            p = lifted(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(list(p), pa.list_(pa.float64())), pa.array(tree.value.of(p).astype(np.int32))], ["vec_id", "v", "p", "cell"])

    index = written(rows.mapInArrow(placed, "vec_id long, v array<double>, p array<double>, cell int"), "index")
    boxes = index.groupBy("cell").agg(F.count("*").alias("n"), F.array(*[F.min(F.col("p")[i]) for i in range(PROJECTIONS)]).alias("low"), F.array(*[F.max(F.col("p")[i]) for i in range(PROJECTIONS)]).alias("high")).collect()  # CELLS rows at most
    blocks = {r["cell"]: -(-r["n"] // BLOCK) for r in boxes}
    cells = np.array([r["cell"] for r in boxes])
    low, high = np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])
    n_blocks = F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]) if len(blocks) <= 64 else None
    sizes = spark.createDataFrame([(c, n) for c, n in blocks.items()], "cell int, blocks int")
    data = (index.withColumn("blocks", n_blocks[F.col("cell")]) if n_blocks is not None else index.join(F.broadcast(sizes), "cell")).select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v", "p")
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "p", "cell")).alias("q")).select("vec_id", "q.v", "q.p", "q.cell")
    queries = written(queries, "queries")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def routed(asked: DataFrame, home: bool) -> DataFrame:
        """cell, block, query, v, p, bound for each block that a query is to search."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, vs, ps, own, bound = (b.column(c).to_pylist() for c in ("vec_id", "v", "p", "cell", "bound"))
                made: list[tuple] = []
                for i, v, p, c, s in zip(ids, vs, ps, own, bound, strict=True):
                    if home:
                        to = [c]
                    else:
                        q = np.concatenate([v, [0.0]]) @ directions  # a query has 0 in the added component
                        far = (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(axis=1)
                        reach = ruled * max(m2 + float(np.dot(v, v)) - 2 * s, 0.0) if s > -math.inf else math.inf
                        to = [t for t in cells[far <= reach].tolist() if t != c]
                    made += [(t, j, i, v, p, s) for t in to for j in range(blocks[t])]
                cols = list(zip(*made, strict=True)) or [()] * 6
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["cell", "block", "query", "v", "p", "bound"])

        return asked.mapInArrow(run, "cell int, block int, query long, v array<double>, p array<double>, bound double")

    def searched(asked: DataFrame, home: bool) -> DataFrame:
        """Queries (at most BLOCK at a time) meet a block's rows in its task."""
        left = routed(asked, home).select("cell", "block", F.lit(1).alias("kind"), F.col("query").alias("vec_id"), "v", "p", "bound")
        right = data.select("cell", "block", F.lit(0).alias("kind"), "vec_id", "v", "p", F.lit(0.0).alias("bound"))
        both = right.unionByName(left).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "kind", "vec_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, block, tree = None, [], None
            for b in batches:
                cell, number, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "kind"))
                ids, bound = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("bound").to_numpy(zero_copy_only=False)
                v, p = _matrix(b.column("v")), _matrix(b.column("p"))
                cut = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(ids)]
                out = ([], [], [])
                for a, e in zip(cut, cut[1:], strict=False):
                    if a == e:
                        continue
                    key = (cell[a], number[a])
                    if key != held:
                        held, block, tree = key, [], None
                    if kind[a] == 0:
                        block.append((ids[a:e].copy(), v[a:e].copy(), p[a:e].copy()))
                        continue
                    if tree is None and block:
                        tree = _Tree(*(np.concatenate(x) for x in zip(*block, strict=True)))
                    for i in range(a, e) if tree else ():
                        q = np.concatenate([v[i], [0.0]]) @ directions
                        got, score = tree.search(v[i], q, int(ids[i]), k, m2 + float(v[i] @ v[i]), ruled, float(bound[i]))
                        out[0].extend([int(ids[i])] * len(got))
                        out[1].extend(got.tolist())
                        out[2].extend(score.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

        return both.mapInArrow(run, "query_id long, vec_id long, score double")

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = written(ranked(searched(queries.withColumn("bound", F.lit(float("-inf"))), True)), "first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    asked = queries.join(kth, queries.vec_id == kth.query_id, "left").select("vec_id", "v", "p", "cell", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    found = first.select("query_id", "vec_id", "score").unionByName(searched(asked, False))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
