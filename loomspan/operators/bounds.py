"""Exact search that rules clusters out by angle.

A few centres are fitted to a bounded sample, and every row of the corpus goes to
its nearest one, whose radius is the largest angle to any of its rows. An angle
between unit vectors obeys the triangle inequality, so no row of a cluster is
nearer to a query than the centre's angle less the radius. For a threshold,
clusters beyond it are left out; for the first k, the rows of a query's nearest
clusters are scored first, and then those of every cluster that can still hold a
better one than the k-th. Results are the same as those of a full search. What
is saved depends on the vectors: clusters that overlap all around, as those of
vectors without structure do, rule hardly anything out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import dot, unit
from ..shipping import ship
from ..staging import written
from . import blocks
from .retrieval import ranked

#: Centres, and rows of the sample that they are fitted to for each of them.
CENTRES, FITTED = 256, 32
#: More than rounding adds to an angle: that of a cosine near 1 is off by the root of a double's error.
SLACK = 1e-6


def _fitted(sample: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors, by rounds of assignment and averaging; the first ones are spread over the sample."""
    found = sample[:: max(1, -(-len(sample) // centres))].copy()
    for _ in range(rounds):
        own = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        found[length > 0] = sums[length > 0] / length[length > 0, None]
    return found


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


class Clustered:
    """A corpus (doc_id, embedding) as tables: `rows` (cluster, doc_id, c) and `clusters` (cluster, centre, radius, n), at most CENTRES.

    Zero vectors, which have no direction, take no part, as in a full search.
    """

    def __init__(self, corpus: DataFrame, centres: int = CENTRES) -> None:
        spark = corpus.sparkSession
        ship(spark)
        units = written(corpus.select("doc_id", unit(F.col("embedding")).alias("c")).where("c IS NOT NULL"), "units")
        # a sample by the ids' hashes: the same rows in every run
        sample = units.orderBy(F.xxhash64("doc_id"), "doc_id").limit(centres * FITTED).select("c").toArrow()
        fitted = _fitted(blocks.matrix(sample.column("c")), centres) if sample.num_rows else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = (blocks.matrix(batch.column("c")) @ shared.value.T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], ["cluster", *batch.schema.names])

        dealt = units.mapInArrow(run, T.StructType([T.StructField("cluster", T.IntegerType()), *units.schema.fields]))
        self.rows = written(dealt, "clustered")
        named = spark.createDataFrame([(i, v) for i, v in enumerate(fitted.tolist())], "cluster int, centre array<double>")
        measured = self.rows.join(F.broadcast(named), "cluster").groupBy("cluster").agg(F.max(_angle(dot(F.col("c"), F.col("centre")))).alias("radius"), F.count("*").alias("n"))
        self.clusters = written(named.join(measured, "cluster"), "clusters")
        held = {r["cluster"]: r["n"] for r in self.clusters.select("cluster", "n").collect()}  # at most CENTRES
        self._bands = [sum(held.get(i, 0) for i in range(a, a + blocks.BAND)) for a in range(0, max(1, len(fitted)), blocks.BAND)]

    def _reached(self, queries: DataFrame) -> DataFrame:
        """query_id, cluster, low, turn, n: every query with every cluster, the least angle of any row, and the centre's angle."""
        met = self._asked(queries).join(F.broadcast(self.clusters), F.lit(True))  # at most CENTRES rows
        turn = _angle(dot(F.col("q"), F.col("centre")))
        return met.select("query_id", "cluster", turn.alias("turn"), "n", (turn - F.col("radius") - SLACK).alias("low"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.dropDuplicates(["query_id"]).select("query_id", unit(F.col("embedding")).alias("q")).where("q IS NOT NULL")

    def _scored(self, reached: DataFrame, queries: DataFrame, **kept) -> DataFrame:
        """The rows of the clusters reached by each query, as blocks.met keeps them."""
        # at most CENTRES clusters for each query
        asks = reached.groupBy("query_id").agg(F.collect_list("cluster").alias("within"))
        return blocks.met(self._asked(queries).join(asks, "query_id"), self.rows, within="cluster", bands=self._bands, **kept)

    def above(self, queries: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
        """query_id, doc_id, score of all rows whose score reaches the threshold; and query_id, n: the rows scored for each query."""
        able = written(self._reached(queries).where(F.col("low") <= float(np.arccos(np.clip(threshold, -1, 1)))), "able")
        return self._scored(able, queries, least=threshold), able.groupBy("query_id").agg(F.sum("n").alias("n"))

    def nearest(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """query_id, rank, doc_id, score as retrieve() gives them; and query_id, n: the rows scored for each query."""
        reached = written(self._reached(queries), "reached")
        turn = W.partitionBy("query_id").orderBy("turn", "cluster")
        before = F.sum("n").over(turn) - F.col("n")
        first = reached.withColumn("before", before).where(F.col("before") < k).drop("before")  # clusters that hold k rows between them
        best = written(ranked(self._scored(first, queries, k=k), k), "first")
        limit = best.where(F.col("rank") == k).select("query_id", _angle(F.col("score")).alias("limit"))
        # a query without k rows so far has seen all there are
        rest = reached.join(first.select("query_id", "cluster"), ["query_id", "cluster"], "left_anti").join(limit, "query_id").where(F.col("low") <= F.col("limit") + SLACK)
        rest = written(rest.drop("limit"), "rest")
        both = best.select("query_id", "doc_id", "score").unionByName(self._scored(rest, queries, k=k))
        scored = first.select("query_id", "n").unionByName(rest.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("n"))
        return ranked(both, k).select("query_id", "rank", "doc_id", "score"), scored


def share_scored(scored: DataFrame, clustered: Clustered) -> float:
    """Rows scored over queries times rows: the second result of above() or nearest()."""
    total = clustered.rows.count()
    row = scored.agg(F.sum("n").alias("n"), F.count("*").alias("q")).first()
    return (row["n"] or 0) / (row["q"] * total) if total and row["q"] else 0.0
