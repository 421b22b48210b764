"""Vector retrieval: similarity, top-k, threshold, ranking, comparison of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.running import sums_before
from ..functions.vector import dot, norm, unit
from ..staging import written
from . import blocks

#: Queries, and rows of a corpus, that a block has at most.
ROUND, SPAN = blocks.ROWS, blocks.ROWS


def similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with `score`, the cosine of two vector columns."""
    return pairs.withColumn("score", dot(F.col(a), F.col(b)) / (norm(F.col(a)) * norm(F.col(b))))


def _units(queries: DataFrame, corpus: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """query_id, q and doc_id, c, with the columns `by`: vectors brought to unit length."""
    return queries.select(*by, "query_id", unit(F.col("embedding")).alias("q")), corpus.select(*by, "doc_id", unit(F.col("embedding")).alias("c"))


def _sized(corpus: DataFrame) -> tuple[int, int]:
    return blocks.sized(corpus.agg(F.max(F.size("embedding"))).first()[0] or 0, (ROUND, SPAN))


def scored(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, doc_id, score of every query against every row of the corpus; zero vectors, which have no direction, take no part.

    queries: query_id, embedding; corpus: doc_id, embedding. Vectors are
    brought to unit length once, then every score is a dot product.
    """
    return blocks.met(*_units(queries, corpus), size=(ROUND, SPAN))


def ranked(scores: DataFrame, k: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """scores with `rank` from 1, best first, ties to the smaller doc_id; the first k of each query. With k, Spark keeps only k rows of a query in each task before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k is not None else out


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 10, *, others: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score of the k nearest rows of each query; queries that repeat an id are searched once. others: without the row that has the query's id."""
    met = blocks.met(*_units(queries.dropDuplicates(["query_id"]), corpus), k=k, others=others, size=_sized(corpus))
    return ranked(met, k).select("query_id", "rank", "doc_id", "score")


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The rows of retrieve() whose score reaches the threshold."""
    return retrieve(queries, corpus, k).where(F.col("score") >= threshold)


def rank_contexts(query: DataFrame, contexts: DataFrame) -> DataFrame:
    """Full ranking of the given contexts for each query."""
    return blocks.rankings(query.select("query_id", "embedding"), contexts.select("doc_id", "embedding"), most=ROUND)


def search_models(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """model, query_id, rank, doc_id, score: as retrieve(), within each model. queries and corpus also carry `model`."""
    met = blocks.met(*_units(queries, corpus, "model"), k=k, by=("model",), size=_sized(corpus))
    return ranked(met, k, ("model", "query_id")).select("model", "query_id", "rank", "doc_id", "score")


def compare_models(found: DataFrame) -> DataFrame:
    """model, avg_score, max_score, min_score, n_results from search_models()."""
    return found.groupBy("model").agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.count("*").alias("n_results"))


def search_counts(log: DataFrame) -> DataFrame:
    """Searches by model, from rows (model, query_id) of searches done."""
    return log.select("model", "query_id").distinct().groupBy("model").agg(F.count("*").alias("n_searches"))


def exported(results: DataFrame) -> DataFrame:
    """results with the score rounded to four places."""
    return results.withColumn("score", F.round("score", 4))


def numbered(corpus: DataFrame) -> DataFrame:
    """corpus with doc_id from the order of its contexts' hashes: ranges of their hash are counted first, so nothing is sorted in one task."""
    ranged = corpus.withColumn("range__", F.conv(F.substring(F.md5("context"), 1, 5), 16, 10).cast("long"))
    counts = written(ranged.groupBy("range__").agg(F.count("*").alias("n__")), "counts")
    base = sums_before(counts, "range__", "n__").select("range__", "base")
    local = F.row_number().over(W.partitionBy("range__").orderBy("context")) - 1
    return ranged.join(base, "range__").withColumn("doc_id", F.concat(F.lit("doc_"), (F.col("base") + local).cast("string"))).drop("range__", "base")
