"""Retrieval metrics from ranked lists and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import written
from .quantiles import quantiles


def similarity_statistics(scores: DataFrame) -> DataFrame:
    """mean, population deviation, least, largest and median score; the median by selection, so no task holds the scores. Without scores all are null."""
    held = written(scores.select("score"), "scores")
    simple = held.agg(F.avg("score").alias("mean_similarity"), F.stddev_pop("score").alias("std_similarity"), F.min("score").alias("min_similarity"), F.max("score").alias("max_similarity"))
    median = quantiles(held, [0.5], column="score").select(F.col("quantile").alias("median_similarity"))
    return simple.join(F.broadcast(median), F.lit(True), "left")  # one row each


def judged(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, rank, hit (1 or 0) of each retrieved row; relevant: query_id, doc_id."""
    marks = relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1.0))
    return found.join(marks, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("hit", F.lit(0.0)).alias("hit"))


def judged_alike(found: DataFrame, corpus: DataFrame, queries: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """As judged(), where a row is relevant if it is alike the query in column `on` (a label, or the context's text) and has another id; and query_id, n: how many such rows there are.

    Only retrieved rows look up their value; the number of relevant rows is the
    value's count, so no pairs of rows that are alike are made.
    """
    own = queries.select("query_id", F.col(on).alias("own__"))
    theirs = corpus.select("doc_id", F.col(on).alias("theirs__"))
    met = found.join(own, "query_id").join(theirs, "doc_id", "left")
    hit = (F.col("own__") == F.col("theirs__")) & (F.col("query_id") != F.col("doc_id"))
    marks = met.select("query_id", "rank", F.coalesce(hit.cast("double"), F.lit(0.0)).alias("hit"))
    counts = corpus.groupBy(F.col(on).alias("own__")).agg(F.count("*").alias("n__"))
    mine = corpus.select(F.col("doc_id").alias("query_id"), F.lit(1).alias("itself__"))  # a query that is in the corpus isn't relevant to itself
    n = own.join(counts, "own__", "left").join(mine, "query_id", "left")
    return marks, n.select("query_id", (F.coalesce("n__", F.lit(0)) - F.coalesce("itself__", F.lit(0))).alias("n"))


def first_hits(marks: DataFrame, k: int) -> DataFrame:
    """query_id, first: zero-based place of the first relevant row, k where there is none."""
    return marks.groupBy("query_id").agg(F.coalesce(F.min(F.when((F.col("hit") > 0) & (F.col("rank") <= k), F.col("rank") - 1)), F.lit(k)).alias("first"))


def recall(first: DataFrame, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries with a relevant row among the first n, for each n."""
    return first.agg(*[F.avg((F.col("first") < n).cast("double")).alias(f"recall_at_{n}") for n in at])


def mrr(first: DataFrame, k: int, *, compat: bool = True) -> DataFrame:
    """Mean of 1 / (place + 1). A miss gives 1 / (k + 1) in compat mode and 0 otherwise."""
    value = 1.0 / (F.col("first") + 1)
    return first.agg(F.avg(value if compat else F.when(F.col("first") < k, value).otherwise(0.0)).alias("mrr"))


def ndcg(marks: DataFrame, k: int, *, compat: bool = True, relevant: DataFrame | None = None) -> DataFrame:
    """Mean gain over the ideal: in compat mode a list that is relevant throughout, otherwise one with as many relevant rows as the query has.

    relevant: query_id, doc_id, or query_id, n.
    """
    gain = 1 / F.log2(F.col("rank") + 1)
    top = marks.where(F.col("rank") <= k)
    each = top.groupBy("query_id").agg(F.sum(F.col("hit") * gain).alias("dcg"), F.sum(gain).alias("full"))
    if compat:
        return each.agg(F.avg(F.try_divide("dcg", "full")).alias(f"ndcg_at_{k}"))
    counts = relevant if "n" in relevant.columns else relevant.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = counts.select("query_id", F.least("n", F.lit(k)).cast("int").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return each.join(ideal, "query_id", "left").agg(F.avg(F.when(F.col("n") > 0, F.col("dcg") / best).otherwise(0.0)).alias(f"ndcg_at_{k}"))


def mean_average_precision(marks: DataFrame, k: int) -> DataFrame:
    """Mean over queries of the average, over the relevant rows among the first k, of the precision at each; 0 without any."""
    top = marks.where(F.col("rank") <= k)
    # the precision at a hit is the number of hits up to it over its rank
    upto = F.aggregate(
        F.array_sort(F.collect_list(F.when(F.col("hit") > 0, F.col("rank")))),
        F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, r: F.struct((a["n"] + 1).alias("n"), (a["s"] + (a["n"] + 1) / r).alias("s")),
    )
    each = top.groupBy("query_id").agg(upto.alias("a")).select(F.coalesce(F.try_divide("a.s", "a.n"), F.lit(0.0)).alias("ap"))
    return each.agg(F.avg("ap").alias(f"map_at_{k}"))


def map_compat(marks: DataFrame, k: int, top_k: int = 10) -> DataFrame:
    """The mean that comes out when relevances stand in for ranks: for each query over its first top_k rows, the average of j / (relevance_j + 1)."""
    each = marks.where(F.col("rank") <= top_k).groupBy("query_id").agg(F.avg(F.col("rank") / (F.col("hit") + 1)).alias("v"))
    return each.agg(F.avg("v").alias(f"map_at_{k}_compat"))


def evaluated(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row with all ranking metrics, in compat mode but for the average precision."""
    return summarised(written(judged(found, relevant), "marks"), k)


def summarised(marks: DataFrame, k: int = 10) -> DataFrame:
    """evaluated(), from marks that are a table."""
    first = first_hits(marks, k)
    parts = [recall(first), mrr(first, k), ndcg(marks, 5), ndcg(marks, 10), mean_average_precision(marks, 5)]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p), F.lit(True))
    return out


def judgements(examples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries (query_id, question), corpus (doc_id, context: the last of the id in order of `position`), relevant (query_id, doc_id, distinct)."""
    queries = examples.groupBy(F.col("id").alias("query_id")).agg(F.max_by("question", "position").alias("question"))
    corpus = examples.groupBy("doc_id").agg(F.max_by("context", "position").alias("context"))
    relevant = examples.select(F.col("id").alias("query_id"), "doc_id").distinct()
    return queries, corpus, relevant


def efficiency(models: DataFrame) -> DataFrame:
    """models (model, params, total_ms, n_sentences) with size in MB of 32-bit parameters and milliseconds for each sentence."""
    return models.withColumns({"model_size_mb": F.col("params") * 4 / F.lit(2**20), "inference_time_ms": F.col("total_ms") / F.col("n_sentences")})
