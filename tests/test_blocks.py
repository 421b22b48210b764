"""Scores of blocks of queries against blocks of a corpus, held against every pair."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions.vector import dot, unit
from loomspan.operators import blocks, bounds, retrieval, tagging


def _vectors(spark, n=300, dims=6):
    x = np.random.default_rng(5).standard_normal((n, dims)).astype(np.float32)
    x[50:120] = x[7]  # copies
    rows = [(i, [float(v) for v in r], i % 4 if i % 9 else None) for i, r in enumerate(x)]
    rows += [(n, [0.0] * dims, 1), (n + 1, None, 1), (n + 2, [float("nan")] * dims, 2), (n + 3, [1.0, 2.0], 3), (n + 4, [], 3)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>, label int").repartition(5).cache()


def _plain(queries, corpus):
    q = queries.select("query_id", unit(F.col("embedding")).alias("q"))
    c = corpus.select("doc_id", "label", unit(F.col("embedding")).alias("c"))
    return q.crossJoin(c).where("size(q) = size(c)").select("query_id", "doc_id", "label", dot(F.col("q"), F.col("c")).alias("score")).where("score IS NOT NULL").cache()


def _rows(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("size", [(4096, 1 << 14), (20, 40)])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "ROUND", size[0])
    monkeypatch.setattr(retrieval, "SPAN", size[1])
    monkeypatch.setattr(blocks, "HELD", 700)
    corpus = _vectors(spark)
    queries = corpus.where("doc_id % 5 = 0 OR doc_id > 299").select(F.col("doc_id").alias("query_id"), "embedding")
    pairs, columns = _plain(queries, corpus), ("query_id", "doc_id", "score")
    assert _rows(retrieval.scored(queries, corpus), *columns) == _rows(pairs, *columns)
    for k in (1, 10, 80):
        assert _rows(retrieval.retrieve(queries, corpus, k), *columns, "rank") == _rows(retrieval.ranked(pairs, k), *columns, "rank")
        rest = retrieval.ranked(pairs.where("query_id <> doc_id"), k)
        assert _rows(retrieval.retrieve(queries, corpus, k, others=True), *columns, "rank") == _rows(rest, *columns, "rank")
    sentences = corpus.select(F.col("label").alias("paper"), F.col("doc_id").alias("sentence_no"), "embedding")
    got = tagging.tag_scores(sentences, queries.withColumnRenamed("query_id", "tag_id"), key="paper")
    assert _rows(got, "paper", "tag_id", "score") == _rows(pairs.groupBy("label", "query_id").agg(F.max("score").alias("score")), "label", "query_id", "score")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_whole_rankings_sort_lists(spark, monkeypatch, kind):
    """A row for each pair was shuffled and sorted."""
    monkeypatch.setattr(retrieval, "ROUND", 20)
    monkeypatch.setattr(retrieval, "SPAN", 40)
    corpus = _vectors(spark).withColumn("doc_id", F.when(F.col("doc_id") != 60, F.col("doc_id")).cast(kind))
    queries = _vectors(spark).where("doc_id % 25 = 0 OR doc_id > 299").select(F.col("doc_id").cast(kind).alias("query_id"), "embedding")
    got = retrieval.rank_contexts(queries, corpus)
    columns = ("query_id", "rank", "doc_id", "score")
    assert got.schema["rank"].dataType.typeName() == "integer" and got.schema["doc_id"].dataType.typeName() == kind
    assert _rows(got, *columns) == _rows(retrieval.ranked(_plain(queries, corpus)), *columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroupsInArrow" in plan
    assert retrieval.rank_contexts(queries.where("false"), corpus).count() == 0 and retrieval.rank_contexts(queries, corpus.where("false")).count() == 0


def test_whole_rankings_shuffle_no_scores(spark, monkeypatch):
    """Lists of all scores were shuffled, which is the square of the input; the corpus is now sent to each block of queries."""
    monkeypatch.setattr(blocks, "SPOOLED", 100, raising=False)
    monkeypatch.setattr(blocks, "GIVEN", 50, raising=False)
    monkeypatch.setattr(blocks, "HELD", 700)
    corpus = _vectors(spark).union(_vectors(spark).where("doc_id IN (3, 8, 303)"))  # ids that stand twice
    queries = corpus.where("doc_id % 25 = 3 OR doc_id > 299").select((F.col("doc_id") % 60).alias("query_id"), "embedding")  # and queries of other lengths under one id
    got = retrieval.rank_contexts(queries, corpus)
    assert queries.distinct().count() > queries.select("query_id").distinct().count()
    assert _rows(got, "query_id", "rank", "doc_id", "score") == _rows(retrieval.ranked(_plain(queries, corpus)), "query_id", "rank", "doc_id", "score")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InArrow") == 1  # what makes scores also ranks them


def test_no_search_makes_a_row_for_each_pair(spark):
    """Pairs of rows were joined one by one, which took most of a search's time."""
    corpus = _vectors(spark)
    queries = corpus.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    sentences = corpus.select("label", F.col("doc_id").alias("sentence_no"), "embedding")
    models = corpus.withColumn("model", F.lit("m"))
    held = bounds.Clustered(corpus.where("doc_id < 300"), centres=20)
    for df in (
        retrieval.retrieve(queries, corpus, 3),
        retrieval.search_models(models.withColumnRenamed("doc_id", "query_id"), models, 3),
        tagging.tag_scores(sentences, queries.withColumnRenamed("query_id", "tag_id"), key="label"),
        held.above(queries, 0.5)[0],
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    few = blocks.met(*retrieval._units(queries, corpus), k=3)
    assert few.count() <= 3 * queries.count() * max(1, corpus.count() // 256)


def test_clusters_of_many_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BAND", 3)
    corpus = _vectors(spark).where("doc_id < 300")
    queries = corpus.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    held, pairs = bounds.Clustered(corpus, centres=10), _plain(queries, corpus)
    columns = ("query_id", "doc_id", "score")
    reached = held._reached(queries).select("query_id", "cluster")
    got = held._scored(reached, queries, least=0.2, size=(20, 11))
    assert _rows(got, *columns) == _rows(pairs.where("score >= 0.2"), *columns)
    assert _rows(held.nearest(queries, 4)[0], *columns, "rank") == _rows(retrieval.ranked(pairs, 4), *columns, "rank")


@pytest.mark.parametrize("k", [1, 5])
def test_best_is_cut_where_scores_are_nearly_alike(k):
    """Every row whose score was within a rounding of the k-th came out; in single precision far more are."""
    r = np.random.default_rng(9)
    c = r.standard_normal((5 * 4 * blocks.STRIDE + 7, 12))
    c[100:300] = c[3] + r.standard_normal((200, 12)) * 1e-8  # nearly alike: single precision can't tell
    c[300:340] = c[4] + r.standard_normal((40, 12)) * 1e-12
    c[400:420] = c[5]  # copies
    q = np.concatenate([c[[3, 4, 5]], r.standard_normal((40, 12))])
    c[600:603], q[9] = np.nan, np.nan
    c, q = (x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (c, q))
    for some in (c, np.delete(c, slice(600, 603), axis=0)):
        i, j, s = blocks.best(q, some, k)
        assert (np.bincount(i) == k).all()
        for a in range(len(q)):
            every = blocks.summed(q, some, np.full(len(some), a), np.arange(len(some)))
            first = np.lexsort((np.arange(len(some)), -every, ~np.isnan(every)))[:k]
            assert sorted(j[i == a]) == sorted(first) and np.array_equal(np.sort(s[i == a]), np.sort(every[first]), equal_nan=True)


def test_models_are_dealt_to_blocks_of_their_own_size(spark, monkeypatch):
    """The corpus was dealt out once for each block of the queries of all models together."""
    monkeypatch.setattr(retrieval, "ROUND", 70)
    corpus = _vectors(spark).select("doc_id", "embedding", F.explode(F.array(*map(F.lit, "abc"))).alias("model"))
    queries = corpus.where("doc_id % 5 = 0 AND doc_id < 300").withColumnRenamed("doc_id", "query_id")
    plan = retrieval.search_models(queries, corpus, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"pmod\(xxhash64\(query_id#\d+L?, 42\), (\d+)\)", plan)) == {"1"}


def test_vectors_are_brought_to_unit_length_once(spark):
    """A filter for null vectors added every vector's length up a second time."""
    corpus = _vectors(spark)
    queries = corpus.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    plan = retrieval.retrieve(queries, corpus, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("sqrt(") == 2


def test_long_vectors_have_small_blocks():
    assert blocks.sized(64) == (1 << 15, 1 << 15) and blocks.sized(64, (20, 40)) == (20, 40)
    assert blocks.sized(1 << 11) == (1 << 10, 1 << 10) and blocks.sized(1 << 30) == (1, 1) and blocks.sized(0) == (1 << 15, 1 << 15)
