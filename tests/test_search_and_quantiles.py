"""Exact quantiles by selection, search with bounds, stored corpora, blocks of queries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions.vector import unit
from loomspan.operators import bounds, corpora, encoders, evaluation, quantiles, retrieval


def _plain(values, p):
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    place = p * (len(ordered) - 1)
    a, b = ordered[math.floor(place)], ordered[math.ceil(place)]
    return a if a == b else a * (1 - (place - math.floor(place))) + b * (place - math.floor(place))


@pytest.mark.parametrize("bins", [100, 1024])
def test_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    r = random.Random(bins)
    groups = {
        "ties": [1.5] * 50 + [2.5] * 3,
        "one": [7.0],
        "tiny": [r.random() * 5e-324 * 10 for _ in range(5)],
        "huge": [1.7e308, -1.7e308, 0.0, 1e300, -5.0],
        "near": [1.0 + i * 2.3e-16 for i in range(40)],
        "mixed": [r.choice([-1, 1]) * 10 ** r.uniform(-20, 20) for _ in range(200)],
        None: [float(i) for i in range(101)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(3).cache()
    at = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = {(x.g, x["at"]): (x.n, x.quantile) for x in quantiles.quantiles(df, at, by=["g"]).collect()}
    assert got.keys() == {(g, p) for g in groups for p in at}
    assert all(n == len(groups[g]) and q == pytest.approx(_plain(groups[g], p), rel=1e-12) for (g, p), (n, q) in got.items())


def test_quantiles_of_odd_values(spark):
    values = [float("nan"), float("inf"), -float("inf"), 3.0, 1.0, float("inf"), 2.0]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    got = {x["at"]: x.quantile for x in quantiles.quantiles(df, [i / 6 for i in range(7)]).collect()}
    assert [got[i / 6] for i in range(6)] == [-float("inf"), 1.0, 2.0, 3.0, float("inf"), float("inf")] and math.isnan(got[1.0])
    assert quantiles.quantiles(df.limit(0), [0.5]).count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        quantiles.quantiles(df, [1.5])


def test_similarity_statistics_hold_no_task_full(spark):
    scores = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 10)], "score double")
    made = evaluation.similarity_statistics(scores)
    assert tuple(made.first()) == (4.0, pytest.approx(3.5355339), 1.0, 10.0, 2.5)
    assert "ercentile" not in made._jdf.queryExecution().toString()
    assert tuple(evaluation.similarity_statistics(scores.limit(0)).first()) == (None,) * 5


def _vectors(spark, seed, n=600, spread=0.15, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dims))
    x = centres[rng.integers(0, 20, n)] + spread * rng.standard_normal((n, dims))
    x[40:70] = x[3]  # ties
    x[5] = 0
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(3).cache()


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_search_with_bounds_is_exact(spark, spread):
    corpus = _vectors(spark, 1, spread=spread)
    queries = corpus.where("doc_id % 9 = 0 OR doc_id = 5").select(F.col("doc_id").alias("query_id"), "embedding")
    held = bounds.Clustered(corpus, centres=25)
    rows = lambda df: {tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect()}
    for k in (1, 10, 700):
        got, scored = held.nearest(queries, k)
        assert rows(got) == {r for r in rows(retrieval.retrieve(queries, corpus.where("doc_id <> 5"), k)) if r[3] is not None}
        if k == 10 and spread < 1:
            assert bounds.share_scored(scored, held) < 0.5
    every = {(r.query_id, r.doc_id): r.score for r in retrieval.scored(queries, corpus).where("score IS NOT NULL").collect()}
    for t in (-1.0, 0.3, 0.9, 1.0):
        got, scored = held.above(queries, t)
        assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == {k: v for k, v in every.items() if v >= t}
    none = bounds.Clustered(corpus.limit(0))
    assert none.nearest(queries)[0].count() == 0 and none.above(queries, 0.1)[0].count() == 0


def test_many_queries_meet_the_corpus_in_blocks(spark, monkeypatch):
    corpus = _vectors(spark, 2, n=200)
    queries = corpus.select(F.col("doc_id").alias("query_id"), "embedding")
    by = lambda df: df.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = lambda df: {tuple(r) for r in df.collect()}
    whole, models = rows(retrieval.retrieve(queries, corpus, 5)), rows(retrieval.search_models(by(queries), by(corpus), 5))
    monkeypatch.setattr(retrieval, "ROUND", 30)
    monkeypatch.setattr(retrieval, "SPAN", 70)
    blocks = retrieval.search_models(by(queries), by(corpus), 5)
    assert rows(retrieval.retrieve(queries, corpus, 5)) == whole and rows(blocks) == models
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_stored_corpora(spark, tmp_path):
    store = str(tmp_path / "corpora")
    corpus = _vectors(spark, 3, n=120)
    here = corpora.Corpora(spark, store)
    assert here.names() == []
    here.add("first", corpus)
    here.add("second", corpus.where("doc_id >= 60"))
    here.add("second", corpus.where("doc_id < 30"))  # replaces
    with pytest.raises(ValueError, match="is empty"):
        here.add("none", corpus.limit(0))
    with pytest.raises(ValueError, match="differ in length"):
        here.add("odd", spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id int, embedding array<double>"))
    other = spark.newSession()
    there = corpora.Corpora(other, store)
    assert there.names() == ["first", "second"] and {r.name: r.rows for r in there.index().collect()} == {"first": 119, "second": 29}
    queries = corpus.where("doc_id IN (0, 7)").select(F.col("doc_id").alias("query_id"), "embedding")
    found = there.retrieve(queries, "second", k=4)
    want = retrieval.retrieve(queries, corpus.where("doc_id < 30 AND doc_id <> 5").select(F.col("doc_id").cast("string").alias("doc_id"), "embedding"), 4)
    assert {tuple(r)[1:] for r in found.collect()} == {tuple(r) for r in want.collect()}
    assert {r.name for r in there.retrieve(queries, "first", "second").collect()} == {"first", "second"}
    with pytest.raises(ValueError, match="unknown corpora: third"):
        there.vectors("first", "third")
    got = there.look_up("first", spark.createDataFrame([("3",), ("5",), ("1000",)], "doc_id string")).collect()
    assert [r.doc_id for r in got] == ["3"] and got[0].embedding == pytest.approx(corpus.where("doc_id = 3").select(unit(F.col("embedding"))).first()[0])


def test_a_search_reads_the_partitions_of_its_corpus_only(spark, tmp_path):
    corpus = _vectors(spark, 4, n=160)
    store = corpora.Corpora(spark, str(tmp_path / "corpora"))
    for name in ("a", "b", "c"):
        store.add(name, corpus)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = store.vectors("b")
        assert found.count() == 159
        plan = found._jdf.queryExecution().executedPlan()
        assert "dynamicpruning" in plan.toString()
        found.collect()
        leaves, read = plan.collectLeaves(), []
        for i in range(leaves.size()):
            metrics = leaves.apply(i).metrics()
            if metrics.contains("numPartitions"):
                read.append(metrics.apply("numPartitions").value())
        assert 0 < max(read) <= corpora.BUCKETS
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_corpora_without_ids_are_numbered(spark, tmp_path):
    store = corpora.Corpora(spark, str(tmp_path / "corpora"))
    store.add("texts", spark.createDataFrame([(f"text {i}", [1.0, float(i)]) for i in range(7)], "context string, embedding array<double>"))
    assert sorted(r.doc_id for r in store.vectors("texts").collect()) == [f"doc_{i}" for i in range(7)]


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],), ([],), (None,)], "tokens array<array<double>>")
    assert [r[0] for r in df.select(encoders.pooled(F.col("tokens"), "mean")).collect()] == [[2.0, 4.0], None, None]
    assert [r[0] for r in df.select(encoders.pooled(F.col("tokens"), "cls")).collect()] == [[1.0, 2.0], None, None]
    with pytest.raises(ValueError, match="pooling"):
        encoders.pooled(F.col("tokens"), "max")
