import math

import pytest
from pyspark.sql import functions as F

from loomspan.functions.vector import unit
from loomspan.operators import encoders, evaluation, report, retrieval


def test_topk_with_ties_and_threshold(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r["rank"], r.doc_id, r.score) for r in retrieval.retrieve(queries, corpus, 3).orderBy("rank").collect()]
    assert [g[:2] for g in got][:2] == [(1, 1), (2, 2)] and got[0][2] == pytest.approx(1)
    assert {r.doc_id for r in retrieval.search(queries, corpus, 4, 0.5).collect()} == {1, 2}


def test_many_queries_meet_the_corpus_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROUND", 3)
    rows = [(i, [float(i % 5), 1.0]) for i in range(20)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    got = retrieval.retrieve(corpus.withColumnRenamed("doc_id", "query_id"), corpus, 2)
    assert got.count() == 40
    models = corpus.withColumn("model", F.lit("m"))
    assert retrieval.search_models(models.withColumnRenamed("doc_id", "query_id"), models, 2).count() == 40


def test_metrics(spark):
    marks = spark.createDataFrame([(q, r, h) for q, hits in ((1, (0, 1, 1)), (2, (0, 0, 0)), (3, (1, 0, 1))) for r, h in enumerate(map(float, hits), 1)], "query_id int, rank int, hit double")
    first = evaluation.first_hits(marks, 3)
    assert {r.query_id: r["first"] for r in first.collect()} == {1: 1, 2: 3, 3: 0}
    assert evaluation.recall(first, (1, 2)).first().asDict() == pytest.approx({"recall_at_1": 1 / 3, "recall_at_2": 2 / 3})
    assert evaluation.mrr(first, 3).first()[0] == pytest.approx((1 / 2 + 1 / 4 + 1) / 3)
    assert evaluation.mrr(first, 3, compat=False).first()[0] == pytest.approx((1 / 2 + 1) / 3)
    assert evaluation.mean_average_precision(marks, 3).first()[0] == pytest.approx(((1 / 2 + 2 / 3) / 2 + 0 + (1 + 2 / 3) / 2) / 3)
    gain = [1 / math.log2(i + 1) for i in (1, 2, 3)]
    assert evaluation.ndcg(marks, 3).first()[0] == pytest.approx(((gain[1] + gain[2]) + (gain[0] + gain[2])) / sum(gain) / 3)
    relevant = spark.createDataFrame([(1, 1), (1, 2), (3, 1), (3, 9)], "query_id int, doc_id int")
    assert evaluation.ndcg(marks, 3, compat=False, relevant=relevant).first()[0] == pytest.approx(((gain[1] + gain[2]) + (gain[0] + gain[2])) / (gain[0] + gain[1]) / 3)


def test_compat_average_precision(spark):
    """Ten results with one hit at place p give 5.5 - p / 20, none give 5.5."""
    marks = spark.createDataFrame([(q, r, float(r == p)) for q, p in ((1, 4), (2, 0)) for r in range(1, 11)], "query_id int, rank int, hit double")
    assert evaluation.map_compat(marks, 5).first()[0] == pytest.approx((5.5 - 4 / 20 + 5.5) / 2)


def test_similarity_statistics_use_the_population_deviation(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "score double")
    assert tuple(evaluation.similarity_statistics(df).first()) == pytest.approx((2.5, math.sqrt(1.25), 1, 4, 2.5))


def test_normalised_report(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "model string, x double, y double")
    got = {(r.model, r.metric): r.value for r in report.normalised(df, ["x", "y"]).collect()}
    assert got == {("a", "x"): 0, ("b", "x"): 1, ("a", "y"): 0.5, ("b", "y"): 0.5}
    assert "<td>a</td>" in report.chart_page({"t": report.long_form(df, ["x"])})


def _load():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_encoder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id int, text string")
    assert [list(r.embedding) for r in encoders.encoded(df, _load).orderBy("doc_id").collect()] == [[3.0, 1.0], [0.0, 1.0]]
    v = df.select(encoders.hashed_words(df.text, 8).alias("v")).first().v
    assert len(v) == 8 and sum(v) == 1
    with pytest.raises(ValueError):
        encoders.ModelConfig("k", "h", "max", 1, "c", "d")
    with pytest.raises(ValueError):
        encoders.lookup([], "nothing")


def test_judgements(spark):
    ex = spark.createDataFrame([("q1", "d1", "a", "old", 1), ("q1", "d2", "a", "x", 2), ("q2", "d1", "b", "new", 3)], "id string, doc_id string, question string, context string, position int")
    queries, corpus, relevant = evaluation.judgements(ex)
    assert {r.doc_id: r.context for r in corpus.collect()} == {"d1": "new", "d2": "x"}
    assert sorted(map(tuple, relevant.collect())) == [("q1", "d1"), ("q1", "d2"), ("q2", "d1")] and queries.count() == 2


def test_every_stated_query_is_ranked(spark, tmp_path):
    from loomspan.plans import all_queries

    rows = [(i, [1.0, float(i)], i % 3) for i in range(121)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = all_queries()["rank_contexts_batch"][0](spark, str(tmp_path)).collect()
    ranks = {q: sorted(r["rank"] for r in got if r.query_id == q) for q in {r.query_id for r in got}}
    assert ranks == {q: list(range(1, 122)) for q in range(0, 121, 20)}


def test_a_page_shows_whole_tables_only(spark):
    df = spark.range(report.PAGE_ROWS + 1)
    with pytest.raises(ValueError, match="more than"):
        report.chart_page({"t": df})
    assert report.chart_page({"t": df.where("id > 0")}).count("<tr><td>") == report.PAGE_ROWS


def test_a_length_is_added_up_once_for_each_vector(spark):
    """Within the function over components it was added up again for each of them: the square of their number for each vector."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],)], "e array<float>").select(unit(F.col("e")).alias("u"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 1
    got = [r["u"] for r in df.collect()]
    assert got[:3] == [[0.6, 0.8], None, None] and len(got[3]) == 2 and all(x != x for x in got[3])


def test_a_transposed_report_runs_its_metrics_once(spark):
    """The models' names were collected from the whole search, which then ran again for the rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, None)], "model string, x double, y double")
    got = report.transposed(df.mapInArrow(counted, df.schema), ["x", "y"])
    assert sorted(map(tuple, got.collect())) == [("x", 1.0, 3.0), ("y", 5.0, None)] and read.value == 2
