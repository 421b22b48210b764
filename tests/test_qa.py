import pytest
from pyspark.sql import functions as F

from loomspan.operators import qa, spans


def _spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label string, start long, text string").withColumn("end", F.col("start") + F.length("text"))


def test_diverse_choice_stops_at_ten(spark):
    rows = [(1, "A", 10 * i, ("one", "Two", "three")[min(i, 2)]) for i in range(12)] + [(1, "B", 3, "x")]
    got = sorted(r.start for r in qa.chosen(_spans(spark, rows)).where("label = 'A'").collect())
    assert got == [10 * i for i in range(10)]
    few = [(1, "A", i, "same") for i in range(9)] + [(1, "A", 50, "other"), (1, "A", 60, "third")]
    assert {50, 60} <= {r.start for r in qa.chosen(_spans(spark, few)).collect()}


def test_anchoring(spark):
    text = "alpha beta gamma"
    answers = [(0, "alpha"), (3, "beta"), (1, "delta"), (99, "alpha"), (12, "gamma")]
    df = spark.createDataFrame([(text, answers)], "text string, answers array<struct<start:int,text:string>>")
    got = df.select(qa.anchored(df.answers, df.text).alias("a")).first().a
    assert [tuple(x) for x in got] == [(0, "alpha"), (6, "beta")]


@pytest.mark.parametrize(
    ("length", "low", "high", "want"),
    [(50, 0, 5, (0, 50)), (100, 40, 60, (0, 100)), (300, 0, 10, (0, 100)), (300, 140, 160, (100, 200)), (300, 290, 300, (200, 300)), (300, 10, 250, (0, 100)), (300, 30, 50, (0, 100))],
)
def test_context_window(spark, length, low, high, want):
    df = spark.createDataFrame([("x" * length, [(low, "x" * (high - low))])], "text string, answers array<struct<start:int,text:string>>")
    a, b = qa.window_start(df.answers, df.text, 100)
    assert tuple(df.select(a, b).first()) == want


def test_pairs_ids_and_answers(spark):
    docs = spark.createDataFrame([(1, "ab 12 cd 34"), (2, "zz 9")], "doc_id long, text string")
    s = _spans(spark, [(1, "W", 0, "ab"), (1, "NUM", 3, "12"), (1, "NUM", 9, "34"), (2, "NUM", 3, "9")])
    got = {r.id: r for r in qa.pairs(docs, s, qa.templates(spark, ["NUM"])).collect()}
    assert set(got) == {"1_q1_W", "1_q2_NUM", "2_q3_NUM"}
    assert got["1_q1_W"].question == "What is the w?" and "num" in got["1_q2_NUM"].question
    assert all(r.context[a.start : a.start + len(a.text)] == a.text for r in got.values() for a in r.answers)


@pytest.mark.parametrize("n", [1, 7, 10, 20])
def test_split_sizes(spark, n):
    rows = spark.createDataFrame([(f"id{i}",) for i in range(n)], "id string")
    got = {r.split: r["count"] for r in qa.split(rows).groupBy("split").count().collect()}
    train, val = int(n * 0.7), int(n * 0.15)
    assert (got.get("train", 0), got.get("validation", 0), got.get("test", 0)) == (train, val, n - train - val)


def test_split_by_document_and_ratios(spark):
    rows = spark.createDataFrame([(f"id{i}", i % 4) for i in range(40)], "id string, doc_id int")
    assert qa.split(rows, by="doc_id").groupBy("doc_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert qa.ratios(1.4, 0.3, 0.3) == pytest.approx((0.7, 0.15, 0.15)) and qa.ratios(0.7, 0.15, 0.15) == (0.7, 0.15, 0.15)
    assert qa.warm_up_steps(5) == 1 and qa.warm_up_steps(3200) == 30


def test_issues(spark):
    schema = "k int, id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>"
    good = ("a", "q", "alpha beta", (["beta"], [6]))
    rows = [
        (0, *good),
        (1, None, *good[1:]),
        (2, "a", "q", "c", None),
        (3, "a", "q", "c", (None, [1])),
        (4, "a", "q", "c", (["x"], [1, 2])),
        (5, "a", "q", "c", ([], [])),
        (6, "a", "q", "alpha beta", (["beta", "beta", "zeta", "beta", None], [6, 2, 0, 50, 0])),
    ]
    got = {r.k: r.issues for r in qa.issues(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == []
    assert got[1] == ["field id is missing"] and got[2] == ["field answers is missing"]
    assert got[3] == ["answers lack texts or starts"] and got[4] == ["texts and starts differ in number"]
    assert got[5] == ["no answer"]
    assert [i[:8] for i in got[6]] == ["answer 1", "answer 2", "answer 3", "answer 4"]
    assert "stands at 6 instead of 2" in got[6][0] and "absent: zeta" in got[6][1] and "outside of 10 characters" in got[6][2]
    report = qa.validation_report(qa.issues(spark.createDataFrame(rows, schema))).first()
    assert (report.total, report.valid, report.invalid) == (7, 1, 6)


def test_whole_texts_are_validated(spark, tmp_path):
    from loomspan.plans import all_queries

    text = "".join(chr(0x4E00 + i) for i in range(9000))  # no letter comes twice
    spark.createDataFrame([(i, text) for i in range(7)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.issues for r in all_queries()["qa_validate_whole"][0](spark, str(tmp_path)).collect()}
    assert got[0] == "" and "stands at 4500 instead of 4501" in got[1] and "starts at 9000, outside of 9000 characters" in got[2]
    assert "absent: zz#zz" in got[3]


def test_spans_are_chosen_and_grouped_in_one_reading(spark):
    """Two windows and an aggregation sorted and grouped the spans, one after another."""
    words = ["Ab", "ab", "c", "D", "d", "e", "f", "\u0130x", "i\u0307x", None]
    rows = [(d, f"L{label}" if label else None, 3 * i, words[(i * (d + 1) + label) % (d + 3)]) for d in range(1, 8) for label in range(3) for i in range(40 if d % 2 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, label string, start long, text string").repartition(6)
    for most, fewest in ((10, 1), (3, 2), (1, 1), (10, 4)):
        want = qa.groups(qa.chosen(df, most=most), fewest=fewest)
        got = qa.chosen_groups(df, most=most, fewest=fewest)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
        assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    plan = qa.chosen_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort ") == 1
    assert qa.chosen_groups(df.where("false")).count() == 0
    kept = spans.resolved(df.withColumns({"end": F.col("start") + 3, "label_ord": F.lit(0)}))
    want = qa.groups(qa.chosen(kept))
    got = qa.chosen_groups(kept, in_order=True)
    exchanges = [d._jdf.queryExecution().executedPlan().toString().count("Exchange") for d in (kept, got, qa.chosen_groups(kept))]
    assert exchanges[0] == exchanges[1] < exchanges[2]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    docs = spark.createDataFrame([(d, "x" * 200) for d in range(9)], "doc_id long, text string")
    assert "number" in qa.placed_pairs(docs, df.where("text IS NOT NULL")).columns
