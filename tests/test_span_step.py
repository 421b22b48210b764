"""The step that all span queries share: patterns that read runs once, and joins with a lexicon."""

import random

from pyspark.sql import functions as F

from loomspan.operators import entities, qa, spans
from loomspan.operators.lexicon import GENERIC, Entry, dimension


def _texts():
    r = random.Random(8)
    parts = ["a", "b", "tion", "tio", "on", "ti", "A", "Z", "0", "12", ".", "..", "@", " ", "the ", "le", "la ", "der ", "el ", "\n", "é", "-"]
    return ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(3000)] + ["", "nationtiontio", "a@b@c.d@e", "1.2.3.4.5.6.7.8", "bathe le la the x."]


def test_patterns_that_read_once_match_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").repartition(4)
    assert all(e.once for e in GENERIC)
    rows = lambda entries: sorted(map(tuple, spans.matches(docs, entries).collect()))
    got = rows(GENERIC)
    assert got == rows([Entry(e.label, e.group, e.pattern) for e in GENERIC]) and {r[1] for r in got} == {e.label for e in GENERIC}


def test_rows_of_a_label_do_not_meet_in_one_task(spark):
    """Lexicons have no known size, so Spark dealt whole tables by label to join them."""
    docs = spark.createDataFrame(list(enumerate(_texts()))[:50], "doc_id long, text string")
    found = spans.resolved(spans.matches(docs, GENERIC))
    named = docs.select(F.explode(F.split("text", " ")).alias("text"), F.concat(F.lit("num"), F.substring("text", 1, 3)).alias("label"))
    pairs = qa.pairs(docs, found, qa.templates(spark, [e.label for e in GENERIC]))
    for df in (entities.valid(named, dimension(spark, GENERIC)), pairs):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and ("[label#" in line or ", label#" in line)]
        assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_spans_are_dealt_once(spark):
    docs = spark.createDataFrame(list(enumerate(_texts()))[:50], "doc_id long, text string")
    df = spans.resolved(spans.matches(docs, GENERIC))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_sorted_once(spark):
    """Matches were sorted for their places, and three times more for windows that were ordered by an expression; each cluster was a group."""
    docs = spark.createDataFrame(list(enumerate(_texts()))[:50], "doc_id long, text string")
    plan = _plan(spans.resolved(spans.matches(docs, GENERIC)))
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_greedy_choice_over_batches(spark):
    """Chains of overlaps, longer than a batch of Arrow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(3)
        rows = [(d, "AB"[r.randint(0, 1)], i % 3, s, s + r.randint(1, 9), "x") for d in range(40) for i, s in enumerate(r.choices(range(60), k=r.randint(1, 50)))]
        got = spans.resolved(spark.createDataFrame(rows, "doc_id long, label string, label_ord int, start long, `end` long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for d in range(40):
        last = 0
        for x in sorted((x for x in rows if x[0] == d), key=lambda x: (x[3], x[3] - x[4], x[2])):
            if x[3] >= last:
                last = x[4]
                want.add((d, x[3], x[4]))
    assert sorted((g.doc_id, g.start, g.end) for g in got) == sorted(want)
