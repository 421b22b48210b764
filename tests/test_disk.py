"""What queries write to disk besides their results, held against their texts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspan.operators import qa, spans
from loomspan.operators.lexicon import GENERIC
from loomspan.plans import all_queries, record_queries


def _table(spark, tmp_path, n=300):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9)))
    more = lambda: r.choice(["the " + word(), word() + ".", word().title(), str(r.randint(1, 9999)), f"{word()}@{word()}.org", word() + "tion"])
    texts = [" ".join(more() if r.random() < 0.3 else word() for _ in range(700)) for _ in range(n)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), sum(map(len, texts))


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    each = sc.statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_extractions_shuffle_texts_alone(spark, tmp_path):
    """Spans were shuffled for each figure that a record has, and all of it a second time for a resume that adds nothing."""
    place, size = _table(spark, tmp_path)
    before = _shuffled(spark)
    assert all_queries()["extraction_files"][0](spark, place).count() == 300
    assert _shuffled(spark) - before < 1.5 * size


@pytest.mark.parametrize("kind", ["long", "string"])
def test_records_of_scanned_documents(spark, kind):
    texts = ["", None, " \n\t", "no", "The 12 nations of 1.2.3.4 saw the cat. ", "a@b.c the nation 7.", "é 5 le mot.", "Zed " * 30]
    rows = [(i, t) for i, t in enumerate(texts * 40)] + [(4, "again 99 the end."), (4, "a@b.c"), (None, "the 5."), (None, "the 6.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc_id": F.col("doc_id").cast(kind), "filepath": F.lit("f")}).repartition(3)
    shown = lambda df: sorted(str(r) for r in df.withColumn("metadata", F.col("metadata").dropFields("processing_time")).collect())
    # every text but those of one id, whose matches may come in any order where they begin and end together
    some, both = docs.where("doc_id <> 4 OR doc_id IS NULL"), docs.where("doc_id = 4")
    for given in (some, both):
        got = spans.scanned_records(given, GENERIC)
        want = spans.records(given, spans.matches(given, GENERIC))
        assert got.dtypes == want.dtypes and shown(got) == shown(want)
    assert spans.scanned_records(docs.where("false"), GENERIC).count() == 0


def test_split_samples_shuffle_no_contexts(spark, tmp_path):
    """Contexts, spans and groups were shuffled besides the texts, and the dataset lay there as plain text."""
    place, size = _table(spark, tmp_path)
    before = _shuffled(spark)
    made = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(record_queries, "folder", lambda spark, name: made.append(f"{tmp_path}/{name}") or made[-1])
        assert all_queries()["qa_split_samples"][0](spark, place).count() == 300
    assert _shuffled(spark) - before < 4 * size
    files = [p for p in Path(made[0]).rglob("part-*") if p.is_file()]
    lines = spark.read.json(made[0])
    assert lines.where("length(context) > 3000").count() > 1000 and set(lines.columns) == {"id", "doc_id", "label", "question", "context", "answers", "begins", "split"}
    assert sum(p.stat().st_size for p in files) < 0.5 * lines.agg(F.sum(F.length("context"))).first()[0]


def test_pairs_of_scanned_documents(spark):
    texts = ["", None, "no", "The 12 nations of 1.2.3.4 saw the cat. ", "a@b.c the Nation 7.", "é 5 le mot.", "The Zed 7 the zed " * 300]
    rows = [(i, t) for i, t in enumerate(texts * 30)] + [(3, "again 99 the end. 12"), (None, "the 5.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    templates = qa.templates(spark, [e.label for e in GENERIC])
    shown = lambda df, *drop: sorted(str(r) for r in df.drop(*drop).collect())
    found = spans.resolved(spans.matches(docs, GENERIC))
    got = qa.pairs(docs, GENERIC, templates, fewest=2, most=3)
    want = qa.pairs(docs, found, templates, fewest=2, most=3, in_order=True)
    assert got.dtypes == want.dtypes and shown(got, "begins") == shown(want, "begins") and got.count() > 50
    alone = docs.where("doc_id <> 3")
    split = qa.pairs(alone, GENERIC, templates, seed=7, splits=True)
    assert shown(split) == shown(qa.split(qa.pairs(alone, GENERIC, templates, seed=7), seed=7).select(split.columns))
    assert qa.pairs(docs.where("false"), GENERIC, templates, splits=True).count() == 0
