import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions.text import chunks, first_date, first_number, preview, sentences, strip, word_count
from loomspan.operators import tagging


def _one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text"))).first()[0]


def _plain_chunks(text, size=2000, overlap=100):
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            dot = text.rfind(".", start, end)
            end = dot + 1 if dot > start + size / 2 else end
        out.append((start, end))
        if end == len(text):
            return out
        start = max(start + 1, end - overlap)


@pytest.mark.parametrize("n", [0, 1999, 2000, 2001, 5000, 30_000])
@pytest.mark.parametrize("dots", [0.0, 0.01])
def test_chunks(spark, n, dots):
    r = random.Random(n)
    text = "".join("." if r.random() < dots else "é" for _ in range(n))
    assert [tuple(c) for c in _one(spark, text, chunks)] == _plain_chunks(text)


def test_small_text_helpers(spark):
    assert _one(spark, "\n ab \t", strip) == "ab" and _one(spark, "  a b\n c ", word_count) == 3
    assert _one(spark, "x" * 2000, preview) == "x" * 2000 and _one(spark, "x" * 2001, preview) == "x" * 2000 + "..."


def test_sentences_split_decimals_and_drop_short_ones(spark):
    assert _one(spark, "a" * 20 + ". " + "b" * 21 + "! The rate in the U.S. was about 3.5 per year in all places", sentences) == ["b" * 21, "5 per year in all places"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("on 3 May 2021 and June 5, 2020", "June 5, 2020"),
        ("in may 2019", "may 2019"),
        ("2020-01-05 or 1/2/2021", "2020-01-05"),
        ("at 01/02/2017", "01/02/2017"),
        ("5th of Mayor 2019, Marching 1999, Decibel 2001", "Not specified"),
        ("room 12/34 in 2019-2020", "Not specified"),
        ("by sept. 5th, 2018", "sept. 5th, 2018"),
        ("on 3 May 1821 or 12 Oct 2021", "Oct 2021"),
        ("on 12-11-2016x and 2016-11-12", "2016-11-12"),
        ("none", "Not specified"),
    ],
)
def test_dates(spark, text, want):
    assert _one(spark, text, first_date) == want


def test_numbers(spark):
    assert _one(spark, "x12 and 1,240 of 7", first_number) == "1" and _one(spark, "no", first_number) == "Not specified"


def test_countries(spark):
    docs = spark.createDataFrame([(1, "germany, USA; the us and us. South Africa. Indiana")], "doc_id int, text string")
    assert {r.country: r.n for r in tagging.country_counts(docs).collect()} == {"Germany": 1, "USA": 3, "South Africa": 1}


def test_tag_tree(spark):
    tree = {
        "popu": {"age": [("older adults", "OLD"), ("child",), "infant", ("a", "b", "c"), None], "risk": {"high": {"x": ["smoker"]}, "low": [("none", "N")]}},
        "flat": ["ignored"],
    }
    found = tagging.tag_index(tagging.definition(spark, tree))
    got = [tuple(r) for r in found.drop("path").orderBy("tag_id").collect()]
    assert got == [
        (0, "popu", "age", "age", "OLD", "older adults"),
        (1, "popu", "age", "age", "child", "child"),
        (2, "popu", "age", "age", "infant", "infant"),
        (3, "popu", "risk", "risk", "smoker", "smoker"),
        (4, "popu", "risk", "risk", "N", "none"),
    ]


def test_tags_of_many_definitions(spark):
    rows = [(1, '{"a": {"b": {"c": {"d": ["x", ["y", "Y"]]}}, "e": []}}'), (2, "broken {"), (3, None), (4, "[1]"), (5, '{"a": {"b": ["x", " "]}, "A": {"k": ["z"]}}')]
    tags = tagging.tag_index(spark.createDataFrame(rows, "def_id int, definition string"), by=["def_id"])
    assert sorted((r.def_id, r.tag_id, r.cat, r.sub, r.code, len(r.path)) for r in tags.collect()) == [(1, 0, "a", "b", "x", 4), (1, 1, "a", "b", "Y", 4), (5, 0, "A", "k", "z", 2), (5, 1, "a", "b", "x", 2)]
    scores = spark.createDataFrame([("p", 1, 0, 0.5), ("p", 1, 1, 0.5), ("q", 5, 1, 0.1), ("q", 5, 0, 0.9)], "doc_id string, def_id int, tag_id int, score double")
    up = {(r.doc_id, "/".join(r.node)): (r.score, r.tags, r.best) for r in tagging.rolled_up(scores, tags, by=["def_id"]).collect()}
    assert up == {("p", "a"): (0.5, 2, 0), ("p", "a/b"): (0.5, 2, 0), ("p", "a/b/c"): (0.5, 2, 0), ("p", "a/b/c/d"): (0.5, 2, 0), ("q", "A"): (0.9, 1, 0), ("q", "A/k"): (0.9, 1, 0), ("q", "a"): (0.1, 1, 1), ("q", "a/b"): (0.1, 1, 1)}


def test_records_from_tags(spark):
    tags = spark.createDataFrame([(0, "popu", "age", "A"), (1, "popu", "age", "A"), (2, "popu", "age", "B"), (3, "other", "z", "Z"), (4, "topic", "t", "T")], "tag_id int, cat string, sub string, code string")
    scores = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.9), (1, 2, 0.65), (1, 3, 0.9), (1, 4, 0.64)], "doc_id int, tag_id int, score double")
    hits = tagging.matched(scores, tags)
    assert [(r.section, r.sub, r.codes) for r in tagging.codes(hits).collect()] == [("Population", "age", ["A", "B"])]
    papers = spark.createDataFrame([(1, "in May 2020 and 7 more", "UK UK USA USA USA USA USA France")], "doc_id int, sentence string, text string")
    r = tagging.paper_records(hits, tagging.paper_fields(papers)).withColumn("countries", F.map_entries("study_country")).first()
    assert r.Population == {"age": ["A", "B"]} and [tuple(c) for c in r.countries] == [("USA", 5), ("UK", 2), ("France", 1)] and (r.date, r.number) == ("May 2020", "2020")


def test_best_sentence_is_the_first_on_ties(spark):
    rows = [(1, 0, "low", 0.1), (1, 1, "first", 0.9), (1, 2, "second", 0.9)]
    df = spark.createDataFrame(rows, "doc_id int, sentence_no int, sentence string, score double")
    assert tagging.best_sentences(df).first().sentence == "first"


def test_a_text_is_read_once_for_all_phrases_of_its_tags(spark):
    """Each tag went over the whole text, twice, and every tag's row carried the text."""
    docs = [(1, "aaaa b aaa \U0001f600 na\u00efve banana"), (2, ""), (3, None), (4, "no tags"), (5, "xyxyx zz")]
    tags = [(1, 0, "aa"), (1, 1, "a"), (1, 2, "na\u00efve"), (1, 3, "ana"), (1, 4, "aa"), (1, 5, "\U0001f600"), (1, 6, "aaaa b"), (2, 0, "a"), (3, 0, "a"), (5, 0, "xyx"), (5, 1, "q")]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(tags, "doc_id long, tag_id int, phrase string").repartition(3)
    times = F.floor((F.length("text") - F.length(F.replace("text", F.col("phrase"), F.lit("")))) / F.length("phrase"))
    plain = right.join(left, "doc_id").select("doc_id", "tag_id", times.alias("score"))
    got = tagging.phrase_counts(left, right)
    key = lambda r: (r.doc_id, r.tag_id)
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key) and got.schema == plain.schema
    many = [f"word{i}x" for i in range(3000)]
    assert tagging._times(" ".join(many) * 2, many) == [2] * 3000
