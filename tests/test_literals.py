"""Patterns that are tried only where a literal that they need occurs."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import literals, spans
from loomspan.operators.lexicon import Entry, study_lexicon
from loomspan.plans.record_queries import SENTENCES, _planted

DATA = "/root/testdata/sf0.001"


def _all_patterns(entries):
    """The entries without what they need, so that every pattern is tried."""
    return [Entry(e.label, e.group, e.pattern) for e in entries]


def _found(df):
    return {(r.doc_id, r.label, r.start, r.end, r.text) for r in df.collect()}


def test_every_sentence_keeps_its_spans(spark):
    """Sentences in any case, glued to other words and with the characters that patterns take for ASCII letters."""
    entries = study_lexicon()
    r = random.Random(1)
    texts = []
    for _, b, p, a in SENTENCES:
        odd = p.replace("k", "K").replace("s", "ſ").replace("i", "ı")
        texts += [b + p + a, p.upper(), p.lower(), odd, odd.title(), f"x{p}", f"{p}x", f"({p})", p.replace(" ", "-"), p.replace(" ", " "), r.choice(["é", "_", "5", "·"]) + p, p.replace(" ", "")]
    texts += ["5ml and 5 μg, 5Μg 0.5µg", "hrHPV or high-riskHPV", "aOR 0.5 adjHR=2", "50percent 3 per cent", "p=0.05 P-value was 0.03", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = _found(spans.matches(docs, entries)), _found(spans.matches(docs, _all_patterns(entries)))
    assert got == want and len(want) > 200 and {label for _, label, *_ in want} == {e.label for e in entries}


@pytest.mark.parametrize("table", ["documents", "pages"])
def test_whole_tables_with_planted_phrases(spark, table):
    """The same spans as all 55 patterns find, with a fifth of the evaluations at most, and every label among them."""
    entries = study_lexicon()
    key, text = ("doc_id", "text") if table == "documents" else ("page_id", "html")
    raw = spark.read.parquet(f"{DATA}/{table}.parquet").select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    docs = _planted(raw.withColumn("doc_id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("doc_id")).cast("long"))).cache()
    got, want = _found(spans.matches(docs, entries)), _found(spans.matches(docs, _all_patterns(entries)))
    assert got == want
    if docs.count() >= len(entries):
        assert {label for _, label, *_ in want} == {e.label for e in entries}
    n = literals.evaluations(docs, entries).first()
    assert n.of == docs.count() * 55 and n.tested * 5 <= n.of


def test_needs():
    e = [Entry("A", "g", "x"), *study_lexicon()]
    index = literals.LiteralIndex(e)
    assert index.needed("") == [0] and index.needed("nothing here") == [0]
    names = lambda t: {e[i].label for i in index.needed(t)}
    assert "COUNTRY" in names("in Kenya") and "COUNTRY" not in names("in kenya") and "COUNTRY" not in names("xKenya")
    assert "PERCENT" in names("5%") and "CANCER" in names("CERVICAL CARCINOMA")
    assert literals.LiteralIndex([]).needed("text") == []


def test_texts_are_folded_as_bytes():
    """A text with one character outside ASCII was folded character by character, in some forty times the time."""
    from time import process_time

    from loomspan.operators.literals import FOLDED, folded

    every = "".join(map(chr, range(0x110000)))  # surrogates too
    assert folded(every) == every.translate(FOLDED) and folded("") == "" and folded("ABC xyz [@") == "abc xyz [@"
    text = "A na\u00efve Plan of W\u00c4RME " * 40000
    took = []
    for f in (lambda: text.translate(FOLDED), lambda: folded(text)):
        began = process_time()
        f()
        took.append(process_time() - began)
    assert took[1] < took[0] / 3
