import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.operators import entities, lexicon, spans
from loomspan.operators.lexicon import Entry


def _spans(spark, rows):
    """rows: doc, start, end, label, label_ord."""
    return spark.createDataFrame([(d, s, e, lab, o, "x" * (e - s)) for d, s, e, lab, o in rows], "doc_id long, start long, end long, label string, label_ord int, text string")


def _kept(df):
    return sorted((r.doc_id, r.start, r.end, r.label) for r in df.collect())


def test_offsets_are_code_points_as_in_finditer(spark):
    # the last has the mark that matches get, so it is searched another way
    texts = ["😀 née le 12 mai 2020, ça va 3x", "", "ab12\ncd 4😀5", "no match", "12", "a\ue0f112 \ue0f1 é 7"]
    entries = [Entry("NUM", "g", "[0-9]+"), Entry("WORD", "g", r"(?iU)\b\w+\b")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.label, r.start, r.end, r.text) for r in spans.matches(docs, entries).collect()}
    want = {(i, lab, m.start(), m.end(), m.group()) for i, t in enumerate(texts) for lab, p in (("NUM", "[0-9]+"), ("WORD", r"\b\w+\b")) for m in re.finditer(p, t)}
    assert got == want
    assert all(texts[i][a:b] == t for i, _, a, b, t in got)


def test_rule_layer_takes_leftmost_then_longest_then_label_order(spark):
    df = _spans(spark, [(1, 0, 5, "A", 0), (1, 0, 9, "B", 1), (2, 3, 6, "Z", 0), (2, 3, 6, "A", 1), (3, 0, 4, "A", 0), (3, 3, 8, "B", 1), (3, 7, 9, "C", 2)])
    assert _kept(spans.resolved(df)) == [(1, 0, 9, "B"), (2, 3, 6, "Z"), (3, 0, 4, "A"), (3, 7, 9, "C")]


def test_merge_layer_prefers_the_shorter_and_sorts_labels(spark):
    a = _spans(spark, [(1, 0, 9, "B", 0), (2, 3, 6, "Z", 0)])
    b = _spans(spark, [(1, 0, 5, "A", 1), (1, 0, 5, "A", 1), (2, 3, 6, "A", 1)])
    assert _kept(spans.merged(a, b)) == [(1, 0, 5, "A"), (2, 3, 6, "A")]
    assert _kept(spans.merged(a, b, prefer="longest"))[0] == (1, 0, 9, "B")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 12), st.integers(0, 3)), max_size=60))
def test_resolution_equals_the_plain_loop(spark, raw):
    rows = [(d, s, s + n, "ABCD"[o], o) for d, s, n, o in set(raw)]
    want = []
    for doc in range(4):
        last = 0
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], -(r[2] - r[1]), r[4])):
            if r[1] >= last:
                want.append(r[:4])
                last = r[2]
    assert _kept(spans.resolved(_spans(spark, rows))) == sorted(want)


def test_counts_and_running_sums(spark):
    df = _spans(spark, [(d, s, s + 1, lab, 0) for d in (1, 5, 3000) for s in range(3) for lab in "AB"])
    got = {(r.doc_id, r.label): (r.n, r.running) for r in spans.running_counts(df).collect()}
    assert got == {(d, lab): (3, 3 * i) for i, d in enumerate((1, 5, 3000), 1) for lab in "AB"}


def test_study_lexicon(spark):
    entries = lexicon.study_lexicon()
    assert len(entries) == 55 and len({e.label for e in entries}) == 55
    text = (
        "This systematic review searched PubMed until March 5, 2021 and included 42 studies. HPV types 16 and HPV 6 vaccination; pregnant women in Kenya, n = 1,240. "
        "Vaccine efficacy was 78% (RR = 0.45, 95% CI 0.30 to 0.62, p < 0.001). The ICER was $1,200 per QALY gained and cold chain storage was a barrier."
    )
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = {(r.label, r.text) for r in spans.resolved(spans.matches(docs, entries)).collect()}
    labels = {label for label, _ in found}
    assert {"REVIEW_TYPE", "DATABASE", "DATE_OF_LAST_LITERATURE_SEARCH", "N_STUDIES", "HPV_TYPE", "SPECIAL_POP", "COUNTRY", "SAMPLE_SIZE", "EFFICACY", "EFFECT_VALUE", "CI", "PVALUE", "ICER", "COST", "QALY", "LOGISTICS", "BARRIER"} <= labels
    assert ("PERCENT", "78%") in found and ("CI", "95% CI 0.30 to 0.62") in found
    for phrase in ("January 15, 2020", "15 January 2020", "Jan 2020", "2020-01-15"):
        one = spark.createDataFrame([(1, f"searched on {phrase} again")], "doc_id int, text string")
        assert "DATE_OF_LAST_LITERATURE_SEARCH" in {r.label for r in spans.matches(one, entries).collect()}


def test_study_spans_equal_a_plain_search(spark):
    """All patterns over the sentences of all labels, run together, against Python's own expressions."""
    from loomspan.plans.record_queries import SENTENCES

    text = " \u00e9 ".join(b + p + a for _, b, p, a in SENTENCES)
    entries = lexicon.study_lexicon()
    got = {(r.label, r.start, r.end) for r in spans.matches(spark.createDataFrame([(1, text)], "doc_id int, text string"), entries).collect()}
    assert got == {(e.label, m.start(), m.end()) for e in entries for m in re.finditer(e.pattern.replace("(?U)", ""), text)}
    ordinary = "We may grade the two papers; a rob of 3 in 10 said or wrote so, and the ear was cut at once."
    assert spans.matches(spark.createDataFrame([(1, ordinary)], "doc_id int, text string"), entries).count() == 0


def test_strict_json(spark):
    """A parser that takes NaN and Infinity for numbers would keep these answers; here they are no JSON."""
    from loomspan.functions.text import extracted_json

    df = spark.createDataFrame([(i, x) for i, x in enumerate(('{"a": NaN}', '{"a": nan}', '{"a": Infinity}', '{"a": -inf}', '{"a": null}'))], "i int, answer string")
    assert [r[0] for r in df.orderBy("i").select(extracted_json(df.answer)).collect()] == [None, None, None, None, '{"a": null}']


def test_records(spark):
    docs = spark.createDataFrame([(1, "ab 12 cd"), (2, " \n "), (3, "nothing")], "doc_id long, text string")
    rule = spans.matches(docs, [Entry("NUM", "g", "[0-9]+"), Entry("W", "g", "[a-z]+ ")])
    other = entities.located(docs, spark.createDataFrame([(1, "CD", "X"), (1, "zz", "X")], "doc_id long, text string, label string"))
    got = {r.doc_id: r for r in spans.records(docs, rule, other).collect()}
    assert set(got) == {1, 3} and got[3].spans == []
    assert [(s.start, s.end, s.label, s.text) for s in got[1].spans] == [(0, 3, "W", "ab "), (3, 5, "NUM", "12"), (6, 8, "X", "cd")]
    assert got[1].metadata.total_labels_found == 3 and got[1].metadata.file_size == 8 and len(got[1].metadata.processing_time) == 26
    assert got[1].stats.rule_based_entities == 2 and got[1].stats.llm_entities == 1 and got[1].stats.label_distribution == {"NUM": 1, "W": 1, "X": 1}


def test_entity_filter(spark):
    labels = lexicon.dimension(spark, lexicon.GENERIC)
    rows = [("42", "number"), ("42", "unknown"), ("x", "NUMBER"), ("The ", "NUMBER"), ("", "NUMBER")]
    got = entities.valid(spark.createDataFrame(rows, "text string, label string"), labels).collect()
    assert [tuple(r) for r in got] == [("42", "NUMBER")]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('x\n```json\n{"a": 1}\n```', '{"a": 1}'),
        ("```\n[1]\n```", "[1]"),
        ('so {"a": {"b": 2}} it is', '{"a": {"b": 2}}'),
        (' [1, 2] ', "[1, 2]"),
        ('{"a": ', None),
        ("", None),
        ("words", None),
    ],
)
def test_json_in_answers(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "answer string")
    from loomspan.functions.text import extracted_json

    assert df.select(extracted_json(df.answer)).first()[0] == want


def _client():
    def call(text):
        if "fail" in text:
            raise RuntimeError("no answer")
        return '```json\n{"entities": [{"text": "' + text.split()[0] + '", "label": "NUMBER"}]}\n```'

    return call


def test_model_client(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "fail")], "doc_id long, text string")
    got = {r.doc_id: r for r in entities.parsed(entities.asked(docs, _client, attempts=2, wait=0.0)).collect()}
    assert [tuple(e) for e in got[1].entities] == [("alpha", "NUMBER")]
    assert got[2].answer is None and got[2].error == "no answer" and got[2].entities == []
