"""Question-answer queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qa, spans
from ..operators.lexicon import GENERIC, questions
from .catalog import register
from .span_queries import RES, documents, found

TEMPLATES = ", ".join(f"('{e.label}', {i}, '{q}')" for e in GENERIC for i, q in enumerate(questions(e.label)))
_PICK = """again AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, lower(text) ORDER BY start) AS again FROM res),
pick AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY CASE WHEN again > 1 THEN 1 ELSE 0 END, start) AS pick FROM again),
sel AS (SELECT doc_id, label, start, "end", text FROM pick WHERE pick <= 10)"""
_GROUPS = """g AS (SELECT doc_id, label, count(*) AS n, min(start) AS first, max(start + length(text)) AS high, string_agg(start || ':' || text, '|' ORDER BY start) AS answers FROM sel GROUP BY doc_id, label)"""
_PAIRS = f"""{RES}, {_PICK}, {_GROUPS},
tpl(label, no, question) AS (VALUES {TEMPLATES}),
x AS (SELECT g.*, d.text, length(d.text) AS len, (4000 - (high - first)) // 2 AS room FROM g JOIN documents d USING (doc_id)),
y AS (SELECT *, greatest(0, first - room) AS a, least(len, high + room) AS b FROM x),
z AS (SELECT *, CASE WHEN len <= 4000 OR high - first > 4000 THEN 0 WHEN a > 0 AND b = len THEN greatest(0, len - 4000) ELSE a END AS f,
  CASE WHEN len <= 4000 THEN len WHEN high - first > 4000 THEN 4000 WHEN a = 0 THEN least(len, 4000) ELSE b END AS t FROM y),
prs AS (SELECT doc_id || '_q' || row_number() OVER (ORDER BY doc_id, first, label) || '_' || label AS id, doc_id, label,
  (SELECT question FROM tpl WHERE tpl.label = z.label AND no = CAST('0x' || substr(md5(doc_id || '|' || z.label || '|42'), 1, 7) AS BIGINT) % 4) AS question,
  substr(text, f + 1, t - f) AS context, n AS n_answers, first - f AS first_start FROM z)"""


def _spans(spark, sf_dir):
    return spans.resolved(found(spark, sf_dir))


def _listed(column: str):
    return F.array_join(F.transform(column, lambda a: F.concat(a["start"].cast("string"), F.lit(":"), a["text"])), "|")


@register(f"{RES}, {_PICK} SELECT doc_id, label, start AS start_pos, text AS span_text FROM sel")
def qa_select_spans(spark, sf_dir):
    return qa.chosen(_spans(spark, sf_dir)).select("doc_id", "label", F.col("start").alias("start_pos"), F.col("text").alias("span_text"))


@register(f"{RES}, {_PICK} SELECT doc_id, label, start AS start_pos, text AS span_text FROM again WHERE again = 1")
def qa_unique_answers(spark, sf_dir):
    return qa.unique_texts(_spans(spark, sf_dir)).select("doc_id", "label", F.col("start").alias("start_pos"), F.col("text").alias("span_text"))


@register(f"{RES}, {_PICK}, {_GROUPS} SELECT doc_id, label, n, first, answers FROM g WHERE n >= 2")
def qa_groups(spark, sf_dir):
    g = qa.groups(qa.chosen(_spans(spark, sf_dir)), fewest=2)
    return g.select("doc_id", "label", "n", "first", _listed("answers").alias("answers"))


def _pairs(spark, sf_dir, splits=False):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return qa.pairs(docs, GENERIC, qa.templates(spark, [e.label for e in GENERIC]), splits=splits)


@register(f"{_PAIRS} SELECT * FROM prs")
def qa_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", "doc_id", "label", "question", "context", F.size("answers").cast("long").alias("n_answers"), F.col("answers")[0]["start"].cast("long").alias("first_start"))


@register(
    f"""{_PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY md5(id || '|42'), id) AS p, count(*) OVER () AS n FROM prs),
s AS (SELECT doc_id, CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM o)
SELECT count(*) AS n_pairs, count(DISTINCT doc_id) AS n_docs, round(count(*) / count(DISTINCT doc_id), 6) AS mean_pairs,
  count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split = 'test') AS n_test FROM s"""
)
def qa_dataset_statistics(spark, sf_dir):
    narrow = qa.placed_pairs(documents(spark, sf_dir).select("doc_id", "text"), GENERIC).select("id", "doc_id")
    return qa.dataset_statistics(qa.split(narrow)).withColumn("mean_pairs", F.round("mean_pairs", 6))


@register(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), CAST(doc_id AS VARCHAR)) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM o"""
)
def qa_split(spark, sf_dir):
    return qa.split(documents(spark, sf_dir).select("doc_id"), by="doc_id").select("doc_id", "split")


#: Answers with a defect that depends on the id: right, moved, absent, out of bounds.
_ANSWERS = "SELECT doc_id, text, array(named_struct('start', cast(10 + doc_id % 2 as int), 'text', substring(text, 11, 6)), named_struct('start', cast(case when doc_id % 3 = 0 then 1000000 else 5 end as int), 'text', case when doc_id % 5 = 0 then 'zz#zz' else substring(text, 6, 4) end)) AS answers FROM docs_in"


@register(
    """WITH a AS (SELECT doc_id, text, 10 + doc_id % 2 AS s, substr(text, 11, 6) AS t, 0 AS k FROM documents
UNION ALL SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 1000000 ELSE 5 END, CASE WHEN doc_id % 5 = 0 THEN 'zz#zz' ELSE substr(text, 6, 4) END, 1 FROM documents),
b AS (SELECT doc_id, k, t, CASE WHEN s < length(text) AND s + length(t) <= length(text) THEN CASE WHEN substr(text, s + 1, length(t)) = t THEN s ELSE nullif(strpos(text, t) - 1, -1) END END AS s FROM a)
SELECT doc_id, coalesce(string_agg(s || ':' || t, '|' ORDER BY k) FILTER (s IS NOT NULL), '') AS answers FROM b GROUP BY doc_id"""
)
def qa_anchor(spark, sf_dir):
    given = spark.sql(_ANSWERS.replace("docs_in", "{docs_in}"), docs_in=documents(spark, sf_dir))
    return given.withColumn("answers", qa.anchored(F.col("answers"), F.col("text"))).select("doc_id", _listed("answers").alias("answers"))


@register(
    """WITH x AS (SELECT doc_id, text, length(text) AS len, least(length(text) - 1, doc_id * 37 % 5000) AS first, least(length(text), doc_id * 37 % 5000 + 100 + doc_id * 91 % 5000) AS high FROM documents WHERE length(text) > 10),
r AS (SELECT *, CAST(floor((4000 - (high - first)) / 2) AS BIGINT) AS room FROM x), y AS (SELECT *, greatest(0, first - room) AS a, least(len, high + room) AS b FROM r)
SELECT doc_id, CAST(CASE WHEN len <= 4000 OR high - first > 4000 THEN 0 WHEN a > 0 AND b = len THEN greatest(0, len - 4000) ELSE a END AS BIGINT) AS start_pos,
  CAST(CASE WHEN len <= 4000 THEN len WHEN high - first > 4000 THEN 4000 WHEN a = 0 THEN least(len, 4000) ELSE b END AS BIGINT) AS end_pos FROM y"""
)
def qa_context(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.length("text") > 10)
    low = F.least(F.length("text") - 1, F.col("doc_id") * 37 % 5000).cast("int")
    high = F.least(F.length("text"), F.col("doc_id") * 37 % 5000 + 100 + F.col("doc_id") * 91 % 5000).cast("int")
    one = docs.withColumn("answers", F.array(F.struct(low.alias("start"), F.substr("text", low + 1, high - low).alias("text"))))
    start, end = qa.window_start(F.col("answers"), F.col("text"), 4000)
    return one.select("doc_id", start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"))


#: Examples with a defect that depends on the id: none, moved, out of bounds, absent, unequal lengths, no answer, no question.
_EXAMPLES = """SELECT doc_id, cast(doc_id as string) AS id, CASE WHEN doc_id % 7 = 6 THEN null ELSE 'What?' END AS question, text AS context,
named_struct('text', CASE doc_id % 7 WHEN 3 THEN array('zz#zz') WHEN 4 THEN array('a', 'b') WHEN 5 THEN cast(array() as array<string>) ELSE array(substring(text, 6, 5)) END,
'answer_start', CASE doc_id % 7 WHEN 1 THEN array(3) WHEN 2 THEN array(length(text)) WHEN 5 THEN cast(array() as array<int>) ELSE array(5) END) AS answers FROM {docs}"""
_ISSUES = """WITH c AS (SELECT doc_id, doc_id % 7 AS k, text AS context, length(text) AS len, substr(text, 6, 5) AS t FROM documents),
i AS (SELECT doc_id, CASE WHEN k = 6 THEN 'field question is missing' WHEN context IS NULL THEN 'field context is missing' WHEN k = 5 THEN 'no answer'
  WHEN k = 4 THEN 'texts and starts differ in number'
  WHEN k = 3 THEN CASE WHEN len <= 5 THEN 'answer 0 starts at 5, outside of ' || len || ' characters' ELSE 'answer 0 is absent: zz#zz' END
  WHEN k = 2 THEN 'answer 0 starts at ' || len || ', outside of ' || len || ' characters'
  WHEN k = 1 THEN CASE WHEN len <= 3 THEN 'answer 0 starts at 3, outside of ' || len || ' characters' WHEN substr(context, 4, length(t)) = t THEN NULL ELSE 'answer 0 stands at ' || (strpos(context, t) - 1) || ' instead of 3' END
  WHEN len <= 5 THEN 'answer 0 starts at 5, outside of ' || len || ' characters' END AS issue FROM c)"""


def _checked(spark, sf_dir):
    return qa.issues(spark.sql(_EXAMPLES, docs=documents(spark, sf_dir)))


@register(f"{_ISSUES} SELECT doc_id, coalesce(issue, '') AS issues FROM i")
def qa_validate(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", F.array_join("issues", "; ").alias("issues"))


@register(f"{_ISSUES} SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue ORDER BY n DESC, issue LIMIT 10")
def qa_issue_histogram(spark, sf_dir):
    return qa.issue_histogram(_checked(spark, sf_dir))


@register(f"{_ISSUES} SELECT count(*) AS total, count(*) FILTER (issue IS NULL) AS valid, count(*) FILTER (issue IS NOT NULL) AS invalid, round(count(*) FILTER (issue IS NULL) * 100.0::DOUBLE / count(*), 6) AS valid_percentage, round(count(*) FILTER (issue IS NOT NULL) * 100.0::DOUBLE / count(*), 6) AS invalid_percentage FROM i")
def qa_validation_report(spark, sf_dir):
    return qa.validation_report(_checked(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("valid_percentage", "invalid_percentage")})


#: As _EXAMPLES, but answers start in the middle of the text.
_WHOLE_EXAMPLES = """SELECT doc_id, cast(doc_id as string) AS id, CASE WHEN doc_id % 7 = 6 THEN null ELSE 'What?' END AS question, text AS context,
named_struct('text', CASE doc_id % 7 WHEN 3 THEN array('zz#zz') WHEN 4 THEN array('a', 'b') WHEN 5 THEN cast(array() as array<string>) ELSE array(substring(text, mid + 1, 5)) END,
'answer_start', CASE doc_id % 7 WHEN 1 THEN array(mid + 1) WHEN 2 THEN array(length(text)) WHEN 5 THEN cast(array() as array<int>) ELSE array(mid) END) AS answers
FROM (SELECT doc_id, text, cast(floor(length(text) / 2) as int) AS mid FROM {docs})"""
_WHOLE_ISSUES = """WITH c AS (SELECT doc_id, doc_id % 7 AS k, text AS context, length(text) AS len, length(text) // 2 AS mid, substr(text, length(text) // 2 + 1, 5) AS t FROM documents),
s AS (SELECT *, CASE k WHEN 1 THEN mid + 1 WHEN 2 THEN len ELSE mid END AS s, CASE k WHEN 3 THEN 'zz#zz' ELSE t END AS a FROM c),
i AS (SELECT doc_id, CASE WHEN k = 6 THEN 'field question is missing' WHEN context IS NULL THEN 'field context is missing' WHEN k = 5 THEN 'no answer'
  WHEN k = 4 THEN 'texts and starts differ in number' WHEN s >= len THEN 'answer 0 starts at ' || s || ', outside of ' || len || ' characters'
  WHEN substr(context, s + 1, length(a)) = a THEN NULL WHEN strpos(context, a) = 0 THEN 'answer 0 is absent: ' || a
  ELSE 'answer 0 stands at ' || (strpos(context, a) - 1) || ' instead of ' || s END AS issue FROM s)"""


def _whole_checked(spark, sf_dir):
    return qa.issues(spark.sql(_WHOLE_EXAMPLES, docs=documents(spark, sf_dir)))


@register(f"{_WHOLE_ISSUES} SELECT doc_id, coalesce(issue, '') AS issues FROM i")
def qa_validate_whole(spark, sf_dir):
    return _whole_checked(spark, sf_dir).select("doc_id", F.array_join("issues", "; ").alias("issues"))


@register(f"{_WHOLE_ISSUES} SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue ORDER BY n DESC, issue LIMIT 10")
def qa_issue_histogram_whole(spark, sf_dir):
    return qa.issue_histogram(_whole_checked(spark, sf_dir))


@register(f"{_WHOLE_ISSUES} SELECT count(*) AS total, count(*) FILTER (issue IS NULL) AS valid, count(*) FILTER (issue IS NOT NULL) AS invalid, round(count(*) FILTER (issue IS NULL) * 100.0::DOUBLE / count(*), 6) AS valid_percentage, round(count(*) FILTER (issue IS NOT NULL) * 100.0::DOUBLE / count(*), 6) AS invalid_percentage FROM i")
def qa_validation_report_whole(spark, sf_dir):
    return qa.validation_report(_whole_checked(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("valid_percentage", "invalid_percentage")})


def _turns(spark, sf_dir):
    """Each user turn with the assistant's next one."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    user = c.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    answer = c.where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("context"))
    return user.join(answer, ["doc_id", "turn"])


_TURNS = "t AS (SELECT u.conv_id AS doc_id, u.turn + 1 AS turn, u.text AS question, a.text AS context FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"
_N = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@register(
    f"WITH {_TURNS} SELECT count(*) AS num_examples, count(DISTINCT doc_id) AS num_docs, "
    + ", ".join(f"round(avg({_N.format(c)}), 6) AS avg_{c}_words, min({_N.format(c)}) AS min_{c}_words, max({_N.format(c)}) AS max_{c}_words" for c in ("question", "context"))
    + " FROM t"
)
def qa_word_stats(spark, sf_dir):
    s = qa.word_statistics(_turns(spark, sf_dir))
    return s.select("num_examples", "num_docs", *[(F.round(c, 6) if c.startswith("avg") else F.col(c).cast("long")).alias(c) for c in s.columns[2:]])


@register(f"WITH {_TURNS} SELECT question, context FROM t WHERE question <> '' AND context <> ''")
def qa_training_pairs(spark, sf_dir):
    return qa.training_pairs(_turns(spark, sf_dir))
