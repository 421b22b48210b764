"""Span queries over documents, with the generic lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, spans
from ..operators.lexicon import GENERIC, dimension
from ..staging import folder, written
from ..streaming.incremental import document_stream, extract_stream
from .catalog import register

#: For the merge of two sources: the first four labels count as one, the others as the other.
CUT = 4

LEX = ", ".join(f"('{e.label}', {i}, '{e.group}', '{e.pattern}')" for i, e in enumerate(GENERIC))
#: e: doc_id, label, label_ord, start, "end", text of all matches
E = f"""lex(label, label_ord, label_group, p) AS (VALUES {LEX}),
mm AS (SELECT doc_id, label, label_ord, label_group, regexp_extract_all(text, p) AS m, regexp_split_to_array(text, p) AS q FROM documents, lex),
u AS (SELECT doc_id, label, label_ord, label_group, unnest(m) AS text, unnest(q[1:len(m)]) AS gap, unnest(range(len(m))) AS pos FROM mm WHERE len(m) > 0),
v AS (SELECT *, CAST(sum(length(gap) + length(text)) OVER (PARTITION BY doc_id, label_ord ORDER BY pos) AS BIGINT) AS "end" FROM u),
e AS (SELECT doc_id, label, label_ord, label_group, "end" - length(text) AS start, "end", text FROM v)"""


def kept(source: str, order: str, name: str) -> str:
    """Greedy choice within clusters of overlapping spans."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS r,
  CASE WHEN start >= coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS fresh FROM {source}),
{name}_c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY r) AS cluster FROM {name}_o),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY r) AS k FROM {name}_c),
{name}_f AS (
  SELECT doc_id, cluster, k, label, start, "end", text, "end" AS last, true AS keep FROM {name}_n WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.cluster, n.k, n.label, n.start, n."end", n.text, CASE WHEN n.start >= f.last THEN n."end" ELSE f.last END, n.start >= f.last
  FROM {name}_f f JOIN {name}_n n ON n.doc_id = f.doc_id AND n.cluster = f.cluster AND n.k = f.k + 1),
{name} AS (SELECT doc_id, label, start, "end", text FROM {name}_f WHERE keep)"""


RES = f"""WITH RECURSIVE {E}, {kept("e", 'start, "end" - start DESC, label_ord', "res")}"""
OUT = 'doc_id, label, start AS start_pos, "end" AS end_pos, text AS span_text'


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Regular expressions cost far more than reading, so a table of fewer splits than there are cores is dealt to all of them first."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.matches(spread(documents(spark, sf_dir).select("doc_id", "text")), GENERIC)


def _out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "label", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), F.col("text").alias("span_text"))


@register(f"WITH {E} SELECT {OUT} FROM e")
def span_matches(spark, sf_dir):
    return _out(found(spark, sf_dir))


@register(f"{RES} SELECT {OUT} FROM res")
def span_resolved(spark, sf_dir):
    return _out(spans.resolved(found(spark, sf_dir)))


@register(
    f"""WITH RECURSIVE {E}, r AS (SELECT * FROM e WHERE label_ord < {CUT}), {kept("r", 'start, "end" - start DESC, label_ord', "one")},
m AS (SELECT DISTINCT doc_id, label, start, "end", text FROM (SELECT * FROM one UNION ALL SELECT doc_id, label, start, "end", text FROM e WHERE label_ord >= {CUT})),
{kept("m", 'start, "end", label', "res")} SELECT {OUT} FROM res"""
)
def span_merged(spark, sf_dir):
    m = written(found(spark, sf_dir), "matches")  # read for both sources
    return _out(spans.merged(spans.resolved(m.where(F.col("label_ord") < CUT)), m.where(F.col("label_ord") >= CUT)))


@register(f"{RES} SELECT doc_id, label, count(*) AS n FROM res GROUP BY ALL")
def span_label_counts(spark, sf_dir):
    return spans.label_counts(spans.resolved(found(spark, sf_dir)))


@register(f"WITH {E}, c AS (SELECT doc_id, label, count(*) AS n FROM e GROUP BY ALL) SELECT doc_id, label, n, CAST(sum(n) OVER (PARTITION BY label ORDER BY doc_id) AS BIGINT) AS running FROM c")
def span_label_counts_running(spark, sf_dir):
    return spans.running_counts(found(spark, sf_dir))


@register(
    f"""{RES}, f AS (SELECT doc_id, label, count(*) AS n, min(start) AS at_ FROM res GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_spans, count(*) AS n_labels, string_agg(label, ',' ORDER BY at_, label) AS labels FROM f GROUP BY doc_id"""
)
def span_doc_stats(spark, sf_dir):
    return spans.document_stats(spans.resolved(found(spark, sf_dir)))


@register(f"{RES} SELECT label, count(*) AS n FROM res GROUP BY label ORDER BY n DESC, label LIMIT 10")
def span_top_labels(spark, sf_dir):
    return spans.top_labels(spans.resolved(found(spark, sf_dir)))


@register(f"WITH {E} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM e WHERE label IN (SELECT label FROM lex WHERE label_group IN ('contact', 'quantity')) GROUP BY label")
def label_semijoin(spark, sf_dir):
    known = dimension(spark, GENERIC).where(F.col("label_group").isin("contact", "quantity"))
    hit = found(spark, sf_dir).join(F.broadcast(known), "label", "left_semi")  # a lexicon's labels
    return hit.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@register("""WITH d AS (SELECT doc_id, text, substr(text, 50, 12) AS entity FROM documents)
SELECT doc_id, CAST(strpos(lower(text), lower(entity)) - 1 AS BIGINT) AS start_pos, CAST(strpos(lower(text), lower(entity)) - 1 + length(entity) AS BIGINT) AS end_pos, 'PIECE' AS label,
       substr(text, strpos(lower(text), lower(entity)), length(entity)) AS span_text FROM d WHERE entity <> ''""")
def entity_locate(spark, sf_dir):
    docs = documents(spark, sf_dir)
    named = docs.select("doc_id", F.substring("text", 50, 12).alias("text"), F.lit("PIECE").alias("label"))
    return _out(entities.located(docs, named)).select("doc_id", "start_pos", "end_pos", "label", "span_text")


_WORDS = "SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS text FROM documents"
_TRIVIAL = ", ".join(f"'{w}'" for w in entities.TRIVIAL)


@register(
    f"""WITH w AS ({_WORDS}), l AS (SELECT text, CASE length(text) % 3 WHEN 0 THEN 'Number' WHEN 1 THEN 'article' ELSE 'unheard' END AS label FROM w)
SELECT upper(label) AS label, count(*) AS n, count(DISTINCT text) AS n_texts FROM l
WHERE length(text) >= 2 AND text NOT IN ({_TRIVIAL}) AND label <> 'unheard' GROUP BY ALL"""
)
def entity_filter(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("text"))
    rest = F.length("text") % 3
    named = words.withColumn("label", F.when(rest == 0, "Number").when(rest == 1, "article").otherwise("unheard"))
    return entities.valid(named, dimension(spark, GENERIC)).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


_ANSWERS = """CASE doc_id % 5 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || '{"entities": [{"text": "' || w || '", "label": "X"}]}' || chr(10) || '```'
  WHEN 1 THEN '```' || chr(10) || '[1, 2, "' || w || '"]' || chr(10) || '``` done' WHEN 2 THEN 'so {"a": "' || w || '"} it is' WHEN 3 THEN 'broken {"a": ' || w || '}' ELSE '' END"""


def _shaped(x: str) -> str:
    # DuckDB takes bare nan and inf for numbers, which JSON has not
    bare = "'^\\{\"a\": (nan|inf)'"
    return f"CASE WHEN regexp_matches({x}, '(?s)^\\{{.*\\}}$|^\\[.*\\]$') AND json_valid({x}) AND NOT regexp_matches({x}, {bare}) THEN {x} END"


@register(
    f"""WITH d AS (SELECT doc_id, regexp_extract(text, '[a-z]+') AS w FROM documents), a AS (SELECT doc_id, {_ANSWERS} AS answer FROM d),
x AS (SELECT doc_id, trim(regexp_extract(answer, '(?s)```json\\s*(.*?)\\s*```', 1)) AS x1, trim(regexp_extract(answer, '(?s)```\\s*(.*?)\\s*```', 1)) AS x2, trim(regexp_extract(answer, '(?s)(\\{{.*\\}})', 1)) AS x3, trim(answer) AS x4 FROM a)
SELECT doc_id, coalesce({_shaped("x1")}, {_shaped("x2")}, {_shaped("x3")}, {_shaped("x4")}) AS content FROM x"""
)
def llm_json_extract(spark, sf_dir):
    answers = documents(spark, sf_dir).select("doc_id", F.regexp_extract("text", "[a-z]+", 0).alias("w")).select("doc_id", F.expr(_ANSWERS.replace("chr(10)", "'\\n'")).alias("answer"))
    return answers.select("doc_id", entities.extracted_json(F.col("answer")).alias("content"))


@register(f"{RES} SELECT {OUT} FROM res")
def stream_spans(spark, sf_dir):
    """The resolved spans again, by way of a file stream."""
    place = folder(spark, "stream")
    # a pattern, because a stream source takes a plain path for a folder, and the table may be one file
    docs = document_stream(spark, f"{sf_dir}/documents.parque[t]", documents(spark, sf_dir).schema).select("doc_id", "text")
    extract_stream(docs, GENERIC, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return _out(spark.read.parquet(f"{place}/out"))
