"""Document queries: previews, hashes, resume, chunks, sentences, dates, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import FORMS
from ..functions.text import chunks, first_date, first_number, preview
from ..operators import tagging
from ..operators.entities import PROMPT_CHARACTERS
from ..sources import files
from .catalog import register
from .span_queries import documents, spread


@register("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS preview, length(text) AS n FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''")
def doc_preview(spark, sf_dir):
    return files.nonblank(documents(spark, sf_dir)).select("doc_id", preview(F.col("text")).alias("preview"), F.length("text").cast("long").alias("n"))


@register(f"SELECT doc_id, substr(text, 1, {PROMPT_CHARACTERS}) AS prompt FROM documents")
def doc_prompt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.substring("text", 1, PROMPT_CHARACTERS).alias("prompt"))


@register("SELECT doc_id, md5(text) AS hash FROM documents")
def doc_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))


@register("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark, sf_dir):
    return files.pending(documents(spark, sf_dir).select("doc_id", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "source")


@register("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 3")
def first_pending(spark, sf_dir):
    return files.first_files(resume_antijoin(spark, sf_dir), 3, "doc_id")


_END = """CASE WHEN least({s} + 2000, n) < n AND strpos(reverse(substr(text, {s} + 1, least({s} + 2000, n) - {s})), '.') > 0
  AND least({s} + 2000, n) - strpos(reverse(substr(text, {s} + 1, least({s} + 2000, n) - {s})), '.') > {s} + 1000
  THEN least({s} + 2000, n) - strpos(reverse(substr(text, {s} + 1, least({s} + 2000, n) - {s})), '.') + 1 ELSE least({s} + 2000, n) END"""


@register(
    f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
c AS (SELECT doc_id, text, n, 0::BIGINT AS chunk_no, 0::BIGINT AS start, {_END.format(s="0")} AS stop FROM d
  UNION ALL SELECT doc_id, text, n, chunk_no + 1, greatest(start + 1, stop - 100), {_END.format(s="greatest(start + 1, stop - 100)")} FROM c WHERE stop < n)
SELECT doc_id, chunk_no, start AS start_pos, CAST(stop AS BIGINT) AS end_pos FROM c"""
)
def doc_chunks(spark, sf_dir):
    each = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.posexplode(chunks(F.col("text"))))
    return each.select("doc_id", F.col("pos").cast("long").alias("chunk_no"), F.col("col.start").cast("long").alias("start_pos"), F.col("col.end").cast("long").alias("end_pos"))


_SENTENCES = r"""s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS l FROM documents)"""


@register(f"WITH {_SENTENCES} SELECT doc_id, unnest(range(len(l))) AS sentence_no, unnest(l) AS sentence FROM s")
def sentences(spark, sf_dir):
    return tagging.sentence_table(documents(spark, sf_dir)).withColumn("sentence_no", F.col("sentence_no").cast("long"))


@register(f"WITH {_SENTENCES}, t AS (SELECT doc_id, unnest(l) AS sentence FROM s) SELECT doc_id, count(*) AS n, round(avg(length(sentence)), 6) AS mean_length, max(length(sentence)) AS max_length FROM t GROUP BY doc_id")
def sentence_lengths(spark, sf_dir):
    n = F.length("sentence")
    return tagging.sentence_table(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.max(n).cast("long").alias("max_length"))


#: The texts hold no dates, so some are put after them, one form for each remainder of the id.
_DATED = """text || CASE doc_id % 7 WHEN 0 THEN ' searched on 3 May 2021 and June 2020' WHEN 1 THEN ' until 2019-04-30 only' WHEN 2 THEN ' Sept. 5, 2018 and 01/02/2017'
  WHEN 3 THEN ' 12-11-2016 or so' WHEN 4 THEN ' in march 1999' WHEN 5 THEN ' 1,240 studies' ELSE '' END"""


@register(f"SELECT doc_id, coalesce({', '.join(f'''nullif(regexp_extract({_DATED}, '{p}'), '')''' for p in FORMS)}, 'Not specified') AS found FROM documents")
def first_dates(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(_DATED).alias("text")).select("doc_id", first_date(F.col("text")).alias("found"))


@register(rf"SELECT doc_id, coalesce(nullif(regexp_extract({_DATED}, '\b([0-9]+)\b', 1), ''), 'Not specified') AS found FROM documents")
def first_numbers(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(_DATED).alias("text")).select("doc_id", first_number(F.col("text")).alias("found"))


#: In place of country names, which the texts don't hold: common words of four languages.
PLACES = {"English": "the|and|of", "French": "les|une|des", "German": "der|und|die", "Spanish": "los|una|del"}


@register(
    "WITH p(country, words) AS (VALUES "
    + ", ".join(f"('{c}', ['{w.replace('|', chr(39) + ', ' + chr(39))}'])" for c, w in PLACES.items())
    + r"""), t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\pL\pN_]+') AS l FROM documents),
n AS (SELECT doc_id, country, len(list_filter(l, lambda x: list_contains(words, x))) AS n FROM t, p) SELECT doc_id, country, n FROM n WHERE n > 0"""
)
def country_counts(spark, sf_dir):
    return tagging.country_counts(spread(documents(spark, sf_dir)), countries=PLACES).select("doc_id", "country", F.col("n").cast("long").alias("n"))
