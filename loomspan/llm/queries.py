"""Queries op1 to op13 over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, contamination, divergence, exact_dedup, langid, mixing, pii, simhash, substring_dedup, suffix_dedup, token_store, vector_codes
from .common import folder

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    store = folder(spark, "store")
    token_store.write(docs, store)
    return token_store.digests(spark, store, token_store.keys_of(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(_documents(spark, sf_dir).select("doc_id", "text"), decode=True))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.found(_documents(spark, sf_dir)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", digits.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(contamination.matched(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight >= level) * weight, cap)) AS target
  FROM l),
b AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (
  SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (
  SELECT g.source, g.h, n, b.target - b.whole * b.source_size AS budget, sum(n) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
x AS (
  SELECT source, budget, coalesce(min(h) FILTER (upto > budget), max(h)) AS th FROM c GROUP BY source, budget),
y AS (
  SELECT x.source, x.th, x.budget > 0 AND abs(c.upto - x.budget) <= abs(c.upto - c.n - x.budget) AS inc
  FROM x JOIN c ON x.source IS NOT DISTINCT FROM c.source AND x.th = c.h)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.whole + CASE WHEN d.h < y.th OR (d.h = y.th AND y.inc) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN y ON d.source IS NOT DISTINCT FROM y.source"""


_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_NORMAL}, '{_LETTERS}') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS terms FROM k GROUP BY lang) USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(coalesce(c.n, 0) + 5 AS HUGEINT) * 1000000000) // CAST(g.total + 5 * g.terms AS HUGEINT) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (
  SELECT lang, term, 1 + (CAST(sum(n) + 5 AS HUGEINT) * 1000000000) // CAST(any_value(total) + 5 * any_value(terms) AS HUGEINT) AS q
  FROM p JOIN (SELECT lang, sum(total) AS total, any_value(terms) AS terms FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50"""


def _op12_sql(rounds: int = 4) -> str:
    near = """SELECT i, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
    SELECT x.i, x.p, c.e, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN {c} AS c ON c.p = x.p) GROUP BY i, p"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (" + near.format(c=f"c{r}") + ")")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT p, e, list(v ORDER BY place) AS v FROM (
    SELECT p, e, place, CAST(floor(CAST(sum(n) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM (
      SELECT a.p, a.e, unnest(x.v) AS n, generate_subscripts(x.v, 1) AS place FROM a{r} AS a JOIN x ON x.i = a.i AND x.p = a.p)
    GROUP BY p, e, place) GROUP BY p, e),
c{r + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} AS m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label,
         list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (
  SELECT i, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM k, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, i AS e, v FROM x WHERE i < 256),
{(',' + chr(10)).join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)},
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN r USING (i), b"""


_WORDS = rf"regexp_extract_all({_NORMAL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS x
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
o AS (
  SELECT d.r, s, n.n, array_to_string(w[s : s + n.n - 1], ' ') AS x
  FROM d, (SELECT DISTINCT n FROM i) AS n, unnest(range(1, len(d.w) - n.n + 2)) AS t(s)),
m AS MATERIALIZED (SELECT DISTINCT o.r, o.s, o.n, i.item_id FROM o JOIN i ON o.n = i.n AND o.x = i.x),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + n)) AS t(p) GROUP BY r),
g AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_ann, op2_mixing, op3_langid, op4_suffix_dedup, op5_simhash, op6_token_store, op7_substring_dedup, op8_bpe, op9_pii, op10_exact_dedup, op11_divergence, op12_vector_codes, op13_contamination)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op10_exact_dedup": OP10_SQL, "op11_divergence": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_contamination": OP13_SQL}
