"""Retrieval, evaluation, tagging and report queries over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import FORMS
from ..operators import bounds, evaluation, quantiles, report, retrieval, spans, tagging
from ..operators.lexicon import GENERIC, dimension
from ..staging import written
from .catalog import register
from .document_queries import _DATED, PLACES
from .span_queries import E, documents, spread

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0)"
_Q = "q.vec_id % 20 = 0"
_S = f"s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, q.label = c.label AS same, list_dot_product(q.e, c.e) AS score FROM n q, n c WHERE {_Q})"
_R = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"
_TOP = f"WITH {_V}, {_S}, {_R}"


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _corpus(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _queries(spark, sf_dir):
    """A stated query set: every twentieth vector."""
    return _vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _ranks(df):
    return _six(df.withColumn("rank", F.col("rank").cast("long")), "score")


_PAIR = f"WITH {_V} SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e), 6) AS score FROM n a JOIN n b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a = v.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("doc_id"), F.col("embedding").alias("a"))
    b = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("b"))
    return retrieval.similarity(a.join(b, "doc_id")).select("query_id", "doc_id", "score")


@register(_PAIR)
def pair_similarity(spark, sf_dir):
    return _six(_pairs(spark, sf_dir), "score")


@register(f"WITH p AS ({_PAIR.replace('round(list_dot_product(a.e, b.e), 6)', 'list_dot_product(a.e, b.e)')}) SELECT round(avg(score), 6) AS mean_similarity, round(stddev_pop(score), 6) AS std_similarity, round(min(score), 6) AS min_similarity, round(max(score), 6) AS max_similarity, round(median(score), 6) AS median_similarity FROM p")
def similarity_stats(spark, sf_dir):
    s = evaluation.similarity_statistics(_pairs(spark, sf_dir))
    return _six(s, *s.columns)


_CUTS = (0.05, 0.25, 0.5, 0.75, 0.95)


@register(
    f"WITH p AS ({_PAIR.replace('a.vec_id AS query_id', 'a.label, a.vec_id AS query_id').replace('round(list_dot_product(a.e, b.e), 6)', 'list_dot_product(a.e, b.e)')}), q AS (SELECT label, count(*) AS n, quantile_cont(score, [{', '.join(map(str, _CUTS))}]) AS v FROM p GROUP BY label) "
    f"SELECT label, unnest([{', '.join(f'{c}::DOUBLE' for c in _CUTS)}]) AS at, n, round(unnest(v), 6) AS quantile FROM q"
)
def similarity_quantiles(spark, sf_dir):
    """The distribution of the pairs' similarities by the label of the first."""
    labels = _vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "label")
    scores = written(_pairs(spark, sf_dir).where("score is not null").join(labels, "query_id").select("label", "score"), "scores")
    return _six(quantiles.quantiles(scores, _CUTS, by=["label"], column="score"), "quantile")


@register("SELECT lang, source, unnest([0.1::DOUBLE, 0.5, 0.99]) AS at, n, unnest(v) AS quantile FROM (SELECT lang, source, count(n_chars) AS n, quantile_cont(n_chars, [0.1, 0.5, 0.99]) AS v FROM documents GROUP BY lang, source HAVING count(n_chars) > 0)")
def length_quantiles(spark, sf_dir):
    """Lengths of documents by language and source."""
    return _six(quantiles.quantiles(documents(spark, sf_dir).select("lang", "source", "n_chars"), [0.1, 0.5, 0.99], by=["lang", "source"], column="n_chars"), "quantile")


@register(f"{_TOP.replace(_Q, 'q.vec_id = 0')} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def topk(spark, sf_dir):
    return _ranks(retrieval.retrieve(_queries(spark, sf_dir).where("query_id = 0"), _corpus(spark, sf_dir)))


@register(f"{_TOP} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def topk_batch(spark, sf_dir):
    return _ranks(retrieval.retrieve(_queries(spark, sf_dir), _corpus(spark, sf_dir)))


@register(f"{_TOP} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def topk_bounded(spark, sf_dir):
    """topk_batch by way of clusters that are ruled out."""
    return _ranks(bounds.Clustered(_corpus(spark, sf_dir)).nearest(_queries(spark, sf_dir))[0])


@register(f"{_TOP} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE score >= 0.3")
def search_above(spark, sf_dir):
    """All rows at or above a score, however many, by way of clusters that are ruled out."""
    return _ranks(retrieval.ranked(bounds.Clustered(_corpus(spark, sf_dir)).above(_queries(spark, sf_dir), 0.3)[0]))


@register(f"{_TOP} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10 AND score >= 0.3")
def search_threshold(spark, sf_dir):
    return _ranks(retrieval.search(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10, 0.3))


@register(f"{_TOP.replace('FROM n q, n c WHERE', 'FROM n q JOIN n c ON c.vec_id BETWEEN q.vec_id AND q.vec_id + 49 WHERE')} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r")
def rank_contexts(spark, sf_dir):
    """Every query of the stated set ranks a list of contexts of its own: the fifty rows from its id on."""
    lists = _queries(spark, sf_dir).withColumn("doc_id", F.explode(F.sequence("query_id", F.col("query_id") + 49)))
    own = lists.select("query_id", "doc_id", F.col("embedding").alias("a")).join(_corpus(spark, sf_dir).select("doc_id", F.col("embedding").alias("b")), "doc_id")
    return _ranks(retrieval.ranked(retrieval.similarity(own).select("query_id", "doc_id", "score")).where("score is not null"))


@register(f"{_TOP} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r")
def rank_contexts_batch(spark, sf_dir):
    """Every query of the stated set against every context.

    Scores are rounded as the SQL does it; Spark's round writes each number out
    in digits, which took longer than the score and its rank.
    """
    r, s = retrieval.rank_contexts(_queries(spark, sf_dir), _corpus(spark, sf_dir)), F.col("score")
    six = F.when(F.isnan(s), s).otherwise(F.signum(s) * F.floor(F.abs(s) * 1e6 + 0.5) / 1e6 + 0.0)
    return r.withColumns({"rank": F.col("rank").cast("long"), "score": six})


#: Three "models": prefixes of the vectors.
PREFIXES = (16, 32, 64)
_MODELS = f"""WITH v AS (SELECT 'm' || d AS model, vec_id, CAST(embedding[1:d] AS DOUBLE[]) AS e FROM embeddings, (VALUES {", ".join(f"({d})" for d in PREFIXES)}) p(d)),
n AS (SELECT model, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
s AS (SELECT c.model, q.vec_id AS query_id, c.vec_id AS doc_id, list_dot_product(q.e, c.e) AS score FROM n q JOIN n c ON q.model = c.model WHERE {_Q}),
r AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, doc_id) AS rank FROM s),
t AS (SELECT * FROM r WHERE rank <= 5), m AS (SELECT model, avg(score) AS avg_score, max(score) AS max_score, min(score) AS min_score, count(*) AS n_results FROM t GROUP BY model)"""


def _by_model(df, keep):
    each = F.array(*[F.struct(F.lit(f"m{d}").alias("model"), F.slice("embedding", 1, d).alias("embedding")) for d in PREFIXES])
    return df.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def _searched(spark, sf_dir):
    return retrieval.search_models(_by_model(_queries(spark, sf_dir), ["query_id"]), _by_model(_corpus(spark, sf_dir), ["doc_id"]), 5)


def _compared(spark, sf_dir):
    return retrieval.compare_models(_searched(spark, sf_dir))


@register(f"{_MODELS} SELECT model, query_id, rank, doc_id, round(score, 6) AS score FROM t")
def search_models(spark, sf_dir):
    return _ranks(_searched(spark, sf_dir))


@register(f"{_MODELS} SELECT model, round(avg_score, 6) AS avg_score, round(max_score, 6) AS max_score, round(min_score, 6) AS min_score, n_results FROM m")
def compare_models(spark, sf_dir):
    return _six(_compared(spark, sf_dir), "avg_score", "max_score", "min_score")


@register(f"{_MODELS} SELECT model, count(DISTINCT query_id) AS n_searches FROM t GROUP BY model")
def search_counts(spark, sf_dir):
    return retrieval.search_counts(_searched(spark, sf_dir))


_SCORES = ["avg_score", "max_score", "min_score"]
_LONG = f"{_MODELS}, l AS (UNPIVOT (SELECT model, avg_score, max_score, min_score FROM m) ON avg_score, max_score, min_score INTO NAME metric VALUE value)"


@register(f"{_LONG} SELECT model, metric, round(value, 6) AS value FROM l")
def report_long(spark, sf_dir):
    return _six(report.long_form(_compared(spark, sf_dir), _SCORES), "value")


@register(f"{_LONG}, w AS (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM l) SELECT model, metric, round(CASE WHEN round(hi, 9) > round(lo, 9) THEN (value - lo) / (hi - lo) ELSE 0.5 END, 6) AS value FROM w")
def report_normalised(spark, sf_dir):
    m = _compared(spark, sf_dir)
    return _six(report.normalised(m.withColumns({c: F.round(c, 9) for c in _SCORES}), _SCORES), "value")


@register("WITH m AS (SELECT 'm' || d AS model, count(*) * d AS params, count(*) * 0.5::DOUBLE AS total_ms, count(*) AS n_sentences FROM embeddings, (VALUES (16), (32), (64)) p(d) GROUP BY d) SELECT model, CAST(params AS BIGINT) AS params, round(params * 4 / 1048576.0::DOUBLE, 6) AS model_size_mb, round(total_ms / n_sentences, 6) AS inference_time_ms FROM m")
def model_size(spark, sf_dir):
    n = _by_model(_vectors(spark, sf_dir), ["vec_id"]).groupBy("model").agg(F.sum(F.size("embedding")).alias("params"), (F.count("*") * 0.5).alias("total_ms"), F.count("*").alias("n_sentences"))
    return _six(evaluation.efficiency(n), "model_size_mb", "inference_time_ms").select("model", "params", "model_size_mb", "inference_time_ms")


# judgements: a row is relevant to a query if it has the query's label and is another one
_HITS = f"""{_TOP.replace("n q, n c WHERE", "n q JOIN n c ON q.vec_id <> c.vec_id WHERE")}, t AS (SELECT query_id, rank, CAST(same AS INT)::DOUBLE AS hit FROM r WHERE rank <= 10),
f AS (SELECT query_id, coalesce(min(rank - 1) FILTER (hit > 0), 10) AS first FROM t GROUP BY query_id),
rel AS (SELECT q.vec_id AS query_id, count(*) AS n FROM n q JOIN n c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE {_Q} GROUP BY q.vec_id)"""


def _others(spark, sf_dir):
    return retrieval.retrieve(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10, others=True)


def _judged(spark, sf_dir):
    """Marks of the retrieved rows, as a table, and the number of relevant rows of each query."""
    marks, n = evaluation.judged_alike(_others(spark, sf_dir), _corpus(spark, sf_dir), _queries(spark, sf_dir), "label")
    return written(marks, "marks"), n


def _marks(spark, sf_dir):
    return _judged(spark, sf_dir)[0]


@register(f"{_HITS} SELECT round(avg((first < 1)::INT), 6) AS recall_at_1, round(avg((first < 5)::INT), 6) AS recall_at_5, round(avg((first < 10)::INT), 6) AS recall_at_10 FROM f")
def ir_recall(spark, sf_dir):
    return _six(evaluation.recall(evaluation.first_hits(_marks(spark, sf_dir), 10)), "recall_at_1", "recall_at_5", "recall_at_10")


@register(f"{_HITS} SELECT round(avg(1.0 / (first + 1)), 6) AS mrr, round(avg(CASE WHEN first < 10 THEN 1.0 / (first + 1) ELSE 0 END), 6) AS mrr_standard FROM f")
def ir_mrr(spark, sf_dir):
    first = evaluation.first_hits(_marks(spark, sf_dir), 10)
    both = evaluation.mrr(first, 10).join(F.broadcast(evaluation.mrr(first, 10, compat=False).withColumnRenamed("mrr", "mrr_standard")), F.lit(True))
    return _six(both, "mrr", "mrr_standard")


@register(
    f"""{_HITS}, d AS (SELECT query_id, sum(hit / log2(rank + 1)) AS dcg, sum(1 / log2(rank + 1)) AS full_ FROM t WHERE rank <= 5 GROUP BY query_id),
i AS (SELECT query_id, (SELECT sum(1 / log2(k + 1)) FROM range(1, 6) x(k) WHERE k <= rel.n) AS best FROM rel)
SELECT round(avg(dcg / full_), 6) AS ndcg_at_5, round(avg(coalesce(dcg / best, 0)), 6) AS ndcg_standard FROM d LEFT JOIN i USING (query_id)"""
)
def ir_ndcg(spark, sf_dir):
    marks, relevant = _judged(spark, sf_dir)
    standard = evaluation.ndcg(marks, 5, compat=False, relevant=relevant).withColumnRenamed("ndcg_at_5", "ndcg_standard")
    return _six(evaluation.ndcg(marks, 5).join(F.broadcast(standard), F.lit(True)), "ndcg_at_5", "ndcg_standard")


@register(
    f"""{_HITS}, h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS j FROM t WHERE rank <= 5 AND hit > 0),
p AS (SELECT query_id, avg(j / rank) AS ap FROM h GROUP BY query_id), c AS (SELECT query_id, avg(rank / (hit + 1)) AS v FROM t GROUP BY query_id)
SELECT round(avg(coalesce(ap, 0)), 6) AS map_at_5, round(avg(v), 6) AS map_at_5_compat FROM c LEFT JOIN p USING (query_id)"""
)
def ir_map(spark, sf_dir):
    marks = _marks(spark, sf_dir)
    both = evaluation.mean_average_precision(marks, 5).join(F.broadcast(evaluation.map_compat(marks, 5)), F.lit(True))
    return _six(both, "map_at_5", "map_at_5_compat")


@register("SELECT DISTINCT role AS query_id, conv_id AS doc_id FROM conversations")
def ir_judgements(spark, sf_dir):
    """The documents that are relevant to each query."""
    return evaluation.judgements(_examples(spark, sf_dir))[2]


@register("SELECT role AS query_id, arg_max(text, turn * 1000000000 + conv_id) AS question FROM conversations GROUP BY role")
def ir_questions(spark, sf_dir):
    """The question of each query, where the last one stands."""
    return evaluation.judgements(_examples(spark, sf_dir))[0]


@register("SELECT conv_id AS doc_id, arg_max(text, turn) AS context FROM conversations GROUP BY conv_id")
def ir_corpus(spark, sf_dir):
    """The context of each document, where the last one stands."""
    return evaluation.judgements(_examples(spark, sf_dir, F.col("turn")))[1]


def _examples(spark, sf_dir, position=None):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = F.col("turn") * 1_000_000_000 + F.col("conv_id") if position is None else position
    return c.select(F.col("role").alias("id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("question"), F.col("text").alias("context"), at.alias("position"))


_TAGS = "tags AS (SELECT vec_id AS tag_id, e, CASE (vec_id // 25) % 5 WHEN 0 THEN 'popu' WHEN 1 THEN 'topic' WHEN 2 THEN 'outcome' WHEN 3 THEN 'intervention' ELSE 'other' END AS cat, 's' || (vec_id // 25) % 3 AS sub, 'c' || (vec_id // 25) % 7 AS code FROM n WHERE vec_id % 25 = 0)"
_TAGGED = f"WITH {_V}, {_TAGS}, s AS (SELECT n.label AS doc_id, t.tag_id, max(list_dot_product(n.e, t.e)) AS score FROM n, tags t GROUP BY ALL), m AS (SELECT s.doc_id, CASE cat WHEN 'popu' THEN 'Population' ELSE cat END AS section, sub, code, tag_id FROM s JOIN tags USING (tag_id) WHERE score >= 0.5 AND cat <> 'other')"


def _tags(spark, sf_dir):
    """Every twenty-fifth vector as a tag's, with made-up places in a tree."""
    no = F.floor(F.col("vec_id") / 25)
    cat = F.element_at(F.array(*map(F.lit, ["popu", "topic", "outcome", "intervention", "other"])), (no % 5 + 1).cast("int"))
    name = lambda p, k: F.concat(F.lit(p), (no % k).cast("string"))
    return _vectors(spark, sf_dir).where("vec_id % 25 = 0").select(F.col("vec_id").alias("tag_id"), "embedding", cat.alias("cat"), name("s", 3).alias("sub"), name("c", 7).alias("code"))


def _tag_scores(spark, sf_dir):
    sentences = _vectors(spark, sf_dir).select(F.col("label").alias("doc_id"), F.col("vec_id").alias("sentence_no"), "embedding")
    return tagging.tag_scores(sentences, _tags(spark, sf_dir))


@register(f"{_TAGGED} SELECT doc_id, tag_id, round(score, 6) AS score FROM s")
def tag_scores(spark, sf_dir):
    return _six(_tag_scores(spark, sf_dir), "score")


def _hits(spark, sf_dir):
    return tagging.matched(_tag_scores(spark, sf_dir), _tags(spark, sf_dir).drop("embedding"), 0.5)


@register(f"{_TAGGED} SELECT doc_id, section, sub, code, tag_id FROM m")
def tag_matches(spark, sf_dir):
    return _hits(spark, sf_dir)


@register(f"{_TAGGED}, f AS (SELECT doc_id, section, sub, code, min(tag_id) AS at_ FROM m GROUP BY ALL) SELECT doc_id, section, sub, string_agg(code, ',' ORDER BY at_, code) AS codes FROM f GROUP BY doc_id, section, sub")
def tag_codes(spark, sf_dir):
    return tagging.codes(_hits(spark, sf_dir)).withColumn("codes", F.array_join("codes", ","))


_COUNTRY = "WITH p(country, words) AS (VALUES " + ", ".join(f"('{c}', ['{w.replace('|', chr(39) + ', ' + chr(39))}'])" for c, w in PLACES.items()) + ")"


@register(
    _COUNTRY
    + rf""", {E}, t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\pL\pN_]+') AS l FROM documents),
n AS (SELECT doc_id, country, len(list_filter(l, lambda x: list_contains(words, x))) AS n FROM t, p),
c AS (SELECT doc_id, string_agg(country || '=' || n, ',' ORDER BY n DESC, country) AS countries FROM n WHERE n > 0 GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS topics FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce({", ".join(f"nullif(regexp_extract({_DATED}, '{p}'), '')" for p in FORMS)}, 'Not specified') AS date,
coalesce(nullif(regexp_extract({_DATED}, '\b([0-9]+)\b', 1), ''), 'Not specified') AS number, coalesce(topics, '') AS topics, coalesce(countries, '') AS countries
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""
)
def paper_record(spark, sf_dir):
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    hits = spans.matches(docs, GENERIC).select("doc_id", "label").distinct().join(F.broadcast(dimension(spark, GENERIC)), "label")
    hits = hits.select("doc_id", F.lit("topic").alias("section"), F.col("label_group").alias("sub"), F.col("label").alias("code"), F.col("label_ord").alias("tag_id"))
    papers = tagging.paper_fields(docs.withColumn("sentence", F.expr(_DATED)), countries=PLACES)
    r = tagging.paper_records(hits, papers)
    topics = F.array_join(F.array_sort(F.flatten(F.map_values("topic"))), ",")
    listed = F.transform(F.map_entries("study_country"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return r.select("doc_id", "date", "number", F.coalesce(topics, F.lit("")).alias("topics"), F.coalesce(F.array_join(listed, ","), F.lit("")).alias("countries"))
