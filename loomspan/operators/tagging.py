"""Tagging of papers against a tree of terms, and what is read from their sentences."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_date, first_number, sentences
from ..functions.vector import unit
from ..shipping import ship
from ..staging import written
from . import blocks
from .retrieval import scored

#: Countries and the names that count for each.
COUNTRIES: dict[str, str] = {
    "Germany": "Germany",
    "USA": "USA|United States|US",
    "UK": "UK|United Kingdom|England",
    "Canada": "Canada",
    "Australia": "Australia",
    "France": "France",
    "Italy": "Italy",
    "Spain": "Spain",
    "Netherlands": "Netherlands",
    "Belgium": "Belgium",
    "Sweden": "Sweden",
    "Norway": "Norway",
    "Denmark": "Denmark",
    "Switzerland": "Switzerland",
    "Austria": "Austria",
    "Poland": "Poland",
    "China": "China",
    "Japan": "Japan",
    "India": "India",
    "Brazil": "Brazil",
    "Mexico": "Mexico",
    "South Africa": "South Africa",
}
#: Categories of the record, and their names in it.
SECTIONS = {"popu": "Population", "topic": "topic", "outcome": "outcome", "intervention": "intervention"}


def definition(spark: SparkSession, tree: dict[str, Any]) -> DataFrame:
    """definition: one row with a nested dict as JSON; tuples become arrays."""
    return spark.createDataFrame([(json.dumps(tree),)], "definition string")


def tag_index(definitions: DataFrame, *, column: str = "definition", by: Sequence[str] = ()) -> DataFrame:
    """by, tag_id, cat, sub, field, code, phrase, path of stored tag definitions: one JSON object a row, for each of `by` one.

    An object's keys are nodes, and an array's items are tags: a phrase,
    [phrase] or [phrase, code]; others are left out, as are blank phrases,
    arrays right below the top, and rows that don't parse. path has the keys
    from the top, whose first is the category; the second is both sub and
    field, however deep the tag lies. tag_id numbers a definition's tags from 0
    in order of path and place. Depths may differ: the rows that are objects go
    down a level at a time, until none is left.
    """
    spark = definitions.sparkSession
    is_a = lambda v, kind: F.startswith(F.schema_of_variant(v), F.lit(kind))
    # parsed again on each level, since variants aren't kept in tables of all formats
    nodes = definitions.select(*by, F.col(column).alias("json"), F.array().cast("array<string>").alias("path"))
    lists = None
    while True:
        parsed = nodes.withColumn("v", F.try_parse_json("json")).where("v IS NOT NULL").where(is_a(F.col("v"), "OBJECT"))
        below = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*by, F.concat("path", F.array("key")).alias("path"), F.to_json("value").alias("json"), is_a(F.col("value"), "OBJECT").alias("object"), is_a(F.col("value"), "ARRAY").alias("list"))
        below = written(below.where("object OR list"), "nodes")
        here = below.where("list").where(F.size("path") > 1).select(*by, "path", "json")
        lists = here if lists is None else lists.unionByName(here)
        nodes = below.where("object").select(*by, "json", "path")
        if nodes.isEmpty():
            break
    items = lists.withColumn("v", F.parse_json("json")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where("value IS NOT NULL")
    one, several = F.try_variant_get("value", "$", "string"), F.try_variant_get("value", "$", "array<string>")
    pair = F.when(is_a(F.col("value"), "STRING"), F.array(one)).when(is_a(F.col("value"), "ARRAY") & (F.size(several) <= 2), several)
    found = items.select(*by, "path", "pos", pair.alias("pair")).where(F.length(F.trim(F.get("pair", F.lit(0)))) > 0)
    place = F.row_number().over(W.partitionBy(*by).orderBy("path", "pos")) - 1
    return found.select(*by, place.alias("tag_id"), F.col("path")[0].alias("cat"), F.col("path")[1].alias("sub"), F.col("path")[1].alias("field"), F.trim(F.element_at("pair", -1)).alias("code"), F.trim(F.col("pair")[0]).alias("phrase"), "path")


def _times(text: str, phrases: Sequence[str]) -> list[int]:
    """How often each phrase stands in the text, as str.count has it, from one pass over the text."""
    import ahocorasick

    trie = ahocorasick.Automaton()
    for p in phrases:
        if p:
            trie.add_word(p, (p, len(p)))
    n, last = dict.fromkeys(phrases, 0), dict.fromkeys(phrases, -1)
    if len(trie):
        trie.make_automaton()
        for end, (p, length) in trie.iter(text):
            if end - length >= last[p]:
                n[p] += 1
                last[p] = end
    return [n[p] for p in phrases]


def phrase_counts(docs: DataFrame, tags: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, tag_id, score: how often the phrase of each of a document's own tags stands in its text; an occurrence that overlaps one counted before isn't counted.

    docs: key, text; tags: key, tag_id, phrase. A text is read once for all of
    its phrases, so the work grows with the texts and what is found in them.
    """
    ship(docs.sparkSession)
    own = tags.groupBy(key).agg(F.collect_list(F.struct("tag_id", "phrase")).alias("tags"))
    met = docs.select(key, "text").join(own, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tags")
            tag_ids, phrases = lists.flatten().flatten()
            phrases, n, at = phrases.to_pylist(), [], 0
            for raw, size in zip(batch.column("text").cast(pa.binary()).to_pylist(), lists.value_lengths().to_pylist(), strict=True):
                n += _times(raw.decode("utf-8", "replace"), phrases[at : at + size]) if raw is not None else [None] * size
                at += size
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pc.list_parent_indices(lists)), tag_ids, pa.array(n, pa.int64())], [key, "tag_id", "score"])

    return met.mapInArrow(run, T.StructType([docs.schema[key], tags.schema["tag_id"], T.StructField("score", T.LongType())]))


def rolled_up(scores: DataFrame, tags: DataFrame, *, by: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """key, node, score, tags, best: for each node above a tag the best score of any tag below it, their number, and the tag that has it, the first on ties.

    scores: key, tag_id, score, and the columns `by` that tell definitions
    apart; tags: from tag_index. node is the node's path.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))
    above = tags.select(*by, "tag_id", F.explode(prefixes).alias("node"))
    met = scores.join(above, [*by, "tag_id"])
    return met.groupBy(key, "node").agg(F.max("score").alias("score"), F.count("*").alias("tags"), F.min_by("tag_id", F.struct(-F.col("score"), "tag_id")).alias("best"))


def sentence_table(docs: DataFrame, *, key: str = "doc_id", longer_than: int = 20) -> DataFrame:
    """key, sentence_no (from 0, among those kept), sentence."""
    return docs.select(key, F.posexplode(sentences(F.col("text"), longer_than)).alias("sentence_no", "sentence"))


def tag_scores(sentence_vectors: DataFrame, tag_vectors: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, tag_id, score: the best cosine of any sentence of the document.

    sentence_vectors: key, sentence_no, embedding; tag_vectors: tag_id, embedding.
    """
    rows = sentence_vectors.select(F.col(key).alias("doc_id"), F.struct(key, "sentence_no").alias("part__"), unit(F.col("embedding")).alias("c"))
    tags = tag_vectors.select(F.col("tag_id").alias("query_id"), unit(F.col("embedding")).alias("q"))
    tops = blocks.met(tags, rows, top=True)  # of each pair of blocks
    return tops.groupBy(F.col("doc_id").alias(key), F.col("query_id").alias("tag_id")).agg(F.max("score").alias("score"))


def best_sentences(scores: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, sentence of the highest score, the first one on ties. scores: key, sentence_no, sentence, score."""
    return scores.groupBy(key).agg(F.max_by("sentence", F.struct("score", -F.col("sentence_no"))).alias("sentence"))


def paper_fields(papers: DataFrame, *, key: str = "doc_id", countries: dict[str, str] | None = None) -> DataFrame:
    """key, date, number, study_country of each paper, in one pass: date and number of studies from `sentence`, and how often the countries that occur are named in `text`, most often first."""
    each = F.array_sort(_named(countries), lambda a, b: F.when(a["n"] != b["n"], F.signum(b["n"] - a["n"]).cast("int")).when(a["country"] < b["country"], -1).otherwise(1))
    listed = F.transform(each, lambda x: F.struct(x["country"].alias("key"), x["n"].cast("long").alias("value")))
    return papers.select(key, first_date(F.col("sentence")).alias("date"), first_number(F.col("sentence")).alias("number"), F.map_from_entries(listed).alias("study_country"))


def _named(countries: dict[str, str] | None) -> Column:
    given = countries or COUNTRIES
    names = {c: p.lower().split("|") for c, p in given.items()}
    if _apart(names):  # one search of the text finds the names of all
        found = F.transform(F.regexp_extract_all("text", F.lit(rf"(?i)\b(?:{'|'.join(given.values())})\b"), F.lit(0)), F.lower)
        own = lambda x, c: F.size(F.filter(x, lambda v: v.isin(*names[c])))
        each = lambda x: F.array(*[F.struct(F.lit(c).alias("country"), own(x, c).alias("n")) for c in given])
        return F.filter(F.get(F.transform(F.array(found), each), F.lit(0)), lambda x: x["n"] > 0)
    each = F.array(*[F.struct(F.lit(c).alias("country"), F.regexp_count("text", F.lit(rf"(?i)\b(?:{p})\b")).alias("n")) for c, p in given.items()])
    return F.filter(each, lambda x: x["n"] > 0)


def _apart(names: dict[str, list[str]]) -> bool:
    """Whether all names are ASCII words, and no name of one country can overlap one of another in a text."""
    if not all(re.fullmatch("[a-z]+( [a-z]+)*", n) for own in names.values() for n in own):
        return False
    split = [(c, n.split()) for c, own in names.items() for n in own]
    meet = lambda a, b: any(a[i : i + len(b)] == b[: len(a) - i] for i in range(len(a)))
    return not any(c != d and meet(a, b) for c, a in split for d, b in split)


def country_counts(docs: DataFrame, *, key: str = "doc_id", countries: dict[str, str] | None = None) -> DataFrame:
    """key, country, n of the countries that occur, whatever the case."""
    return docs.select(key, F.explode(_named(countries)).alias("x")).select(key, "x.country", "x.n")


def matched(scores: DataFrame, tags: DataFrame, threshold: float = 0.65, *, key: str = "doc_id") -> DataFrame:
    """key, section, sub, code, tag_id of the tags at or above the threshold that belong to a section of the record."""
    section = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    hit = scores.where(F.col("score") >= threshold).join(tags, "tag_id")
    return hit.withColumn("section", section[F.col("cat")]).where("section is not null").select(key, "section", "sub", "code", "tag_id")


def codes(hits: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, section, sub, codes: distinct codes in order of their first tag."""
    first = hits.groupBy(key, "section", "sub", "code").agg(F.min("tag_id").alias("at"))
    return first.groupBy(key, "section", "sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"))


def paper_records(hits: DataFrame, papers: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """papers (from paper_fields) with a map from sub to codes for each section."""
    by_section = codes(hits, key=key).groupBy(key).agg(
        *[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("sub", "codes"))))).alias(s) for s in SECTIONS.values()]
    )
    return papers.join(by_section, key, "left")


def most_alike(sentence_vectors: DataFrame, phrase_vector: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, sentence nearest to the one row of phrase_vector (embedding), the first one on ties."""
    rows = sentence_vectors.select(F.struct(key, "sentence_no", "sentence").alias("doc_id"), "embedding")
    s = scored(phrase_vector.select(F.lit(0).alias("query_id"), "embedding"), rows)
    return best_sentences(s.select(f"doc_id.{key}", "doc_id.sentence_no", "doc_id.sentence", "score"), key=key)
