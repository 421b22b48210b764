"""Labelled spans: matching, overlap resolution, counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.running import sums_before
from ..shipping import ship
from ..staging import written
from .lexicon import Entry
from .literals import with_needed


#: Documents whose matches are held at once.
DOCUMENTS = 256
#: Start, end, number of the entry, text.
Found = tuple[int, int, int, str]
#: Stands on either side of a match while a text is cut; a text that has it is searched twice instead.
_MARK = "\ue0f1"


def _cut_at(text: Column, pattern: str) -> Column:
    """The pieces of a text and the matches between them, by turns, from one search: matches are marked, and the text is cut at the marks."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    twice = F.flatten(F.zip_with(pieces, found, lambda q, m: F.when(m.isNull(), F.array(q)).otherwise(F.array(q, m))))
    return F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(marked)


def _search(entries: Sequence[Entry]) -> Callable[[bytes | None], list[Found]]:
    """What finds all matches of the entries' forms that read once in a text: start, end, number of the entry, what stands there."""
    searched = [(i, re.compile(e.once).finditer, e.holds) for i, e in enumerate(entries)]

    def found(raw: bytes | None) -> list[Found]:
        text = raw.decode("utf-8", "replace") if raw else ""
        return [(*m.span(), i, m[0]) for i, search, holds in searched if not holds or any(x in text for x in holds) for m in search(text)]

    return found


def _scanned(texts: DataFrame, entries: Sequence[Entry], key: str) -> DataFrame:
    """matches() by the entries' forms that read once, dealt by document."""
    ship(texts.sparkSession)
    given = tuple(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(given)
        labels = pa.array([e.label for e in given])
        for whole in batches:
            for a in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(a, DOCUMENTS)
                rows, spans = [], []
                for row, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    some = search(raw)
                    rows += [row] * len(some)
                    spans += some
                starts, ends, ords, found = zip(*spans, strict=True) if spans else ((), (), (), ())
                ords = pa.array(ords, pa.int32())
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), labels.take(ords), ords, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "label", "label_ord", "start", "end", "text"])

    kind = T.StructType([texts.schema[key], *T._parse_datatype_string("label string, label_ord int, start long, `end` long, text string").fields])
    return texts.mapInArrow(run, kind).repartition(key)


def matches(docs: DataFrame, entries: Sequence[Entry], *, key: str = "doc_id") -> DataFrame:
    """key, label, label_ord, start, end, text of all matches of all patterns, overlaps included.

    One scan applies every pattern, or, where entries know literals that they
    need, just those that a text can match (see literals). With m the matches
    and q the pieces between them, match i starts where the first i pieces and
    the matches before it end. Patterns mustn't match the empty string. Entries
    that all have a form that reads once are scanned for in Python, which tells
    where a match is.
    """
    if all(e.once and not e.needs for e in entries):
        return _scanned(docs.select(key, "text"), entries, key)
    some = any(e.needs for e in entries)
    texts = with_needed(docs.select(key, "text"), entries) if some else docs.select(key, "text")

    def searched(i: int, e: Entry) -> Column:
        found = F.struct(F.lit(e.label).alias("label"), F.lit(i).alias("label_ord"), _cut_at(F.col("text"), e.once or e.pattern).alias("cut"))
        return F.when(F.array_contains("needed__", i), found) if some else found

    long = texts.select(key, F.explode(F.array(*[searched(i, e) for i, e in enumerate(entries)])).alias("x")).where(F.size("x.cut") > 1)
    # pieces and matches by turns: each match with the length of the piece before it
    turns = F.transform(F.sequence(F.lit(0), F.floor(F.size("x.cut") / 2).cast("int") - 1), lambda k: F.struct(F.col("x.cut")[2 * k + 1].alias("m"), F.length(F.col("x.cut")[2 * k]).alias("gap")))
    # dealt by document once: all that is told within a document, or within parts of it, follows without another shuffle
    each = long.select(key, "x.label", "x.label_ord", F.posexplode(turns)).repartition(key)
    w = W.partitionBy(key, "label_ord").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ended = each.withColumn("end", F.sum(F.col("col.gap") + F.length("col.m")).over(w))
    return ended.select(key, "label", "label_ord", (F.col("end") - F.length("col.m")).alias("start"), "end", F.col("col.m").alias("text"))


def greedy(found: list[Found]) -> list[Found]:
    """resolved() of the matches of one document."""
    kept, last = [], 0
    for span in sorted(found, key=lambda s: (s[0], s[0] - s[1], s[2])):
        if not kept or span[0] >= last:
            kept.append(span)
            last = span[1]
    return kept


def told(docs: DataFrame, entries: Sequence[Entry], tell: Callable[[list[Found]], tuple], kind: T.StructType, *, key: str = "doc_id") -> DataFrame:
    """docs with the columns `kind`, whose values tell() gives for all matches of a document; rows without a key have none.

    entries all have a form that reads once. Texts are dealt by key and sorted,
    and a document is searched where it then lies, so no span is shuffled. A task
    holds the rows and matches of one key, and a batch of what it gives.
    """
    ship(docs.sparkSession)
    given, types = tuple(entries), [to_arrow_type(f.dataType) for f in kind]
    dealt = docs.repartition(key).sortWithinPartitions(key)
    at, own = docs.columns.index("text"), docs.columns.index(key)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[Found]]]:
        search, now, rows, found = _search(given), None, [], []
        for whole in batches:
            for a in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(a, DOCUMENTS)
                for row, (doc, raw) in enumerate(zip(batch.column(own).to_pylist(), batch.column(at).cast(pa.binary()).to_pylist(), strict=True)):
                    if rows and (doc is None or doc != now):
                        yield rows, found
                        rows, found = [], []
                    now = doc
                    rows.append(batch.slice(row, 1))
                    found += search(raw) if doc is not None else []
        if rows:
            yield rows, found

    def table(rows: list[pa.RecordBatch], values: list[tuple]) -> pa.RecordBatch:
        new = [pa.array(v, t) for v, t in zip(zip(*values, strict=True), types, strict=True)]
        same = [pa.concat_arrays(c) for c in zip(*(r.columns for r in rows), strict=True)]
        return pa.RecordBatch.from_arrays([*same, *new], [*rows[0].schema.names, *kind.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, values = [], []
        for rows, found in documents(batches):
            ready += rows
            values += [tell(found)] * len(rows)
            if len(ready) >= DOCUMENTS:
                yield table(ready, values)
                ready, values = [], []
        if ready:
            yield table(ready, values)

    return dealt.mapInArrow(run, T.StructType([*docs.schema.fields, *kind.fields]))


def _kept(spans: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """Greedy choice in the given order: a span stays if it starts at or after the end of the last one that stayed.

    Spark deals the spans by document and sorts them, once; a task then reads
    them in that order and holds one end, so no document is gathered. order:
    columns of spans, up or down, since Spark would sort again for expressions.
    """
    ship(spans.sparkSession)
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    placed = spans.where("start IS NOT NULL").withColumn("place__", place).select(key, *fields, "place__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            starts = batch.column("start")
            ends = pc.coalesce(batch.column("end"), starts)
            keep = []
            for first, start, end in zip(pc.equal(batch.column("place__"), 1).to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
                stays = first or start >= last
                keep.append(stays)
                if stays:
                    last = end
            yield batch.drop_columns(["place__"]).filter(pa.array(keep, pa.bool_()))

    return placed.mapInArrow(run, placed.drop("place__").schema)


def resolved(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Without overlaps: leftmost first, the longest of those that start together, then label order."""
    sized = spans.withColumn("length__", F.col("end") - F.col("start"))
    return _kept(sized, key, [F.col("start"), F.desc("length__"), F.col("label_ord")], ["label", "label_ord", "start", "end", "text"])


def merged(*sources: DataFrame, key: str = "doc_id", prefer: str = "shortest") -> DataFrame:
    """Union of span tables without repeats of (start, end, label) and without overlaps: at one start the shortest stays, or the longest; then the label that sorts first."""
    every = sources[0].select(key, "start", "end", "label", "text")
    for s in sources[1:]:
        every = every.unionByName(s.select(key, "start", "end", "label", "text"))
    end = F.col("end") if prefer == "shortest" else F.desc("end")
    return _kept(every.dropDuplicates([key, "start", "end", "label"]), key, [F.col("start"), end, F.col("label")], ["start", "end", "label", "text"])


def label_counts(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    return spans.groupBy(key, "label").agg(F.count("*").alias("n"))


def running_counts(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Counts by document and label with their running sum over documents in order of an integer key.

    Counts are written out, so spans are found once; sums of ranges of keys come first, so no label passes through one task whole.
    """
    n = written(label_counts(spans, key=key), "counts")
    return sums_before(n, key, "n", by=("label",)).select(key, "label", "n", (F.col("base") + F.col("n")).alias("running"))


def document_stats(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, n_spans, n_labels, labels in order of first appearance."""
    first = spans.groupBy(key, "label").agg(F.count("*").alias("n"), F.min("start").alias("at"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"])
    return first.groupBy(key).agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_labels"), F.array_join(labels, ",").alias("labels"))


def top_labels(spans: DataFrame, k: int = 10) -> DataFrame:
    return spans.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def records(docs: DataFrame, rule: DataFrame, other: DataFrame | None = None, *, key: str = "doc_id") -> DataFrame:
    """Extraction rows: document, merged spans, metadata of the file, and statistics by source and label. Blank documents are left out."""
    rules = resolved(rule, key=key)
    both = merged(rules, other, key=key) if other is not None else merged(rules, key=key)
    item = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "text")
    spans = both.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("spans"))
    dist = label_counts(both, key=key).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.col("n").cast("int").alias("n"))))).alias("label_distribution"))
    stats = label_counts(rule, key=key).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.col("n").cast("int").alias("n"))))).alias("rule_stats"))
    n_rule = rules.groupBy(key).agg(F.count("*").cast("int").alias("n_rule"))
    out = docs.where(F.regexp_replace("text", r"\s+", "") != "").join(spans, key, "left").join(dist, key, "left").join(stats, key, "left").join(n_rule, key, "left")
    if other is not None:
        out = out.join(other.groupBy(key).agg(F.count("*").cast("int").alias("n_other")), key, "left")
    else:
        out = out.withColumn("n_other", F.lit(0))
    return _record(out, docs.columns, key)


def scanned_records(docs: DataFrame, entries: Sequence[Entry], *, key: str = "doc_id") -> DataFrame:
    """records() of docs and matches(docs, entries), for entries that all have a form that reads once: nothing but the texts is shuffled, and those once."""
    labels, counts = [e.label for e in entries], "map<string,int>"
    kind = T._parse_datatype_string(f"spans array<struct<start:int,end:int,label:string,text:string>>, label_distribution {counts}, rule_stats {counts}, n_rule int, n_other int")

    def tell(found: list[Found]) -> tuple:
        kept = greedy(found)
        n, every = (sorted(Counter(labels[s[2]] for s in some).items()) for some in (kept, found))
        return [(start, end, labels[i], text) for start, end, i, text in kept], n, every, len(kept), 0

    return _record(told(docs.where(F.col("text").rlike(r"\S")), entries, tell, kind, key=key), docs.columns, key)


def _record(out: DataFrame, given_: list[str], key: str) -> DataFrame:
    """Documents with their spans and counts as rows of extractions; given_: the columns that came with the documents."""
    empty_map = F.create_map().cast("map<string,int>")
    dist_, none = F.coalesce("label_distribution", empty_map), F.array().cast(out.schema["spans"].dataType)
    given = lambda c, other: F.col(c) if c in given_ else other
    return out.select(
        key,
        "text",
        F.coalesce("spans", none).alias("spans"),
        F.struct(
            given("filepath", F.lit(None).cast("string")).alias("filepath"),
            given("file_size", F.length("text")).cast("int").alias("file_size"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processing_time"),
            given("hash", F.md5("text")).alias("hash"),
            F.size(dist_).alias("total_labels_found"),
        ).alias("metadata"),
        F.struct(
            F.coalesce("n_rule", F.lit(0)).alias("rule_based_entities"),
            F.coalesce("n_other", F.lit(0)).alias("llm_entities"),
            F.size(F.coalesce("spans", none)).alias("total_entities"),
            F.coalesce("rule_stats", empty_map).alias("rule_stats"),
            dist_.alias("label_distribution"),
            F.map_keys(dist_).alias("unique_labels"),
        ).alias("stats"),
    )
