"""How far the sources of a language differ in their terms, by deduplicated count columns.

A term's counts over the sources of its language are a sparse vector. Terms
with one and the same vector contribute one and the same to every comparison,
so vectors are told apart first and counted: each pair of sources is evaluated
once for each distinct vector, and multiplied by the number of terms that have
it. Within a vector only sources that stand in it are paired. A source that
lacks a term gives it a probability of its own that doesn't depend on the term,
so what one source's terms are against another that lacks them needs only the
histogram of the one's counts, and terms that both lack need only their number.

Texts are read once. Tasks count the terms of their rows by language and
source before anything is shuffled, so a common term travels as one row for
each source and task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepared, slices, text_bytes, text_pieces, written

#: A term is kept where so many documents of its language have it.
LEAST = 30
#: Ranks of the term part.
TOP = 50
#: Added to every count, and what probabilities are multiplied by.
PSEUDO, SCALE = 5, 1_000_000_000
#: Entries that a task gathers before it sends them on.
HELD = 200_000

#: Letters A-Z in lower case; every other ASCII character but a-z is a blank. Bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_DOC = 1 << 44  # one document, above the count of occurrences


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), d (documents) of a task's rows; a null term says that the group occurs."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            names = [None, *terms]
            packed = [0, *terms.values()]
            for i in range(0, len(names), 50_000):
                term, value = names[i : i + 50_000], packed[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(term), pa.string()), pa.array([source] * len(term), pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array([v & (_DOC - 1) for v in value], pa.int64()), pa.array([v // _DOC for v in value], pa.int64())],
                    ["lang", "source", "term", "n", "d"],
                )

    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch.column("text")), strict=True):
                into = held.setdefault((lang or "", source or ""), {})
                before, known = len(into), into.get
                own: Counter = Counter()
                for piece in text_pieces(text, _TABLE):
                    own.update(piece.split())
                for w, n in own.items():
                    into[w] = known(w, 0) + n + _DOC
                size += len(into) - before
            if size > HELD:
                yield from sent()
                held, size = {}, 0
    yield from sent()


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, counts: the kept terms, and for each the sources that have it with their counts, by source.

    The row of a language whose term is null lists all its sources, with 0.
    """
    prepared(docs.sparkSession)
    found = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    # one shuffle serves both groupings
    by_source = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return (
        by_source.groupBy("lang", "term")
        .agg(F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
        .where(F.col("term").isNull() | (F.col("d") >= least))
        .select("lang", "term", "counts")
    )


def _probability(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE (count + PSEUDO) / (total + PSEUDO terms)), in whole numbers of up to 38 digits."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    above = (wide(count) + F.lit(PSEUDO)) * F.lit(SCALE)
    below = wide(total) + wide(terms) * F.lit(PSEUDO)
    return F.call_function("div", above, below) + F.lit(1)


def _pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language, both ways round."""
    of = lambda side: groups.select("lang", F.col("source").alias(f"s{side}"), F.col("total").alias(f"total{side}"), F.col("terms").alias(f"terms{side}"), F.col("zero").alias(f"z{side}"))
    entries = vectors.select("lang", "m", F.explode("counts").alias("e"))
    counts = entries.groupBy("lang", F.col("e.source").alias("s1"), F.col("e.n").alias("n1")).agg(F.sum("m").alias("m")).join(of(1), ["lang", "s1"]).withColumn("p1", _probability("n1", "total1", "terms1"))
    # a source's terms against every other source as if that had none of them
    alone = counts.join(of(2), "lang").where("s1 <> s2").select("lang", F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), (F.col("m") * F.abs(F.col("p1") - F.col("z2"))).alias("value"))
    # terms that neither has: all but those of the one and those of the other
    own = counts.groupBy("lang", F.col("s1").alias("source")).agg(F.sum("m").alias("own"))
    sized = groups.join(own, ["lang", "source"], "left").na.fill(0, ["own"])
    left, right = (sized.select("lang", F.col("source").alias(f"s{i}"), F.col("zero").alias(f"z{i}"), F.col("own").alias(f"o{i}"), F.col("terms").alias(f"V{i}")) for i in (1, 2))
    neither = left.join(right, "lang").where("s1 < s2").select("lang", "s1", "s2", F.when(F.col("V1") == 0, F.lit(0)).otherwise((F.col("V1") - F.col("o1") - F.col("o2")) * F.abs(F.col("z1") - F.col("z2"))).cast("long").alias("value"))
    # what a term that both have changes in the two above, once for each two counts
    rest = F.slice("counts", F.col("i") + 2, F.size("counts"))
    both = vectors.select("lang", "m", "counts", F.posexplode("counts").alias("i", "a")).select("lang", "m", "a", F.explode(rest).alias("b"))
    both = both.groupBy("lang", F.col("a.source").alias("s1"), F.col("a.n").alias("n1"), F.col("b.source").alias("s2"), F.col("b.n").alias("n2")).agg(F.sum("m").alias("m"))
    both = both.join(of(1), ["lang", "s1"]).join(of(2), ["lang", "s2"]).withColumn("p1", _probability("n1", "total1", "terms1")).withColumn("p2", _probability("n2", "total2", "terms2"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    both = both.select("lang", "s1", "s2", (F.col("m") * (gap("p1", "p2") - gap("p1", "z2") - gap("p2", "z1") + gap("z1", "z2"))).alias("value"))
    once = alone.unionByName(neither).unionByName(both).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item"))))
    return once.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def _terms(kept: DataFrame, vectors: DataFrame, groups: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has oftener than its language."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    entries = vectors.select("lang", "counts", total.alias("all"), F.explode("counts").alias("e")).select("lang", "counts", "all", "e.source", "e.n")
    scored = entries.join(groups, ["lang", "source"]).join(langs, "lang").select("lang", "source", "counts", (_probability("n", "total", "terms") - _probability("all", "lang_total", "terms")).alias("value")).where("value > 0")
    # every distinct vector has a term, so vectors beyond the rank can't give one
    best = scored.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("place") <= top).drop("place")
    named = best.join(kept, ["lang", "counts"]).select("lang", "source", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of the docs' columns lang, source, text; null counts as '' in each.

    Terms are runs of ASCII letters, A-Z lower-cased, and of characters beyond
    ASCII. A language keeps the V terms that `least` of its rows have. A count c
    of a group with N occurrences of kept terms gives p = 1 + floor(SCALE (c +
    PSEUDO) / (N + PSEUDO V)), in exact arithmetic. Part `pair` has for each
    (lang, source) every other source of the language and the sum of |p - q|
    over all kept terms, 0 where there are none; part `term` has its first
    `top` terms by p less the language's p, where that is above 0. Ranks go by
    value, ties by item as UTF-8. A source alone in its language has no pairs.

    Each row counts as a document, repeated rows and ids too. A text without
    terms only makes its group occur. Texts of any length are cut at blanks, a
    megabyte at a time. An empty table gives no rows. Other columns are
    ignored, whatever their names. Rows of the result and of one term's vector
    grow with the number of sources, and so with its square: those are the
    pairs asked for.
    """
    counted = written(term_counts(docs, least), "term-counts")
    kept = counted.where("term IS NOT NULL")
    vectors = written(kept.groupBy("lang", "counts").agg(F.count("*").alias("m")), "vectors")
    terms = vectors.groupBy("lang").agg(F.sum("m").alias("terms"))
    totals = vectors.select("lang", "m", F.explode("counts").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("m") * F.col("e.n")).alias("total"))
    groups = counted.where("term IS NULL").select("lang", F.explode("counts.source").alias("source"))
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    groups = written(groups.withColumn("zero", F.when(F.col("terms") > 0, _probability(F.lit(0), "total", "terms"))), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(vectors, groups).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    ranked = _terms(kept, vectors, groups, langs, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")
