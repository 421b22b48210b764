"""Mixing sources to target weights with hash-threshold histograms. DataFrame operations only.

Each document has a 60-bit hash. A source whose target is r times its size
takes every document floor(r) times, and once more those whose hash is below a
threshold. The threshold comes from histograms of sizes by hash bucket: find
the bucket in which the running sum passes the budget, split only this bucket
into finer ones, and so on until a bucket is one hash. Nothing is sorted by
hash, and a larger budget only raises the threshold, so mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.running import ordered
from .common import word_count, written

HASH_BITS = 60
#: Bits that each level of the histogram adds.
LEVEL_BITS = 12
#: No document is repeated more often.
MOST = 3
#: A table with a row for each of so many sources is broadcast; a larger one is joined by shuffle.
FEW = 100_000


def _hash(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of each row. The hash depends on id and text, so equal rows share it."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("hash"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source.

    Sources in code-point order (null last) weigh 1, 2, 3, repeating. A target
    stops at MOST times the source's size and the excess goes to the others by
    weight. In order of cap over weight the capped sources come first, so one
    running sum over sources finds the common level. Sources may be many: their
    order and sums are taken in ranges.
    """
    by_name = F.col("source").asc_nulls_last()
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = (F.pmod(F.col("place") - 1, F.lit(3)) + 1).cast("double")
    weighed = ordered(sums, [by_name]).select("source", "source_size", weight.alias("weight"), (F.lit(float(MOST)) * F.col("source_size")).alias("cap"))
    weighed = weighed.withColumn("at", F.col("cap") / F.col("weight"))
    levelled = written(ordered(weighed, [F.col("at").asc(), by_name], capped="cap", lighter="weight"), "levels")
    whole = levelled.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    level = (F.col("all_sizes") - F.col("capped")) / (F.col("all_weights") - F.col("lighter"))
    # the level of the first source that its cap does not stop holds for all that follow
    held = levelled.join(F.broadcast(whole), F.lit(True)).select("at", level.alias("level"))
    common = held.agg(F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "level")))["level"].alias("level"))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levelled.join(F.broadcast(common), F.lit(True)).select("source", "source_size", target.alias("target"))  # one row each


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source: whole (times every document is taken), threshold (hashes below it are taken once more; none where whole copies are all), and included (whether documents at the threshold are, too)."""
    share = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(share)).otherwise(F.lit(0)).cast("long")
    wanted = written(wanted, "targets")
    hinted = F.broadcast if wanted.count() <= FEW else lambda table: table
    state = wanted.select("source", "source_size", "target", whole.alias("whole")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    carried = ("source_size", "target", "whole", "budget")
    for level in range(HASH_BITS // LEVEL_BITS):
        above, below = HASH_BITS - level * LEVEL_BITS, HASH_BITS - (level + 1) * LEVEL_BITS
        at = hinted(state.select(F.col("source").alias("s"), "prefix", "before", *carried))
        # only the boundary bucket's rows are summed again, in each task first
        inside = sizes.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", above) == F.col("prefix")))
        same = [F.first(c).alias(c) for c in carried]
        cells = inside.groupBy("source", F.shiftright("hash", below).alias("bucket")).agg(F.sum("size").alias("n"), F.first("before").alias("before"), *same)
        w = W.partitionBy("source").orderBy("bucket")
        cells = cells.withColumn("upto", F.col("before") + F.sum("n").over(w))
        # the first bucket that passes the budget, or the last one if none does
        here = F.struct("bucket", "upto", "n")
        crossed = cells.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("budget"), here)), F.max(here)).alias("hit"), *same)
        state = crossed.select("source", *carried, F.col("hit.bucket").alias("prefix"), (F.col("hit.upto") - F.col("hit.n")).alias("before"), F.col("hit.n").alias("n"))
    nearer = F.abs(F.col("before") + F.col("n") - F.col("budget")) <= F.abs(F.col("before") - F.col("budget"))
    return state.select("source", "source_size", "target", "whole", F.when(F.col("budget") > 0, F.col("prefix")).otherwise(F.lit(-1)).alias("threshold"), (nearer & (F.col("budget") > 0)).alias("included"))


def _small(plan: DataFrame) -> DataFrame:
    """plan has a row for each source; broadcast it if a count shows that it is small, so that a hot source isn't shuffled to one task."""
    return F.broadcast(plan) if plan.count() <= FEW else plan


def mixed(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken.

    taken is 0 to MOST times the size. Null and blank texts have size 0; a null
    source is a source of its own, the last; equal rows share a hash and are
    taken alike. An empty table gives no rows. Other columns are ignored.
    """
    sizes = written(sized(docs), "sizes")
    plan = written(thresholds(sizes, targets(sizes)), "mix")
    p = _small(plan.withColumnRenamed("source", "s"))
    more = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("included"))
    return sizes.join(p, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + more.cast("long"))).alias("taken"), (F.col("whole") + more.cast("long")).alias("times"), "hash"
    )


def mixture(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes each: absent, once, or up to MOST times. A text without words is taken as a text with words of its hash would be.

    All columns stay, whatever their names.
    """
    sizes = written(sized(docs), "sizes")
    p = _small(written(thresholds(sizes, targets(sizes)), "mix").select("source", "whole", "threshold", "included"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("own"), _hash(docs["doc_id"], docs["text"]).alias("hash"))
    more = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("included"))
    times = F.sequence(F.lit(0), (F.col("whole") + more.cast("long")).cast("int"))
    taken = rows.join(p, F.col("own").eqNullSafe(F.col("source"))).select("row", F.explode(times).alias("n"))
    return taken.where("n > 0").select("row.*")
