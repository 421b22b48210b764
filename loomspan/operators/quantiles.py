"""Exact quantiles without a sort and without a group's values in one task.

A wanted rank is looked for as in a selection: the values that can still be it
lie in a range, which begins as all of them. Counts over BINS equal parts of the
range show the part that holds the rank; the least and the largest value found
in it are the next range. A range of one value is the answer. Every pass reads
the narrow table of values once, sends a row for each part, task and rank, and
makes the range smaller by BINS, so a handful of passes serve any table and
memory doesn't follow its size. All groups and all ranks go through the passes
together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import written

#: Parts of a range in each pass.
BINS = 1024


def _part(x: Column, low: Column, high: Column) -> Column:
    """The part of [low, high] that x is in, growing with x. Infinities and NaN, which have no distance, are parts of their own and are told from finite values first."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    kind = F.when(F.isnan(x), 3).when(x == float("inf"), 2).when(x == -float("inf"), 0).otherwise(1)
    # halves, for the distance of two doubles can pass the largest one
    share = (x / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(finite(low) & finite(high), F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")).otherwise(kind)


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    """a's columns equal b's of the same names with two underscores, null with null; a constant where there are none, which keeps the join one of equal keys."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[f"{c}__"])
    return out


def selected(values: DataFrame, wanted: DataFrame, by: Sequence[str] = (), column: str = "value") -> DataFrame:
    """by, rank, value: the value of each wanted rank (from 0) of its group. values should be a table, as it is read in every pass; its nulls don't count."""
    values = values.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("x"))
    keys = [f"{c}__" for c in by]
    limits = values.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    limits = limits.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "low", "high")
    ranges = wanted.select(*by, "rank").distinct().join(limits, _same(wanted, limits, by)) if by else wanted.select("rank").distinct().join(F.broadcast(limits), F.lit(True))  # one row
    ranges = written(ranges.select(*by, "rank", F.col("rank").alias("left"), "low", "high"), "ranges")
    while True:
        # -0.0 and 0.0, and NaN and NaN, are one value to Spark's comparisons
        open_ = ranges.where("low < high")
        if open_.isEmpty():
            return ranges.select(*by, "rank", F.col("low").alias("value"))
        sought = open_.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "rank", "left", "low", "high")
        met = values.join(sought, _same(values, sought, by) & F.col("x").between(F.col("low"), F.col("high")))
        parts = met.groupBy(*by, "rank", "left", _part(F.col("x"), F.col("low"), F.col("high")).alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        before = F.sum("n").over(W.partitionBy(*by, "rank").orderBy("part")) - F.col("n")
        found = parts.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        ranges = written(ranges.where("NOT low < high").unionByName(found.select(*by, "rank", (F.col("left") - F.col("before")).alias("left"), "low", "high")), "ranges")


def quantiles(values: DataFrame, at: Sequence[float], *, by: Sequence[str] = (), column: str = "value") -> DataFrame:
    """by, at, n, quantile: of each group's n non-null values, interpolated between the two neighbours of place at * (n - 1).

    values is read in every pass, so it should be a table. NaN is larger than
    all numbers. A group without a value has no row.
    """
    if not all(0 <= p <= 1 for p in at):
        raise ValueError("quantiles lie between 0 and 1")
    counted = values.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    place = F.col("at") * (F.col("n") - 1)
    sought = written(counted.withColumn("at", F.explode(F.array(*[F.lit(float(p)) for p in at]))).select(*by, "at", "n", F.floor(place).alias("lower"), F.ceil(place).alias("upper"), (place - F.floor(place)).alias("share")), "sought")
    ranks = sought.select(*by, F.explode(F.array("lower", "upper")).alias("rank"))
    found = written(selected(values, ranks, by, column), "selected")
    out = sought
    for side in ("lower", "upper"):
        named = found.select(*[F.col(c).alias(f"{c}__") for c in by], F.col("rank").alias("rank__"), F.col("value").alias(f"at_{side}"))
        out = out.join(named, _same(out, named, by) & (F.col(side) == F.col("rank__"))).drop("rank__", *[f"{c}__" for c in by])
    # equal neighbours need no arithmetic, which infinities wouldn't survive
    value = F.when(F.col("at_lower") == F.col("at_upper"), F.col("at_lower")).otherwise(F.col("at_lower") * (1 - F.col("share")) + F.col("at_upper") * F.col("share"))
    return out.select(*by, "at", "n", value.alias("quantile"))
