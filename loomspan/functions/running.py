"""Running sums and numbers over an ordered key, without a sort of everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import written


def sums_before(counts: DataFrame, key: str, value: str, *, by: tuple[str, ...] = (), width: int = 1024, levels: int = 2) -> DataFrame:
    """counts with `base`: the sum of value over all smaller keys, within each `by`.

    counts has a row for each (by, integer key) and is read levels + 1 times.
    Keys are cut into ranges of `width`, and those into ranges again: a window
    sees `width` rows, and the top one a width ** levels-th part of the keys.
    """
    preceding = lambda w: F.coalesce(F.sum(value).over(w.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not levels:
        return counts.withColumn("base", preceding(W.partitionBy(*by)))
    up = f"{key}_"
    cut = counts.withColumn(up, F.floor(F.col(key) / width))
    above = sums_before(cut.groupBy(*by, up).agg(F.sum(value).alias(value)), up, value, by=by, width=width, levels=levels - 1)
    # <=> in the join, for `by` columns may be null
    above = above.select(*[F.col(c).alias(f"{c}__") for c in (*by, up)], F.col("base").alias("base__"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in (*by, up)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    met = cut.join(above, condition)
    return met.select(*counts.columns, (F.col("base__") + preceding(W.partitionBy(*by, up))).alias("base"))


def ordered(df: DataFrame, order: list[Column], **values: str | Column) -> DataFrame:
    """df with `place` (from 1 in the given order) and a column for each of values: its sum over all rows before.

    Rows are dealt to ranges of the order and written; a range's rows are
    numbered and summed in a task of their own, above the sums of the ranges
    before it, of which there is a row for each partition.
    """
    ranged = written(df.withColumns({f"{k}__": F.col(v) if isinstance(v, str) else v for k, v in values.items()}).repartitionByRange(*order).withColumn("part__", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part__").agg(F.count("*").alias("n__"), *[F.sum(f"{k}__").alias(f"{k}__") for k in values])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = W.partitionBy().orderBy("part__")
    base = totals.select("part__", before("n__", parts).alias("rows__"), *[before(f"{k}__", parts).alias(f"{k}_base__") for k in values])
    local = W.partitionBy("part__").orderBy(*order)
    met = ranged.join(F.broadcast(base), "part__")  # a row for each partition
    return met.select(*df.columns, (F.col("rows__") + F.row_number().over(local)).alias("place"), *[(F.col(f"{k}_base__") + before(f"{k}__", local)).alias(k) for k in values])
