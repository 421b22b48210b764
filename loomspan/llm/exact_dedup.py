"""Exact deduplication with two passes of a Bloom filter.

Pass one writes the hash of each text into a filter that remembers, for each
position, whether it was set once or at least twice. Pass two holds every row
against it: a row whose positions were all set twice may have a copy and is
shuffled to its group; the others are certainly alone and pass straight
through. The filter only decides what is shuffled, so a crowded one costs
traffic and never a wrong answer.

A filter has BITS bits for each row, counted first, so the share of rows that
are shuffled in vain is the same at every size, about one in two hundred. No
more than LARGEST bits are fetched and broadcast at once: the hashes of more
rows than these serve are cut into slices, each with a filter of its own. Then
hashes and ids are dealt to a partition for each slice, and one filter after
another is fetched, broadcast, used on its own slice and destroyed. So hashes
are read twice and texts once, whatever the number of slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, prepared, written

#: Parts of the filter; each is built by one task.
SEGMENTS = 64
#: Positions that a hash sets within its part.
PROBES = 3
#: Bits of the filter for each row, and the least and largest filter.
BITS, SMALLEST, LARGEST = 16, 1 << 20, 1 << 30
#: Rows of one group of copies are met by this many salted copies of the group's totals.
SALTS = 16


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """One row for each hash, PROBES positions within its segment."""
    h = h.astype(np.uint64, copy=False)
    a = h & np.uint64(0xFFFFFFFF)
    b = ((h >> np.uint64(20)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    step = np.arange(PROBES, dtype=np.uint64)[None, :]
    return ((a[:, None] + step * b[:, None]) % np.uint64(bits)).astype(np.uint32)


def _segment(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.uint64, copy=False) >> np.uint64(58)).astype(np.int32)


def possibly_repeated(hashes: DataFrame, column: str, filter_bits: int) -> DataFrame:
    """seg, twice: the filter of positions set at least twice, as one packed bitmap for each segment that has any, filter_bits bits in all."""
    bits = filter_bits // SEGMENTS

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(h: np.ndarray) -> pa.RecordBatch:
            seg, pos = _segment(h), _positions(h, bits)
            rows: list[tuple[int, bytes, bytes]] = []
            for s in np.unique(seg):
                # the positions of one hash count once, however they fall
                p = np.sort(pos[seg == s], axis=1)
                own = np.ones(p.shape, bool)
                own[:, 1:] = p[:, 1:] != p[:, :-1]
                at, n = np.unique(p[own], return_counts=True)
                rows.append((int(s), at[n == 1].tobytes(), at[n > 1].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["seg", "once", "twice"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= 1 << 20:
                yield packed(np.concatenate(held))
                held = []
        if held and sum(map(len, held)):
            yield packed(np.concatenate(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one, two = maps.setdefault(s, (np.zeros(bits, bool), np.zeros(bits, bool)))
                at = np.frombuffer(once, np.uint32)
                two[at[one[at]]] = True
                one[at] = True
                at = np.frombuffer(twice, np.uint32)
                one[at] = two[at] = True
        for s, (_, two) in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())], ["seg", "twice"])

    parts = hashes.select(column).mapInArrow(mapped, "seg int, once binary, twice binary")
    return parts.repartition(SEGMENTS, "seg").mapInArrow(merged, "seg int, twice binary")


def _fetched(table: DataFrame, filter_bits: int) -> list[bytes]:
    """The bitmaps of a filter, at most LARGEST bits."""
    maps = [bytes((filter_bits // SEGMENTS + 7) // 8)] * SEGMENTS
    for r in table.collect():
        maps[r["seg"]] = bytes(r["twice"])
    return maps


def _sized(rows: int) -> tuple[int, int]:
    """Bits of a filter, and the number of slices."""
    wanted = max(SMALLEST, BITS * rows)
    slices = -(-wanted // LARGEST)
    return max(SMALLEST, 1 << (-(-wanted // slices) - 1).bit_length()), slices


def _slice(h: Column, slices: int) -> Column:
    return F.pmod(F.hash(h), F.lit(slices))


def _tested(rows: DataFrame, table: DataFrame, bits: int, last: bool = True) -> DataFrame:
    """rows with `maybe`, told by their hash column h, in place of h. Unless it is the last one, the filter is used at once and destroyed."""
    rest = [c for c in rows.columns if c != "h"]
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField("maybe", T.BooleanType())])
    width = bits // SEGMENTS
    maps = rows.sparkSession.sparkContext.broadcast(_fetched(table, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            seg, pos, maybe = _segment(h), _positions(h, width), np.zeros(len(h), bool)
            for s in np.unique(seg):
                bitmap, own = np.frombuffer(maps.value[s], np.uint8), seg == s
                p = pos[own]
                maybe[own] = ((bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(maybe)], [*rest, "maybe"])

    tested = rows.mapInArrow(run, schema)
    if last:
        return tested
    tested = written(tested, "tested")
    maps.destroy()
    return tested


def _digested() -> tuple[Column, Column]:
    norm = lower_ascii(F.col("text"))
    return F.sha2(norm.cast("binary"), 256).alias("text_sha256"), F.xxhash64(norm).alias("h")


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, list, int]:
    """The rows of copies() that pass straight through, those that are shuffled, and the filters with their bits."""
    prepared(docs.sparkSession)
    bits, slices = _sized(docs.count())
    # texts are read once; from here on rows are narrow, and their numbers must not change
    narrow = docs.select("doc_id", *_digested()).withColumn("row", F.monotonically_increasing_id())
    filters = []
    if slices == 1:
        narrow = written(narrow, "exact")
        filters = [written(possibly_repeated(narrow, "h", bits), "filter")]
        rows = _tested(narrow, filters[0], bits)
    else:
        # rows go to their slice's partition, a slice to several tasks, and each pass reads its own
        dealt = narrow.withColumn("slice", _slice(F.col("h"), slices))
        narrow = written(dealt.repartition("slice", F.pmod("row", F.lit(SALTS))), "exact", ("slice",))
        rows = None
        for k in range(slices):
            own = narrow.where(F.col("slice") == k).drop("slice")
            part = _tested(own, written(possibly_repeated(own, "h", bits), "filter"), bits, last=False)
            rows = part if rows is None else rows.unionByName(part)
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = written(rows.where("maybe"), "maybe")
    groups = (
        some.groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = some.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    shared = salted.join(groups, ["text_sha256", "salt"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
    return alone, shared, filters, bits


def copies(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and empty texts are copies of one another. The largest doc_id of a
    group stays. Null ids are smaller than all others: keep_id is null only if
    the whole group has none. Rows that tie on doc_id differ by their place in
    the input, and just one of them is kept. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    alone, shared, _, _ = _copies(docs)
    return alone.unionByName(shared)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that share both doc_id and normalised text leave one row: the one
    whose text sorts first, then the one whose columns, as JSON, sort first.
    Rows that are alike in that, too, are alike altogether.

    Texts that the filter tells to be alone go straight through. Only the
    others are shuffled, to the ids and digests that stay. Beyond one filter's
    rows, ids and digests of the rows that go are joined instead; either way
    texts are read three times, for the digests, for those alone and for the others.
    """
    _, shared, filters, bits = _copies(docs)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.col("doc_id").alias("own_id"), *_digested())
    if filters:
        stay = written(shared.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")), "stay")
        rows = _tested(whole, filters[0], bits)
        alone = rows.where(~F.col("maybe"))
        some = rows.where("maybe").join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("text_sha256") == F.col("stay_sha")), "left_semi")
    else:
        # no filter for all rows fits an executor: the rows that go, or that share id and text with others, are named instead
        fates = shared.groupBy(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
        fates = written(fates.select("stay_id", "stay_sha", "kept"), "fates")
        rows = whole.join(fates, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("text_sha256") == F.col("stay_sha")), "left")
        alone, some = rows.where(F.col("kept").isNull()), rows.where("kept")
    first = some.groupBy("own_id", "text_sha256").agg(F.min_by("whole", F.struct("whole.text", F.to_json("whole"))).alias("whole"))
    return alone.select("whole.*").unionByName(first.select("whole.*")).select(*docs.columns)
