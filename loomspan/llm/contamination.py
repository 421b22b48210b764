"""Benchmark passages in documents, by a prefix-filtered join of shingles.

An item's windows of ten words are the sets to be contained, and shingles of up
to three words are their tokens. A document that contains a window whole
contains each of its shingles, so one of them, the rarest in the documents, is
all of the window's prefix that has to be joined, and a window with a shingle
that no document has is out. A document's shingle that meets a prefix says
where the window would begin and end; where that lies within the document, the
words in between are compared with the window's.

Texts are read twice: for the shingles' document frequencies, and for the
places of the prefixes, each of which travels with the words around it. Both
passes test shingles against a bitmap of bounded size, so that a crowded one
costs traffic and never a wrong answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepared, slices, text_bytes, text_pieces, written

WINDOW, SHINGLE = 10, 3
#: Bits of the bitmap for each shingle, and the least and most bits.
BITS, FEWEST, MOST = 64, 1 << 16, 1 << 26
#: Shingles that a task counts before it sends them on.
HELD = 200_000

#: ASCII letters, lower-cased, and digits; every other ASCII character is a blank. Bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Segment:
    """Words of a piece of a text with those around it. Shingles and windows that begin at places own[0] to own[1] are this segment's."""

    __slots__ = ("row", "words", "base", "own", "last")

    def __init__(self, row: int, words: list[bytes], base: int, begin: int, last: bool) -> None:
        self.row, self.words, self.base, self.last = row, words, base, last
        self.own = (begin, len(words) if last else max(begin, len(words) - WINDOW + 1))


def _segments(texts: list[bytes]) -> Iterator[_Segment]:
    for row, text in enumerate(texts):
        around: list[bytes] = []
        base = begin = 0
        pieces = iter(text_pieces(text, _TABLE))
        piece = next(pieces)
        while piece is not None:
            then = next(pieces, None)
            segment = _Segment(row, around + piece.split(), base, begin, then is None)
            yield segment
            left = max(0, segment.own[1] - WINDOW + 1)
            around, base, begin, piece = segment.words[left:], base + left, segment.own[1] - left, then


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), "<u8").astype(np.uint64)


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` consecutive words."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, window (its words, joined by a blank), words (how many), shingles, longest (bytes of its longest word) of each window of each item."""
    for whole in batches:
        for batch in slices(whole, "text"):
            items = batch.column("item").to_pylist()
            for s in _segments(text_bytes(batch.column("text"))):
                words = min(WINDOW, len(s.words)) if not s.base and s.last else WINDOW
                size = min(SHINGLE, words)
                keys = _shingles(_hashes(s.words), size).view(np.int64) if size else ()
                starts = range(s.own[0], min(s.own[1], len(s.words) - words + 1)) if words else ()
                for i in range(0, len(starts), 20_000):
                    some = starts[i : i + 20_000]
                    cut = [s.words[k : k + words] for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([items[s.row]] * len(some), pa.string()), pa.array([b" ".join(c) for c in cut], pa.binary()).cast(pa.string()), pa.array([words] * len(some), pa.int32()), pa.array([keys[k : k + words - size + 1] for k in some], pa.list_(pa.int64())), pa.array([max(map(len, c)) for c in cut], pa.int32())],
                        ["item", "window", "words", "shingles", "longest"],
                    )


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


class _Bitmap:
    """Which shingles may be wanted: two bits for each, at most MOST in all. sizes: the numbers of words that they have."""

    def __init__(self, wanted: DataFrame) -> None:
        """wanted: shingle, size."""
        counted = wanted.groupBy("size").agg(F.count("*").alias("n")).collect()
        self.sizes = sorted(r["size"] for r in counted)
        self.bits = min(MOST, max(FEWEST, 1 << (BITS * sum(r["n"] for r in counted)).bit_length()))

        def run(batches: Iterator[pa.RecordBatch], bits=self.bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(_probes(batch.column("shingle").to_numpy(zero_copy_only=False).view(np.uint64), bits)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["place", "bit"])

        words = wanted.select("shingle").mapInArrow(run, "place int, bit long").groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
        self.map = np.zeros(self.bits >> 6, np.uint64)
        self.map[words.column("place").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        yes = np.ones(len(h), bool)
        for at in _probes(h, self.bits):
            yes &= ((self.map[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return yes


def _met(segments: list[_Segment], bitmap: _Bitmap) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of shingles: segment number, place within the segment and hash of each own shingle that the bitmap holds."""
    lengths = np.array([len(s.words) for s in segments])
    ends = np.cumsum(lengths)
    h = _hashes([w for s in segments for w in s.words])
    low, high = (ends - lengths + np.array([s.own[k] for s in segments]) for k in (0, 1))
    for size in bitmap.sizes:
        keys = _shingles(h, size)
        at = np.flatnonzero(bitmap.holds(keys))
        of = np.searchsorted(ends, at, side="right")
        own = (at >= low[of]) & (at < high[of]) & (at + size <= ends[of])
        at, of = at[own], of[own]
        yield of, at - (ends - lengths)[of], keys[at]


def _frequencies(shared: Broadcast):
    """shingle, n: the number of documents that have it, of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.uint64()).view(pa.int64()), pa.array(list(held.values()), pa.int64())], ["shingle", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                seen: dict[int, set] = {}
                for group in _grouped(_segments(text_bytes(batch.column("text")))):
                    rows = np.array([s.row for s in group])
                    for of, _, keys in _met(group, shared.value):
                        for row, key in zip(rows[of].tolist(), keys.tolist(), strict=True):
                            seen.setdefault(row, set()).add(key)
                for keys in seen.values():
                    for key in keys:
                        held[key] = held.get(key, 0) + 1
            if len(held) > HELD:
                yield sent()
                held.clear()
        yield sent()

    return run


def _grouped(segments: Iterator[_Segment], most: int = 300_000) -> Iterator[list[_Segment]]:
    """Segments in lists of about so many words."""
    held, words = [], 0
    for s in segments:
        held.append(s)
        words += len(s.words)
        if words >= most:
            yield held
            held, words = [], 0
    if held:
        yield held


_PLACES = "row long, doc_id {kind}, n_words long, place long, shingle long, left int, around array<string>"


def _places(shared: Broadcast, longest: int):
    """A row for each document (row, doc_id, n_words) and for each place of a wanted shingle (row, place, shingle, left, around).

    around has the words that a window through the place can have, `left` of
    them before it. Words longer than any of the items' are left blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                n, count = batch.num_rows, [0] * batch.num_rows
                out: list[tuple] = []
                for group in _grouped(_segments(text_bytes(batch.column("text")))):
                    for s in group:
                        count[s.row] = s.base + len(s.words)
                    for of, at, keys in _met(group, shared.value):
                        for k, i, key in zip(of.tolist(), at.tolist(), keys.view(np.int64).tolist(), strict=True):
                            s, left = group[k], min(i, WINDOW)
                            around = [w.decode() if len(w) <= longest else "" for w in s.words[i - left : i + WINDOW]]
                            out.append((number + s.row, s.base + i, key, left, around))
                    if len(out) > 20_000:
                        yield _batch(batch, [], out)
                        out = []
                yield _batch(batch, [(number + i, i, c) for i, c in enumerate(count)], out)
                number += n

    def _batch(batch: pa.RecordBatch, docs: list[tuple], out: list[tuple]) -> pa.RecordBatch:
        ids = batch.column("doc_id").take(pa.array([d[1] for d in docs] + [None] * len(out), pa.int64()))
        none, blank = [None] * len(docs), [None] * len(out)
        columns = [none + [o[k] for o in out] for k in (1, 2, 3, 4)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs] + [o[0] for o in out], pa.int64()), ids, pa.array([d[2] for d in docs] + blank, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", "doc_id", "n_words", "place", "shingle", "left", "around"])

    return run


def _prefixes(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """shingle, id, words, window, offset: each window that can occur, by its rarest shingle."""
    tokens = windows.select("id", F.size("shingles").alias("all"), F.posexplode("shingles").alias("offset", "shingle"))
    rare = tokens.join(frequencies, "shingle").groupBy("id", "all").agg(F.count("*").alias("met"), F.min(F.struct("n", "shingle", "offset")).alias("best"))
    return rare.where("met = all").select("id", "best.shingle", "best.offset").join(windows.select("id", "words", "window"), "id")


def matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans, items of each row of docs, whose columns are doc_id, text; benchmark has item_id, text.

    Words are runs of ASCII letters, A-Z lower-cased, digits and characters
    beyond ASCII. A window is ten consecutive words of an item, or all of an
    item that has fewer, but not none. spans are the runs of words (first,
    count) that occurrences of windows cover, in order; items the ids, as
    strings in order, of the items with an occurring window.

    Null texts have no words. Rows of one item_id are one item, and a null
    item_id is the item ''. Rows of docs that repeat an id, or are alike
    altogether, or have none, are judged each. Texts of any length are cut into
    pieces that overlap. Empty tables are no error. Other columns are ignored,
    whatever their names. A window that many items have is compared once.
    """
    spark = docs.sparkSession
    prepared(spark)
    context = spark.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    of_items = written(items.mapInArrow(_windows, "item string, window string, words int, shingles array<long>, longest int"), "item-windows")
    windows = written(of_items.groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"), F.first("longest").alias("longest")).withColumn("id", F.monotonically_increasing_id()), "windows")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    wanted = windows.select(F.explode("shingles").alias("shingle"), F.least("words", F.lit(SHINGLE)).alias("size")).distinct()
    bitmap = context.broadcast(_Bitmap(wanted))
    frequencies = texts.select("text").mapInArrow(_frequencies(bitmap), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    prefixes = written(_prefixes(windows, frequencies), "prefixes")
    bitmap.destroy()

    longest = windows.agg(F.max("longest")).first()[0] or 0
    bitmap = context.broadcast(_Bitmap(prefixes.select("shingle", F.least("words", F.lit(SHINGLE)).alias("size")).distinct()))
    found = written(texts.mapInArrow(_places(bitmap, longest), _PLACES.format(kind=docs.schema["doc_id"].dataType.simpleString())), "places")
    bitmap.destroy()

    begin = F.col("left") - F.col("offset")
    within = (begin >= 0) & (begin + F.col("words") <= F.size("around"))
    same = F.array_join(F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.col("words")), " ") == F.col("window")
    places = found.where("place IS NOT NULL").select("row", "place", "shingle", "left", "around")
    occurring = written(places.join(prefixes, "shingle").where(within & same).select("row", "id", (F.col("place") - F.col("offset")).alias("first"), "words"), "occurring")

    before = F.max(F.col("first") + F.col("words")).over(Window.partitionBy("row").orderBy("first", "words").rowsBetween(Window.unboundedPreceding, -1))
    runs = occurring.select("row", "first", "words").distinct().withColumn("begins", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("begins").over(Window.partitionBy("row").orderBy("first", "words"))).groupBy("row", "run").agg(F.min("first").alias("first"), (F.max(F.col("first") + F.col("words")) - F.min("first")).alias("count"))
    spans = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "count"))).alias("spans"))

    members = of_items.select("window", "item").distinct().join(windows.select("window", "id"), "window").select("id", "item")
    hits = occurring.select("row", "id").distinct().join(members, "id").select("row", "item").distinct()
    listed = hits.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))

    rows = found.where("place IS NULL").select("row", "doc_id", "n_words")
    joined = rows.join(spans.join(listed, "row"), "row", "left")
    none = "array<struct<first:bigint,count:bigint>>"
    return joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(none)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of matched()'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["count"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
