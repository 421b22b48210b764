"""Super-k-mers: runs of consecutive windows that share a minimiser.

A window is `window` consecutive elements (words or bytes). Its minimiser is
the gram of `gram` elements within it whose hash is smallest, the leftmost on
ties. Where it lies depends on the window's content alone, so equal windows
have equal minimisers at the same place, and whatever is to be found out about
equal windows can be found out among the runs of one minimiser.

`compared` carries this out for an operator that knows how to cut its texts and
how to compare the runs of a bucket. Runs of equal content are one, with a
weight that is summed before anything meets. A minimiser with a single run has
no partner and goes no further. Where very many different runs share one, their
windows are dealt anew by what all windows of a narrower range have in common,
until a bucket is small or a range is one window, of which all runs are equal;
so every window is compared in the same way, and no bucket is unbounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Different runs of one key that are compared in one piece; those of a larger bucket are dealt anew.
BUCKET = 500
#: A range of windows is cut into so many when its bucket is dealt anew.
WAYS = 8

RUN = "doc long, sig long, first int, count int, off int, mini long, content long"
LEVEL = "key long, sub long, w long, off int, packed binary"
PIECE = "key long, sub long, at int, w long, off int, packed binary, key2 long, sub2 long"
FLAG = "key long, sub long, at int, many int, w long"

Batches = Iterator[pa.RecordBatch]

_ODD = 0x9E3779B97F4A7C15
#: The inverse of _ODD modulo 2**64.
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Low bits of a key that hold a place, so that the smallest key is the leftmost. Texts of any length that Arrow can hold fit.
_PLACE = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def gram_hashes(elements: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram` consecutive elements (unsigned 64-bit numbers)."""
    n = len(elements)
    if n < gram:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(elements * _powers(_ODD, n), out=sums[1:])
        return _mixed((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys, by doubling."""
    least, span = keys, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    return least if span == width else np.minimum(least[: len(keys) - width + 1], least[width - span : width - span + len(keys) - width + 1])


def runs(elements: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The super-k-mers of texts laid end to end: text, first window (within the text), number of windows, place of the minimiser (from the first window on), minimiser hash.

    elements: the texts' elements as unsigned 64-bit numbers; lengths: of each
    text. No window reaches over the end of its text, and a text shorter than a
    window has none.
    """
    n, lengths = len(elements), np.asarray(lengths, np.int64)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none, none, np.empty(0, np.uint64)
    hashes = gram_hashes(elements, gram)
    low = np.uint64((1 << _PLACE) - 1)
    least = _sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text = np.repeat(np.arange(len(lengths)), lengths)[: n - window + 1]
    at = np.arange(n - window + 1)
    valid = at + window <= starts[text + 1]
    at, text, place = at[valid], text[valid], (least[valid] & low).astype(np.int64)
    if not len(at):
        return none, none, none, none, np.empty(0, np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(cut, len(at)))
    return text[cut], at[cut] - starts[text[cut]], count, place[cut] - at[cut], hashes[place[cut]]


def piecewise(texts: Iterator, window: int, gram: int):
    """The super-k-mers of texts that come in pieces, the same as those of the whole.

    texts: for each text the pieces, each an object that `+` joins, a slice
    cuts, and `elements()` turns into the numbers that runs() takes; a lone text
    has one. A piece's last run may go on in the next one, so it is left for
    that, with all from its first window on. For each piece that has runs:
    number of the text, first window of the piece in it, the piece, and runs()
    of it without the number of the text.
    """
    for number, pieces in enumerate(texts):
        base, held = 0, None
        pieces = iter(pieces)
        piece = next(pieces, None)
        while piece is not None:
            then = next(pieces, None)
            held = piece if held is None else held + piece
            _, first, count, off, mini = runs(held.elements(), np.array([len(held)]), window, gram)
            if then is not None:
                if not len(first):
                    piece = then
                    continue
                cut = int(first[-1])
                first, count, off, mini = first[:-1], count[:-1], off[:-1], mini[:-1]
            if len(first):
                yield number, base, held, first, count, off, mini
            if then is not None:
                base, held = base + cut, held[cut:]
            piece = then


def parts_of(batch: pa.RecordBatch, row: int, most: int = 4096) -> Iterator[list[dict]]:
    """A row's `parts`, so many at a time."""
    listed = batch.column("parts")
    start, end = listed.offsets[row].as_py(), listed.offsets[row + 1].as_py()
    for at in range(start, end, most):
        yield listed.values.slice(at, min(most, end - at)).to_pylist()


def table(schema: str, columns) -> pa.RecordBatch:
    """A batch of the named columns; `schema` as Spark reads it."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(named, columns, strict=True)], [n for n, _ in named])


def ranges(off: int, count: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut a run of `count` windows, the first of which has its minimiser at `off`, where that place passes a multiple of `width`.

    For each part: its first window and number of windows, and the least and
    greatest place of the minimiser in its range. All runs are cut alike.
    """
    at = 0
    while at < count:
        low = (off - at) // width * width
        n = min(count - at, off - at - low + 1)
        yield at, n, low, low + width - 1
        at += n


def _any(*names: str) -> list[Column]:
    """The columns of one of the rows that are equal in what counts: all are taken from the row that comes first."""
    return [F.first(c).alias(c) for c in names]


def _decided(level: DataFrame, width: int, again: Callable, split: Callable, merge: Callable) -> DataFrame:
    """FLAG rows for LEVEL rows, a table that is written already."""
    spark = level.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = written(level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "hot")
    none = hot.isEmpty()
    small = level if none else level.join(hot, "key", "left_anti")
    found = small.select("key", "sub", "w", "off", "packed").repartition(parts, "key").sortWithinPartitions("key", "sub").mapInArrow(merge, FLAG)
    if none:
        return found
    narrow = -(-width // WAYS)
    pieces = written(level.join(hot, "key", "left_semi").mapInArrow(split(narrow), PIECE), "pieces")
    cells = pieces.groupBy("key2", "sub2").agg(again("w").alias("w"), *_any("off", "packed"))
    cells = written(cells.select(F.col("key2").alias("key"), F.col("sub2").alias("sub"), "w", "off", "packed"), "cells")
    own = _decided(cells, narrow, again, split, merge).select(F.col("key").alias("key2"), F.col("sub").alias("sub2"), F.col("at").alias("more"), "many", "w")
    return found.unionByName(pieces.select("key", "sub", "at", "key2", "sub2").join(own, ["key2", "sub2"]).select("key", "sub", (F.col("at") + F.col("more")).cast("int").alias("at"), "many", "w"))


def compared(texts: DataFrame, *, width: int, cut: Callable, pack: Callable, split: Callable, merge: Callable, weight: Column, again: Callable, partnered: Column) -> DataFrame:
    """doc, sig, first, count, w: the stretches of windows that `merge` reports, in every document that has them.

    texts: doc, sig, text; rows alike in doc and sig are one text. width: places
    that a minimiser can have in a window. All that is called gets and gives
    Arrow batches: cut (texts to RUN), pack (texts with `parts` to LEVEL),
    split(width) (LEVEL to PIECE) and merge (LEVEL, sorted by key and sub, to FLAG).
    weight: an aggregate over the runs of one content, which `again` adds up;
    partnered: an aggregate over the runs of a minimiser that tells whether any
    of them can have a partner.
    """
    every = written(texts.mapInArrow(cut, RUN), "runs")
    # tables of their own on both sides of a join, so that Spark can split a minimiser or content that very many runs share
    some = written(every.groupBy("mini").agg(partnered.alias("some")).where("some").select("mini"), "minimisers")
    runs_ = written(every.join(some, "mini", "left_semi"), "shared")
    contents = runs_.groupBy("mini", "content").agg(weight.alias("w"), *_any("doc", "sig", "first", "count", "off"))
    wanted = contents.groupBy("doc", "sig").agg(F.array_sort(F.collect_list(F.struct("first", "count", "off", "mini", "content", "w"))).alias("parts"))
    level = written(texts.join(wanted, ["doc", "sig"]).select("text", "parts").mapInArrow(pack, LEVEL), "packed")
    found = _decided(level, width, again, split, merge)
    flags = written(found.groupBy(F.col("key").alias("mini"), F.col("sub").alias("content")).agg(F.collect_set(F.struct("at", "many", "w")).alias("flags")), "flags")
    hits = runs_.select("doc", "sig", "first", "mini", "content").join(flags, ["mini", "content"])
    hits = hits.select("doc", "sig", "first", F.explode("flags").alias("f"))
    return hits.select("doc", "sig", (F.col("first") + F.col("f.at")).cast("int").alias("first"), F.col("f.many").alias("count"), F.col("f.w").alias("w"))
