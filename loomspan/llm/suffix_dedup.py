"""Removal of bytes within strings of 200 bytes that occur more than once, by merging Burrows-Wheeler transforms.

Texts are cut into super-k-mers of 200-byte windows (see superkmer): every
window belongs to just one run, and equal windows to runs of one minimiser.
Each distinct run of a minimiser that has any partner is a shard, with the
number of its copies as its weight and a Burrows-Wheeler transform of its own.

The shards of a minimiser are merged by refining their interleave. A symbol is
eight bytes. To begin with, the rows that hold a window's last symbol are in
order of this symbol; each round deals them stably by the symbol that stands
before, which the transform knows, so that they are in order of one symbol
more. No suffix of one shard is compared with one of another. A row that is
alone in its interval is done, and the number of rounds it took is the common
prefix that it has with any other row. Rows that are still in one interval when
25 symbols, 200 bytes, are dealt start equal strings.

A window is repeated if its interval has two rows, or its shard two copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared, slices, text_bytes, written
from .superkmer import FLAG, LEVEL, PIECE, RUN, compared, parts_of, piecewise, ranges, runs, table

WINDOW = 200
GRAM = 32
STEP = 8
#: Bytes of text whose windows are looked at together; a longer text is cut into pieces.
PIECE_BYTES = 2 << 20
#: Bytes of shards that are merged together where buckets are small.
BYTES = 1 << 19


def _symbols(joined: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number in the order of the bytes; zero bytes follow the end."""
    raw = np.frombuffer(joined + bytes(STEP - 1), np.uint8).astype(np.uint64)
    out = np.zeros(len(joined), np.uint64)
    for i in range(STEP):
        out = (out << np.uint64(8)) | raw[i : i + len(joined)]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the order of the keys."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.zeros(len(keys), np.int64)
    new[1:] = held[1:] != held[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


class Transforms:
    """The transforms of shards, laid one after another.

    A row stands for a place that has a whole symbol; `place` says which, in
    the text of all shards. Rows of a shard are in order of the symbols from
    their place on. `before` is the symbol before a row (a number in the order
    of the symbols, -1 for none), and `back` the row of that symbol's place.
    """

    def __init__(self, shards: list[bytes], window: int) -> None:
        joined = b"".join(shards)
        lengths = np.array([len(s) for s in shards], np.int64)
        self.begin = np.cumsum(lengths) - lengths
        ends = self.begin + lengths
        of = np.repeat(np.arange(len(shards)), lengths)
        whole = np.arange(len(joined)) + STEP <= ends[of]
        places = np.flatnonzero(whole)
        number = np.full(len(joined), -1, np.int64)
        number[places] = _dense(_symbols(joined)[places])
        # order within each shard: by the first symbol, then by twice as many until no two rows tie or a window is told.
        # The rank of a row is the first place of its class, so a class that splits leaves all other ranks as they are.
        key = of[places] * (len(places) + 1) + number[places]
        sorted_ = np.argsort(key)
        order, key = places[sorted_], key[sorted_]
        at, told = np.arange(len(order)), 1
        rank = np.full(len(joined), -1, np.int64)
        while True:
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            own = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
            rank[order[at]] = own
            tie = ~new
            tie[:-1] |= tie[1:]
            at, own = at[tie], own[tie]
            if not len(at) or told * STEP >= window:
                break
            later = order[at] + told * STEP
            next_ = np.where(later < ends[of[order[at]]], rank[np.minimum(later, len(rank) - 1)], -1) + 1
            key = own * (len(places) + 2) + next_
            sub = np.argsort(key)
            order[at], key = order[at][sub], key[sub]
            told *= 2
        self.place = order
        row = np.full(len(joined), -1, np.int64)
        row[self.place] = np.arange(len(self.place))
        self.shard = of[self.place]
        self.first = number[self.place]
        has = self.place - STEP >= self.begin[self.shard]
        earlier = np.where(has, self.place - STEP, 0)
        self.before = np.where(has, number[earlier], -1)
        self.back = np.where(has, row[earlier], -1)


def common_prefixes(shards: list[bytes], buckets: list[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shard, place and symbols for each window: how many of the window's last symbols any other window of its bucket has as well.

    Shards of a bucket stand together, and none holds a window twice.
    """
    made = Transforms(shards, window)
    last = made.place - (window - STEP)  # where the window begins whose last symbol this row starts with
    row = np.flatnonzero(last >= made.begin[made.shard])
    window_of = last[row]
    common = np.zeros(len(made.place) + 1, np.int64)  # by the window's number
    number = np.arange(len(row))
    interval = np.array(buckets, np.int64)[made.shard[row]]
    symbol = made.first[row]
    for k in range(window // STEP):
        if k:
            symbol, row = made.before[row], made.back[row]
        if not len(row):
            break
        order = np.argsort(symbol * (int(interval.max(initial=0)) + 1) + interval)
        row, number, symbol, interval = row[order], number[order], symbol[order], interval[order]
        new = np.ones(len(row), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(new) - 1
        more = np.bincount(interval)[interval] > 1
        row, number, interval = row[more], number[more], interval[more]
        common[number] = k + 1
    n = len(window_of)
    of = np.searchsorted(made.begin, window_of, side="right") - 1 if n else window_of
    return of, window_of - made.begin[of], common[:n]


def _stretches(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shard, first window and number of windows of consecutive windows of one shard."""
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])) if len(of) else np.empty(0, np.int64)
    return of[cut], at[cut], np.diff(np.append(cut, len(of)))


class _Bytes(bytes):
    """A piece of a text, for superkmer.piecewise."""

    def elements(self) -> np.ndarray:
        return np.frombuffer(self, np.uint8).astype(np.uint64) + np.uint64(1)

    def __add__(self, other: bytes) -> _Bytes:
        return _Bytes(bytes(self) + bytes(other))

    def __getitem__(self, at):
        return _Bytes(bytes.__getitem__(self, at))


def _run_rows(doc, sig, first, count, off, mini, joined: bytes, begin: np.ndarray) -> pa.RecordBatch:
    digest = xxhash.xxh64_digest
    content = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(begin.tolist(), (begin + count + WINDOW - 1).tolist(), strict=True)]), "<i8")
    return table(RUN, [doc, sig, first.astype(np.int32), count.astype(np.int32), off.astype(np.int32), mini.view(np.int64), content.astype(np.int64)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", PIECE_BYTES):
            doc, sig = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sig"))
            texts = text_bytes(batch.column("text"))
            if len(texts) == 1:
                pieces = (_Bytes(texts[0][i : i + PIECE_BYTES]) for i in range(0, len(texts[0]), PIECE_BYTES))
                for _, base, piece, first, count, off, mini in piecewise([pieces], WINDOW, GRAM):
                    yield _run_rows(np.repeat(doc, len(first)), np.repeat(sig, len(first)), base + first, count, off, mini, bytes(piece), first)
                continue
            joined = b"".join(texts)
            lengths = np.array([len(t) for t in texts], np.int64)
            text, first, count, off, mini = runs(np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1), lengths, WINDOW, GRAM)
            yield _run_rows(doc[text], sig[text], first, count, off, mini, joined, (np.cumsum(lengths) - lengths)[text] + first)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            out: list[tuple] = []
            for row, text in enumerate(text_bytes(batch.column("text"))):
                for parts in parts_of(batch, row):
                    out += [(p["mini"], p["content"], p["w"], p["off"], text[p["first"] : p["first"] + p["count"] + WINDOW - 1]) for p in parts]
                    if len(out) > 20_000:
                        yield table(LEVEL, list(zip(*out, strict=True)))
                        out = []
            yield table(LEVEL, list(zip(*out, strict=True)) or [()] * 5)


def _split(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, sub, w, off, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "w", "off", "packed")), strict=True):
                for at, n, low, high in ranges(off, len(packed) - WINDOW + 1, width):
                    part = packed[at : at + n + WINDOW - 1]
                    shared = packed[off - low : off - high + WINDOW]  # what every window of the whole range has
                    out.append((key, sub, at, w, off - at, part, xxhash.xxh64_intdigest(b"%d %d " % (key, low) + shared) - (1 << 63), xxhash.xxh64_intdigest(part) - (1 << 63)))
            yield table(PIECE, list(zip(*out, strict=True)) or [()] * 8)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LEVEL rows sorted by key and sub: the stretches of windows that are repeated."""
    rows: list[tuple] = []
    size, held = 0, None

    def flush() -> pa.RecordBatch:
        if not rows:
            return table(FLAG, [()] * 5)
        keys = np.array([r[0] for r in rows], np.int64)
        bucket = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        of, at, common = common_prefixes([r[3] for r in rows], bucket.tolist())
        weight = np.array([r[2] for r in rows], np.int64)
        hit = (common * STEP >= WINDOW) | (weight[of] > 1)
        of, at, many = _stretches(of[hit], at[hit])
        subs = np.array([r[1] for r in rows], np.int64)
        return table(FLAG, [keys[of], subs[of], at.astype(np.int32), many.astype(np.int32), np.zeros(len(of), np.int64)])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "w", "packed")), strict=True):
            if row[0] != held and size >= BYTES:
                yield flush()
                rows, size = [], 0
            held = row[0]
            if not rows or rows[-1][:2] != row[:2]:  # rows alike in id and text send theirs more than once
                rows.append(row)
                size += len(row[3])
    yield flush()


def _key_columns() -> tuple[Column, ...]:
    """doc and sig (hash of the text), which name a row together: rows that share both are alike in all that follows."""
    text = F.coalesce("text", F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, sig, first, count: stretches of 200-byte windows that also start anywhere else."""
    prepared(docs.sparkSession)
    found = compared(docs.select(*_key_columns()), width=WINDOW - GRAM + 1, cut=_cut, pack=_pack, split=_split, merge=_merged, weight=F.count("*"), again=F.sum, partnered=F.count("*") > 1)
    return found.select("doc", "sig", "first", "count")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row of docs.

    A byte goes if a 200-byte string that covers it also starts anywhere else,
    in this row or another; strings are judged on the input. Null texts are
    empty, repeated rows repeat each other's strings, and n_spans counts
    maximal removed runs. What is kept may cut a character, so it stays binary.
    Texts of any length are cut into pieces whose runs are those of the whole.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    found = repeated_windows(docs)
    spans = written(found.groupBy("doc", "sig").agg(F.sort_array(F.collect_set(F.struct("first", "count"))).alias("spans")), "spans")
    joined = docs.select("doc_id", *_key_columns()).join(spans, ["doc", "sig"], "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                out: list[tuple] = []
                for raw, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                    left, at, gone, n = [], 0, 0, 0
                    for s in spans or ():
                        a, b = s["first"], s["first"] + s["count"] + WINDOW - 1
                        if a > at or not n:
                            n += 1
                            left.append(raw[at:a])
                            at = a
                        if b > at:
                            gone, at = gone + b - at, b
                    left.append(raw[at:])
                    out.append((len(raw), gone, n, b"".join(left)))
                n_bytes, n_removed, n_spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
