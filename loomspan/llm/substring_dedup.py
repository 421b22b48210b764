"""Removal of word passages that stand in an earlier document, by super-k-mer partitioning.

Each text's windows of 50 words are cut into super-k-mers: runs of windows
that share a minimiser (see superkmer). Each distinct run whose minimiser
stands in two documents travels as one packed string, with the smallest id that
has it, to the minimiser's bucket. There all windows are sorted, which tells,
exactly, the smallest id that each window starts in; a document's windows with
a smaller one than its own go. A passage that a third of all documents share is
one string in its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, prepared, slices, text_bytes, text_pieces, written
from .superkmer import FLAG, LEVEL, PIECE, RUN, compared, parts_of, piecewise, ranges, runs, table

WINDOW = 50
GRAM = 8
#: Bytes of packed runs that a task sends at once.
PACKED = 4 << 20
_LAST = (1 << 63) - 1  # what a null id counts as: later than all others, and not earlier than another null


def _digests(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), "<u8").astype(np.uint64)


def _words_of(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [t.split() for t in texts]
    elements = _digests([w for ws in words for w in ws])
    return words, elements, np.array([len(w) for w in words], np.int64)


def _ends(words: list[bytes]) -> list[int]:
    """Where each word begins in the words joined by one space, and one place more than where the last ends."""
    return [0, *accumulate(len(w) + 1 for w in words)]


class _Words(list):
    """The words of a piece of a text, for superkmer.piecewise."""

    def elements(self) -> np.ndarray:
        return _digests(self)

    def __add__(self, other: list) -> _Words:
        return _Words([*self, *other])

    def __getitem__(self, at):
        return _Words(list.__getitem__(self, at)) if isinstance(at, slice) else list.__getitem__(self, at)


def _contents(words: list[bytes], first: list[int], count: list[int]) -> list[int]:
    joined, ends = b" ".join(words), _ends(words)
    return [xxhash.xxh64_intdigest(joined[ends[a] : ends[a + n + WINDOW - 1] - 1]) - (1 << 63) for a, n in zip(first, count, strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            doc, sig = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sig"))
            texts = text_bytes(batch.column("text"))
            if len(texts) == 1:  # it may be of any length
                pieces = (_Words(p.split()) for p in text_pieces(texts[0], BLANKS))
                for _, base, words, first, count, off, mini in piecewise([pieces], WINDOW, GRAM):
                    content = _contents(words, first.tolist(), count.tolist())
                    yield table(RUN, [np.repeat(doc, len(first)), np.repeat(sig, len(first)), (base + first).astype(np.int32), count.astype(np.int32), off.astype(np.int32), mini.view(np.int64), content])
                continue
            words, elements, lengths = _words_of(texts)
            text, first, count, off, mini = runs(elements, lengths, WINDOW, GRAM)
            content: list[int] = []
            cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            for t, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if b > a:
                    content += _contents(words[t], first[a:b].tolist(), count[a:b].tolist())
            yield table(RUN, [doc[text], sig[text], first.astype(np.int32), count.astype(np.int32), off.astype(np.int32), mini.view(np.int64), content])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            out: list[tuple] = []
            size = 0
            for row, text in enumerate(text_bytes(batch.column("text"))):
                for p, packed in _packed(text, (p for parts in parts_of(batch, row) for p in parts)):
                    out.append((p["mini"], p["content"], p["w"], p["off"], packed))
                    size += len(packed)
                    if size > PACKED:
                        yield table(LEVEL, list(zip(*out, strict=True)))
                        out, size = [], 0
            yield table(LEVEL, list(zip(*out, strict=True)) or [()] * 5)


def _packed(text: bytes, parts: Iterator[dict]) -> Iterator[tuple[dict, bytes]]:
    """Each part with its words, joined by a space. Parts are in order, so a piece of the text is enough at a time."""
    held: list[bytes] = []
    base, pieces = 0, iter(text_pieces(text, BLANKS))
    for p in parts:
        end = p["first"] + p["count"] + WINDOW - 1
        while base + len(held) < end:
            keep = max(0, p["first"] - base)
            base, held = base + min(keep, len(held)), held[keep:]
            held += next(pieces).split()
        yield p, b" ".join(held[p["first"] - base : end - base])


def _split(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, sub, w, off, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "w", "off", "packed")), strict=True):
                words = packed.split()
                ends = _ends(words)
                for at, n, low, high in ranges(off, len(words) - WINDOW + 1, width):
                    part = packed[ends[at] : ends[at + n + WINDOW - 1] - 1]
                    shared = packed[ends[off - low] : ends[off - high + WINDOW] - 1]  # what every window of the whole range has
                    out.append((key, sub, at, w, off - at, part, xxhash.xxh64_intdigest(b"%d %d " % (key, low) + shared) - (1 << 63), xxhash.xxh64_intdigest(part) - (1 << 63)))
            yield table(PIECE, list(zip(*out, strict=True)) or [()] * 8)

    return run


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LEVEL rows sorted by key and sub: each bucket's windows are sorted, and equal ones get the smallest id that any of them has.

    A window that a single run holds gets this run's own.
    """
    held, rows = None, []

    def flush() -> Iterator[tuple]:
        windows, of = [], []
        for k, (_, _, packed) in enumerate(rows):
            ends = _ends(packed.split())
            for i in range(len(ends) - WINDOW):
                windows.append(packed[ends[i] : ends[i + WINDOW] - 1])
                of.append((k, i))
        order = sorted(range(len(windows)), key=windows.__getitem__)
        least = [[0] * (packed.count(b" ") + 2 - WINDOW) for _, _, packed in rows]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and windows[order[end]] == windows[order[at]]:
                end += 1
            smallest = min(rows[of[o][0]][1] for o in order[at:end])
            for o in order[at:end]:
                k, i = of[o]
                least[k][i] = smallest
            at = end
        for k, (sub, _, _) in enumerate(rows):
            begin = 0
            for i in range(1, len(least[k]) + 1):
                if i == len(least[k]) or least[k][i] != least[k][begin]:
                    yield held, sub, begin, i - begin, least[k][begin]
                    begin = i

    def flagged(out) -> pa.RecordBatch:
        return table(FLAG, list(zip(*out, strict=True)) or [()] * 5)

    for batch in batches:
        out = []
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "w", "packed")), strict=True):
            if key != held:
                out += flush()
                held, rows = key, []
            if not rows or rows[-1][0] != row[0]:  # rows alike in id and text send theirs more than once
                rows.append(row)
        yield flagged(out)
    yield flagged(list(flush()))


def _stripped(text: bytes, spans) -> tuple[int, int, bytes]:
    """Number of words, number of those within spans (runs of windows, in order), and the others, joined by a space."""
    upto, n, gone = 0, 0, 0  # words before `upto` go if a span covers them
    left: list[bytes] = []
    spans = iter([*spans, None])
    span = next(spans)
    for piece in text_pieces(text, BLANKS):
        words = piece.split()
        at, end = n, n + len(words)
        while at < end:
            if at < upto:
                gone, at = gone + min(upto, end) - at, min(upto, end)
            elif span is not None and span["first"] <= at:
                upto, span = max(upto, span["first"] + span["count"] + WINDOW - 1), next(spans)
            else:
                stop = min(end, span["first"]) if span is not None else end
                left.append(b" ".join(words[at - n : stop - n]))
                at = stop
        n = end
    return n, gone, b" ".join(left)


def _key_columns() -> tuple[Column, ...]:
    """doc (a null id is the last), sig (hash of the text, which tells rows with one id apart), text."""
    text = F.coalesce("text", F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, sig, first, count: runs of windows that also start in a document with a smaller id."""
    prepared(docs.sparkSession)
    found = compared(docs.select(*_key_columns()), width=WINDOW - GRAM + 1, cut=_cut, pack=_pack, split=_split, merge=_sorted_windows, weight=F.min("doc"), again=F.min, partnered=F.min("doc") < F.max("doc"))
    return found.where("doc > w").select("doc", "sig", "first", "count")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept of each row of docs, with the kept words joined by one space.

    A word goes if a window of 50 words that covers it also starts in a
    document with a smaller id; windows are judged on the input. Null texts
    have no words. A null id counts as later than all others, and two nulls as
    neither earlier. Rows that repeat an id are one document to the rule, so
    they never remove each other's words. Texts of any length are cut into pieces
    whose runs are those of the whole. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    found = repeated_windows(docs)
    spans = written(found.groupBy("doc", "sig").agg(F.sort_array(F.collect_set(F.struct("first", "count"))).alias("spans")), "spans")
    keyed = docs.select("doc_id", *_key_columns())
    joined = keyed.join(spans, ["doc", "sig"], "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                n_words, n_removed, kept = [], [], []
                for raw, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                    n, gone, left = _stripped(raw, spans or ())
                    n_words.append(n)
                    n_removed.append(gone)
                    kept.append(left)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, kept string")
