"""Helpers that the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import folder, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Word separators of all contracts: the six ASCII blanks. ``bytes.split()`` uses the same set.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

def prepared(spark: SparkSession, size: str = "8m", rows: int = 4000) -> None:
    """Send the package to the workers, and cap the bytes of one Arrow batch, so that a worker's memory doesn't follow document length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


#: Translation that leaves all bytes as they are but the six ASCII blanks, which become one, for text_pieces.
BLANKS = bytes(32 if c in b" \t\n\v\f\r" else c for c in range(256))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_pieces(text: bytes, table: bytes, most: int = 1 << 20):
    """The text through a translation table that makes separators blanks, cut at blanks into pieces of about `most` bytes."""
    at = 0
    while len(text) - at > most:
        piece = text[at : at + most].translate(table)
        cut = piece.rfind(b" ") + 1
        while not cut:  # one word is longer than a piece
            end = at + len(piece) + most
            piece = text[at:end].translate(table)
            cut = piece.rfind(b" ") + 1 if end < len(text) else len(piece)
        yield piece[:cut]
        at += cut
    yield text[at:].translate(table)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a batch into runs of rows of about `most` text bytes; one long text makes a run of its own."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)
