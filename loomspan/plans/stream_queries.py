"""Streams over the given tables, delivered in pieces, some of them twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lexicon import GENERIC
from ..staging import folder
from ..streaming.incremental import document_stream
from ..streaming.stateful import appended, content_key, running_count_stream, unique_stream
from .catalog import register
from .span_queries import E, documents

#: Pieces that a table is delivered in.
PIECES = 3


def _pieces(df, order):
    """Conditions that cut df into PIECES ranges of a column."""
    low, high = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    cuts = [low + (high - low) * i / PIECES for i in range(1, PIECES)] if low is not None else []
    at = F.col(order).cast("double")
    return [(at >= a if a is not None else F.lit(True)) & (at < b if b is not None else F.lit(True)) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]


@register("SELECT event_id, user_id, event_type, value FROM events")
def stream_unique_events(spark, sf_dir):
    """Events of which every piece arrives two or three times, by a stream that is ended and started again from its checkpoint."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events, place = events.withColumn("ts", F.col("ts").cast("timestamp")), folder(spark, "events")
    first, second, third = _pieces(events, "ts")
    for pieces in ((first, first, second), (first, second, third, third)):
        for piece in pieces:
            events.where(piece).coalesce(1).write.mode("append").parquet(f"{place}/in")
        arriving = document_stream(spark, f"{place}/in", events.schema, files_per_batch=1).withColumn("content", content_key(*events.columns))
        appended(unique_stream(arriving, "ts", "2 days", ["content"]), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("event_id", "user_id", "event_type", "value")


@register(f"WITH {E}, c AS (SELECT doc_id, label, count(*) AS n FROM e GROUP BY ALL) SELECT doc_id, label, n, CAST(sum(n) OVER (PARTITION BY label ORDER BY doc_id) AS BIGINT) AS running FROM c")
def stream_running_counts(spark, sf_dir):
    """The running label counts again, by a stream that carries them as state and gets one piece twice.

    A piece is as many files as Spark writes it in, and a batch is the files that
    came since the last: the stream goes on from its checkpoint after each piece.
    """
    docs, place = documents(spark, sf_dir).select("doc_id", "text"), folder(spark, "running")
    first, second, third = _pieces(docs, "doc_id")
    for piece in (first, second, second, third):
        docs.where(piece).write.mode("append").parquet(f"{place}/in")
        arriving = document_stream(spark, f"{place}/in", docs.schema, files_per_batch=1 << 30)
        appended(running_count_stream(arriving, GENERIC), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("doc_id", "label", "n", "running")
