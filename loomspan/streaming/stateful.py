"""Streams that keep state: rows that arrive again, and counts that run on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lexicon import Entry
from ..shipping import ship


def unique_stream(rows: DataFrame, event_time: str, delay: str, by: Sequence[str]) -> DataFrame:
    """The first of the rows that agree in `by` and whose event times lie within `delay` of each other.

    Keys are forgotten when the watermark, the latest event time less the
    delay, has passed them, so state is as large as a delay's rows and not as
    the stream. A row older than the watermark is dropped: it is late, whether
    it was seen before or not.
    """
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(by))


def content_key(*columns: str):
    """A column that is equal for rows of equal contents: what tells a document that arrives under another name."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def appended(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived as Parquet files, each row once, and end. A later call with the same checkpoint goes on from there."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _run_on(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A label's rows of a batch in order of document, with the counts so far."""
    batch = pd.concat(list(rows)).sort_values("key", kind="stable")
    total = state.get[0] if state.exists else 0
    running = batch["n"].cumsum() + total
    state.update((int(running.iloc[-1]),))
    yield pd.DataFrame({"key": batch["key"], "label": key[0], "n": batch["n"], "running": running})


def running_count_stream(docs: DataFrame, entries: Sequence[Entry], *, key: str = "doc_id", delay: str = "1 day") -> DataFrame:
    """key, label, n, running: matches of each label in each document, and their sum over this and all documents that came before it.

    As spans.running_counts, where documents arrive in order of an integer key:
    within a batch they are put in order, and each label's sum is carried on as
    state. A document that comes late is counted where it arrives. One whose key
    arrived within `delay` is dropped, so a file that is delivered again adds
    nothing. Matches are counted in each row, so a batch sends a number for each
    document and label, and a label's task holds those of one batch.
    """
    ship(docs.sparkSession)
    arrived = unique_stream(docs.select(F.col(key).cast("long").alias("key"), "text").withColumn("arrived", F.current_timestamp()), "arrived", delay, ["key"])
    each = F.array(*[F.struct(F.lit(e.label).alias("label"), F.regexp_count("text", F.lit(e.once or e.pattern)).cast("long").alias("n")) for e in entries])
    counts = arrived.select("key", F.explode(each).alias("x")).select("key", "x.label", "x.n").where("n > 0")
    out = counts.groupBy("label").applyInPandasWithState(_run_on, "key long, label string, n long, running long", "total long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)
