"""Extraction over documents that keep arriving; each batch gives what the same rows give at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import spans
from ..operators.lexicon import Entry


def document_stream(spark: SparkSession, folder: str, schema: StructType, *, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def extract_stream(docs: DataFrame, entries: Sequence[Entry], out: str, checkpoint: str, *, key: str = "doc_id") -> StreamingQuery:
    """Write the resolved spans of each batch to its own folder below `out`.

    A batch that is run again after a failure overwrites its own folder, so
    every document's spans are there once. Documents are independent, so no
    state is kept between batches.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spans.resolved(spans.matches(rows, entries, key=key), key=key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
