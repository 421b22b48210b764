"""Entities named by a language model: filtering, and finding them in the text."""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor
from concurrent.futures import wait as futures_wait

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import extracted_json, strip
from ..shipping import ship
from .lexicon import TRIVIAL

ENTITY = "array<struct<text:string,label:string>>"
PROMPT_CHARACTERS = 2500


def valid(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (text, label, ...) with a known label, in upper case, and a text of two characters or more that is no trivial word."""
    text = strip(F.col("text"))
    kept = entities.where((F.length(text) >= 2) & ~F.lower(text).isin(*TRIVIAL)).withColumn("label", F.upper("label"))
    # a lexicon's labels: joined by shuffle, all rows of a label would meet in one task
    return kept.join(F.broadcast(labels.select("label").distinct()), "label", "left_semi").select(entities.columns)


def located(docs: DataFrame, entities: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, start, end, label, text of each entity's first occurrence, whatever its case; entities that don't occur are dropped."""
    e = entities.where((F.col("text") != "") & (F.col("label") != "")).select(key, F.col("text").alias("entity"), "label")
    at = F.expr("locate(lower(entity), lower(text))")
    found = docs.select(key, "text").join(e, key).withColumn("at", at).where("at > 0")
    return found.select(key, (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("entity")).alias("end"), "label", F.expr("substring(text, at, length(entity))").alias("text"))


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """answers with `entities`, the list under "entities" in the JSON of a model's answer; empty where there is none."""
    content = extracted_json(F.col(column))
    return answers.withColumn("entities", F.coalesce(F.from_json(content, f"struct<entities:{ENTITY}>")["entities"], F.array().cast(ENTITY)))


def answered(call: Callable[[str], str], texts: Sequence[str], *, attempts: int = 4, wait: float = 1.0, at_once: int = 8) -> list[tuple[str | None, str | None]]:
    """answer, error of each text, in order, with at most `at_once` calls under way.

    A call that raises is made again after wait, 2 wait, 4 wait ... seconds; its
    place is free for other texts meanwhile. After the last attempt its error stays.
    """
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
    due = [(0.0, i, 0) for i in range(len(texts))]  # when, which text, attempts made: a heap
    under_way: dict[Future, tuple[int, int]] = {}
    with ThreadPoolExecutor(at_once) as pool:
        while due or under_way:
            now = time.monotonic()
            while due and len(under_way) < at_once and due[0][0] <= now:
                _, i, made = heapq.heappop(due)
                under_way[pool.submit(call, texts[i])] = (i, made + 1)
            later = max(0.0, due[0][0] - now) if due and len(under_way) < at_once else None
            if not under_way:
                time.sleep(later or 0.0)
                continue
            for done in futures_wait(under_way, timeout=later, return_when=FIRST_COMPLETED).done:
                i, made = under_way.pop(done)
                failed = done.exception()
                if failed is None:
                    out[i] = (done.result(), None)
                elif made < attempts:
                    heapq.heappush(due, (time.monotonic() + wait * 2 ** (made - 1), i, made))
                else:
                    out[i] = (None, str(failed))
    return out


def asked(docs: DataFrame, client: Callable[[], Callable[[str], str]], *, key: str = "doc_id", attempts: int = 4, wait: float = 1.0, at_once: int = 8) -> DataFrame:
    """key, answer, error: what a model says to the first PROMPT_CHARACTERS characters of each text.

    client() is called once for each task and returns a function from text to
    answer, which several threads call: at most `at_once` in a task. Calls that
    raise are made again, see answered; then the row carries the error and a
    null answer.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            found = answered(call, batch["text"].tolist(), attempts=attempts, wait=wait, at_once=at_once)
            yield pd.DataFrame({key: batch[key], "answer": [a for a, _ in found], "error": [e for _, e in found]})

    return docs.select(key, F.substring("text", 1, PROMPT_CHARACTERS).alias("text")).mapInPandas(run, f"{key} {kind}, answer string, error string")


def named(answers: DataFrame, docs: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, start, end, label, text of the entities in the rows of asked() that are valid and stand in the document."""
    each = parsed(answers).select(key, F.explode("entities").alias("e")).select(key, "e.text", "e.label")
    return located(docs, valid(each, labels), key=key).dropDuplicates([key, "start", "end", "label"])


def observed_rate(answers: DataFrame) -> tuple[DataFrame, Observation]:
    """answers, and what success_rate() says of them, counted while they are written."""
    seen = Observation("answers")
    failed = F.count(F.when(F.col("error").isNotNull(), 1))
    share = F.coalesce(F.try_divide((F.count("*") - failed) * 100.0, F.count("*")), F.lit(0.0))
    return answers.observe(seen, F.count("*").alias("documents"), failed.alias("failed"), share.alias("success_percentage")), seen


def success_rate(answers: DataFrame) -> DataFrame:
    """documents, failed, success_percentage of the rows of asked(); 0 percent without documents."""
    failed = F.count(F.when(F.col("error").isNotNull(), 1))
    return answers.agg(F.count("*").alias("documents"), failed.alias("failed"), F.coalesce(F.try_divide((F.count("*") - failed) * 100.0, F.count("*")), F.lit(0.0)).alias("success_percentage"))
