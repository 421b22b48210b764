"""Text encoders. Any function from a list of texts to vectors can be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

Encoder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class ModelConfig:
    key: str
    hf_name: str
    pooling: str
    max_seq_length: int
    category: str
    description: str

    def __post_init__(self) -> None:
        if self.pooling not in ("cls", "mean"):
            raise ValueError(f"unknown pooling: {self.pooling}")


def registry(spark: SparkSession, models: list[ModelConfig]) -> DataFrame:
    return spark.createDataFrame([(m.key, m.hf_name, m.pooling, m.max_seq_length, m.category, m.description) for m in models], "key string, hf_name string, pooling string, max_seq_length int, category string, description string")


def lookup(models: list[ModelConfig], key: str) -> ModelConfig:
    """The model of this key; an unknown key raises."""
    for m in models:
        if m.key == key:
            return m
    raise ValueError(f"unknown model {key!r}; known: {', '.join(m.key for m in models)}")


def saved_models(spark: SparkSession, folder: str, weights: str = "pytorch_model.bin") -> DataFrame:
    """model, path of the subfolders of a folder that hold a file of this name; file contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", weights).load(f"{folder.rstrip('/')}/*").select("path")
    path = F.regexp_replace("path", "/[^/]+$", "")
    return found.select(F.element_at(F.split(path, "/"), -1).alias("model"), path.alias("path"))


def encoded(texts: DataFrame, load: Callable[[], Encoder], *, column: str = "text", batch: int = 32) -> DataFrame:
    """texts with `embedding`. load() runs once for each task and returns the encoder, which gets `batch` texts at a time."""
    ship(texts.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in series:
            out: list = []
            for a in range(0, len(s), batch):
                out += list(model(s.iloc[a : a + batch].fillna("").tolist()))
            yield pd.Series(out)

    return texts.withColumn("embedding", encode(F.col(column)))


def pooled(tokens: Column, pooling: str) -> Column:
    """One vector for a sequence of token vectors: the first one's (`cls`), or the mean of all (`mean`). Null for an empty sequence; vectors are of one length."""
    if pooling not in ("cls", "mean"):
        raise ValueError(f"unknown pooling: {pooling}")
    if pooling == "cls":
        return F.get(tokens, F.lit(0))
    start = F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(tokens, start, lambda s, t: F.zip_with(s, t, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(tokens))


def hashed_words(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for a trained encoder: counts of words by hash, in native expressions."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))
