"""Corpora by name, kept as a table that any session can search.

Vectors are brought to unit length once, when a corpus is added, and written in
partitions by name, version and a hash of the id. An index says which version of
a name holds. A search joins the table with the index rows of the names that are
asked for, so Spark's dynamic pruning reads their partitions and no others; a
look-up by id reads the buckets of its ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import unit
from . import blocks
from .retrieval import numbered, ranked

#: Buckets of ids within a corpus.
BUCKETS = 16
_INDEX = "name string, version string, no long, rows long, dims int"


def _bucket(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Corpora:
    """The corpora below a folder that all executors reach. Ids are kept as text."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def _there(self, part: str) -> bool:
        place = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{part}")
        return place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def index(self) -> DataFrame:
        """name, version, rows, dims of each corpus: its latest version."""
        if not self._there("index"):
            return self._spark.createDataFrame([], _INDEX).drop("no")
        every = self._spark.read.schema(_INDEX).parquet(f"{self._folder}/index")
        last = every.groupBy("name").agg(F.max_by(F.struct("version", "rows", "dims"), "no").alias("x"))
        return last.select("name", "x.*")

    def add(self, name: str, corpus: DataFrame) -> None:
        """corpus: embedding, and doc_id; without ids rows are called doc_0, doc_1 ... in order of the hash of their context. A known name is replaced. An empty corpus, or vectors of different lengths, raise."""
        if "doc_id" not in corpus.columns:
            corpus = numbered(corpus)
        version = uuid.uuid4().hex
        rows = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), unit(F.col("embedding")).alias("embedding")).where("embedding IS NOT NULL")
        rows = rows.withColumn("name", F.lit(name)).withColumn("version", F.lit(version)).withColumn("bucket", _bucket("doc_id"))
        rows.repartition("bucket").write.mode("append").partitionBy("name", "version", "bucket").parquet(f"{self._folder}/vectors")
        held = self._vectors().where((F.col("name") == name) & (F.col("version") == version))
        seen = held.agg(F.count("*").alias("rows"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("dims")).first()
        if not seen["rows"]:
            raise ValueError(f"corpus {name} is empty")
        if seen["least"] != seen["dims"]:
            raise ValueError(f"vectors of corpus {name} differ in length")
        no = (self._spark.read.schema(_INDEX).parquet(f"{self._folder}/index").agg(F.max("no")).first()[0] or 0) + 1 if self._there("index") else 1
        self._spark.createDataFrame([(name, version, no, seen["rows"], seen["dims"])], _INDEX).coalesce(1).write.mode("append").parquet(f"{self._folder}/index")

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self.index().collect())

    def _vectors(self) -> DataFrame:
        return self._spark.read.schema("doc_id string, embedding array<double>, name string, version string, bucket int").parquet(f"{self._folder}/vectors")

    def vectors(self, *names: str) -> DataFrame:
        """name, doc_id, embedding of the corpora of these names, from their partitions alone. An unknown name raises."""
        known = self.index().where(F.col("name").isin(*names)).select("name", "version")
        missing = sorted(set(names) - {r["name"] for r in known.collect()})
        if missing:
            raise ValueError(f"unknown corpora: {', '.join(missing)}")
        return self._vectors().join(F.broadcast(known), ["name", "version"]).select("name", "doc_id", "embedding")  # a row for each name given

    def retrieve(self, queries: DataFrame, *names: str, k: int = 10) -> DataFrame:
        """name, query_id, rank, doc_id, score of the k nearest rows of each named corpus. queries: query_id, embedding."""
        corpus = self.vectors(*names).select("name", "doc_id", F.col("embedding").alias("c"))
        # each query asks every corpus named
        q = queries.dropDuplicates(["query_id"]).select(F.explode(F.array(*map(F.lit, sorted(set(names))))).alias("name"), "query_id", unit(F.col("embedding")).alias("q"))
        dims = self.index().where(F.col("name").isin(*names)).agg(F.max("dims")).first()[0]
        scores = blocks.met(q, corpus, k=k, by=("name",), size=blocks.sized(dims or 0))
        return ranked(scores, k, ("name", "query_id")).select("name", "query_id", "rank", "doc_id", "score")

    def look_up(self, name: str, ids: DataFrame) -> DataFrame:
        """doc_id, embedding of the ids (column doc_id) that a corpus has, from their buckets alone."""
        asked = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("bucket", _bucket("doc_id"))
        version = self.index().where(F.col("name") == name).first()
        if version is None:
            raise ValueError(f"unknown corpora: {name}")
        rows = self._vectors().where((F.col("name") == name) & (F.col("version") == version["version"]))
        return rows.join(asked, ["bucket", "doc_id"]).select("doc_id", "embedding")
