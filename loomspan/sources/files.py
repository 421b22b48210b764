"""Readers and writers: text files, JSON lines, datasets by split, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import preview, strip
from ..schemas import EXTRACTION, QA
from ..staging import written


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """doc_id (file stem), text, filepath, file_size, hash of the files of a folder, not of its subfolders.

    Valid UTF-8 is read as such and anything else as Latin-1; line ends become \\n. A missing folder raises.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    out = raw.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), F.regexp_replace(text, "\r\n?", "\n").alias("text"), F.col("path").alias("filepath"), F.md5("content").alias("hash"))
    return out.select("doc_id", "text", "filepath", F.length("text").alias("file_size"), "hash")


def nonblank(docs: DataFrame) -> DataFrame:
    return docs.where(F.length(strip(F.col("text"))) > 0)


def pending(docs: DataFrame, done: DataFrame, by: str = "doc_id") -> DataFrame:
    """Documents whose key isn't among those done; `by` may also be the hash of the contents."""
    return docs.join(done.select(by).distinct(), by, "left_anti")


def first_files(docs: DataFrame, n: int = 3, order: str = "filepath") -> DataFrame:
    return docs.orderBy(order).limit(n)


def extraction_rows(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records from JSON lines; blank and malformed lines are left out, missing fields are null."""
    return spark.read.schema(EXTRACTION).option("mode", "DROPMALFORMED").json(path)


def processed_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string").option("mode", "DROPMALFORMED").json(path).where("doc_id is not null").distinct()


def qa_rows(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Question-answer rows with a question and a context; missing texts count as empty. A missing file raises."""
    rows = spark.read.schema(QA).option("mode", "DROPMALFORMED").json(path)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("id", "question", "context", "doc_id")}).where((F.col("question") != "") & (F.col("context") != ""))
    return rows.limit(most) if most is not None else rows


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def unprocessed(docs: DataFrame, path: str) -> DataFrame:
    """Documents that the output at path doesn't have; all of them where there is no output yet.

    The ids that are left are told without texts and written. Where most is done
    they are few, and texts aren't dealt out to be compared with them.
    """
    spark = docs.sparkSession
    if not _there(spark, path):
        return docs
    left = written(pending(docs.select("doc_id"), processed_ids(spark, path)), "pending").distinct().withColumnRenamed("doc_id", "left__")
    return docs.join(left, F.col("doc_id").eqNullSafe(F.col("left__")), "left_semi")


def append_extractions(records: DataFrame, path: str, *, resume: bool = True, compression: str | None = None) -> dict:
    """Append records as JSON lines, texts cut to a preview. With resume, documents that the output already has are skipped, so a rerun adds nothing; where the documents were given to unprocessed() before, that is done. compression: of the files, for example gzip.

    What was written is counted in passing: documents, characters, and entities in all and by source.
    """
    out = records.withColumn("text", preview(F.col("text")))
    if resume and _there(out.sparkSession, path):
        out = pending(out.withColumn("doc_id", F.col("doc_id").cast("string")), processed_ids(out.sparkSession, path))
    seen = Observation("extractions")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = [F.count("*").alias("documents"), total("metadata.file_size").alias("characters"), *[total(f"stats.{c}").alias(c) for c in ("total_entities", "rule_based_entities", "llm_entities")]]
    out.observe(seen, *counts).write.mode("append").json(path, compression=compression)
    return seen.get


def write_splits(rows: DataFrame, folder: str, *, compression: str | None = None) -> None:
    """A folder of JSON lines for each split, where rows of a document follow one another, since their contexts are much alike. compression: of the files, for example gzip."""
    near = [c for c in ("doc_id",) if c in rows.columns]
    rows.sortWithinPartitions("split", *near).write.mode("overwrite").partitionBy("split").json(folder, compression=compression)


def split_samples(rows: DataFrame, n: int = 100) -> DataFrame:
    """The first n rows of each split, by id."""
    w = W.partitionBy("split").orderBy("id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def write_report(table: DataFrame, folder: str) -> None:
    """A report table, of few rows, as one JSON and one CSV file."""
    table.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def flattened_splits(spark: SparkSession, path: str) -> DataFrame:
    """split, doc_id of a JSON file {split: [ids]}."""
    raw = spark.read.option("multiLine", True).json(path)
    each = F.array(*[F.struct(F.lit(c).alias("split"), F.col(c).cast("array<string>").alias("ids")) for c in raw.columns])
    return raw.select(F.explode(each).alias("x")).select("x.split", F.explode("x.ids").alias("doc_id"))
