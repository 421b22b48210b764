"""Extractions with texts about as long as a preview; pieces of a stream in many files."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import spans
from loomspan.operators.lexicon import GENERIC
from loomspan.plans import all_queries, stream_queries


def _written(spark, tmp_path, texts, files=1):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_lengths_of_previews_are_those_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    place = _written(spark, tmp_path, ["x" * n for n in (5, 2000, 2001, 2002, 2003, 2004, 5000)])
    query, sql = all_queries()["extraction_files"]
    c = duckdb.connect(config={"threads": 2})
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{place}/documents.parquet/*.parquet')")
    columns = ["doc_id", "file_size", "preview_length"]
    want = sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert sorted(tuple(r) for r in query(spark, place).select(*columns).collect()) == want


def test_a_piece_of_a_stream_is_read_and_written_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = [f"On 12 March 20{i:02d} we paid $5 and 7% to a{i}@b.org" for i in range(60)]
    place, made = _written(spark, tmp_path, texts, files=12), []
    monkeypatch.setattr(stream_queries, "folder", lambda spark, name: made.append(f"{tmp_path}/{name}") or made[-1])
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        got = stream_queries.stream_running_counts(spark, place).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = spans.running_counts(spans.matches(spark.read.parquet(f"{place}/documents.parquet"), GENERIC)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    files = spark.read.parquet(f"{made[0]}/in").select(F.input_file_name()).distinct().count()
    assert files > 4  # one for each of the four deliveries before
