"""Comparison tables of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import written


def long_form(metrics: DataFrame, columns: list[str], key: str = "model") -> DataFrame:
    """key, metric, value."""
    return metrics.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "metric", "value")


def normalised(metrics: DataFrame, columns: list[str], key: str = "model") -> DataFrame:
    """key, metric, value scaled to 0..1 within each metric; 0.5 where all values are alike."""
    w = W.partitionBy("metric")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return long_form(metrics, columns, key).withColumns({"low": low, "high": high}).select(key, "metric", F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5).alias("value"))


def efficiency_table(metrics: DataFrame) -> DataFrame:
    """model, time, size, parameters in millions, mean similarity."""
    return metrics.select("model", "inference_time_ms", "model_size_mb", (F.col("params") / 1e6).alias("params_m"), "mean_similarity")


def mean_deviation(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean and sample deviation over models, and both as one text with four places."""
    each = long_form(metrics, columns).groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("deviation"))
    return each.withColumn("shown", F.format_string("%.4f ± %.4f", "mean", "deviation"))


def similarity_table(scores: DataFrame, key: str = "model") -> DataFrame:
    """key, n, mean and population deviation of the scores of each model, and both as one text with four places. scores: key, score."""
    each = scores.groupBy(key).agg(F.count("score").alias("n"), F.avg("score").alias("mean_similarity"), F.stddev_pop("score").alias("std_similarity"))
    return each.withColumn("shown", F.format_string("%.4f ± %.4f", "mean_similarity", "std_similarity"))


def time_similarity(metrics: DataFrame) -> DataFrame:
    """model, inference_time_ms, mean_similarity, fastest first: the points of a scatter chart."""
    return metrics.select("model", "inference_time_ms", "mean_similarity").orderBy("inference_time_ms", "model")


def transposed(metrics: DataFrame, columns: list[str], key: str = "model") -> DataFrame:
    """A row for each metric and a column for each model. A table without models raises.

    The metrics are written first: the models' names are collected before the rows are pivoted, and what they come from would run twice.
    """
    metrics = written(metrics.select(key, *columns), "metrics")
    models = [r[0] for r in metrics.select(key).distinct().orderBy(key).collect()]  # as many as models compared
    if not models:
        raise ValueError("no results to report")
    return long_form(metrics, columns, key).groupBy("metric").pivot(key, models).agg(F.first("value"))


def rounded(metrics: DataFrame, two: tuple[str, ...] = ("model_size_mb", "inference_time_ms")) -> DataFrame:
    """Doubles rounded to four places; sizes and times to two."""
    return metrics.select(*[F.round(c, 2 if c in two else 4).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])


#: Rows of a table that a page can show.
PAGE_ROWS = 1000


def chart_page(tables: dict[str, DataFrame]) -> str:
    """An HTML page with a table for each name; tables are report tables, one row for each model and metric.

    A table of more than PAGE_ROWS rows is an error; write_report writes whole tables.
    """
    from html import escape

    parts = []
    for name, df in tables.items():
        rows = df.limit(PAGE_ROWS + 1).collect()
        if len(rows) > PAGE_ROWS:
            raise ValueError(f"table {name} has more than {PAGE_ROWS} rows")
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "<!doctype html><meta charset='utf-8'><title>Model comparison</title>" + "".join(parts)
