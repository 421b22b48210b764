"""Command line: extract spans, make or validate a question-answer dataset, prepare training, evaluate an encoder, report on models."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import encoders, entities, evaluation, lexicon, qa, report, retrieval, spans, training
from .operators.chat import ChatService
from .sources import files
from .staging import written


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="spans of a folder of text files as JSON lines")
    e.add_argument("--corpus", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--resume", action="store_true")
    e.add_argument("--test", action="store_true", help="only the first three files")
    e.add_argument("--llm", metavar="URL", help="also ask the chat model served there")
    e.add_argument("--model", default="llama3.1:8b")
    e.add_argument("--wait", type=float, default=1.0, help="seconds before a failed question is asked again")
    e.add_argument("--key", help="sent to the service as a bearer token")
    e.add_argument("--timeout", type=float, default=60.0, help="seconds that an answer may take")
    e.add_argument("--temperature", type=float, default=0.1)
    e.add_argument("--tokens", type=int, default=2048, help="most tokens of an answer")
    e.add_argument("--at-once", type=int, default=8, help="questions that each task has under way")
    g = sub.add_parser("qa", help="question-answer dataset from extractions")
    g.add_argument("--ner", required=True)
    g.add_argument("--output", required=True)
    for name, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        g.add_argument(f"--{name}-split", type=float, default=share)
    g.add_argument("--seed", type=int, default=42)
    v = sub.add_parser("validate", help="check a question-answer dataset")
    v.add_argument("file")
    t = sub.add_parser("training", help="training pairs, judgements and settings from a question-answer dataset")
    t.add_argument("--dataset", required=True)
    t.add_argument("--output", required=True)
    for name, value in asdict(training.TrainingConfig()).items():
        t.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    x = sub.add_parser("evaluate", help="metrics of an encoder over a question-answer dataset")
    x.add_argument("--dataset", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--model", default="hashed-words")
    x.add_argument("--encoder", metavar="MODULE:NAME", help="what loads a function from texts to vectors; without it words are counted by hash")
    x.add_argument("--k", type=int, default=10)
    r = sub.add_parser("report", help="comparison tables and a page from JSON lines of metrics by model")
    r.add_argument("--metrics", required=True)
    r.add_argument("--output", required=True)
    return p


def _asked(docs: DataFrame, args: argparse.Namespace) -> tuple[DataFrame, dict] | None:
    """Answers of the chat model, written out, so that it is asked once, and how many failed; none where it can't be reached."""
    if not args.llm:
        return None
    service = ChatService(args.llm, args.model, tuple(e.label for e in lexicon.study_lexicon()), timeout=args.timeout, temperature=args.temperature, tokens=args.tokens, key=args.key)
    if not service.healthy():
        print(f"no model {args.model} at {args.llm}: rules only", file=sys.stderr)
        return None
    answers, seen = entities.observed_rate(entities.asked(docs, service, wait=args.wait, at_once=args.at_once))
    return written(answers, "answers"), seen.get


def _summary(spark: SparkSession, args: argparse.Namespace, counts: dict) -> DataFrame:
    """One row: settings of the run, without its key, and what was counted while it wrote."""
    settings = json.dumps({k: v for k, v in vars(args).items() if k not in ("command", "key")}, sort_keys=True)
    columns = [F.lit(v).alias(k) for k, v in counts.items()]
    return spark.range(1).select(F.lit(args.command).alias("command"), F.lit(settings).alias("settings"), *columns)


def _evaluated(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """One row of metrics, as `report` reads them: similarity of question and context, and ranking of all contexts for each question."""
    rows = written(files.qa_rows(spark, args.dataset).select("id", "doc_id", "question", "context"), "examples")
    if args.encoder:
        module, _, name = args.encoder.partition(":")
        encode = lambda df, c: encoders.encoded(df, getattr(importlib.import_module(module), name), column=c)
    else:
        encode = lambda df, c: df.withColumn("embedding", encoders.hashed_words(F.col(c), 256))
    began = time.perf_counter()
    questions = written(encode(rows.select("id", "question", "context"), "question").select("id", "context", "embedding"), "questions")
    texts = rows.select("context").distinct().withColumn("doc_id", F.sha2("context", 256))
    contexts = written(encode(texts, "context").select("doc_id", "context", "embedding"), "contexts")
    took = (time.perf_counter() - began) * 1000
    own = questions.join(contexts.withColumnRenamed("embedding", "b"), "context")
    similar = evaluation.similarity_statistics(retrieval.similarity(own.withColumnRenamed("embedding", "a")).select("score"))
    queries = questions.select(F.col("id").alias("query_id"), "embedding")
    found = retrieval.retrieve(queries, contexts.select("doc_id", "embedding"), args.k)
    metrics = evaluation.evaluated(found, own.select(F.col("id").alias("query_id"), "doc_id"), args.k)
    n = rows.count() + contexts.count()
    return similar.join(metrics, F.lit(True)).select(F.lit(args.model).alias("model"), "*", F.lit(took / max(1, n)).alias("inference_time_ms"))  # one row each


def _reported(metrics: DataFrame, output: str) -> None:
    """Each comparison table as JSON and CSV files, and all on one page."""
    numbers = [c for c, t in metrics.dtypes if c != "model" and t in ("double", "bigint")]
    tables = {
        "long": report.long_form(metrics, numbers),
        "normalised": report.normalised(metrics, numbers),
        "mean_deviation": report.mean_deviation(metrics, numbers),
        "transposed": report.transposed(metrics, numbers),
    }
    if {"inference_time_ms", "model_size_mb", "params", "mean_similarity"} <= set(metrics.columns):
        tables["efficiency"] = report.rounded(report.efficiency_table(metrics))
        tables["time_similarity"] = report.time_similarity(metrics)
    for name, table in tables.items():
        files.write_report(table, f"{output.rstrip('/')}/{name}")
    page = metrics.sparkSession.createDataFrame([(report.chart_page(tables),)], "value string")
    page.coalesce(1).write.mode("overwrite").text(f"{output.rstrip('/')}/page")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomspan").getOrCreate()
    if args.command == "extract":
        docs = files.nonblank(files.text_files(spark, args.corpus))
        if args.test:
            docs = files.first_files(docs)
        if args.resume:
            docs = files.unprocessed(docs, args.out)
        found = spans.matches(docs, lexicon.study_lexicon())
        asked = _asked(docs, args)
        labels = spark.createDataFrame([(x.label,) for x in lexicon.study_lexicon()], "label string")
        other = written(entities.named(asked[0], docs, labels), "named") if asked else None
        counts = files.append_extractions(spans.records(docs, found, other), args.out, resume=args.resume)
        rate = asked[1] if asked else {"failed": 0, "success_percentage": 100.0 if counts["documents"] else 0.0}
        files.write_report(_summary(spark, args, rate | counts), f"{args.out.rstrip('/')}-summary")
    elif args.command == "qa":
        records = files.extraction_rows(spark, args.ner)
        keys = records.select("doc_id").distinct()
        numbered = qa.global_number(keys.withColumn("h", F.conv(F.substring(F.md5("doc_id"), 1, 7), 16, 10).cast("long")), ["h", "doc_id"], "h")
        rows = records.join(numbered.select("doc_id", F.col("number").alias("no")), "doc_id").dropDuplicates(["doc_id"])
        flat = rows.select("no", F.explode("spans").alias("s")).select("no", "s.label", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.text")
        t = qa.templates(spark, [x.label for x in lexicon.study_lexicon()])
        made = qa.pairs(rows.select("no", "text"), flat, t, seed=args.seed, key="no").join(rows.select("no", "doc_id"), "no").drop("no")
        out = qa.split(made, train=args.train_split, validation=args.val_split, test=args.test_split, seed=args.seed)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out = out.withColumn("answers", F.struct(F.col("answers.text").alias("text"), F.col("answers.start").alias("answer_start"))).withColumn("metadata", F.struct(F.col("label").alias("entity_label"), F.size("answers.text").alias("num_answers"), now.alias("generation_date"))).drop("label")
        watched, seen = qa.observed_statistics(out)
        files.write_splits(watched.drop("begins"), args.output)
        files.write_report(_summary(spark, args, seen.get), f"{args.output.rstrip('/')}-statistics")
    elif args.command == "report":
        _reported(spark.read.json(args.metrics), args.output)
    elif args.command == "training":
        given = training.TrainingConfig(**{k: getattr(args, k) for k in asdict(training.TrainingConfig())})
        tables = training.prepared_tables(written(files.qa_rows(spark, args.dataset), "examples"), given.seed)
        seen = Observation("pairs")
        tables["pairs"] = tables["pairs"].observe(seen, F.count("*").alias("n"))
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{args.output.rstrip('/')}/{name}")
        files.write_report(_summary(spark, args, given.settings(seen.get["n"])), f"{args.output.rstrip('/')}/config")
    elif args.command == "evaluate":
        files.write_report(_evaluated(spark, args), args.output)
    else:
        lines = spark.read.text(args.file).where(F.trim("value") != "")
        totals, issues, labels = qa.checked_summary(qa.issues(qa.parsed_examples(lines)))
        print(f"{totals['valid']} of {totals['total']} valid ({totals['valid_percentage'] or 0:.1f} %), {totals['invalid']} not")
        for title, counted in (("issues", issues), ("labels of valid rows", labels)):
            print(f"{title}:", *[f"  {n:>8}  {value}" for value, n in counted], sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
