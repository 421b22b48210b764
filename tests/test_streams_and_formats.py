"""Streams with state, data sources of the library's own, counters of a run, questions under way at once."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.operators import entities, qa, spans
from loomspan.operators.chat import ChatService
from loomspan.operators.lexicon import GENERIC
from loomspan.sources import files, formats
from loomspan.streaming.incremental import document_stream
from loomspan.streaming.stateful import appended, content_key, running_count_stream, unique_stream


def test_documents_that_arrive_again(spark, tmp_path):
    """Copies under another name within the delay go, also after a restart; a row older than the watermark is late."""
    schema = "name string, text string, at timestamp"
    batches = [
        [("a", "one", "2024-01-01 00:00:00"), ("b", "two", "2024-01-01 01:00:00"), ("c", "one", "2024-01-01 00:30:00")],
        [("d", "two", "2024-01-01 02:00:00"), ("e", "three", "2024-01-03 00:00:00")],
        [("f", "three", "2024-01-03 05:00:00"), ("g", "late", "2024-01-01 00:00:00"), ("h", "one", "2024-01-04 00:00:00")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "name string, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = document_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema).withColumn("content", content_key("text"))
        appended(unique_stream(stream, "at", "1 day", ["content"]), str(tmp_path / "out"), str(tmp_path / f"cp")).awaitTermination()
        if not i:
            assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "two"}
    got = sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got in (["a", "b", "e", "h"], ["b", "c", "e", "h"])


def test_running_counts_as_a_stream(spark, tmp_path):
    """In order of arrival: a late document is counted where it comes, a repeated file adds nothing."""
    docs = lambda ids: spark.createDataFrame([(i, f"Word{i} the cat, {i} stations.") for i in ids], "doc_id long, text string")
    for ids in ((3, 1, 2), (7, 5), (3, 1, 2), (4,)):
        docs(ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = document_stream(spark, str(tmp_path / "in"), docs((1,)).schema, files_per_batch=1)
        appended(running_count_stream(stream, GENERIC), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.doc_id, r.label): (r.n, r.running) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, total = {}, {}
    counts = {(r.doc_id, r.label): r.n for r in spans.label_counts(spans.matches(docs((1, 2, 3, 4, 5, 7)), GENERIC)).collect()}
    for i in (1, 2, 3, 5, 7, 4):
        for (d, label), n in counts.items():
            if d == i:
                total[label] = total.get(label, 0) + n
                want[d, label] = (n, total[label])
    assert got == want


def test_text_source(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for i in range(20):
        (folder / f"p{i:02}.txt").write_bytes(f"text né {i}\r\n".encode("latin-1" if i % 5 == 0 else "utf-8"))
    (folder / "skip.md").write_text("no")
    (folder / "sub").mkdir()
    (folder / "sub" / "deep.txt").write_text("no")
    (folder / "gone.txt").symlink_to(folder / "nowhere")
    formats.register(spark)
    read = spark.read.format("loomspan_text").option("files_per_task", 3).load(str(folder))
    assert read.rdd.getNumPartitions() == 7
    rows = {r.doc_id: r for r in read.collect()}
    bad = rows.pop("gone", None)
    assert bad is None or (bad.error and bad.text is None)
    (folder / "gone.txt").unlink()
    want = {r.doc_id: r for r in files.text_files(spark, str(folder)).collect()}
    assert {k: (r.text, r.file_size, r.hash, r.error) for k, r in rows.items()} == {k: (r.text, r.file_size, r.hash, None) for k, r in want.items()}
    with pytest.raises(Exception, match="none"):
        spark.read.format("loomspan_text").load(str(tmp_path / "none")).collect()


def test_a_file_that_cannot_be_read_is_a_row(tmp_path):
    (tmp_path / "a.txt").write_text("fine")
    source = formats._TextReader({"path": str(tmp_path)})
    rows = list(source.read(formats._Files([str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])))
    assert rows[0][:2] == ("a", "fine") and rows[0][5] is None and rows[1][:2] == ("b", None) and rows[1][5]


def test_text_source_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    formats.register(spark)
    for i in range(3):
        (folder / f"p{i}.txt").write_text(f"text {i}")
        stream = spark.readStream.format("loomspan_text").load(str(folder)).select("doc_id", "text")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(f"p{k}", f"text {k}") for k in range(i + 1)]
        time.sleep(0.02)


class _Slow(BaseHTTPRequestHandler):
    """Answers after a while; fails the first question of each text that says so; counts questions under way."""

    lock, now, most, asked, keys = threading.Lock(), 0, 0, {}, set()

    def _say(self, value, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(value).encode())

    def do_GET(self):
        page = int(self.path.rpartition("=")[2])
        type(self).keys.add(self.headers["Authorization"])
        self._say([{"n": page * 2}, {"n": page * 2 + 1}] if page != 3 else {}, 500 if page == 3 else 200)

    def do_POST(self):
        kind = type(self)
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
        with kind.lock:
            kind.now += 1
            kind.most = max(kind.most, kind.now)
            kind.asked[text] = kind.asked.get(text, 0) + 1
            first = kind.asked[text] == 1
        time.sleep(0.15)
        with kind.lock:
            kind.now -= 1
        self._say({"message": {"content": f"about {text}"}}, 500 if ("once" in text and first) or "never" in text else 200)

    def log_message(self, *args):
        pass


@pytest.fixture()
def slow():
    _Slow.now = _Slow.most = 0
    _Slow.asked, _Slow.keys = {}, set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Slow)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_questions_under_way_at_once(spark, slow):
    """Wall time falls by the bound, which holds; answers keep their rows; only failed questions are asked again."""
    texts = [f"text {i}" + (" once" if i % 8 == 0 else "") + (" never" if i == 5 else "") for i in range(32)]
    call = ChatService(slow, "m", (), key="secret")()
    began = time.monotonic()
    found = entities.answered(call, texts, attempts=2, wait=0.3, at_once=8)
    took = time.monotonic() - began
    assert [a for a, _ in found] == [None if i == 5 else f"about {t}" for i, t in enumerate(texts)] and "500" in found[5][1]
    assert _Slow.most == 8 and took < 32 * 0.15 / 2 and sum(_Slow.asked.values()) == 32 + 4 + 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[8:16])], "doc_id long, text string").coalesce(1)
    _Slow.most = 0
    got = {r.doc_id: r.answer for r in entities.asked(docs, ChatService(slow, "m", ()), wait=0.0, at_once=3).collect()}
    assert got == {i: f"about {t}" for i, t in enumerate(texts[8:16])} and _Slow.most <= 3
    assert entities.answered(call, []) == []


def test_http_source(spark, slow):
    formats.register(spark)
    read = spark.read.format("loomspan_http").option("url", slow + "/x?page={page}").option("pages", 6).option("pages_per_task", 2).option("key", "k").load()
    assert read.rdd.getNumPartitions() == 3
    rows = read.collect()
    assert sorted(json.loads(r.item)["n"] for r in rows if r.item) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]
    assert [(r.page, "500" in r.error) for r in rows if r.error] == [(3, True)] and _Slow.keys == {"Bearer k"}


def test_validate_counts_broken_lines_and_missing_fields(spark, tmp_path, capsys):
    good = {"id": "1", "question": "q", "context": "alpha", "answers": {"text": ["alpha"], "answer_start": [0]}, "metadata": {"entity_label": "DOSE"}}
    lines = [json.dumps(good), json.dumps({k: v for k, v in good.items() if k != "question"}), json.dumps({k: v for k, v in good.items() if k != "id"}), "{broken", "", " "]
    (tmp_path / "qa.jsonl").write_text("\n".join(lines))
    assert cli.main(["validate", str(tmp_path / "qa.jsonl")]) == 0
    out = capsys.readouterr().out
    assert "1 of 4 valid (25.0 %), 3 not" in out and "field question is missing" in out and "line is no JSON object" in out and "1  DOSE" in out


def test_counters_of_a_run_equal_the_aggregates(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"The cat number {i} saw Kenya and rotavirus. " * 3) for i in range(9)], "doc_id long, text string")
    records = spans.records(docs, spans.matches(docs, GENERIC))
    seen = files.append_extractions(records, str(tmp_path / "out"))
    again = files.extraction_rows(spark, str(tmp_path / "out")).agg(F.count("*"), F.sum("metadata.file_size"), F.sum("stats.total_entities"), F.sum("stats.rule_based_entities"), F.sum("stats.llm_entities")).first()
    assert tuple(seen[k] for k in ("documents", "characters", "total_entities", "rule_based_entities", "llm_entities")) == tuple(again)
    assert files.append_extractions(records, str(tmp_path / "out"))["documents"] == 0
    made = qa.split(qa.pairs(docs, spans.resolved(spans.matches(docs, GENERIC)), qa.templates(spark, ["NUMBER"])))
    watched, counts = qa.observed_statistics(made)
    watched.write.parquet(str(tmp_path / "pairs"))
    assert counts.get == qa.dataset_statistics(spark.read.parquet(str(tmp_path / "pairs"))).first().asDict()
    lines = spark.createDataFrame([(json.dumps({"id": str(i)}),) for i in range(5)] + [("[",)], "value string")
    checked = qa.issues(qa.parsed_examples(lines))
    totals, issues, labels = qa.checked_summary(checked)
    assert totals == qa.validation_report(checked).first().asDict() and issues == [tuple(r) for r in qa.issue_histogram(checked).collect()] and labels == []


def _loaded():
    return lambda texts: [[float(len(t)), float(t.count("a")) + 1.0] for t in texts]


def test_training_and_evaluation_commands(spark, tmp_path):
    rows = [{"id": f"q{i}", "doc_id": f"d{i % 4}", "question": f"what is alpha {i}", "context": f"alpha {i} is here"} for i in range(8)]
    (tmp_path / "qa.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = str(tmp_path / "training")
    assert cli.main(["training", "--dataset", str(tmp_path / "qa.jsonl"), "--output", out, "--epochs", "20"]) == 0
    assert spark.read.parquet(f"{out}/pairs").count() == 8 and spark.read.parquet(f"{out}/queries").count() == 8 and spark.read.parquet(f"{out}/corpus").count() == 4
    config = spark.read.json(f"{out}/config/json").first()
    assert (config.epochs, config.num_pairs, config.warmup_steps, config.learning_rate) == (20, 8, 2, 2e-5)
    for encoder in ([], ["--encoder", f"{__name__}:_loaded"]):
        made = str(tmp_path / f"metrics{len(encoder)}")
        assert cli.main(["evaluate", "--dataset", str(tmp_path / "qa.jsonl"), "--output", made, "--model", "m", *encoder]) == 0
        r = spark.read.json(f"{made}/json").first()
        assert r.model == "m" and 0 < r.mrr <= 1 and r.median_similarity <= r.max_similarity and r.recall_at_10 == 1.0
