import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.operators import encoders, spans
from loomspan.operators.chat import ChatService
from loomspan.operators.lexicon import GENERIC
from loomspan.sources import files
from loomspan.streaming.incremental import document_stream, extract_stream


def test_text_files(spark, tmp_path):
    (tmp_path / "a.b.txt").write_bytes("né 12\r\nx\ry".encode())
    (tmp_path / "latin.txt").write_bytes("né".encode("latin-1"))
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "skip.md").write_text("no")
    docs = files.text_files(spark, str(tmp_path))
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {"a.b", "latin", "blank"} and got["a.b"].text == "né 12\nx\ny" and got["latin"].text == "né" and got["a.b"].file_size == 9
    assert {r.doc_id for r in files.nonblank(docs).collect()} == {"a.b", "latin"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.text_files(spark, str(tmp_path / "none")).collect()


def test_tolerant_json(spark, tmp_path):
    p = tmp_path / "qa.jsonl"
    rows = [json.dumps({"id": "1", "question": "q", "context": "c", "answers": {"text": ["c"], "answer_start": [0]}}), "", "{broken", json.dumps({"question": "q", "context": ""}), json.dumps({"question": "q", "context": "d"})]
    p.write_text("\n".join(rows))
    got = files.qa_rows(spark, str(p)).orderBy("context").collect()
    assert [(r.id, r.context, r.doc_id) for r in got] == [("1", "c", ""), ("", "d", "")]


def test_command_line_and_resume(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for i in range(4):
        (corpus / f"p{i}.txt").write_text(f"This systematic review included {i + 3} studies from Kenya. " * 60)
    out = str(tmp_path / "out")
    assert cli.main(["extract", "--corpus", str(corpus), "--out", out]) == 0
    first = files.extraction_rows(spark, out)
    assert first.count() == 4 and first.select(F.max(F.length("text"))).first()[0] == 2003
    assert all(s.label for r in first.collect() for s in r.spans)
    cli.main(["extract", "--corpus", str(corpus), "--out", out, "--resume"])
    assert files.extraction_rows(spark, out).count() == 4
    made = str(tmp_path / "qa")
    cli.main(["qa", "--ner", out, "--output", made])
    rows = spark.read.json(made)
    assert rows.count() == 12 and {r.split for r in rows.collect()} == {"train", "validation", "test"}
    assert cli.main(["validate", made]) == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"Word{i} the cat saw {i} stations. End.") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), docs.schema, files_per_batch=1)
    extract_stream(stream, GENERIC, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r.doc_id, r.start, r.end, r.label) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(spans.resolved(spans.matches(docs, GENERIC)))


def test_split_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "dev": ["c"], "test": ["d"]}))
    assert sorted(map(tuple, files.flattened_splits(spark, str(tmp_path / "s.json")).collect())) == [("dev", "c"), ("test", "d"), ("train", "a"), ("train", "b")]


class _Chat(BaseHTTPRequestHandler):
    """Lists one model, fails the first question, and then names a word of each text, a trivial one and one that isn't there."""

    questions = 0

    def _say(self, value, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(value).encode())

    def do_GET(self):
        self._say({"models": [{"name": "tiny:1"}]})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).questions += 1
        if type(self).questions == 1:
            self._say({}, 500)
            return
        word = asked["messages"][1]["content"].split()[0]
        named = [{"text": word.upper(), "label": "country"}, {"text": "the", "label": "COUNTRY"}, {"text": "nowhere", "label": "COUNTRY"}, {"text": word, "label": "NO_LABEL"}]
        self._say({"message": {"content": "Here: " + json.dumps({"entities": named})}})

    def log_message(self, *args):
        pass


@pytest.fixture()
def chat():
    _Chat.questions = 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_extraction_with_a_chat_model(spark, tmp_path, chat):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for i in range(3):
        (corpus / f"p{i}.txt").write_text(f"Place{i} had rotavirus cases.")
    out = str(tmp_path / "out")
    given = ["extract", "--corpus", str(corpus), "--out", out, "--llm", chat, "--model", "tiny:1", "--wait", "0", "--resume"]
    assert cli.main(given) == 0
    rows = files.extraction_rows(spark, out).collect()
    assert len(rows) == 3 and _Chat.questions == 4
    for r in rows:
        assert ("COUNTRY", 0, 6) in {(s.label, s.start, s.end) for s in r.spans} and r.stats.llm_entities == 1 and r.stats.rule_based_entities > 0
    summary = spark.read.json(f"{out}-summary/json").first()
    assert (summary.command, summary.documents, summary.failed, summary.success_percentage) == ("extract", 3, 0, 100.0)
    assert json.loads(summary.settings)["model"] == "tiny:1"
    cli.main(given)
    assert _Chat.questions == 4 and files.extraction_rows(spark, out).count() == 3


def test_without_the_model_rules_remain(spark, tmp_path, chat, capsys):
    assert not ChatService(chat, "tiny", ()).healthy() and not ChatService("http://127.0.0.1:9", "tiny:1", (), timeout=1).healthy()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("Kenya had rotavirus cases.")
    cli.main(["extract", "--corpus", str(tmp_path / "c"), "--out", str(tmp_path / "out"), "--llm", chat, "--model", "other"])
    assert "rules only" in capsys.readouterr().err and _Chat.questions == 0
    assert files.extraction_rows(spark, str(tmp_path / "out")).first().stats.llm_entities == 0


def test_report_command(spark, tmp_path):
    rows = [{"model": m, "mean_similarity": s, "inference_time_ms": t, "model_size_mb": 10.0, "params": 2_000_000} for m, s, t in (("a", 0.5, 3.0), ("b", 0.7, 1.0))]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = str(tmp_path / "report")
    assert cli.main(["report", "--metrics", str(tmp_path / "m.jsonl"), "--output", out]) == 0
    assert spark.read.json(f"{out}/long/json").count() == 8
    assert {(r.model, r.params_m) for r in spark.read.json(f"{out}/efficiency/json").collect()} == {("a", 2.0), ("b", 2.0)}
    t = {r.metric: (r.a, r.b) for r in spark.read.json(f"{out}/transposed/json").collect()}
    assert t["mean_similarity"] == (0.5, 0.7)
    page = "".join(r.value for r in spark.read.text(f"{out}/page").collect())
    assert page.count("<table>") == 6
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(Exception):  # noqa: B017  no metrics, no report
        cli.main(["report", "--metrics", str(tmp_path / "none.jsonl"), "--output", out])


def test_saved_models(spark, tmp_path):
    for name, file in (("one", "pytorch_model.bin"), ("two", "pytorch_model.bin"), ("three", "other.bin")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_bytes(b"x")
    assert sorted(r.model for r in encoders.saved_models(spark, str(tmp_path)).collect()) == ["one", "two"]
