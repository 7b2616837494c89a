"""All tables or none; and requests to a language model that are not asked twice."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from threadloom.plans import config, language_model
from threadloom.sources import sinks

KEYS = {"a": ("k",), "b": ("k", "l")}


def test_versions(spark, tmp_path):
    """A run that stops between tables, or has a repeated or null key, leaves the old set readable."""
    path = f"file://{tmp_path}/db"
    one = spark.createDataFrame([(1, "x"), (2, None)], "k long, l string")
    with pytest.raises(FileNotFoundError):
        sinks.read_database(spark, path)
    sinks.write_database({"a": one, "b": one.where("l is not null")}, path, KEYS)
    broken = spark.range(1).select(F.raise_error(F.lit("stopped")).cast("long").alias("k"), F.lit("y").alias("l"))
    for tables, error in (({"a": one.limit(1), "b": broken}, "stopped"), ({"a": one.union(one)}, "repeated keys"), ({"a": one, "b": one}, "null or repeated")):
        with pytest.raises(Exception, match=error):
            sinks.write_database(tables, path, KEYS)
        got = sinks.read_database(spark, path)
        assert set(got) == {"a", "b"} and got["a"].count() == 2 and got["b"].count() == 1
    for n in (3, 4, 5):
        sinks.write_database({"a": spark.range(n).withColumnRenamed("id", "k")}, path, KEYS)
        assert sinks.read_database(spark, path)["a"].count() == n
    assert len(sinks._manifests(path)) == 2
    said = json.loads((tmp_path / "db" / sinks._manifests(path)[-1]).read_text())
    assert said["tables"]["a"]["key"] == ["k"] and said["tables"]["a"]["columns"] == ["k bigint"]


@pytest.fixture
def service():
    """Answers ``limit`` requests and fails the rest."""
    state = {"asked": [], "limit": 3}

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            if len(state["asked"]) >= state["limit"]:
                return self.send_error(500)
            state["asked"].append(prompt)
            self.send_response(200)
            self.end_headers()
            answer = {"category": prompt[-2:], "topics": [], "keywords": [{"keyword": "K", "score": 0.5}, "plain", {"keyword": " "}], "label": "l"}
            self.wfile.write(json.dumps({"response": json.dumps(answer)}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()


def test_ledger(spark, service, tmp_path):
    """A task that dies half-way, then a service that gives up: what was answered is never asked again."""
    c = config.profile("heuristic", use_ollama=True, ollama_url=service["url"])
    texts = spark.createDataFrame([(f"c{i}", f"a long text {i:02d}") for i in range(8)], "conversation_id string, corpus string").coalesce(1)
    told = language_model.analyzer(c, at_once=1, ledger=f"file://{tmp_path}/ledger")(texts)
    with pytest.raises(Exception, match="dead"):
        told.select(F.when(F.col("conversation_id") == "c5", F.raise_error(F.lit("dead"))).otherwise("x")).collect()
    assert len(service["asked"]) == 3
    service["limit"] = 6
    assert sum(r.category is not None for r in told.collect()) == 6
    service["limit"] = 100
    rows = {r.conversation_id: r for r in told.collect()}
    assert [rows[f"c{i}"].category for i in range(8)] == [f"{i:02d}" for i in range(8)] and len(service["asked"]) == len(set(service["asked"])) == 8
    assert rows["c1"].topics == [] and [tuple(k) for k in rows["c1"].keywords] == [("K", 0.5), ("plain", 0.0)]
    # Whole texts are sent.
    long = spark.createDataFrame([("x", "word " * 10_000 + "99")], "conversation_id string, corpus string")
    assert language_model.analyzer(c)(long).first().category == "99" and len(service["asked"][-1]) > 50_000


def test_labeler_request(spark, service):
    c = config.profile("heuristic", use_ollama=True, ollama_url=service["url"])
    records = spark.createDataFrame([("cluster:0001", "old", "s", ["k1", "k2"])], "cluster string, label string, summary string, keywords array<string>")
    members = spark.createDataFrame([("cluster:0001", f"c{i}", f"Title {9 - i // 2}", ["X", "x", "Y"][i % 3], None if i % 2 else f"sum {i}") for i in range(20)], "cluster string, conversation_id string, title string, category string, summary string")
    out = language_model.labeler(c)(records, members).first()
    asked = json.loads(service["asked"][0].split("\n\n", 1)[1])
    assert out.label == "l" and out.summary == "s" and asked["keywords"] == ["k1", "k2"] and asked["categories"] == ["X", "Y"]
    assert len(asked["titles"]) == 6 and asked["titles"][0] == "Title 9" and len(asked["summaries"]) == 4


def test_spoken(spark):
    m = spark.createDataFrame([("c", "1", "user", "hello"), ("c", "2", None, " "), ("c", "3", "assistant", "you"), ("d", "1", "user", None)], "conversation_id string, node_id string, role string, text string")
    path = spark.createDataFrame([("c", 0, "1"), ("c", 1, "2"), ("c", 2, "3"), ("d", 0, "1")], "conversation_id string, pos int, node_id string")
    assert [tuple(r) for r in language_model.spoken(m, path).collect()] == [("c", "[user] hello\n\n[assistant] you")]
