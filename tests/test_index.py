"""The index and everything built on it, against plain Python on small messages, and the outputs read back."""

import json
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import categories, classifier, forest, graph, reports, similarity, store, topics, wordpiece
from threadloom.operators import catalog as K
from threadloom.plans import config, index, main
from threadloom.sources import sinks, tables

SMALL = "/root/testdata/sf0.001"
NODE = "row_idx long, conversation_id string, node_id string, parent_node_id string, create_time double, role string, text string, aggregate_code string, execution_output string, title string, current_node string, conversation_time double, source_file string, content_type string, attachments_json string"


@pytest.fixture(scope="module")
def messages(spark):
    talk = {
        "a": ("Parser bug", "Fix the azure parser bug in the azure cloud pipeline"),
        "b": ("Parser work", "Fix the azure parser bug in the azure cloud pipeline today"),
        "c": (None, "Grafana dashboards with loki traces and tempo metrics"),
        "d": ("Empty", None),
    }
    rows = []
    for k, (c, (title, text)) in enumerate(talk.items()):
        rows += [
            (4 * k, c, f"{c}1", None, 1.0 + k, "user", text, None, None, title, f"{c}3" if c == "a" else None, 1700000000.0 + k, "f.json", "text", None),
            (4 * k + 1, c, f"{c}2", f"{c}1", 2.0 + k, None, None, None, None, "later title", None, None, None, None, None),
            (4 * k + 2, c, f"{c}3", f"{c}2", 3.0 + k, "assistant", "Done.  \n", "print(1)", "1", None, None, None, None, "text", '["f.png"]'),
            (4 * k + 3, c, f"{c}4", f"{c}2", 4.0 + k, "assistant", "😀" * 41, None, None, None, None, None, None, None, None),
        ]
    return spark.createDataFrame(rows, NODE)


def predictor(corpora):
    """A stand-in for the classifier: Security first, then the baseline's own category for conversation a."""
    first = corpora.select("conversation_id", F.lit(1).alias("pos"), F.lit("Security").alias("category"), F.lit(0.5).alias("score"))
    return first.unionByName(corpora.select("conversation_id", F.lit(2).alias("pos"), F.lit("Infrastructure/Cloud").alias("category"), F.lit(0.3).alias("score")))


@pytest.fixture(scope="module")
def built(messages):
    return index.build(messages, config.profile("hybrid"), index.Providers(predictor=predictor))


def test_hidden_nodes(spark, messages):
    """A node without role, text, code and output holds the path together and is not in it."""
    paths = defaultdict(list)
    for r in forest.leaf_paths(messages).where("conversation_id = 'a'").orderBy("branch", "pos").collect():
        paths[r.branch].append((r.pos, r.node_id))
    assert paths == {1: [(0, "a1"), (1, "a3")], 2: [(0, "a1"), (1, "a4")]}
    current = spark.createDataFrame([("a", "a2"), ("b", "none")], "conversation_id string, current_node string")
    got = defaultdict(list)
    for r in forest.current_path(messages, current).orderBy("conversation_id", "pos").collect():
        got[r.conversation_id].append(r.node_id)
    assert got["a"] == ["a1"] and got["b"] == ["b1", "b4"] and got["d"] == ["d1", "d4"]
    with pytest.raises(ValueError, match="duplicate"):
        forest.checked(messages.union(messages.limit(1)))


def test_attributes(messages):
    a = {r.conversation_id: r for r in forest.attributes(messages).collect()}
    assert a["a"].title == "Parser bug" and a["c"].title == "(untitled)" and a["a"].current_node == "a3" and a["b"].source_file == "f.json"
    assert [r.conversation_id for r in forest.conversations(messages).orderBy("conv_idx").collect()] == ["a", "b", "c", "d"]


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = store.ranked(df, [F.col("x").desc()], "n").collect()
    assert all(r.n == 1000 - r.x for r in got) and len(got) == 1000


def test_shared_folder(spark, monkeypatch):
    """Tables are deleted on release; on a cluster without a shared folder nothing is written."""
    import os

    monkeypatch.setattr(store, "_WRITTEN", [])
    got = store.kept(spark.range(3))
    path = store._WRITTEN[0].removeprefix("file://").removeprefix("file:")
    assert got.count() == 3 and os.path.isdir(path)
    store.release(spark)
    assert not os.path.exists(path) and store._WRITTEN == []

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint"):
        store.folder(Cluster)


def test_code_units(spark):
    s = "a😀b" * 40
    r = spark.createDataFrame([(s,)], "s string").select(X.units(F.col("s")).alias("u"), X.preview(F.col("s")).alias("p"), X.fnv1a(F.col("s")).alias("h"), X.chunks(F.col("s"), 50).alias("c")).first()
    h = 2166136261
    for i in range(0, len(s.encode("utf-16-le")), 2):
        h = ((h ^ int.from_bytes(s.encode("utf-16-le")[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    length = lambda t: len(t.encode("utf-16-le")) // 2
    assert r.u == 160 and r.p == "a😀b" * 20 + "..." and r.h == h and "".join(r.c) == s and all(length(c) in (49, 50) for c in r.c[:-1])


@pytest.mark.parametrize(
    "term, want",
    [("event_log", "Event Log"), ("asp.net", "Asp.Net"), ("v2beta", "V2beta"), ("2nd", "2Nd"), ("it's", "It's"), ("ALL-CAPS word", "ALL CAPS Word"), ("mIXED", "Mixed"), (" ", "")],
)
def test_humanized(spark, term, want):
    assert spark.createDataFrame([(term,)], "t string").select(X.humanized(F.col("t"))).first()[0] == want


def test_scalars(spark):
    d = spark.createDataFrame([(0.12345, 1e15, "a b/c?", "12.5", "T", "x"), (2.0, None, "é", " ", None, "y"), (0.9996, 1700000000.5, "", "-3", "(untitled)", "z")], "n double, t double, s string, v string, title string, id string")
    rows = d.select(X.short_number(F.col("n")), X.unix_text(F.col("t")), X.href(F.col("s")), tables.number_or_zero(F.col("v")), X.safe_name(F.col("title"), F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [("0.123", "1.0E15", "a%20b%2Fc%3F", 12.5, "T__x"), ("2", "(null)", "%C3%A9", 0.0, "y"), ("1", "2023-11-14 22:13:20Z", "", -3.0, "(untitled)__z")]


def test_facets_and_edges(built):
    f = {r.conversation_id: (r.category, r.secondary) for r in built["facets"].collect()}
    # The baseline's category opens the order, so where the model names it too, it is selected.
    assert f["a"] == ("Infrastructure/Cloud", "Security") and f["c"] == ("Security", "Observability/Telemetry")
    e = Counter((r.edge_type, r.from_id, r.to_id, r.weight) for r in built["edges"].collect())
    assert e["has_category", "a", "cat:Infrastructure/Cloud", 1.0] == 1 and e["has_secondary_category", "a", "cat:Security", 0.5] == 1
    assert e["has_secondary_category", "c", "cat:Observability/Telemetry", 0.75] == e["has_tertiary_category", "c", "cat:Infrastructure/Cloud", 0.3] == 1 and e["reply", "a2", "a3", 1.0] == 1
    kinds = Counter(k for k, *_ in e)
    assert kinds["belongs_to_cluster"] == kinds["has_topic_label"] == 4 and kinds["similar_to"] == 1 and kinds["reply"] == 12
    assert {"cluster_category", "cluster_keyword", "belongs_to_category_community", "community_category", "community_keyword", "has_topic", "category_parent"} <= set(kinds)
    assert not graph.without_replaced(built["edges"]).where("edge_type = 'has_topic'").count() and graph.similar_only(built["edges"]).count() == 1
    nodes = {r.id: (r.label, r.kind) for r in built["nodes"].collect()}
    assert nodes["a"] == ("Parser bug", "conversation") and nodes["a4"] == ("😀" * 40 + "...", "assistant") and nodes["a2"] == ("", "message") and nodes["cat:Security"] == ("Security", "category")
    assert {"keyword", "topic", "topic_label", "topic_cluster", "category_community"} <= {k for _, k in nodes.values()}


def test_topics(built):
    t = {r.conversation_id: r for r in built["topics"].collect()}
    a = t["a"]
    assert a.topic_label == " / ".join(" ".join(w.capitalize() for w in x.split()) for x in a.topics[:3]) and len(a.topics) <= 8
    words = [set(x.split()) for x in a.topics]
    assert not any(i != j and (x <= y) for i, x in enumerate(words) for j, y in enumerate(words))


def plain_records(members, keywords, per_member, top):
    """Summed scores of the first keywords of each group's members."""
    out = {}
    for group in set(members.values()):
        total = Counter()
        for c, k in ((r.conversation_id, r) for r in keywords if r.rank < per_member):
            if members.get(c) == group:
                total[k.keyword] += round(k.score * 10000)
        out[group] = [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0].upper()))][:top]
    return out


def test_cluster_records(built):
    members = {r.conversation_id: r.cluster for r in built["cluster_members"].collect()}
    assert members == {"a": "cluster:0001", "b": "cluster:0001", "c": "cluster:0002", "d": "cluster:0003"}
    records = {r.cluster: r for r in built["clusters"].collect()}
    want = plain_records(members, built["keywords"].collect(), 6, 8)
    assert {k: r.keywords for k, r in records.items()} == want
    one = records["cluster:0001"]
    assert one.ids == ["a", "b"] and one.category == "Infrastructure/Cloud" and one.summary == "Infrastructure/Cloud: " + ", ".join(one.keywords[:5])
    topic = {r.conversation_id: r.topic_label for r in built["topics"].collect()}
    assert records["cluster:0002"].label == topic["c"] and one.label.count(" / ") == 2


def test_community_records(spark):
    f = spark.createDataFrame([("a", "X", "Y", None), ("b", "X", "Z", None), ("c", "Y", "X", None), ("d", "Q", None, None)], "conversation_id string, category string, secondary string, tertiary string")
    m = spark.createDataFrame([(c, "catcomm:0001") for c in "abc"] + [("d", "catcomm:0002")], "conversation_id string, community string")
    k = spark.createDataFrame([(c, i, f"k{i}", 1.0 - i / 10) for c in "abcd" for i in range(3)], "conversation_id string, rank int, keyword string, score double")
    r = {x.community: x for x in topics.community_records(m, f, k).collect()}
    one, two = r["catcomm:0001"], r["catcomm:0002"]
    assert one.categories == ["X", "Y", "Z"] and one.label == "X + Y + Z" and one.summary == "X centered with Y, Z across 3 conversations." and one.keywords == ["k0", "k1", "k2"]
    assert (two.label, two.summary, two.category) == ("Q", "Q centered across 1 conversations.", "Q")


def test_catalog(built):
    rows = {r.conversation_id: r for r in built["catalog"].collect()}
    analysis = {r.conversation_id: r for r in built["analysis"].collect()}
    near = defaultdict(list)
    for r in built["neighbors"].collect():
        near[r.id].append(r.neighbor)
    for c, r in rows.items():
        facets = {x for x in (r.category, r.secondary, r.tertiary) if x}
        cross = [n for n in near[c] if analysis[n].category != r.category]
        assert r.bridge_score == 4 * (len(facets) - 1) + 2 * len({analysis[n].category for n in cross}) + len(cross)
        assert [n.id for n in r.neighbors or []] == near[c][:12] and r.branches == 2
        assert r.search_text == r.search_text.lower() and r.title.lower() in r.search_text
    a, c = rows["a"], rows["c"]
    assert a.created == "2023-11-14 22:13:20Z" and a.transcript_path == "../transcripts/Parser%20bug__a.txt" and a.baseline_category == "Infrastructure/Cloud"
    assert a.category_disagrees and a.ml_category == "Security" and a.perspective_score == 100 and a.strong_signal and c.selected_category == "Security"
    s = built["summary"].first()
    assert (s.conversations, s.clusters, s.similarity_edges, s.categories, s.with_secondary) == (4, 3, 1, len({x for r in rows.values() for x in (r.category, r.secondary, r.tertiary) if x}), 4)
    shown = reports.select_catalog(built["catalog"], text="AZURE", any_of=["Security"], only=("bridges", "strong")).collect()
    assert {r.conversation_id for r in shown} == {"a", "b"}
    assert [r.conversation_id for r in reports.sort_catalog(built["catalog"], "title").collect()][0] == "c"
    assert built["category_disagreements"].count() == 4


def test_insights(built):
    lists = index.insights(built)
    rows = built["catalog"].collect()
    want = Counter(x for r in rows for x in {r.category, r.secondary, r.tertiary} if x)
    assert {r.category: r.any_n for r in lists["categories"].collect()} == want
    assert [r.conversation_id for r in lists["bridges"].collect()] and lists["disagreements"].count() == 4 and lists["clusters"].first().members == 2
    assert {(r.left_category, r.right_category): r.n for r in lists["category_blends"].collect()}[("Infrastructure/Cloud", "Security")] >= 3
    first = lists["category_blends"].first()
    assert 1 <= len(first.examples) <= 3 and set(first.examples) <= {r.title for r in rows}
    sizes = {k: v.first() for k, v in index.size_reports(built).items()}
    assert sizes["clusters"].groups == 3 and sizes["clusters"].singletons == 2


def test_outputs(spark, messages, built, tmp_path):
    c = config.profile("hybrid", output=f"file://{tmp_path}/out", input="x", train_classifier="")
    t = main.run(spark, c, messages, index.Providers(predictor=predictor))
    db = sinks.read_database(spark, f"file://{tmp_path}/out/database")
    assert len(db) == 14 and db["conversations"].count() == 4 and db["messages"].count() == 12
    assert json.loads(db["conversation_embeddings"].first().vector_json) and {r.scope_id for r in db["graph_edges"].collect()} == {"a", "b", "c", "d", "global"}
    docs = {(r.conversation_id, r.branch): r.document for r in sinks.transcripts(t).collect()}
    assert len(docs) == 12
    text = docs["a", 1]
    assert text.startswith("Title: Parser bug\nConversationId: a\nBranch: 1\nCategory: Infrastructure/Cloud\nSecondaryCategory: Security\n")
    assert "\n```code\nprint(1)\n```\n\n```execution_output\n1\n```\n\nAttachments:\n[\"f.png\"]\n" in text and "[assistant] Node=a3 Parent=a2 Time=1970-01-01 00:00:03Z ContentType=text\nDone.\n" in text
    assert "CurrentNode: a3\n" in docs["a", 0] and "Node=a4" not in docs["a", 0] and "Node=d4" in docs["d", 0] and "TopicClusterSummary: " in docs["b", 0]
    again = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"file://{tmp_path}/out/reports/catalog")
    assert again.count() == 4 and "azure" in again.where("conversation_id = 'a'").first().topics
    dot = (tmp_path / "out/graph/conversation-graph.dot").read_text().split("\n")
    assert dot[:2] == ["digraph conversations {", "  rankdir=LR;"] and dot[-2:] == ["}", ""] and len(dot) == t["nodes"].count() + t["edges"].count() + 4
    assert '  "cat:Security" [shape=hexagon,label="Security"];' in dot and '  "a2" -> "a3" [label="reply:1"];' in dot and '  "a3" [shape=plaintext,label="Done."];' in dot
    own = json.loads((tmp_path / "out/graph/corpus-index.json").read_text())
    assert [c["conversation_id"] for c in own["conversations"]] == list("abcd") and len(own["graph"]["edges"]) == t["edges"].count() and len(own["topic_clusters"]) == 3
    assert {n["id"] for n in json.loads((tmp_path / "out/graph/conversation-graph.json").read_text())["nodes"]} == {r.id for r in t["nodes"].collect()}
    # Every link of the catalog opens its file.
    from urllib.parse import unquote

    for r in t["catalog"].collect():
        assert (tmp_path / "out/reports" / unquote(r.transcript_path)).read_text() == docs[r.conversation_id, 0]
    assert (tmp_path / "out/branches/Parser bug__a__branch-001.txt").read_text() == text and len(list((tmp_path / "out/branches").iterdir())) == 8
    assert "# Corpus insights" in "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/out/reports/insights_md").collect())
    runs = tables.profile_run(spark, "hybrid", f"file://{tmp_path}/out/reports").unionByName(tables.profile_run(spark, "again", f"file://{tmp_path}/out/reports").withColumn("category", F.when(F.col("id") == "a", "Other").otherwise(F.col("category"))))
    report = main.profile_report(runs)
    assert report["agreement"].first().match_rate == 0.75 and [r.id for r in report["disagreements"].collect()] == ["a"] and report["summaries"].count() == 2
    matrix = {r.id: r for r in reports.full_profile_matrix(runs).collect()}
    assert matrix["a"].category_map == "again=Other; hybrid=Infrastructure/Cloud" and matrix["a"].title == "Parser bug"
    sinks.write_selection(built["catalog"].limit(2), f"file://{tmp_path}/sel")
    sinks.write_normalized(messages, f"file://{tmp_path}/norm")
    assert spark.read.json(f"file://{tmp_path}/sel/json").count() == 2 and spark.read.json(f"file://{tmp_path}/norm").count() == 16


def test_empty_index(messages):
    t = index.build(messages.limit(0), config.profile("heuristic"))
    assert all(t[n].count() == 0 for n in ("catalog", "clusters", "communities", "edges", "nodes", "paths")) and t["summary"].first().conversations == 0


def test_language_model_hooks(messages):
    told = lambda corpora: corpora.select("conversation_id", F.lit("Security").alias("category"), F.array(F.lit("told topic"), F.lit("told topic")).alias("topics"), F.array(F.struct(F.lit("told word").alias("keyword"), F.lit(0.5).alias("score"))).alias("keywords"), F.lit("a summary").alias("summary"))
    named = lambda records, members: records.withColumn("label", F.lit("named"))
    t = index.build(messages, config.profile("heuristic", use_ollama=True), index.Providers(analyzer=told, labeler=named))
    a = t["analysis"].where("conversation_id = 'a'").first()
    assert a.category == "Security" and a.topics[0] == "told topic" and a.model_summary == "a summary"
    assert [tuple(k) for k in a["keywords"]] == [("told word", 0.5)] and t["nodes"].where("id = 'kw:told word'").count() == 1
    model = {(r.from_id, r.to_id, r.edge_type) for r in t["model_edges"].collect()}
    assert ("a", "modelcat:Security", "has_model_category") in model and ("a", "modeltopic:told topic", "has_model_topic") in model
    assert not t["edges"].where("edge_type like 'has_model%'").count() and t["edges"].where("from_id = 'a' and edge_type = 'has_keyword' and to_id = 'kw:azure'").count() + t["edges"].where("from_id = 'a' and edge_type = 'has_keyword'").count() > 0
    assert {r.label for r in t["clusters"].collect()} == {"named"} and t["clusters"].first().summary == "a summary"


def test_language_model_service(spark, messages):
    """A small service: one good answer, one that is no JSON, one slow failure; the baseline stays where nothing comes."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from threadloom.plans import language_model

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            answer = {"category": " Security ", "topics": ["x", "X", 3, ""], "summary": "told", "label": "own name"} if "today" in prompt or prompt.startswith("Name") else "not an object"
            if "Grafana" in prompt and prompt.startswith("Classify"):
                return self.send_error(500)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": json.dumps(answer)}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = config.profile("heuristic", use_ollama=True, ollama_url=f"http://127.0.0.1:{server.server_port}")
    t = index.build(messages, c, index.Providers(analyzer=language_model.analyzer(c), labeler=language_model.labeler(c)))
    a = {r.conversation_id: r for r in t["analysis"].collect()}
    assert a["b"].category == "Security" and a["b"].model_summary == "told" and a["b"].topics[0] == "x"
    assert a["a"].category == "Infrastructure/Cloud" and a["c"].category == "Observability/Telemetry" and a["a"].model_summary is None
    assert {r.label for r in t["clusters"].collect()} == {"own name"}
    server.shutdown()
    assert language_model.asked("http://127.0.0.1:9", "m", "p", 1) is None


def test_perspective_report(built, messages):
    corpora, info = built["corpora"], built["conversations"].select(F.col("conversation_id").alias("id"), "title")
    hashed = lambda c: index.hash_vectors(c, 384)
    found = index.embedding_comparison(corpora, info, hashed, hashed, 0.72, 1.1)
    rows, counts = main.perspective(built, found["left"], found["right"])
    assert [(r.id, r.score) for r in rows.collect()][:2] == [("a", 101), ("b", 101)] and counts.first().category_disagreements == 4 and counts.first().embedding_divergences == 2
    assert [e.neighbor for e in rows.first().left_examples] == ["b"]


TOKENS = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] un ##aff ##able the cat ##s . é 1 ##2".split())}


def test_word_pieces():
    w = wordpiece.WordPieces(TOKENS)
    assert w.pieces("unaffable") == ["un", "##aff", "##able"] and w.pieces("unx") == ["un", "[UNK]"] and w.pieces("zz") == ["[UNK]"] and w.pieces("the") == ["the"]
    assert [x for x, _, _ in w.words("The CATS. É 12!")] == ["the", "cats", ".", "é", "12", "!"]
    ids, mask, kinds, n = w.encode("the cats", 9)
    assert ids == [2, 7, 8, 9, 3, 0, 0, 0, 0] and mask == [1] * 5 + [0] * 4 and kinds == [0] * 9 and n == 5
    assert w.encode("the " * 50, 4)[3] == 8 and wordpiece.WordPieces(TOKENS, False).words("Ａ")[0][0] == "Ａ"


def plain_chunks(w, text, most, overlap):
    """As told: the rest of the text is cut again for every chunk."""
    out, cursor, room = [], 0, max(16, most) - 2
    overlap = min(max(overlap, 0), max(16, most) - 1)
    while cursor < len(text):
        rest = text[cursor:]
        spans = [s for word, start, _ in w.words(rest) for s in w.spans(word, start)]
        if not spans:
            break
        take = spans[:room]
        stop = len(rest) if len(spans) <= room else take[-1][1]
        chunk = rest[:stop].strip()
        out.append((chunk, len(take) + 2))
        if stop == len(rest):
            break
        own = [s for word, start, _ in w.words(chunk) for s in w.spans(word, start)]
        at = own[-overlap][0] if 0 < overlap < len(own) else 0
        cursor += at if 0 < at < len(chunk) else stop
    return out


def test_token_chunks(spark):
    w = wordpiece.WordPieces(TOKENS, False)
    # Cuts inside words: 14 pieces are four words of three and two thirds of the fifth; its rest is a word of its own.
    assert w.chunks("unaffable " * 5, 16, 0) == [("unaffable unaffable unaffable unaffable unaff", 16), ("able", 3)]
    assert w.chunks("unaffable " * 5, 3, 2)[1][0] == "unaffable" and w.chunks("unaffable " * 5, 3, 1)[1][0] == "affable" and w.chunks("the  ", 16, 3) == [("the", 3)] and w.chunks("", 16, 5) == [] == w.chunks(" \n", 16, 5)
    assert w.chunks("the\r\ncat", 16, 0) == [("the\ncat", 4)] and w.chunks("zz" * 40, 16, 0) == [("zz" * 40, 3)]
    import random

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["unaffable", "un", "the", "cats", " ", "  ", "\n", ".", "é", "zz", "12", "Cat"]) for _ in range(rng.randrange(1, 90)))
        most, overlap = rng.choice([3, 16, 17, 25]), rng.choice([0, 1, 5, 14, 40])
        assert w.chunks(text, most, overlap) == plain_chunks(w, text, most, overlap), (text, most, overlap)
    m = spark.createDataFrame([("c", "n", "the cats", None, " "), ("c", "m", None, "the", "cat")], "conversation_id string, node_id string, text string, aggregate_code string, execution_output string")
    got = sorted((r.kind, r.pos, r.chunk, r.tokens) for r in wordpiece.token_chunks(m, TOKENS).collect())
    assert got == [("code", 0, "the", 3), ("execution_output", 0, "cat", 3), ("text", 0, "the cats", 5)]
    assert wordpiece.chunk_totals(wordpiece.token_chunks(m, TOKENS)).first().chunk_tokens == 11
    assert wordpiece.encoded(m.select(F.col("node_id").alias("id"), "text"), TOKENS, 8).count() == 2
    assert wordpiece.chunker("auto", None) == "char" and wordpiece.chunker("auto", TOKENS) == "mltokenizer"
    with pytest.raises(ValueError):
        wordpiece.chunker("mltokenizer", None)


def test_chunks_of_documents(spark):
    """The registered query against chunks of whole texts one by one."""
    import hashlib

    from threadloom.plans import queries

    docs = tables.table(spark, SMALL, "documents")
    tokens = wordpiece.found_vocabulary(docs.select("text"))
    w = wordpiece.WordPieces(tokens, False)
    want = Counter()
    for r in docs.collect():
        for i, (chunk, n) in enumerate(w.chunks(r.text or "", 256, 32)):
            want[r.source, str(r.doc_id), i, n, hashlib.sha256(f"text\n{chunk}".encode()).hexdigest().upper()] += 1
    assert Counter(map(tuple, queries.token_chunks(spark, SMALL).select("conversation_id", "node_id", "pos", "tokens", "chunk_hash").collect())) == want
    assert len(tokens) > 2_000 and max(Counter(k[:2] for k in want).values()) > 5


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\n\n the \ncat\n")
    assert wordpiece.vocabulary(spark, str(tmp_path / "v.txt")) == {"[PAD]": 0, "the": 2, "cat": 3}
    (tmp_path / "w.txt").write_text("a\na\n")
    with pytest.raises(ValueError):
        wordpiece.vocabulary(spark, str(tmp_path / "w.txt"))
    (tmp_path / "m.onnx").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:ab\nsize 3\n")
    assert wordpiece.is_lfs_pointer(spark, str(tmp_path / "m.onnx")) and not wordpiece.is_lfs_pointer(spark, str(tmp_path / "v.txt"))


def test_classifier(spark, tmp_path):
    rows = [("red", f"apple cherry rose {i}") for i in range(30)] + [("blue", f"sky sea ocean {i}") for i in range(30)]
    d = spark.createDataFrame(rows, "label string, text string")
    model, found = classifier.train(d, features=1 << 10)
    assert found["micro_accuracy"] > 0.9 and found["macro_accuracy"] > 0.9 and found["log_loss"] < 0.5 and found["top_5_accuracy"] == 1.0
    classifier.save(spark, model, found, classifier.label_distribution(d), f"file://{tmp_path}/m")
    again = classifier.load(f"file://{tmp_path}/m")
    got = classifier.predict_top(again, spark.createDataFrame([("x", "ocean sea"), ("y", " ")], "conversation_id string, corpus string"), 1).collect()
    assert [(r.conversation_id, r.category) for r in got] == [("x", "blue")] and 0.5 < got[0].score < 0.7311
    with pytest.raises(ValueError):
        classifier.train(d.limit(5))
    s = spark.range(1).select(classifier.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(1000.0))).alias("s")).first().s
    assert s == [0.0, 0.0, 1.0] and classifier.no_predictor(spark.createDataFrame([("x", "y")], "conversation_id string, corpus string")).count() == 0


def test_embedding_comparison(messages):
    m = forest.usable(messages)
    corpora, info = forest.corpus(m), forest.attributes(m).select(F.col("conversation_id").alias("id"), "title")
    hashed = lambda c: index.hash_vectors(c, 384)
    got = index.embedding_comparison(corpora, info, hashed, hashed, 0.72, 0.99)
    assert got["left"].count() == 2 and got["overlap"].first().jaccard in (0.0, 1.0) and set(got) == {"left", "right", "overlap", "differences"}


def test_pooling():
    import numpy as np

    x = np.array([[[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]]])
    assert np.allclose(similarity.pooled(x, np.array([[1, 1, 0]])), np.array([[2.0, 2.0]]) / np.sqrt(8)) and np.allclose(similarity.pooled(np.array([[3.0, 4.0]]), None), [[0.6, 0.8]])
    assert similarity.devices("cpu") == [("CPUExecutionProvider", {})] and similarity.devices("auto", cuda=2)[0] == ("CUDAExecutionProvider", {"device_id": 2})


def test_command_line(capsys):
    c = config.parse(["-i", "x.json", "--execution-profile", "onnx", "--chunking-provider", "char", "--max-similar-neighbors", "7", "--compare-models"])
    assert (c.input, c.embedding_provider, c.chunking_provider, c.max_similar_neighbors, c.compare_embeddings) == ("x.json", "onnx", "char", 7, True)
    for bad in (["--nope"], [], ["-i", "x", "--hash-embedding-dim", "1"], ["-i"], ["-i", "x", "--category-provider", "z"], ["-i", "x", "--cuda-device-id", "one"]):
        with pytest.raises(ValueError):
            config.parse(bad)
    assert config.parse(["-h"]) is None and main.main(["--help"]) == 0 and main.main(["--nope"]) == 2 and "usage" in capsys.readouterr().out
    shared = config.profile("custom", similarity_threshold=0.5, hash_similarity_threshold=0.6)
    assert (shared.threshold("hash:384"), shared.threshold("onnx:m"), config.Config().threshold("onnx:m -> hash:384")) == (0.6, 0.5, 0.6)
    assert config.profile("custom", use_ollama=True).labels_clusters() and not config.Config().labels_clusters()


def test_lenient_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"nodeid": "n", "Text": "a,] // no comment ,} \\" /* x */", "CreateTime": 2,}, // end\n{"NODEID": "o"},]')
    (tmp_path / "z.json").write_text("null")
    got = tables.flat_json(spark, f"{tmp_path}/*.json").orderBy("row_idx").collect()
    assert [(r.node_id, r.text, r.create_time) for r in got] == [("n", 'a,] // no comment ,} " /* x */', 2.0), ("o", None, None)]


def test_content_parts(spark, tmp_path):
    parts = ["plain", None, {"content_type": "image_asset_pointer", "asset_pointer": "file-1"}, {"content_type": "audio"}, {"k": 1}]
    node = lambda kind, **more: {"message": {"author": {"role": "user"}, "content": {"content_type": kind, "parts": parts, **more}, "metadata": {"attachments": [{"id": "f"}], "aggregate_result": {"code": "c"}}}}
    doc = {"conversation_id": "c", "mapping": {"a": node("text"), "b": node("multimodal_text"), "d": {"message": {"content": {"content_type": "code", "text": "only text"}}}}}
    (tmp_path / "conversations-1.json").write_text(json.dumps([doc, {"id": "none", "mapping": None}]))
    got = {r.node_id: r for r in tables.raw_export(spark, f"{tmp_path}/conversations-*.json").collect()}
    assert got["a"].text == "plain" and got["b"].text == 'plain\n[image_asset_pointer] file-1\n[part:audio]\n{"k":1}' and got["d"].text == "only text"
    assert json.loads(got["a"].attachments_json) == [{"id": "f"}] and got["a"].aggregate_code == "c" and got["d"].attachments_json is None and len(got) == 3


def test_files(spark, tmp_path):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    (tmp_path / "i.png").write_bytes(tables.PNG + chunk(b"tEXt", b"Title\0a \xe9") + chunk(b"IDAT", b"x") + chunk(b"IEND", b""))
    (tmp_path / "j.json").write_text("[1]")
    assert [tuple(r) for r in tables.png_text_chunks(spark, f"{tmp_path}/*").collect()] == [("i.png", "Title", "a é")]
    assert {r.name: r.kind for r in tables.file_inventory(spark, f"{tmp_path}/*").collect()} == {"i.png": "png", "j.json": "json"}
    assert tables.optional_json(spark, f"{tmp_path}/none.json", "a int") is None and tables.optional_json(spark, f"{tmp_path}/j.json", "a int") is not None


def test_perspective_lists(spark):
    n = lambda *p: spark.createDataFrame(list(p), "id long, neighbor long, weight double, rank int")
    left, right = n(*((1, i, 0.9, i) for i in range(2, 10))), n((1, 2, 0.8, 1))
    rows = reports.perspective(spark.createDataFrame([(1, True), (2, False)], "id long, disagrees boolean"), left, right)
    got = {r.id: r for r in reports.perspective_lists(rows, left, right).collect()}
    assert [e.neighbor for e in got[1].left_examples] == [3, 4, 5, 6, 7] and got[1].right_examples is None
    assert tuple(reports.perspective_counts(rows).first()) == (1, 1, 1)


def test_attachments_and_filters(spark, messages):
    assert reports.with_attachments(messages).count() == 4 and reports.matching_messages(messages, "azure").count() == 2


def test_streaming(spark, messages, tmp_path):
    from threadloom.streaming import ingest

    messages.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.append_messages(spark, f"{tmp_path}/in", messages.schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 16


def test_deduplicated_in_scope(spark):
    e = spark.createDataFrame([("g", "a", "b", "t", 1.0, None), ("g", "a", "b", "t", 2.0, "z"), ("g", "a", "b", "t", 2.0, "y"), ("h", "a", "b", "t", 1.0, None)], "scope_id string, from_id string, to_id string, edge_type string, weight double, metadata_json string")
    assert sorted((r.scope_id, r.weight, r.metadata_json) for r in graph.deduplicated_in_scope(e).collect()) == [("g", 2.0, "y"), ("h", 1.0, None)]
    assert K.facet_count() is not None and categories.ALTERNATE == 0.11


def test_dense_vectors(spark):
    """Values are put in their places, not looked up for every place."""
    rows = [(f"c{i}", b, float(i + 1) / (b + 1)) for i in range(25) for b in range(i % 7, 40, 1 + i % 3)]
    got = index.dense(spark.createDataFrame(rows, "conversation_id string, bucket long, value double").repartition(3), 40, some=4)
    held = {(c, b): x for c, b, x in rows}
    assert {r.id: list(r.v) for r in got.collect()} == {f"c{i}": [held.get((f"c{i}", b), 0.0) for b in range(40)] for i in range(25)}
    texts = spark.createDataFrame([("a", "alpha beta C# .NET"), ("b", "")], "conversation_id string, corpus string")
    v = index.hash_vectors(texts)
    assert "element_at" not in v._jdf.queryExecution().toString()
    assert [(r.id, len(r.v), round(sum(x * x for x in r.v), 9)) for r in v.collect()] == [("a", 384, 1.0)]


def test_workers_take_batches_in_small_parts():
    """However many rows an Arrow batch has, few of them are Python objects at a time; none is lost or moved."""
    import pyarrow as pa

    from threadloom.operators import keywords

    texts = pa.array(["x" * (i % 900) if i != 70 else "y" * 3_000_000 for i in range(5_000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000)), texts], names=["id", "text"])
    parts = list(store.small_parts(iter([batch, batch.slice(0, 0)]), 1))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert max(len(p) for p in parts) <= 1_000 and all(len(p) == 1 or p.column(1).nbytes <= 1 << 20 for p in parts)
    many = pa.RecordBatch.from_arrays([pa.array([f"c{i}" for i in range(3_000)]), pa.array([["alpha", "alpha beta", "gamma"]] * 3_000), pa.array([[9, 8, 7]] * 3_000)], names=["conversation_id", "t", "u"])
    out = list(keywords._greedy(6)(iter([many])))
    assert len(out) > 1 and sum(map(len, out)) == 6_000
    assert out[0].to_pylist()[:2] == [{"conversation_id": "c0", "rank": 0, "keyword": "alpha", "units": 9, "top": 9}, {"conversation_id": "c0", "rank": 1, "keyword": "gamma", "units": 7, "top": 9}]
