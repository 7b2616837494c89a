"""Golden cases of the engine's operators, worked out by hand."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from threadloom.functions import text as X
from threadloom.operators import categories, forest, graph, keywords, reports, similarity
from threadloom.plans import config, oracle, queries
from threadloom.sources import tables

SMALL = "/root/testdata/sf0.001"
NODE = "conversation_id string, node_id string, parent_node_id string, create_time double, role string, text string, aggregate_code string, execution_output string"


def branching(spark):
    rows = [("n1", None, 1.0), ("n2", "n1", 2.0), ("n3", "n2", 3.0), ("n4", "n2", 4.0), ("n5", "n4", 5.0), ("n6", "missing", None)]
    return spark.createDataFrame([("c", n, p, t, "user", n, None, None) for n, p, t in rows], NODE)


def test_forest(spark):
    m = branching(spark)
    assert {r.node_id for r in forest.linked(m).where("parent is null").collect()} == {"n1", "n6"}
    paths = {}
    for r in forest.leaf_paths(m).orderBy("branch", "pos").collect():
        paths.setdefault(r.branch, []).append(r.node_id)
    assert paths == {1: ["n1", "n2", "n3"], 2: ["n1", "n2", "n4", "n5"], 3: ["n6"]}
    named = spark.createDataFrame([("c", "n3")], "conversation_id string, current_node string")
    take = lambda df: [r.node_id for r in df.orderBy("pos").collect()]
    assert take(forest.current_path(m, named)) == ["n1", "n2", "n3"]
    assert take(forest.current_path(m)) == ["n1", "n2", "n4", "n5"]
    assert forest.duplicate_nodes(m.union(m.limit(1))).count() == 1
    assert graph.reply_edges(forest.linked(m)).count() == 4


def test_a_cycle_ends(spark):
    m = spark.createDataFrame([("c", "a", "b", 1.0, "u", "", None, None), ("c", "b", "a", 2.0, "u", "", None, None), ("c", "x", "a", 3.0, "u", "", None, None)], NODE)
    assert [r.node_id for r in forest.leaf_paths(m).orderBy("pos").collect()] == ["b", "a", "x"]


@pytest.mark.parametrize(
    "line, want",
    [
        ("## Fix C# parser in .NET", ["fix", "csharp", "parser", "dotnet"]),
        ("1. Use `event_log` for the API v2", ["use", "event_log", "api"]),
        ("```python", []),
        ("- GP and CA 2024 http://x.y", ["gp", "ca", "x.y"]),
        ("C++ c# C#-style", ["csharp", "c#-style"]),
    ],
)
def test_tokens(spark, line, want):
    df = spark.createDataFrame([(line,)], "raw string")
    assert df.select(X.tokens(X.plain_line(F.col("raw"))).alias("t")).first().t == want


def test_keywords(spark):
    m = spark.createDataFrame([("c", "n", None, 1.0, "user", "# Event log", None, None)], NODE)
    titles = forest.titled(spark.createDataFrame([("c", None)], "conversation_id string, title string"))
    got = keywords.keywords(keywords.term_units(m, titles)).orderBy("rank").collect()
    assert [(r.keyword, r.score) for r in got] == [("event log", 1.0), ("untitled", 1.7143)]


def test_hash_and_chunks(spark):
    df = spark.createDataFrame([("abc", "x" * 2500)], "s string, t string")
    r = df.select(X.fnv1a(F.col("s")).alias("h"), F.transform(X.chunks(F.col("t")), F.char_length).alias("n")).first()
    assert r.h == 440920331 and r.n == [1200, 1200, 100]


def test_top_edges_and_clusters(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.2]), (4, [0.0, 1.0]), (5, []), (6, None)], "id long, v array<double>")
    for rows in (2, 100):
        pairs = similarity.similar_pairs(v, 0.9, block_rows=rows)
        edges = sorted(tuple(r) for r in similarity.top_edges(pairs, 1).collect())
        assert edges == [(1, 2, 0.995), (2, 3, 0.9952)]
    found = similarity.numbered(similarity.components(v.where("id < 5").select("id"), similarity.top_edges(pairs, 1)))
    assert {r.id: r.cluster for r in found.collect()} == {1: "cluster:0001", 2: "cluster:0001", 3: "cluster:0001", 4: "cluster:0002"}


def test_facets(spark):
    rows = [("c", 0, "Security", 0.75, "baseline"), ("c", 1, "C#/.NET", 0.31, "model"), ("c", 2, "Security", 0.22, "model"), ("c", 3, "PowerShell", 0.15, "model"), ("c", 4, "Creative", 0.10, "model")]
    p = spark.createDataFrame(rows, "conversation_id string, pos int, category string, score double, source string")
    assert tuple(categories.facets(categories.selected(p, "hybrid")).first())[1:] == ("Security", "C#/.NET", "PowerShell")
    assert tuple(categories.facets(categories.selected(p, "model")).first())[1:] == ("C#/.NET", "Security", "PowerShell")
    assert tuple(categories.facets(categories.selected(p, "heuristic")).first())[1:] == ("Security", None, None)


def test_cooccurrence(spark):
    k = [(c, i, w) for c, ws in enumerate(("abc", "ab", "ab", "bc")) for i, w in enumerate(ws)]
    df = spark.createDataFrame([(str(c), i, w) for c, i, w in k], "conversation_id string, rank int, keyword string")
    assert [tuple(r) for r in keywords.cooccurrence(df, least=3).collect()] == [("a", "b", 3, 1.0)]
    assert {tuple(r) for r in keywords.cooccurrence(df, least=1).collect()} == {("a", "b", 3, 1.0), ("b", "c", 2, 0.6667), ("a", "c", 1, 0.3333)}


def test_hierarchy(spark):
    df = spark.createDataFrame([("A/B/C",), ("A / B",), ("X",)], "category string")
    assert {tuple(r) for r in keywords.hierarchy(df).collect()} == {("A", "A/B", 2), ("A/B", "A/B/C", 1)}


def test_bridge(spark):
    c = spark.createDataFrame([(1, "X", "Q", None, "0"), (2, "X", None, None, "0"), (3, "Y", None, None, "0"), (4, "Y", None, None, "0"), (5, "Z", None, None, "0")], "id long, category string, secondary string, tertiary string, cluster string")
    n = spark.createDataFrame([(1, i, 0.9, i - 1) for i in (2, 3, 4, 5)], "id long, neighbor long, weight double, rank int")
    assert reports.bridges(c, n).first().bridge_score == 11


def test_edge_overlap(spark):
    e = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    r = similarity.edge_overlap(e(("a", "b"), ("b", "c")), e(("b", "c"), ("c", "d"))).first()
    assert (r.overlap, r.union_n, r.jaccard) == (1, 3, 0.3333)
    assert similarity.edge_overlap(e(), e()).first().jaccard == 1.0


def test_perspective(spark):
    n = lambda *p: spark.createDataFrame(list(p), "id long, neighbor long")
    d = spark.createDataFrame([(1, True), (2, False)], "id long, disagrees boolean")
    left, right = n((1, 5), (1, 6), (1, 7), (2, 1), (2, 3)), n((1, 9), (2, 4))
    got = {r.id: (r.difference, r.score, r.strong) for r in reports.perspective(d, left, right).collect()}
    assert got == {1: (4, 104, True), 2: (3, 3, False)}


def test_flat_json(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text('[ {"conversationid": "c", "NodeId": "n", "CreateTime": 1.5,}, /* x */ {"ConversationId": "d", "nodeid": "m"}, ]')
    got = tables.flat_json(spark, str(f)).orderBy("row_idx").select("conversation_id", "node_id", "create_time").collect()
    assert [tuple(r) for r in got] == [("c", "n", 1.5), ("d", "m", None)]


def test_raw_export(spark, tmp_path):
    (tmp_path / "conversations-1.json").write_text('[{"id": "c", "title": "t", "mapping": {"a": {"parent": null, "children": ["b"], "message": {"author": {"role": "user"}, "create_time": 1.0, "content": {"content_type": "text", "parts": ["x", "y"]}}}, "b": {"parent": "a", "message": null}}}]')
    r = tables.raw_export(spark, str(tmp_path / "conversations-*.json")).collect()
    assert len(r) == 1 and (r[0].conversation_id, r[0].node_id, r[0].text, r[0].role) == ("c", "a", "x\ny", "user")


def test_profiles():
    assert config.profile("onnx", max_similar_neighbors=2).embedding_provider == "onnx"
    assert config.Config().threshold("onnx:m -> hash:384") == 0.60 and config.Config().threshold("hash:384") == 0.72
    with pytest.raises(ValueError):
        config.profile("none")


@pytest.mark.parametrize("name", ["parent_links", "keywords_top", "leaf_paths", "similar_edges", "clusters", "graph_edges", "category_facets", "profile_matrix"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "labels", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.sql(oracle.SQL[name]).df()
    rows = lambda df: sorted(repr(tuple(None if x != x else x for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_label_examples_whole_text(spark):
    """Pages that differ only after their first characters stay apart: by brute force over whole texts."""
    pages = tables.table(spark, SMALL, "pages").select(F.regexp_extract("url", r"//([^/]+)", 1).alias("label"), "html").collect()
    n = {}
    for r in pages:
        n[r.label.strip().upper()] = n.get(r.label.strip().upper(), 0) + 1
    label = lambda x: "UNCATEGORIZED" if not x.strip() or n[x.strip().upper()] < 4 else x.strip().upper()
    want = {(label(r.label), r.html.upper()) for r in pages if r.html and r.html.strip(" ")}
    got = [(r.label.upper(), r.text.upper()) for r in queries.label_examples(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(len(t) for _, t in got) > 60


def test_clusters_by_union_find(spark):
    """Clusters are the components of all similar edges, by brute force over all pairs of vectors."""
    rows = tables.table(spark, SMALL, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    score, root = x @ x.T, list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        near = sorted((-score[i, j], ids[j], j) for j in range(len(ids)) if j != i and score[i, j] >= queries.THRESHOLD)
        for _, _, j in near[:4]:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    heads = sorted({find(i) for i in range(len(ids))})
    want = {ids[i]: f"cluster:{heads.index(find(i)) + 1:04d}" for i in range(len(ids))}
    got = {r.id: r.cluster for r in queries.clusters(spark, SMALL).collect()}
    assert got == want and 1 < len(heads) < len(ids)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
