"""Named files, single documents of many parts, and the text rules they rely on."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.sources import files, sinks


@pytest.mark.parametrize(
    "text, want",
    [("  a\nb  ", "a b"), ("a\r\nb", "a  b"), (" \n\t", ""), (None, ""), ("x" * 81, "x" * 80 + "..."), ("\n" + "y" * 80 + "\n", "y" * 80), ("é ", "é")],
)
def test_preview(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.preview(F.col("t"))).first()[0] == want


def test_stored_name(spark):
    names = ["short", "世" * 140, "世" * 139 + "界"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.stored_name(F.col("n"))).collect()]
    assert got[0] == "short" and len(set(got)) == 3 and all(len(n.encode()) <= 220 for n in got)


def test_named_files(spark, tmp_path):
    rows = [("a", f"n {i}.txt", f"document {i}\n" * i, i) for i in range(40)] + [("b", "same.txt", "first", 1), ("b", "same.txt", "last", 2), ("b", "none.txt", None, 1)]
    files.write_named(spark.createDataFrame(rows, "folder string, name string, document string, k int"), f"file://{tmp_path}/out", ["k"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "a", "b"]
    assert all((tmp_path / "out/a" / f"n {i}.txt").read_text() == f"document {i}\n" * i for i in range(40))
    assert (tmp_path / "out/b/same.txt").read_text() == "last" and (tmp_path / "out/b/none.txt").read_text() == ""


def test_failed_task_leaves_no_file(spark, tmp_path):
    """A task that fails half-way has written to its staging folder only, and that goes with the job."""
    fail = F.udf(lambda i: "x" if i < 30 else 1 / 0, "string")
    rows = spark.range(31).coalesce(1).select(F.lit("a").alias("folder"), F.format_string("%d.txt", "id").alias("name"), F.col("id"))
    spark.dataSource.register(files.NamedFiles)
    with pytest.raises(Exception, match="division"):
        rows.select("folder", "name", fail("id").alias("document")).write.format("named_files").option("path", f"{tmp_path}/out").mode("append").save()
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_document(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("line %d é", "id").alias("value"), "id").repartition(7)
    n = files.write_document(rows, ["id"], f"file://{tmp_path}/sub/all.txt")
    want = "".join(f"line {i} é\n" for i in range(5000)).encode()
    assert (tmp_path / "sub/all.txt").read_bytes() == want and n == len(want) and [p.name for p in (tmp_path / "sub").iterdir()] == ["all.txt"]
    files.write_document(rows.limit(0), ["id"], f"{tmp_path}/none.txt")
    assert (tmp_path / "none.txt").read_bytes() == b""


def test_json_document(spark, tmp_path):
    rows = lambda n: spark.range(n).select(F.format_string("%05d", "id").alias("key"), F.to_json(F.struct("id")).alias("value"))
    ids = lambda n: [{"id": i} for i in range(n)]
    files.write_document(files.json_document({"a": rows(3), "none": rows(0), "g/n": rows(2), "g/e": rows(1)}), ["section", "key"], f"{tmp_path}/x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": ids(3), "none": [], "g": {"n": ids(2), "e": ids(1)}}
    files.write_document(files.json_document({"g/n": rows(2), "b": rows(1)}), ["section", "key"], f"{tmp_path}/y.json")
    assert json.loads((tmp_path / "y.json").read_text()) == {"g": {"n": ids(2)}, "b": ids(1)}


def test_dot(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", 'line one\nline "two" \\', "conversation"), ("k", None, "keyword")], "id string, label string, kind string")
    edges = spark.createDataFrame([("n1", "k", "t", 0.12345)], "from_id string, to_id string, edge_type string, weight double")
    files.write_document(sinks.dot_lines(nodes, edges), ["section", "a", "b", "c"], f"{tmp_path}/g.dot")
    want = ["digraph conversations {", "  rankdir=LR;", '  "n1" [shape=box,label="line one\\nline \\"two\\" \\\\"];', '  "k" [shape=diamond,label=""];', '  "n1" -> "k" [label="t:0.123"];', "}", ""]
    assert (tmp_path / "g.dot").read_text() == "\n".join(want)
