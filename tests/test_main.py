"""The command line's ways in: raw exports, models in a folder, profiles."""

import json

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.plans import config, main
from threadloom.plans import index as I


def test_percent(spark):
    rows = spark.createDataFrame([(0.125,), (0.12345,), (1.0,), (0.0,), (12.3456,)], "x double").select(X.percent(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["12.5 %", "12.3 %", "100.0 %", "0.0 %", "1,234.6 %"]


def test_discovered(tmp_path):
    for name in ("b/z.onnx", "a/model.onnx", "a/vocab.txt", "labels/model/metadata/part-00000"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    c = main.discovered(config.profile("custom", models_dir=str(tmp_path)))
    assert (c.embedding_model, c.embedding_vocab, c.mlnet_model) == (f"{tmp_path}/a/model.onnx", f"file://{tmp_path}/a/vocab.txt", f"file://{tmp_path}/labels")
    own = main.discovered(config.profile("custom", models_dir=str(tmp_path), embedding_model="mine.onnx"))
    assert own.embedding_model == "mine.onnx" and main.discovered(config.Config()) == config.Config()
    assert main.discovered(config.profile("custom", models_dir=f"{tmp_path}/none")).embedding_model == ""


def test_run_profiles_from_a_raw_export(spark, tmp_path, capsys):
    """Nested exports in, a profile's outputs and the comparison's out."""
    node = lambda i, parent: {"parent": parent, "children": [], "message": {"author": {"role": "user"}, "create_time": float(i), "content": {"content_type": "text", "parts": [f"azure cloud parser {i}"]}}}
    docs = [{"id": f"c{k}", "title": f"Title {k}", "create_time": 1.0 * k, "mapping": {f"c{k}n0": node(0, None), f"c{k}n1": node(1, f"c{k}n0")}} for k in range(3)]
    (tmp_path / "conversations-1.json").write_text(json.dumps(docs))
    c = config.parse(["--raw-export", f"{tmp_path}/conversations-*.json", "-o", f"file://{tmp_path}/out", "--run-profiles", "--chunking-provider", "char"])
    assert c.raw_export and c.run_profiles and not c.input
    out = main.run_profiles(spark, c, names=("hybrid",))
    assert out["agreement"].count() == 0 and out["summaries"].first().conversations == 3
    assert (tmp_path / "out/hybrid/transcripts/Title 1__c1.txt").exists() and (tmp_path / "out/comparison/agreement").is_dir()
    told = spark.read.json(f"{tmp_path}/out/comparison/insights/categories").collect()
    assert {(r.profile, r.category, r.any_n) for r in told} == {("hybrid", "Infrastructure/Cloud", 3)}
    assert I.Providers().tokenizers is None
