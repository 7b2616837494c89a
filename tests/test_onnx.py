"""The ONNX embedder on a model written by hand: token ids and their squares as token vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import similarity, wordpiece
from threadloom.plans import config, main


def number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(tag: int, value) -> bytes:
    """A protobuf field: a number, or bytes with their length."""
    if isinstance(value, int):
        return number(tag << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(tag << 3 | 2) + number(len(value)) + value


def node(kind: str, inputs: list[str], output: str, *attributes: bytes) -> bytes:
    return b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, kind) + b"".join(field(5, a) for a in attributes)


def tensor(name: str, kind: int, *dims: str) -> bytes:
    shape = b"".join(field(1, field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def model() -> bytes:
    """last_hidden_state = [x, x * x] of x = input_ids; the mask is an input that it does not use but to add zero."""
    one = lambda name, i: field(1, name) + field(3, i) + field(20, 2)
    many = lambda name, i: field(1, name) + field(8, i) + field(20, 7)
    nodes = [
        node("Sub", ["attention_mask", "attention_mask"], "zero"),
        node("Add", ["input_ids", "zero"], "ids"),
        node("Cast", ["ids"], "x", one("to", 1)),
        node("Mul", ["x", "x"], "xx"),
        node("Unsqueeze", ["x"], "a", many("axes", 2)),
        node("Unsqueeze", ["xx"], "b", many("axes", 2)),
        node("Concat", ["a", "b"], "last_hidden_state", one("axis", 2)),
    ]
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + field(11, tensor("input_ids", 7, "n", "l")) + field(11, tensor("attention_mask", 7, "n", "l")) + field(12, tensor("last_hidden_state", 1, "n", "l", "d"))
    return field(1, 7) + field(8, field(1, "") + field(2, 11)) + field(7, graph)


TOKENS = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] the cat sat".split())}


@pytest.fixture
def path(tmp_path):
    (tmp_path / "m.onnx").write_bytes(model())
    return str(tmp_path / "m.onnx")


def expected(text: str) -> np.ndarray:
    ids, mask, _, n = wordpiece.WordPieces(TOKENS).encode(text, 16)
    x = np.array(ids[:n], float)
    v = np.array([x.mean(), (x * x).mean()])
    return v / np.linalg.norm(v)


def test_embed(spark, path):
    texts = {"a": "the cat", "b": "The cat sat", "c": "", "d": "what"}
    d = spark.createDataFrame(list(texts.items()), "id string, text string").coalesce(1)
    encode = similarity.inputs_of(wordpiece.WordPieces(TOKENS), 16)
    got = {r.id: np.array(r.v) for r in similarity.embed_onnx(d, path, encode, batch=3).collect()}
    assert all(np.allclose(got[k], expected(t), atol=1e-6) for k, t in texts.items()) and len(got) == 4
    # A device that is not there is passed over.
    other = similarity.embed_onnx(d, path, encode, devices=similarity.devices("auto")).collect()
    assert all(np.allclose(r.v, got[r.id]) for r in other)


def test_rows_that_fail(spark, path):
    pieces = wordpiece.WordPieces(TOKENS)
    good = similarity.inputs_of(pieces, 16)

    def encode(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return good(texts)

    d = spark.createDataFrame([("a", "the cat"), ("b", "bad"), ("c", "sat")], "id string, text string").coalesce(1)
    got = {r.id: r.v for r in similarity.embed_onnx(d, path, encode).collect()}
    assert got["b"] is None and np.allclose(got["a"], expected("the cat"), atol=1e-6) and np.allclose(got["c"], expected("sat"), atol=1e-6)


def test_provider(spark, path, monkeypatch):
    """The settings' embedder: rows that fail get hashed vectors; both tokenizers can be compared."""
    c = config.profile("onnx", embedding_model=path, embedding_max_tokens=16, compare_onnx_tokenizers=True)
    corpora = spark.createDataFrame([("a", "the cat"), ("b", "The Cat")], "conversation_id string, corpus string")
    both = [{r.id: r.v for r in main.embedder(c, TOKENS, t)(corpora).collect()} for t in ("legacy", "mltokenizer")]
    assert np.allclose(both[0]["a"], both[0]["b"]) and not np.allclose(both[1]["a"], both[1]["b"]) and np.allclose(both[0]["a"], both[1]["a"])
    broken = lambda texts, *_, **__: texts.select("id", F.when(F.col("id") == "a", F.array(F.lit(1.0), *[F.lit(0.0)] * 31)).alias("v"))
    monkeypatch.setattr(main.similarity, "embed_onnx", broken)
    got = {r.id: r.v for r in main.embedder(c, TOKENS, "legacy")(corpora.replace("The Cat", "grafana loki")).collect()}
    assert got["a"][0] == 1.0 and len(got["b"]) == 32 and abs(sum(x * x for x in got["b"]) - 1) < 1e-9
