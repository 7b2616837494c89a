"""Each stage of the corpus pipeline against a brute-force version, on a table with copies, benchmark passages, repeated rows,
nulls and columns that are named like the operators' own."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import distance, prose, water

import corpus_pipeline
from threadloom.llm import quality_classifier

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, size long, score double, held_out int, taken int, tk int, row int, id int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(40, 5)
    good = [prose(60 + i, i) for i in range(40)]
    bad = [" ".join(w.upper() + "!!" for w in prose(50, 500 + i).split()) for i in range(15)]
    near = [" ".join(["swapped", *t.split()[1:]]) for t in good[:8]]
    leaked = [f"{prose(30, 700 + i)} {' '.join(item.split()[i : i + 14])} {prose(300, 800 + i)}" for i in range(5)]
    texts = good + bad + near + good[8:14] + leaked
    rows = [(i, t, "en", f"s{i % 4}", len(t), 7, 7, 7, 0.1, 7, 7, 7, 7, 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, good[9], *rows[9][2:]), (None, prose(70, 999), *rows[9][2:]), (500, None, *[None] * 12), (501, "", *rows[9][2:])]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(40 + i, 0, 0) for i in range(15)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def kept(spark, folder):
    """What each stage takes and gives, written and read again."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}.parquet")
        after = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns(kept):
    assert list(kept) == ["quality", "near_duplicates", "decontamination", "mixture", "shards"]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    assert all(after.columns == names for _, after in list(kept.values())[:-1])
    assert kept["shards"][1].columns == [{"shard": "shard_in", "slot": "slot_in"}.get(n, n) for n in names] + ["shard", "slot"]


def test_quality(spark, folder, kept):
    docs, after = kept["quality"]
    model = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = Counter(tuple(r) for r in docs.collect() if model.score([r.text or ""])[0] >= 0.3)
    assert rows(after) == want and {r.doc_id for r in after.collect()} >= set(range(40))


def test_near_duplicates(kept):
    before, after = (df.collect() for df in kept["near_duplicates"])
    w = [(r.text or "").lower().split() for r in before]
    comp = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            longest = max(len(w[i]), len(w[j]))
            if comp[i] != comp[j] and abs(len(w[i]) - len(w[j])) <= 0.2 * longest and distance(w[i], w[j]) <= int(0.2 * longest + 1e-9):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    smallest = {}
    for r, c in zip(before, comp):
        smallest[c] = min(smallest.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in after) == Counter(smallest.values())
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) < len(before) - 10


def test_decontamination(spark, folder, kept):
    before, after = kept["decontamination"]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text.split()
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    clean = lambda t: not any(tuple(w[i : i + 13]) in windows for w in [(t or "").split()] for i in range(len(w)))
    assert rows(after) == Counter(tuple(r) for r in before.collect() if clean(r.text)) and after.count() < before.count()


def test_mixture(kept):
    before, after = (df.collect() for df in kept["mixture"])
    sizes = Counter()
    for r in before:
        sizes[r.source] += len((r.text or "").split())
    order = sorted((s for s in sizes), key=lambda s: (s is None, s))
    targets = water({s: sizes[s] for s in order if sizes[s]}, 3) if all(sizes[s] for s in order) else None
    if targets is None:  # sources without words take part in the turn of weights
        weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
        targets, left = {s: 0.0 for s in order if not sizes[s]}, {s for s in order if sizes[s]}
        while True:
            rest, w = sum(sizes.values()) - sum(targets.values()), sum(weights[s] for s in left)
            over = {s for s in left if rest * weights[s] / w > 3 * sizes[s]}
            if not over:
                targets |= {s: rest * weights[s] / w for s in left}
                break
            targets |= {s: 3.0 * sizes[s] for s in over}
            left -= over
    want = Counter()
    for s in order:
        own = sorted((r for r in before if r.source == s), key=lambda r: hashlib.md5(("mix" + (str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest())).encode()).hexdigest()[:15])
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        left_words = round(targets[s] - whole * sizes[s])
        for r in own:
            n = len((r.text or "").split())
            part = max(0, min(n, left_words))
            left_words -= n
            want[tuple(r)] += whole + (part > 0 and 2 * part >= n)
    assert Counter(tuple(r) for r in after) == +want


def test_shards(kept):
    before, after = (df.collect() for df in kept["shards"])
    n = len(before[0])
    assert Counter(tuple(r)[:n] for r in after) == Counter(tuple(r) for r in before)
    assert sorted((r.shard, r["slot"]) for r in after) == sorted((i % 24, i // 24) for i in range(len(after)))


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
    assert out.where(F.col("doc_id").isNull()).count() == 0


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_short_items(spark, tmp_path):
    """A one-word item doesn't empty a corpus: short items count where they fill half of a document; items of 8 words or more always."""
    items = [(1, "the"), (2, "one two three four five six seven eight"), (3, None), (4, " ".join(f"w{i}" for i in range(20)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["the cat saw the dog", "the the a", "x one two three four five six seven eight y", "a " * 30 + " ".join(f"w{i}" for i in range(3, 16)), "a " + " ".join(f"w{i}" for i in range(12)), None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [0, 4, 5, 6]
