"""Similarity with copy classes and block skipping, against all pairs in numpy."""

import time
from collections import Counter

import numpy as np
import pytest

from threadloom.operators import similarity

VECTORS = "id long, v array<double>"


def rows_of(n, kinds, copies, seed=1, noise=0.15, dims=8):
    """Vectors about a few directions; the first ``copies`` of every ten are equal to their direction."""
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (kinds, dims))
    return [(i, [float(x) for x in at[i % kinds] + (0 if i % 10 < copies else 1) * rng.normal(0, noise, dims)]) for i in range(n)]


def plain(rows, threshold):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    key = {i: tuple(v) for i, v in rows}
    x = x / np.linalg.norm(x, axis=1)[:, None]
    score = (x @ x.T).round(12)
    near = {i: sorted((-1.0 if key[i] == key[j] else -score[a, b], j) for b, j in enumerate(ids) if j != i and (key[i] == key[j] or score[a, b] >= threshold)) for a, i in enumerate(ids)}
    return key, near


@pytest.mark.parametrize("block_rows, copies", [(16, 4), (10_000, 4), (16, 0)])
def test_against_all_pairs(spark, block_rows, copies):
    rows = rows_of(400, 12, copies)
    v = spark.createDataFrame(rows, VECTORS).repartition(3)
    key, near = plain(rows, 0.9)
    for k in (1, 3):
        got = {}
        for r in similarity.best_neighbors(v, 0.9, k, block_rows=block_rows).collect():
            got.setdefault(r.id, {})[r.rank] = r.neighbor
        assert got == {i: {n + 1: j for n, (_, j) in enumerate(x[:k])} for i, x in near.items() if x}
    first = {}
    for i in sorted(key):
        first.setdefault(key[i], i)
    classes = {r.id: (r.class_id, r.copies, r.links) for r in similarity.similar_classes(v, 0.9, block_rows=block_rows).collect()}
    n = Counter(key.values())
    assert classes == {i: (first[key[i]], n[key[i]], len(near[i])) for i in key}
    pairs = {(r.a, r.b) for r in similarity.similar_pairs(v, 0.9, block_rows=block_rows).collect()}
    heads = set(first.values())
    assert pairs == {(i, j) for i in heads for _, j in near[i] if i < j and j in heads}


def test_blocks_are_skipped(spark):
    """Far groups of vectors are never multiplied with each other."""
    v = spark.createDataFrame(rows_of(2000, 20, 0, dims=16, noise=0.05), VECTORS)
    pairs = similarity.similar_pairs(v, 0.8, block_rows=50)
    assert pairs.block_pairs >= 820 and pairs.multiplied < 0.4 * pairs.block_pairs


def test_one_common_vector(spark):
    """Half of 20,000 vectors are equal: the output stays in proportion to the rows."""
    rng, start = np.random.default_rng(2), time.time()
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 2 else [float(x) for x in rng.normal(0, 1, 4)]) for i in range(20_000)]
    v = spark.createDataFrame(rows, VECTORS)
    best = similarity.best_neighbors(v, 0.99, 4).cache()
    assert best.count() <= 4 * len(rows)
    common = {r.id: r.neighbor for r in best.where("rank = 1 and id % 2 = 1").collect()}
    assert common == {i: 3 if i == 1 else 1 for i in range(1, 20_000, 2)}
    assert {(r.copies, r.class_id) for r in similarity.similar_classes(v, 0.99).where("id % 2 = 1").collect()} == {(10_000, 1)}
    assert similarity.edges_of(best, 4).count() <= 4 * len(rows) and time.time() - start < 120


def test_hard_vectors(spark):
    """Nulls, empty ones and zeros; negative zero is zero; a vector of length 0 has no links above 0."""
    rows = [(1, [0.0, 0.0]), (2, [-0.0, 0.0]), (3, None), (4, []), (None, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0])]
    v = spark.createDataFrame(rows, VECTORS)
    got = {r.id: (r.class_id, r.copies, r.links) for r in similarity.similar_classes(v, 0.5).collect()}
    assert got == {1: (1, 2, 0), 2: (1, 2, 0), 5: (5, 1, 1), 6: (6, 1, 1)}
    assert similarity.best_neighbors(v.limit(0), 0.5).count() == 0
    texts = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    assert [tuple(r)[:2] for r in similarity.similar_pairs(texts, 0.9).collect()] == [("a", "b")]


def test_number_of_blocks_is_bounded(spark):
    """Vectors are sent once for each block: over 40 blocks, these grow instead, and the pairs stay."""
    rows = rows_of(3000, 12, 0)
    v = spark.createDataFrame(rows, VECTORS)
    found = similarity.class_pairs(v, 0.9, block_rows=16, k=2)
    assert found.block_pairs <= 820
    _, near = plain(rows, 0.9)
    got = {}
    for r in found.collect():
        got.setdefault(r.a, {})[r.rank] = r.b
    assert got == {i: {n + 1: j for n, (_, j) in enumerate(x[:2])} for i, x in near.items() if x}
    assert -(-600_000 // similarity.rows_a_block(600_000, 64, 2048, 40, 64 << 20)) <= 40
    assert similarity.rows_a_block(10**9, 64, 2048, 40, 64 << 20) == 131_072


def test_floats_stay_floats(spark):
    """Vectors of floats are not shuffled as doubles, and give the same pairs."""
    v = spark.createDataFrame(rows_of(300, 6, 2), VECTORS).selectExpr("id", "cast(v as array<float>) v")
    assert similarity.classes(v).schema["v"].dataType.simpleString() == "array<float>"
    pairs = lambda x: sorted((r.a, r.b, round(r.score, 12)) for r in similarity.similar_pairs(x, 0.9, block_rows=32).collect())
    assert pairs(v) == pairs(v.selectExpr("id", "cast(v as array<double>) v"))


def sent(spark, run):
    """What ``run`` gives, and how many rows it shuffled."""
    context = spark.sparkContext._jsc.sc()

    def rows():
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before, got = rows(), run()
    return got, sum(n for stage, n in rows().items() if stage not in before)


def test_what_is_sent_grows_as_the_vectors(spark):
    """A vector is sent once for each of at most 10 stripes, however many blocks there are; with partitions for groups and with a sort."""
    n = 3000
    rows = rows_of(n, 12, 0, noise=1.0)
    v = spark.createDataFrame(rows, VECTORS).localCheckpoint()
    _, near = plain(rows, 0.9)
    wanted = {(i, j) for i, x in near.items() for _, j in x if i < j}
    for most_groups in (1_000, 1):
        pairs, records = sent(spark, lambda m=most_groups: {(r.a, r.b) for r in similarity.class_pairs(v, 0.9, block_rows=16, most_groups=m).collect()})
        assert pairs == wanted
        assert records < 14 * n
    small, large = (sent(spark, lambda m=m: similarity.class_pairs(v.where(f"id < {m}"), 0.5, block_rows=16, k=2).count())[1] for m in (300, 3000))
    assert large < 12 * small


def test_stripes(spark):
    """10 stripes at most, until one has 64 MB; no stripe has more bytes than a block may have."""
    for n in (2_049, 10_256, 102_564, 615_384, 1_500_000, 10**8):
        block = min(similarity.rows_a_block(n, 64, 2048, 40, 64 << 20), -(-n // 10))
        run = similarity.blocks_a_stripe(-(-n // block), block, 64, 10, 64 << 20)
        assert block * run * 64 * 8 <= 64 << 20 and (n > 1_300_000 or -(-n // (block * run)) <= 10)


def test_hits():
    rng = np.random.default_rng(3)
    for n, share in ((0, 0.5), (5, 0.5), (8, 0), (1003, 0.01), (1003, 1)):
        passed = rng.random(n) < share
        assert similarity._hits(passed).tolist() == np.flatnonzero(passed).tolist()
