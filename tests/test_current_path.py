"""The current path, walked and by pointer doubling, against a plain walk."""

import time

import numpy as np
import pytest

from threadloom.operators import forest

NODE = "row_idx long, conversation_id string, node_id string, parent_node_id string, create_time double, role string, text string, aggregate_code string, execution_output string"


def plain(rows, current):
    out = {}
    for c in {r[1] for r in rows}:
        own = {r[2]: r for r in rows if r[1] == c}
        at = current.get(c) if current.get(c) in own else None
        if at is None:
            ends = [r for r in own.values() if r[2] not in {x[3] for x in own.values()}]
            at = min(ends, key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))[2] if ends else None
        path = []
        while at in own and at not in path:
            path.append(at)
            at = own[at][3]
        out[c] = [n for n in reversed(path) if own[n][5] is not None]
    return {c: p for c, p in out.items() if p}


@pytest.mark.parametrize("large", [0, 30, 10_000])
def test_random_forests(spark, large):
    """Roots without parents or with unknown ones, ties, missing times, hidden nodes and a cycle; with ``large`` 0 all go by doubling."""
    rng, rows = np.random.default_rng(3), []
    for c in range(12):
        for i in range(int(rng.integers(1, 70))):
            parent = None if i == 0 or rng.random() < 0.03 else "gone" if rng.random() < 0.02 else f"n{rng.integers(max(0, i - 4), i)}"
            rows.append((len(rows), f"c{c}", f"n{i}", parent, None if rng.random() < 0.1 else float(rng.integers(0, 20)), None if rng.random() < 0.1 else "user", None, None, None))
    rows += [(len(rows) + i, "ring", f"r{i}", f"r{(i + 1) % 5}", 1.0, "user", None, None, None) for i in range(5)] + [(9999, "ring", "tail", "r2", 2.0, "user", None, None, None)]
    current = {"c1": "n0", "c2": "none", "c3": "n3", "ring": "r4"}
    m = spark.createDataFrame(rows, NODE).repartition(3)
    for told in ({}, current):
        df = spark.createDataFrame(list(told.items()), "conversation_id string, current_node string") if told else None
        got = {}
        for r in sorted(forest.current_path(m, df, large).collect(), key=lambda r: (r.conversation_id, r.pos)):
            assert r.pos == len(got.setdefault(r.conversation_id, []))
            got[r.conversation_id].append(r.node_id)
        assert got == plain(rows, told)


def test_long_chain(spark):
    """100,000 messages in one chain, with 1,000 leaves beside it."""
    spine = spark.range(100_000).selectExpr("id as row_idx", "'c' as conversation_id", "concat('n', id) as node_id", "if(id = 0, null, concat('n', id - 1)) as parent_node_id", "double(id) as create_time")
    side = spark.range(1_000).selectExpr("id + 100000 as row_idx", "'c' as conversation_id", "concat('l', id) as node_id", "concat('n', id * 90) as parent_node_id", "0.5D as create_time")
    m = spine.unionByName(side).selectExpr("*", "'user' as role", "string(null) as text", "string(null) as aggregate_code", "string(null) as execution_output").cache()
    m.count()
    start = time.time()
    path = forest.current_path(m).collect()
    took = time.time() - start
    assert len(path) == 100_000 and all(r.node_id == f"n{r.pos}" for r in path) and took < 120, took
    print(took)
