"""Category communities in rounds, against the plain walk over one list."""

import numpy as np
import pytest

from threadloom.operators import communities

GROUP = "signature string, n long, category string, secondary string, tertiary string"


def merge_signatures(groups: list[tuple]) -> list[tuple[str, int]]:
    """(signature, community) of groups (signature, n, category, secondary, tertiary), each in turn: groups of three or more
    found communities, the rest join the best-matching one or found their own. Order matters, and the table is as small as
    the number of facet combinations."""
    order = sorted(groups, key=lambda g: (-g[1], g[0]))
    anchors = [g for g in order if g[1] >= communities.ANCHOR] or order
    found: list[dict] = []

    def profile(g) -> dict[str, float]:
        out: dict[str, float] = {}
        for c, w in zip(g[2:5], communities.FACET_WEIGHTS.values()):
            if c is not None:
                out[c] = max(out.get(c, 0.0), w)
        return out

    def start(g) -> None:
        found.append({"seed": g[0], "n": g[1], "sum": {k: v * g[1] for k, v in profile(g).items()}, "primary": g[2], "in": [g[0]]})

    for g in anchors:
        start(g)
    for g in order if len(anchors) < len(order) else []:
        if g in anchors:
            continue
        mine, scored = profile(g), []
        for c in found:
            theirs = {k: round(v / c["n"], 4) for k, v in c["sum"].items()}
            keys = mine.keys() | theirs.keys()
            low = sum(min(mine.get(k, 0.0), theirs.get(k, 0.0)) for k in keys)
            high = sum(max(mine.get(k, 0.0), theirs.get(k, 0.0)) for k in keys)
            scored.append((min(1.0, (low / high if high else 0.0) + communities.SAME_PRIMARY * (c["primary"] == g[2])), c))
        best = min(scored, key=lambda s: (-s[0], -s[1]["n"], s[1]["seed"]), default=None)
        if best and best[0] >= communities.JOIN:
            c = best[1]
            c["n"] += g[1]
            c["in"].append(g[0])
            for k, v in mine.items():
                c["sum"][k] = c["sum"].get(k, 0.0) + v * g[1]
        else:
            start(g)
    numbered = sorted(found, key=lambda c: (-c["n"], c["seed"]))
    return [(s, i) for i, c in enumerate(numbered, 1) for s in c["in"]]


def named(rows):
    """(signature, community) as numbered in the end."""
    found = {}
    for r in rows:
        found.setdefault((-r.members, r.seed), []).append(r.signature)
    return sorted((s, i) for i, k in enumerate(sorted(found), 1) for s in found[k])


def test_small(spark):
    groups = [("A | B", 3, "A", "B", None), ("A", 1, "A", None, None), ("C", 1, "C", None, None)]
    assert named(communities.merged(spark.createDataFrame(groups, GROUP)).collect()) == [("A", 1), ("A | B", 1), ("C", 2)] == sorted(merge_signatures(groups))
    assert communities.merged(spark.createDataFrame([], GROUP)).count() == 0


@pytest.mark.parametrize("seed, most, block, keep", [(1, 5, 4096, 8), (2, 3, 7, 1), (3, 4, 16, 2), (4, 2, 10, 8)])
def test_random(spark, seed, most, block, keep):
    """Small blocks and lists, so that walks stop early and communities change between rounds; with ``most`` 2 there are no anchors."""
    rng, groups = np.random.default_rng(seed), {}
    for _ in range(120):
        c = [f"c{x}" for x in rng.permutation(9)[: rng.integers(1, 4)]]
        groups[" | ".join(c)] = (" | ".join(c), int(rng.integers(1, most + 1)), *c, *[None] * (3 - len(c)))
    rows = [groups[k] for k in groups]
    got = named(communities.merged(spark.createDataFrame(rows, GROUP).repartition(3), block=block, part=20, keep=keep).collect())
    assert got == sorted(merge_signatures(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_sql(spark, seed):
    """The registered query's SQL on facets in which some groups join and some found communities."""
    import duckdb

    from threadloom.plans import oracle

    rng, rows = np.random.default_rng(seed), []
    for i in range(90):
        c = [f"c{x}" for x in rng.permutation(5)[: rng.integers(1, 4)]]
        rows.append((f"x{i}", *c, *[None] * (3 - len(c))))
    con = duckdb.connect()
    con.execute("CREATE TABLE fac (conversation_id VARCHAR, category VARCHAR, secondary VARCHAR, tertiary VARCHAR)")
    con.executemany("INSERT INTO fac VALUES (?, ?, ?, ?)", rows)
    want = con.sql(f"WITH RECURSIVE {oracle.COMMUNITIES} SELECT conversation_id, community FROM fac JOIN found ON found.signature = concat_ws(' | ', category, secondary, tertiary)").fetchall()
    got = communities.communities(spark.createDataFrame(rows, "conversation_id string, category string, secondary string, tertiary string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 3 < len({c for _, c in want}) < len({r[1:] for r in rows})


def test_of_conversations(spark):
    rows = [(f"x{i}", *c) for i, c in enumerate([("A", "B", None)] * 4 + [("A", None, None)] + [("C", None, None)] * 3 + [("D", "C", None)])]
    got = {r.conversation_id: r.community for r in communities.communities(spark.createDataFrame(rows, "conversation_id string, category string, secondary string, tertiary string")).collect()}
    assert [got[f"x{i}"] for i in (0, 3, 4, 5, 7)] == ["catcomm:0001"] * 3 + ["catcomm:0002"] * 2 and got["x8"] in ("catcomm:0002", "catcomm:0003")
