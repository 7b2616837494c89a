"""Category communities: facet combinations merged in order, in rounds over tables.

Combinations of ``ANCHOR`` rows or more found communities (all do, if there is none). The others come in order (rows falling, then
name): each joins the best-matching community, which changes that one's profile, or founds its own, which later ones may
join. So the result depends on the order, and yet no task needs to see all of it:

1. The next ``block`` combinations are matched with all communities as they stand, in parts; each keeps its ``keep`` best.
2. One task walks the block in order. What it has changed so far are few communities; each combination is matched with those
   again. Its best unchanged community is the first of its list that is not among them. If all of a full list are, the walk
   stops there, and the next round begins with this combination; else its choice is what the plain order gives.
3. The changed communities replace their old rows.

A round commits one combination at least, nearly always the block. The driver sees counts only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import kept, ranked

FACET_WEIGHTS = {"category": 1.0, "secondary": 0.68, "tertiary": 0.44}
ANCHOR, JOIN, SAME_PRIMARY = 3, 0.46, 0.05
STATE = "seed string, n long, primary string, names array<string>, sums array<double>"


def signatures(faceted: DataFrame) -> DataFrame:
    """signature, n, category, secondary, tertiary."""
    s = F.concat_ws(" | ", "category", "secondary", "tertiary")
    return faceted.groupBy(s.alias("signature")).agg(F.count("*").alias("n"), F.min("category").alias("category"), F.min("secondary").alias("secondary"), F.min("tertiary").alias("tertiary"))


def profile(category: str | None, secondary: str | None, tertiary: str | None) -> dict[str, float]:
    """The weight of each category of a combination, the larger of two."""
    out: dict[str, float] = {}
    for c, w in zip((category, secondary, tertiary), FACET_WEIGHTS.values()):
        if c is not None:
            out[c] = max(out.get(c, 0.0), w)
    return out


def match(mine: dict[str, float], primary: str, n: int, theirs: dict[str, float], their_primary: str) -> float:
    """Weighted overlap of a combination with a community's mean profile, and a little for the same first category."""
    mean = {k: round(v / n, 4) for k, v in theirs.items()}
    keys = sorted(mine.keys() | mean.keys())
    low = sum(min(mine.get(k, 0.0), mean.get(k, 0.0)) for k in keys)
    high = sum(max(mine.get(k, 0.0), mean.get(k, 0.0)) for k in keys)
    return min(1.0, (low / high if high else 0.0) + SAME_PRIMARY * (their_primary == primary))


def _founded(rows: DataFrame) -> DataFrame:
    """Communities of one combination each."""
    weights = [F.struct(F.col(c).alias("k"), F.lit(w).alias("w")) for c, w in FACET_WEIGHTS.items()]
    each = F.filter(F.array(*weights), lambda x: x["k"].isNotNull())
    names = F.array_distinct(F.transform(each, lambda x: x["k"]))
    top = lambda k: F.array_max(F.transform(F.filter(each, lambda x: x["k"] == k), lambda x: x["w"]))
    return rows.select(F.col("signature").alias("seed"), "n", F.col("category").alias("primary"), names.alias("names"), F.transform(names, lambda k: top(k) * F.col("n")).alias("sums"))


def _candidates(keep: int):
    """Of one part of the communities: the ``keep`` best for each combination of the block that match enough."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        block, known = group[group.seed.isna()], group[group.seed.notna()]
        held: dict[str, list[int]] = {}
        states = [dict(zip(names, sums)) for names, sums in zip(known.names, known.sums)]
        for i, s in enumerate(states):
            for k in s:
                held.setdefault(k, []).append(i)
        n, primary, seeds, out = known.n.to_numpy(), known.primary.to_numpy(), known.seed.to_numpy(), []
        for seq, *combination in zip(block.seq, block.category, block.secondary, block.tertiary):
            mine = profile(*(c if isinstance(c, str) else None for c in combination))
            near = {i for k in mine for i in held.get(k, ())}
            scored = sorted((-s, -n[i], seeds[i], i) for i in near if (s := match(mine, combination[0], n[i], states[i], primary[i])) >= JOIN)
            out += [(seq, -s, *known.iloc[i][["seed", "n", "primary", "names", "sums"]]) for s, _, _, i in scored[:keep]]
        return pd.DataFrame(out, columns=["seq", "score", "seed", "n", "primary", "names", "sums"])

    return work


def _walk(keep: int):
    """The block in order; rows of its choices (seq, signature, chosen) and of the communities changed (without seq)."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        states: dict[str, dict] = {}
        changed: dict[str, list[str]] = {}
        touched, rows = set(), []
        for seq, own in group.sort_values(["seq", "place"]).groupby("seq", sort=True):
            first = own.iloc[0]
            combination = [c if isinstance(c, str) else None for c in (first.category, first.secondary, first.tertiary)]
            mine, listed = profile(*combination), own[own.seed.notna()]
            for _, c in listed.iterrows():
                states.setdefault(c.seed, {"n": int(c.n), "primary": c.primary, "sums": dict(zip(c.names, c.sums))})
            fresh = [(-c.score, -c.n, c.seed) for _, c in listed.iterrows() if c.seed not in touched]
            if not fresh and len(listed) == keep:
                break
            again = {s for k in mine for s in changed.get(k, ())}
            scored = [(-match(mine, combination[0], states[s]["n"], states[s]["sums"], states[s]["primary"]), -states[s]["n"], s) for s in again]
            best = min([*fresh[:1], *scored], default=(0.0, 0, ""))
            if -best[0] >= JOIN:
                chosen = best[2]
                state = states[chosen]
                state["n"] += int(first.rows)
                for k, v in mine.items():
                    state["sums"][k] = state["sums"].get(k, 0.0) + v * int(first.rows)
            else:
                chosen = first.signature
                states[chosen] = {"n": int(first.rows), "primary": combination[0], "sums": {k: v * int(first.rows) for k, v in mine.items()}}
            touched.add(chosen)
            for k in states[chosen]["sums"]:
                if chosen not in changed.setdefault(k, []):
                    changed[k].append(chosen)
            rows.append((seq, first.signature, chosen, None, None, None, None))
        rows += [(None, None, s, states[s]["n"], states[s]["primary"], list(states[s]["sums"]), list(states[s]["sums"].values())) for s in sorted(touched)]
        return pd.DataFrame(rows, columns=["seq", "signature", "seed", "n", "primary", "names", "sums"]).astype({"seq": "Int64", "n": "Int64"})

    return work


def merged(groups: DataFrame, block: int = 4096, part: int = 2048, keep: int = 8) -> DataFrame:
    """signature, seed (the combination that founded its community), members of the community."""
    s = kept(groups)
    anchored = not s.where(F.col("n") >= ANCHOR).isEmpty()
    anchors = s.where(F.col("n") >= ANCHOR) if anchored else s
    state, chosen = _founded(anchors), [anchors.select("signature", F.col("signature").alias("seed"))]
    pending = s.where(F.col("n") < ANCHOR) if anchored else s.where("false")
    total = pending.count()
    if total:
        pending = kept(ranked(pending, [F.col("n").desc(), F.col("signature")], "seq"))
        state = kept(state)
    done, shape = 0, "seq int, signature string, seed string, n long, primary string, names array<string>, sums array<double>"
    while done < total:
        due = pending.where((F.col("seq") > done) & (F.col("seq") <= done + block))
        parts = max(1, -(-state.count() // part))
        blank = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
        theirs = state.select(F.pmod(F.xxhash64("seed"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("int").alias("seq"), *blank("category", "secondary", "tertiary"), "seed", "n", "primary", "names", "sums")
        mine = due.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "seq", "category", "secondary", "tertiary", *blank("seed"), F.lit(None).cast("long").alias("n"), *blank("primary"), F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("array<double>").alias("sums"))
        found = theirs.unionByName(mine).groupBy("part").applyInPandas(_candidates(keep), "seq int, score double, seed string, n long, primary string, names array<string>, sums array<double>")
        place = F.row_number().over(W.partitionBy("seq").orderBy(F.col("score").desc(), F.col("n").desc(), "seed"))
        best = found.withColumn("place", place).where(F.col("place") <= keep)
        joined = due.withColumnRenamed("n", "rows").join(best, "seq", "left").withColumn("all", F.lit(1))
        walked = kept(joined.groupBy("all").applyInPandas(_walk(keep), shape))
        news = walked.where("seq is null").select("seed", "n", "primary", "names", "sums")
        state = kept(state.join(news.select("seed"), "seed", "left_anti").unionByName(news))
        chosen.append(walked.where("seq is not null").select("signature", "seed"))
        done = walked.agg(F.max("seq")).first()[0]
    every = chosen[0]
    for c in chosen[1:]:
        every = every.unionByName(c)
    return every.join(state.select("seed", F.col("n").alias("members")), "seed")


def communities(faceted: DataFrame, few: int = 100_000, **options) -> DataFrame:
    """conversation_id, community: catcomm:0001 up, by members, then the founding combination."""
    found = kept(merged(signatures(faceted), **options))
    number = ranked(found.select("seed", "members").distinct(), [F.col("members").desc(), F.col("seed")], "number")
    names = kept(found.join(number.select("seed", "number"), "seed").select("signature", F.format_string("catcomm:%04d", "number").alias("community")))
    own = faceted.withColumn("signature", F.concat_ws(" | ", "category", "secondary", "tertiary"))
    return own.join(F.broadcast(names) if names.count() <= few else names, "signature").select("conversation_id", "community")
