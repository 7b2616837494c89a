"""Near-duplicate documents by order MinHash.

Words are hashed; runs of two words are labelled with how often the same run came before in the text. Each of ``sketches``
hash functions picks the three labelled runs with the smallest hashes and keeps them in their order of the text, so that
equal sketches tell of similar order, not only of similar content. Texts of equal words are one class from the start;
classes that share a sketch are candidates, and a pair counts when banded alignment of the whole texts finds at most
(1 - ``similarity``) times the longer one's words to change.

Sketches are sized for links at the threshold itself. A changed word breaks two runs, so two texts of L words or fewer at
similarity 0.8 share at least 0.6 L of their 1.4 L different runs wherever the changes lie, and 96 sketches of three miss
one in about 2,600 such pairs. Few runs make that coarse: texts under ``SHORT`` words (which may link to one under 50) are
sketched by their single words too, of which 0.8 L of 1.2 L at least are shared, and 40 of these miss fewer than one in 7,000.

Within a group of equal sketches each class whose length allows it is first aligned with the group's shortest one. Links
found so (by the first sketches, then by the others where these leave two components) join classes into components. Only
groups whose classes are then still in several components go on: every pair across components that shares a sketch is
compared by two bounds that no link can break (difference of lengths; words in common, counted in buckets), and what
passes is aligned too. Groups of up to ``block`` members are compared in one task; larger ones are cut in bands of length
and parts, and those of more than ``refine`` members first in subgroups that share a rare word (see ``rarest``), which
every link does. So no link is lost for the sake of the short cut, and pairs become rows only where the bounds leave them
possible. A pair is taken in the first group that it shares. Links, components and sketches stay in the cluster.

Edge cases: null, empty and wordless texts are one class. Texts under three words have one run, the whole text. Very long
texts are sketched and aligned in pieces of bounded size. Rows that repeat a doc_id are one document, in the smallest class
of its texts. Null ids are in no class of ``classes``; ``kept`` treats them like others. Extra columns are ignored by
``classes`` and returned by ``kept``, whatever their names but ``_ka`` and ``_kb``. An empty table has no classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

GRAM, PICKED = 2, 3
#: Texts of fewer words than SHORT have WORDS sketches of single words besides.
SHORT, WORDS = 63, 40
#: Sketches whose pairs are aligned before the others'.
FIRST = 8
#: Buckets of words and the largest count of one in a bag's 32 bits; a count that reaches it stands for any larger one.
BUCKETS, TOP = 1 << 11, (1 << 20) - 1
WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0xFF51AFD7ED558CCD)


def words(text: Column) -> Column:
    """Hashes of the lowered words: 31 bits each."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(w, lambda x: F.hash(x))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def runs(w: np.ndarray, gram: int = 5) -> np.ndarray:
    """Hashes of the runs of ``gram`` words (of all, if fewer), each with its occurrence number."""
    w = mixed(w.astype(np.int64).view(np.uint64))
    n = max(len(w) - gram + 1, 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(gram, len(w))):
        h = mixed(h + w[i : i + n])
    by = np.argsort(h, kind="stable")
    ordered = h[by]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        number = np.empty(n, np.uint64)
        number[by] = (np.arange(n) - first).astype(np.uint64)
        h = np.where(number > 0, mixed(h + number * MIX), h)
    return h


def order_sketch(w: np.ndarray, seeds: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """For each seed one hash: of the picked runs in order of the text."""
    h, out = runs(w, gram), seeds.copy()
    short, low = (h >> np.uint64(32)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 16) // len(h))
    for k in range(0, len(seeds), step):
        some = low[k : k + step]
        if len(h) > PICKED:
            x = short[None, :] ^ some[:, None]
            x *= np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            rows, at = np.arange(len(some)), np.empty((len(some), PICKED), np.int64)
            for j in range(PICKED):
                least = x.argmin(axis=1)
                at[:, j] = least
                x[rows, least] = np.uint32(0xFFFFFFFF)
            picked = h[np.sort(at, axis=1)]
        else:
            picked = np.broadcast_to(h, (len(some), len(h)))
        acc = out[k : k + step]
        for i in range(picked.shape[1]):
            acc *= np.uint64(0x9E3779B97F4A7C15)
            acc += picked[:, i]
            acc ^= acc >> np.uint64(29)
    return out.view(np.int64)


def sketched(docs: DataFrame, sketches: int) -> DataFrame:
    """doc_id, tk (hash of the text), k1, k2 (128 bits of the words), n (words), sketch (array; short texts have WORDS more) for every row."""
    seeds, word_seeds = np.split(mixed(np.arange(1, sketches + WORDS + 1, dtype=np.uint64)), [sketches])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tk long, k1 long, k2 long, n int, sketch array<long>"

    def work(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                w = batch.column(4)
                flat, at = w.values.to_numpy(), w.offsets.to_numpy()
                rows = [np.zeros(0, np.int64)]
                for a, b in zip(at[:-1], at[1:]):
                    own = order_sketch(flat[a:b], seeds)
                    rows.append(np.concatenate([own, order_sketch(flat[a:b], word_seeds, 1)]) if b - a < SHORT else own)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(r) for r in rows]), pa.int32()), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(at), pa.int32()), lists], names=["doc_id", "tk", "k1", "k2", "n", "sketch"])

    w = docs.select("doc_id", common.text_key(F.col("text")).alias("tk"), words(F.col("text")).alias("w"))
    return w.select("doc_id", "tk", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(5), "w").alias("k2"), "w").mapInArrow(work, schema)


def shared(x: np.ndarray, y: np.ndarray, buckets: int) -> int:
    """How many values x and y have in common, or more: counted in buckets."""
    return int(np.minimum(np.bincount(x & (buckets - 1), minlength=buckets), np.bincount(y & (buckets - 1), minlength=buckets)).sum())


def aligned(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each pair whether its word edit distance is at most ``most``: dynamic programming over a band about the
    diagonal, for all pairs at once; bands grow for the pairs still open. Pairs with too few words in common, counted in
    buckets, are not aligned, nor are those with too few runs of two (a change breaks two at most)."""
    ok = np.zeros(len(a), bool)
    trimmed, open_ = [], []
    for i, (x, y) in enumerate(zip(a, b)):
        n = min(len(x), len(y))
        same = x[:n] == y[:n]
        head = n if same.all() else int(same.argmin())
        x, y = x[head:], y[head:]
        n = min(len(x), len(y))
        tail = 0
        if n:
            same = x[::-1][:n] == y[::-1][:n]
            tail = n if same.all() else int(same.argmin())
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if len(x) > len(y):
            x, y = y, x
        trimmed.append((x, y))
        if len(y) - len(x) > most[i]:
            continue
        if len(x) == 0:
            ok[i] = True
        elif len(y) - shared(x, y, BUCKETS) <= most[i] and len(y) - 1 - shared(x[:-1] * 31 + x[1:], y[:-1] * 31 + y[1:], 1 << 14) <= 2 * most[i]:
            open_.append(i)
    band = 8
    while open_:
        left = []
        open_.sort(key=lambda i: len(trimmed[i][1]))
        for k in range(0, len(open_), 64):
            some = open_[k : k + 64]
            width = [min(band, int(most[i])) for i in some]
            for i, d, w in zip(some, banded([trimmed[i] for i in some], width), width):
                if d <= w:
                    ok[i] = True
                elif w < most[i]:
                    left.append(i)
        open_, band = left, band * 4
    return ok


def banded(pairs, width: list[int]) -> np.ndarray:
    """Edit distances of (x, y), or more than the width where they are beyond it."""
    wide, big = max(width), np.int32(1 << 28)
    n, m = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    rows, cols = int(n.max()), int(m.max())
    cells = np.arange(2 * wide + 1, dtype=np.int32)
    xs = np.full((len(pairs), rows), -1, np.int64)
    ys = np.full((len(pairs), cols + 2 * wide + 2 + rows), -2, np.int64)
    for i, (x, y) in enumerate(pairs):
        xs[i, : len(x)] = x
        ys[i, wide : wide + len(y)] = y
    # Cell c of row r is for y's first r + c - wide words. No cell of a later row is less than the least of this one, so
    # pairs whose row is all beyond their width are done.
    now = np.where(cells >= wide, cells - wide, big)[None, :].repeat(len(pairs), 0).astype(np.int32)
    out, most, at = np.full(len(pairs), big, np.int32), np.array(width), np.arange(len(pairs))
    for r in range(1, rows + 1):
        j = r + cells - wide
        change = (ys[:, r - 1 : r + 2 * wide] != xs[:, r - 1, None]).astype(np.int32)
        best = now + change
        best[:, :-1] = np.minimum(best[:, :-1], now[:, 1:] + 1)
        best[:, j < 0] = big
        if 0 <= wide - r <= 2 * wide:
            best[:, wide - r] = r
        best = np.minimum.accumulate(best - cells, axis=1) + cells
        now = np.minimum(best, big)
        done = np.flatnonzero(n[at] == r)
        if len(done):
            c = m[at[done]] - r + wide
            inside = (c >= 0) & (c <= 2 * wide)
            out[at[done[inside]]] = now[done[inside], c[inside]]
        if r % 16 == 0:
            live = (now.min(axis=1) <= most[at]) & (n[at] > r)
            if not live.any():
                break
            if 4 * live.sum() <= 3 * len(live):
                now, xs, ys, at = now[live], xs[live], ys[live], at[live]
    return out


def most_changes(longest: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)


def bags(texts: DataFrame) -> DataFrame:
    """id, bag: of each bucket that the words of a text (id, w) fall in, the bucket and its words."""

    def work(batches):
        for batch in batches:
            flat, at = batch.column(1).values.to_numpy() & (BUCKETS - 1), batch.column(1).offsets.to_numpy()
            counted = [np.unique(flat[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
            rows = [(u << 20 | np.minimum(c, TOP)).astype(np.int32) for u, c in counted]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "bag"])

    return texts.select("id", "w").mapInArrow(work, "id long, bag array<int>")


def rarest(texts: DataFrame, similarity: float) -> DataFrame:
    """id, x: the words of each text (id, w) that one of its links must share. A link has at most d words of its own, for d
    changes allowed at the longest possible partner; so of any d + 1 of them one is shared, and if both sides take their first
    in one order of all words, the least shared word is among both. The order is by rarity."""
    each = texts.select("id", F.size("w").alias("n"), F.explode("w").alias("x"))
    amount = each.groupBy("id", "n", "x").agg(F.count("*").alias("c"))
    known = amount.join(each.groupBy("x").agg(F.count("*").alias("f")), "x")
    before = F.coalesce(F.sum("c").over(W.partitionBy("id").orderBy("f", "x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    most = F.floor((1 - similarity) * F.floor(F.col("n") / similarity + 1e-6) + 1e-6)
    return known.withColumn("before", before).where(F.col("before") <= most).select("id", "x")


def units(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """Members (k, s, x, id, n, comp) dealt to units of work: the group itself, if it has at most ``block`` members. A larger one
    is cut in bands of length, so that links are within a band or between neighbouring ones, and a band with more than
    ``block`` members in parts by hash; each two parts that may hold a link are a unit. ``side`` is 0 or 1, or 2 for both."""
    group = ["k", "s", "x"]
    step = -math.log(similarity) + 1e-6
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / step).cast("int")
    sizes = common.durable(members.groupBy(*group, band.alias("band")).agg(F.count("*").alias("m")))
    total = sizes.groupBy(*group).agg(F.sum("m").alias("total"))
    parts = F.ceil(F.col("m") / block).cast("int")
    cut = sizes.join(total.where(F.col("total") > block), group).select(*group, "band", parts.alias("parts"))
    neighbour = lambda by, name: cut.select(*group, (F.col("band") + by).alias("band"), F.col("parts").alias(name))
    cut = cut.join(neighbour(-1, "above"), [*group, "band"], "left").join(neighbour(1, "below"), [*group, "band"], "left")
    at = members.withColumn("band", band).join(cut, [*group, "band"], "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    unit = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), F.lit(side).alias("side"))
    numbers = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)) - 1), lambda q: q < F.coalesce(c, F.lit(0)))
    b, own, zero = F.col("band"), F.col("own"), F.lit(0)
    within = F.transform(numbers(F.col("parts")), lambda q: F.when(q == own, unit(b, own, b, own, 2)).when(own < q, unit(b, own, b, q, 0)).otherwise(unit(b, q, b, own, 1)))
    up = F.transform(numbers(F.col("above")), lambda q: unit(b, own, b + 1, q, 0))
    down = F.transform(numbers(F.col("below")), lambda q: unit(b - 1, q, b, own, 1))
    whole = F.array(unit(zero.cast("int"), zero, zero.cast("int"), zero, 2))
    return at.withColumn("unit", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(F.concat(within, up, down)))).select(*group, "unit.*", "id", "comp", "n")


def possible(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the units' members, with head (the sketches before the group's) and bag, that share their first sketch
    in the group, are in two components, and may be similar by their lengths and bags."""

    def work(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).to_numpy()
        k, side, ids, comp, n = col("k")[0], col("side"), col("id"), col("comp"), col("n").astype(np.int64)
        head = table.column("head").combine_chunks().flatten().to_numpy().reshape(len(ids), k)
        bag = table.column("bag").combine_chunks()
        packed, words_in = bag.flatten().to_numpy(), np.diff(bag.offsets.to_numpy())
        counts = np.zeros((len(ids), BUCKETS), np.float32)
        amount = packed & TOP
        counts[np.repeat(np.arange(len(ids)), words_in), packed >> 20] = np.where(amount == TOP, 1e18, amount)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out, theirs = [np.zeros((0, 2), np.int64)], np.minimum(counts[right], 1e9)
        for c in range(0, len(left), 128):
            x = left[c : c + 128]
            longest = np.maximum(n[x][:, None], n[right][None, :])
            most = most_changes(longest, similarity)
            ok = (comp[x][:, None] != comp[right][None, :]) & (np.abs(n[x][:, None] - n[right][None, :]) <= most)
            ok &= (side[x][:, None] != 2) | (ids[x][:, None] < ids[right][None, :])
            if not ok.any():
                continue
            # The product of two counts is no less than the smaller one; a hair is left for rounding.
            ok &= (np.minimum(counts[x], 1e9) @ theirs.T) * 1.001 + 0.5 >= longest - most
            for q in range(k):
                ok &= head[x, q][:, None] != head[right, q][None, :]
            p, q = np.nonzero(ok)
            for e in range(0, len(p), 512):
                pp, qq = p[e : e + 512], q[e : e + 512]
                common_words = np.minimum(counts[x[pp]], counts[right[qq]]).sum(axis=1, dtype=np.float64)
                may = longest[pp, qq] - common_words <= most[pp, qq] + 0.5
                out.append(np.stack([ids[x[pp[may]]], ids[right[qq[may]]]], axis=1))
        pairs = np.sort(np.concatenate(out), axis=1)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return members.groupBy("k", "s", "x", "low", "i", "high", "j").applyInArrow(work, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, salt: int = 256) -> DataFrame:
    """Those of the pairs (a, b) whose texts (id, w) align. One a may have very many pairs: its text is repeated for every
    ``salt`` of them, and its pairs are spread over the repeats."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / salt).cast("int").alias("salts"))
    left = texts.select(F.col("id").alias("a"), F.col("w").alias("wa")).join(salts, "a").select("a", "wa", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    right = salted.join(texts.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", "wa", "wb")

    def work(batches):
        for batch in batches:
            (la, fa), (lb, fb) = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(3))]
            keep = np.zeros(batch.num_rows, bool)
            lengths = np.diff(la) + np.diff(lb)
            for s, e in common.spans(lengths, 1 << 19):
                a, b = [fa[la[i] : la[i + 1]] for i in range(s, e)], [fb[lb[i] : lb[i + 1]] for i in range(s, e)]
                most = most_changes(np.array([max(len(x), len(y)) for x, y in zip(a, b)]), similarity)
                keep[s:e] = aligned(a, b, most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(work, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, comp (smallest id in reach), written. Labels spread over the edges and then to the labels' own labels, each round
    written to the shared folder, until none changes."""
    e = common.durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = common.durable(e.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id")).withColumn("old", F.col("id")))
    while True:
        near = e.join(label, e.b == label.id).groupBy("a").agg(F.min("comp").alias("m"))
        low = label.join(near, label.id == near.a, "left").select("id", F.least("comp", F.coalesce("m", "comp")).alias("comp"), F.col("comp").alias("old"))
        jump = label.select(F.col("id").alias("j"), F.col("comp").alias("further"))
        stepped = common.durable(low.join(jump, F.col("comp") == F.col("j"), "left").select("id", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old"))
        common.discard(label)
        label = stepped
        if not label.where("comp <> old").limit(1).count():
            break
    out = common.durable(nodes.join(label, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))
    common.discard(e, label)
    return out


def text_classes(docs: DataFrame, similarity: float = 0.8, sketches: int = 96, block: int = 1024, refine: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): k1, k2 (128 bits of the words) of every row with its doc_id, and of every text with its class, a number."""
    durable, key = common.durable, ["k1", "k2"]
    drawn = durable(sketched(docs, sketches))
    rows = durable(drawn.select("doc_id", *key))
    # One row a text, numbered; what is written keeps its number.
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("holder")
    numbered = drawn.groupBy(*key).agg(holder, F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    text = durable(numbered.withColumn("id", F.monotonically_increasing_id()))
    common.discard(drawn)
    # Seeds make the values of different sketches different, so s alone is the group. Most have one member and go first.
    grouped = text.select("id", "n", F.posexplode("sketch").alias("k", "s")).select("id", "n", F.col("k").cast("short").alias("k"), "s")
    several = grouped.groupBy("s").agg(F.count("*").alias("size")).where("size > 1").select("s")
    in_group = durable(grouped.join(several.hint("shuffle_hash"), "s", "left_semi"))
    first = in_group.groupBy("s").agg(F.min_by("id", "n").alias("a"), F.min("n").alias("least"))
    member = durable(in_group.withColumnRenamed("id", "b").join(first, "s"))
    common.discard(in_group)
    near = F.col("n") - F.col("least") <= F.floor((1 - similarity) * F.col("n") + 1e-9)
    star = durable(member.where((F.col("a") != F.col("b")) & near).groupBy("a", "b").agg(F.min("k").alias("k")))
    involved = durable(member.select(F.col("b").alias("id")).distinct())
    wanted = text.join(involved, "id", "left_semi").select("id", F.col("holder.doc_id").alias("h"), F.col("holder.tk").alias("t"))
    own = common.text_key(F.col("text"))
    held = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("h")) & (own == F.col("t")))
    texts = durable(held.dropDuplicates(["id"]).select("id", words(F.col("text")).alias("w")))
    # The first sketches link nearly all; of the others' pairs, those that are then in two components are left.
    sooner = star.where(F.col("k") < FIRST).select("a", "b")
    links = durable(verified(sooner, texts, similarity))
    comp = components(involved, links)
    ends = star.where(F.col("k") >= FIRST).select("a", "b").join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
    later = durable(ends.join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb").select("a", "b"))
    links = durable(links.union(verified(later, texts, similarity)))
    common.discard(comp, later)
    comp = components(involved, links)
    # Groups still split: their possible pairs across components, but for those that the star has tried.
    at = member.join(comp.select(F.col("id").alias("b"), "comp"), "b")
    split = at.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2").select("s", "m")
    open_ = durable(at.join(split, "s").select("k", "s", "m", F.col("b").alias("id"), "n", "comp"))
    common.discard(member)
    some = texts.join(open_.select("id").distinct(), "id", "left_semi")
    carried = text.select("id", "sketch").join(bags(some), "id")
    dealt = open_.where(F.col("m") <= refine).withColumn("x", F.lit(None).cast("int"))
    if open_.where(F.col("m") > refine).limit(1).count():
        large = open_.where(F.col("m") > refine)
        shared_words = rarest(texts.join(large.select("id").distinct(), "id", "left_semi"), similarity)
        dealt = durable(dealt.unionByName(large.join(shared_words, "id").select("k", "s", "m", "id", "n", "comp", "x")))
    members = units(dealt.drop("m"), similarity, block).join(carried, "id").withColumn("head", F.slice("sketch", F.lit(1), F.col("k").cast("int"))).drop("sketch")
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = durable(possible(members, similarity).distinct().join(tried, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        comp = components(involved, durable(links.union(verified(more, texts, similarity))))
    named = durable(text.join(comp, "id", "left").select(*key, F.coalesce("comp", "id").alias("comp")))
    common.discard(text, texts, star, involved, open_, more)
    return rows, named


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) for every distinct non-null doc_id, of any type that has an order."""
    rows, texts = text_classes(docs.where("doc_id is not null"), **options)
    named = rows.join(texts, ["k1", "k2"])
    least = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return named.groupBy("doc_id", "comp").agg(F.lit(1).alias("one")).join(least, "comp").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def kept(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest doc_id, a null one last; of one id's, the one with the
    smallest hash of the text. Rows that repeat id and text are one row, and whichever comes first stays."""
    rows, texts = text_classes(docs, **options)
    order = lambda *extra: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), *extra)
    best = rows.join(texts, ["k1", "k2"]).groupBy("comp").agg(F.min(order(F.col("k1").alias("k1"), F.col("k2").alias("k2"))).alias("b"))
    stay = best.select(*row_key(F.col("b.i"), F.col("b.k1"), F.col("b.k2")))
    w = words(F.col("text"))
    # Rows are packed, so that no column's name can clash with the keys'.
    keyed = common.packed(docs).select("row", *row_key(F.col("doc_id"), F.xxhash64(w), F.xxhash64(F.lit(5), w)))
    return keyed.join(stay, ["_ka", "_kb"], "left_semi").dropDuplicates(["_ka", "_kb"]).select("row.*")


def row_key(doc_id: Column, k1: Column, k2: Column) -> list[Column]:
    """128 bits of an id, null or not, and a text's key."""
    parts = (doc_id.isNull(), doc_id, k1, k2)
    return [F.xxhash64(*parts).alias("_ka"), F.xxhash64(F.lit(9), *parts).alias("_kb")]
