"""Similarity of vectors: exact pairs in blocks, top neighbours, components, clusters, comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded
from .store import kept, ranked


def _ids(vectors: DataFrame) -> str:
    return "string" if vectors.schema["id"].dataType.simpleString() == "string" else "long"


def _values(vectors: DataFrame) -> str:
    """Floats stay floats until they are compared, which halves what is shuffled; other numbers are doubles."""
    return "array<float>" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"


def keyed(vectors: DataFrame) -> DataFrame:
    """id, v, h1, h2 of the vectors that count: with an id, a length and a dimension. Equal vectors have the same 128 bits."""
    v = vectors.where(F.col("id").isNotNull() & (F.size("v") > 0)).select(F.col("id").cast(_ids(vectors)).alias("id"), F.col("v").cast(_values(vectors)).alias("v"))
    return v.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))


def classes(vectors: DataFrame, most: int = 1) -> DataFrame:
    """A row for each different vector: id (the smallest of its copies), v, h1, h2, copies, first (the ``most`` smallest ids). Copies
    are counted before they are shuffled, and of a class no more than ``most`` rows of any task are."""
    rows = keyed(vectors)
    n = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= max(1, most))
    one = first.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list("id")).alias("first"))
    return one.join(n, ["h1", "h2"]).select("id", "v", "h1", "h2", "copies", "first")


def with_class(vectors: DataFrame, found: DataFrame, heavy: int = 1_000, few: int = 100_000) -> DataFrame:
    """The vectors' ids, as ``member``, with the columns of their classes. Classes of over ``heavy`` copies, of which there are few, go to
    the vectors by a broadcast, so that no task gathers one."""
    rows = keyed(vectors).select(F.col("id").alias("member"), "h1", "h2")
    large = found.where(F.col("copies") > heavy)
    n = large.count()
    if not 0 < n <= few:
        return rows.join(found, ["h1", "h2"])
    hot = rows.join(F.broadcast(large), ["h1", "h2"])
    return hot.unionByName(rows.join(F.broadcast(large.select("h1", "h2")), ["h1", "h2"], "left_anti").join(found.where(F.col("copies") <= heavy), ["h1", "h2"]))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None]


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the unit vectors, each the farthest from those before."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def blocks_of(reps: DataFrame, n: int, block_rows: int, pivots: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors with a ``block``: runs of ``block_rows`` in the order of their nearest pivot and the angle to it. Pivots are chosen of at
    most 1,024 vectors, first by hash."""
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(1024).select("v").collect()
    p = spread_out(unit(np.array([r.v for r in sample])), pivots)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cos = unit(np.stack(f.v.to_numpy())) @ p.T
            cell = cos.argmax(axis=1)
            yield f.assign(cell=cell, near=np.arccos(np.clip(cos[np.arange(len(f)), cell], -1, 1)))

    kind = _ids(reps)
    placed = reps.select("id", "v").mapInPandas(place, f"id {kind}, v {_values(reps)}, cell int, near double")
    return ranked(placed, [F.col("cell"), F.col("near"), F.col("id")], "number").select("id", "v", F.floor((F.col("number") - 1) / block_rows).cast("int").alias("block")), p


def near_blocks(blocked: DataFrame, p: np.ndarray, threshold: float) -> tuple[DataFrame, Callable, int, int]:
    """The pairs of blocks (i <= j) that may hold a pair of vectors with cosine ``threshold`` or more, the test of a block against others,
    how many pairs, and of how many. By the triangle inequality on angles: for any pivot, vectors in blocks whose angles to it lie
    in ranges with a gap differ by that gap at least. Ranges are taken in each task first, so no vector is shuffled for them."""

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            angle = pd.DataFrame(np.arccos(np.clip(unit(np.stack(f.v.to_numpy())) @ p.T, -1, 1))).groupby(f.block.to_numpy())
            low, high = angle.min(), angle.max()
            yield pd.DataFrame({"block": np.repeat(low.index.to_numpy(), len(p)), "pivot": np.tile(np.arange(len(p)), len(low)), "low": low.to_numpy().ravel(), "high": high.to_numpy().ravel()})

    ranges = blocked.select("block", "v").mapInPandas(ends, "block int, pivot int, low double, high double").groupBy("block", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = ranges.orderBy("block", "pivot").toPandas()  # a row a block and pivot, of which ``similar_pairs`` bounds the number
    low, high, number = rows.low.to_numpy().reshape(-1, len(p)), rows.high.to_numpy().reshape(-1, len(p)), rows.block.to_numpy()[:: len(p)]
    # A hair more, for angles that round.
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-7

    def near(block: int, others: np.ndarray) -> np.ndarray:
        at, to = np.searchsorted(number, block), np.searchsorted(number, others)
        return np.maximum(low[to] - high[at], low[at] - high[to]).max(axis=1) <= reach

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in f.id:
                yield pd.DataFrame({"i": number[at], "j": number[at:][near(number[at], number[at:])]})

    pairs = kept(blocked.sparkSession.range(len(number)).mapInPandas(met, "i int, j int"))
    return pairs, near, pairs.count(), len(number) * (len(number) + 1) // 2


class _Best:
    """The ``k`` best of each of ``n`` rows so far, ties by ``order`` of the other row; ``floor`` is what a score must reach to be among them."""

    def __init__(self, n: int, k: int, threshold: float, order: np.ndarray):
        self.k, self.threshold, self.order = k, threshold, order
        self.score, self.near, self.floor = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.full(n, threshold, float)

    def add(self, rows: np.ndarray, others: np.ndarray, score: np.ndarray) -> None:
        passed = score >= self.floor[rows]
        if not passed.any():
            return
        u, at = np.unique(rows[passed], return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(u)), self.k)])
        others, score = np.concatenate([others[passed], self.near[u].ravel()]), np.concatenate([score[passed], self.score[u].ravel()])
        by = np.lexsort((self.order[others], -score, at))
        by = by[np.arange(len(by)) - np.searchsorted(at[by], at[by]) < self.k]
        self.score[u], self.near[u] = score[by].reshape(-1, self.k), others[by].reshape(-1, self.k)
        self.floor[u] = np.maximum(self.threshold, self.score[u, -1])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    lengths = np.unique(c.value_lengths().to_numpy())
    if len(lengths) != 1:
        raise ValueError(f"vectors of different dimensions: {lengths[:5].tolist()}")
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), lengths[0])


def _scores(x: np.ndarray, a: np.ndarray, b: np.ndarray, some: int = 1 << 22) -> np.ndarray:
    """Products of rows ``a`` and ``b``, each in the same order of steps wherever it stands; ``some`` values at a time."""
    step = max(1, some // x.shape[1])
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[a[s : s + step]], x[b[s : s + step]]) for s in range(0, len(a), step))])


def rows_a_block(n: int, dims: int, block_rows: int, most_blocks: int, block_bytes: int) -> int:
    """Blocks grow with the vectors where there would be over ``most_blocks``, until one has ``block_bytes``."""
    return max(block_rows, min(-(-n // most_blocks), block_bytes // (8 * dims)))


def blocks_a_stripe(blocks: int, block_rows: int, dims: int, stripes: int, block_bytes: int) -> int:
    """A vector is sent once for each stripe, a run of blocks, so there are ``stripes`` at most, and what is sent grows as the vectors do,
    until a stripe has ``block_bytes``."""
    return max(1, min(-(-blocks // stripes), block_bytes // (8 * dims * block_rows)))


def _hits(passed: np.ndarray) -> np.ndarray:
    """Places of the true values, which are few, in a flat array: eight are looked at at once."""
    whole = len(passed) // 8 * 8
    some = np.flatnonzero(passed[:whole].view(np.uint64))
    row, at = np.nonzero(passed[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[row] * 8 + at, whole + np.flatnonzero(passed[whole:])])


def class_pairs(
    reps: DataFrame, threshold: float, block_rows: int = 2048, k: int | None = None, pivots: int = 32, most_blocks: int = 40, n: int | None = None, block_bytes: int = 64 << 20, stripes: int = 10, most_groups: int = 1_000
) -> DataFrame:
    """a, b, score of different vectors (id, v) with cosine ``threshold`` or more, exactly: every pair once (a < b), or with ``k``
    each vector's k best with their rank, ties to the smaller id (a row from either end). ``n`` is their number, if it is known.

    Vectors are cut into blocks along pivots; pairs of blocks that no such pair can lie in are left out (``multiplied`` of
    ``block_pairs`` stay). The others are dealt by pairs of stripes, runs of blocks: each is one group of bounded size, in which the
    pairs of blocks that stay are multiplied in tiles, so no pair of rows is ever a Spark row unless it passes. Up to
    ``most_groups`` groups have a partition each, which a task takes as it comes; more are grouped by a sort.

    A tile is first multiplied in single precision. What comes within its error of the threshold, or with ``k`` of a row's k-th best
    so far, is multiplied in double precision, which alone decides."""
    kind, n = _ids(reps), reps.count() if n is None else n
    multiplied = total = groups = run = 1
    near = lambda block, others: np.ones(len(others), bool)
    if n <= block_rows:
        dealt = reps.select("id", "v", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        group = F.lit(0)
    else:
        dims = reps.select(F.size("v")).first()[0]
        block_rows = min(rows_a_block(n, dims, block_rows, most_blocks, block_bytes), -(-n // stripes))
        run = blocks_a_stripe(-(-n // block_rows), block_rows, dims, stripes, block_bytes)
        number = -(-n // (block_rows * run))
        groups = number * (number + 1) // 2
        blocked, p = blocks_of(reps, n, block_rows, pivots)
        pairs, near, multiplied, total = near_blocks(blocked, p, threshold)
        stripe = lambda c: F.floor(F.col(c) / run).cast("int")
        sides = pairs.select(F.explode(F.array("i", "j")).alias("block"), stripe("i").alias("i"), stripe("j").alias("j")).distinct()
        dealt = blocked.join(F.broadcast(sides) if 2 * multiplied <= 1_000_000 else sides, "block").select("id", "v", "block", "i", "j")
        # Those of a stripe with itself, which are half as large, come last.
        group = (F.when(F.col("i") < F.col("j"), F.col("j") * (F.col("j") - 1) / 2).otherwise(number * (number - 1) // 2) + F.col("i")).cast("int")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = list(batches)
        if not some:
            return
        rows = pa.Table.from_batches(some)
        x, ids, block = unit(_matrix(rows["v"])), rows["id"].to_numpy(), rows["block"].to_numpy()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        del some, rows
        order = np.argsort(np.argsort(ids))
        best = _Best(len(x), k, threshold, order) if k is not None else None
        floor = best.floor if best else np.full(len(x), threshold, float)
        # Twice the error of a product of ``dims`` steps in single precision.
        single, slack = x.astype(np.float32), (x.shape[1] + 4) * 2.0**-23
        answer = lambda a, b, score: pa.RecordBatch.from_arrays([pa.array(ids[a], pa.string() if kind == "string" else pa.int64()), pa.array(ids[b], pa.string() if kind == "string" else pa.int64()), pa.array(score)], names=["a", "b", "score"])
        tiles = {}
        for one in np.unique(block).tolist():
            at = np.flatnonzero(block == one)
            tiles[one] = np.array_split(at, -(-len(at) // 1024))
        left, right = [one for one in tiles if one // run == i], np.array([one for one in tiles if one // run == j], int)
        met = ((one, other) for one in left for others in [right[right >= one]] for other in others[near(one, others)].tolist())
        for one, other, at, to in ((one, other, at, to) for one, other in met for at in range(len(tiles[one])) for to in range(at if one == other else 0, len(tiles[other]))):
            p, q = tiles[one][at], tiles[other][to]
            low = (floor - slack).astype(np.float32)
            score = single[p] @ single[q].T
            passed = score >= low[p][:, None]
            if best:
                passed |= score >= low[q][None, :]
            a, b = np.divmod(_hits(passed.ravel()), len(q))
            if one == other and at == to:
                a, b = a[a < b], b[a < b]
            a, b = p[a], q[b]
            exact = _scores(x, a, b)
            enough = exact >= threshold
            a, b, exact = a[enough], b[enough], exact[enough]
            if best:
                best.add(a, b, exact)
                best.add(b, a, exact)
            elif len(a):
                swap = order[a] > order[b]
                yield answer(np.where(swap, b, a), np.where(swap, a, b), exact)
        if best:
            a, place = np.nonzero(best.score > -np.inf)
            yield answer(a, best.near[a, place], best.score[a, place])

    shape = f"a {kind}, b {kind}, score double"
    found = dealt.repartitionById(groups, group).mapInArrow(product, shape) if groups <= most_groups else dealt.groupBy("i", "j").applyInArrow(product, shape)
    if k is not None:
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.col("score").desc(), "b"))).where(F.col("rank") <= k)
    found.multiplied, found.block_pairs = multiplied, total
    return found


def similar_pairs(vectors: DataFrame, threshold: float, **options) -> DataFrame:
    """a, b (a < b), score: all pairs of different vectors of (id, v) with cosine ``threshold`` or more, exactly. Copies of a vector are one
    class with its smallest id (see ``similar_classes`` for members). Vectors without length or dimension are left out. Ids
    are numbers or texts."""
    return class_pairs(kept(classes(vectors).select("id", "v")), threshold, **options)


def similar_classes(vectors: DataFrame, threshold: float, **options) -> DataFrame:
    """id, class_id, copies (with itself), links (other vectors with cosine ``threshold`` or more) for every vector: with the pairs of
    ``similar_pairs`` all links, in proportion to the rows."""
    c = kept(classes(vectors))
    pairs = class_pairs(c.select("id", "v"), threshold, **options)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    linked = both.join(c.select(F.col("id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    alike = F.when((F.lit(threshold) <= 1) & F.exists("v", lambda x: x != 0), F.col("copies") - 1).otherwise(0)
    counted = kept(c.join(linked, "id", "left").select("h1", "h2", F.col("id").alias("class_id"), "copies", (alike + F.coalesce("others", F.lit(0))).alias("links")))
    return with_class(vectors, counted).select(F.col("member").alias("id"), "class_id", "copies", "links")


def best_neighbors(vectors: DataFrame, threshold: float, k: int = 4, **options) -> DataFrame:
    """id, neighbor, score, rank: each vector's ``k`` best others with cosine ``threshold`` or more, ties to the smaller id. Copies are
    compared once, and of a class its k + 1 smallest ids are enough: all of its members have the same scores. Where no vector
    has a copy, which is counted first, the classes are the vectors themselves."""
    rows = keyed(vectors)
    n = rows.agg(F.count("*").alias("all"), F.countDistinct("h1", "h2").alias("different")).first()
    if n["all"] == n["different"]:
        return class_pairs(rows.select("id", "v"), threshold, k=k, n=n["all"], **options).select(F.col("a").alias("id"), F.col("b").alias("neighbor"), "score", "rank")
    c = kept(classes(vectors, k + 1))
    pairs = class_pairs(c.select("id", "v"), threshold, k=k, **options)
    theirs = pairs.join(c.select(F.col("id").alias("b"), "first"), "b").select(F.col("a").alias("id"), F.transform("first", lambda x: F.struct((-F.col("score")).alias("s"), x.alias("n"))).alias("near"))
    near = theirs.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    none = F.array().cast(near.schema["near"].dataType)
    own = F.when((F.lit(threshold) <= 1) & F.exists("v", lambda x: x != 0), F.transform("first", lambda x: F.struct(F.lit(-1.0).alias("s"), x.alias("n")))).otherwise(none)
    # One of them may be the vector itself.
    listed = F.slice(F.array_sort(F.concat(own, F.coalesce("near", none))), 1, k + 1)
    best = kept(c.join(near, "id", "left").select("h1", "h2", "copies", listed.alias("best")))
    mine = with_class(vectors, best).select(F.col("member").alias("id"), F.slice(F.filter("best", lambda x: x["n"] != F.col("member")), 1, k).alias("best"))
    return mine.select("id", F.posexplode("best").alias("rank", "x")).select("id", F.col("x.n").alias("neighbor"), (-F.col("x.s")).alias("score"), (F.col("rank") + 1).alias("rank"))


def edges_of(best: DataFrame, k: int = 4) -> DataFrame:
    """a, b, weight: pairs of which either end has the other among its ``k`` best (at least 1)."""
    own = best.where(F.col("rank") <= max(1, k))
    return own.groupBy(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b")).agg(F.bround(F.max("score"), 4).alias("weight"))


def top_edges(pairs: DataFrame, k: int = 4) -> DataFrame:
    """a, b, weight: pairs that either end ranks among its ``k`` best, ties to the smaller neighbour."""
    both = pairs.select("a", "b", "score").union(pairs.select("b", "a", "score"))
    best = both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.col("score").desc(), "b"))).where(F.col("r") <= max(1, k))
    return best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bround(F.max("score"), 4).alias("weight"))


def neighbors(edges: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """id, neighbor, weight, rank: both directions, best first; on ties by the neighbour's title (id, title), in any case, where
    titles are given, then by its id."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("neighbor"), "weight").union(edges.select("b", "a", "weight"))
    if titles is None:
        return both.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.col("weight").desc(), "neighbor")))
    named = both.join(titles.select(F.col("id").alias("neighbor"), "title"), "neighbor", "left").withColumn("title", F.coalesce("title", "neighbor"))
    order = W.partitionBy("id").orderBy(F.col("weight").desc(), folded(F.col("title")), "neighbor")
    return named.select("id", "neighbor", "title", "weight", F.row_number().over(order).alias("rank"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (smallest id in reach): labels spread along edges and jump to their own labels until none changes."""
    e = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = kept(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = e.join(label, e.b == label.id).groupBy("a").agg(F.min("component").alias("near"))
        low = label.join(near, label.id == near.a, "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = label.select(F.col("id").alias("at"), F.col("component").alias("next"))
        label = kept(low.join(jump, low.component == jump.at, "left").select("id", F.least("component", "next").alias("component"), "old"))
        if label.where("component <> old").isEmpty():
            return label.select("id", "component")
        label = label.select("id", "component")


def numbered(found: DataFrame, prefix: str = "cluster") -> DataFrame:
    """id, cluster: components numbered by their smallest id, from 0001."""
    named = ranked(found.select("component").distinct(), [F.col("component")], "number")
    return found.join(named, "component").select("id", F.format_string(f"{prefix}:%04d", "number").alias("cluster"))


def snapshot(vectors: DataFrame, titles: DataFrame, threshold: float, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """The edges and titled neighbour lists of one provider's vectors."""
    edges = kept(edges_of(best_neighbors(vectors, threshold, max(1, k)), k))
    return edges, neighbors(edges, titles)


def compared(left: DataFrame, right: DataFrame, titles: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Two providers' edges: their overlap, and the ids whose neighbours differ most, by title on ties."""
    differences = neighbor_changes(left, right, None).join(titles, "id", "left")
    return edge_overlap(left, right), differences.orderBy(F.col("difference").desc(), folded(F.coalesce("title", F.col("id").cast("string"))), "id").limit(top)


def edge_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """overlap, union_n, jaccard of two edge sets; two empty sets agree."""
    l, r = left.select("a", "b").distinct().withColumn("l", F.lit(1)), right.select("a", "b").distinct().withColumn("r", F.lit(1))
    n = l.join(r, ["a", "b"], "full").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("overlap"), F.count("*").alias("union_n"))
    return n.withColumn("jaccard", F.when(F.col("union_n") == 0, 1.0).otherwise(F.bround(F.col("overlap") / F.col("union_n"), 4)))


def neighbor_changes(left: DataFrame, right: DataFrame, top: int | None = 50) -> DataFrame:
    """id, shared, left_only, right_only, difference: the ``top`` ids whose neighbours differ most, or all."""
    l = neighbors(left).select("id", "neighbor", F.lit(1).alias("l"))
    r = neighbors(right).select("id", "neighbor", F.lit(1).alias("r"))
    j = l.join(r, ["id", "neighbor"], "full").groupBy("id").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    j = j.withColumn("difference", F.col("left_only") + F.col("right_only"))
    return j if top is None else j.orderBy(F.col("difference").desc(), "id").limit(top)


def devices(mode: str, cuda: int = 0, directml: int = 0) -> list[tuple[str, dict]]:
    """Execution providers to try in order, with the device each is to use."""
    chains = {"cpu": [], "cuda": ["CUDAExecutionProvider"], "directml": ["DmlExecutionProvider"], "auto": ["CUDAExecutionProvider", "DmlExecutionProvider"]}
    number = {"CUDAExecutionProvider": cuda, "DmlExecutionProvider": directml}
    return [*((d, {"device_id": number[d]}) for d in chains[mode]), ("CPUExecutionProvider", {})]


def inputs_of(pieces, most: int):
    """Texts to a model's input arrays."""

    def encode(texts: list[str]) -> dict[str, np.ndarray]:
        rows = [pieces.encode(t or "", most) for t in texts]
        return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("input_ids", "attention_mask", "token_type_ids"))}

    return encode


def pooled(x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """One vector a row of length 1: token outputs are averaged over the mask."""
    if x.ndim == 3:
        m = mask[:, :, None]
        x = (x * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def embed_onnx(texts: DataFrame, model_path: str, encode, outputs: tuple[str, ...] = ("sentence_embedding", "embeddings", "last_hidden_state"), devices: list[tuple[str, dict]] | None = None, batch: int = 64) -> DataFrame:
    """id, v from (id, text) by an ONNX model that executors can read at ``model_path``; ``encode`` turns a list of texts into the
    model's inputs, of which it gets those that it has, in its integer type. One session a task, on the first device there is. Where a batch fails its rows are tried one by one, and
    a row that fails has no vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        have = onnxruntime.get_available_providers()
        session = onnxruntime.InferenceSession(model_path, providers=[d for d in devices or [("CPUExecutionProvider", {})] if d[0] in have])
        names = [o.name for o in session.get_outputs()]
        name = next((o for o in outputs if o in names), names[0])
        kinds = {i.name: np.int32 if "int32" in i.type else np.int64 for i in session.get_inputs()}

        def vectors(some: list[str]) -> list[np.ndarray]:
            inputs = encode(some)
            x = session.run([name], {k: inputs[k].astype(t) for k, t in kinds.items()})[0]
            return list(pooled(x, inputs.get("attention_mask")).astype(np.float64))

        def alone(text: str) -> np.ndarray | None:
            try:
                return vectors([text])[0]
            except Exception:
                return None

        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                try:
                    yield pd.DataFrame({"id": some.id, "v": vectors(some.text.tolist())})
                except Exception:
                    yield pd.DataFrame({"id": some.id, "v": [alone(t) for t in some.text]})

    return texts.mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, v array<double>")
