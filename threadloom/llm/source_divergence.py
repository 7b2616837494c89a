"""Source divergence audit: how differently the sources of a language use its words.

Words are counted by language and source. A language keeps the words that enough of its documents hold. Kept words with the
same sparse vector of source counts are one: each pair of sources, and each source against its language, is evaluated once
for a distinct vector, and pair sums take it as often as it has words. What ranks are the words themselves: of those that
share a vector, the first ``top`` by name are enough for the first ``top`` ranks.

Pair sums are taken over cells of two blocks of sources and a part of the vectors. A vector comes to a cell by its counts
there only; all vectors without a count in the cell share one term, (kept words) x |p0 - q0|, which is added once.

Edge cases: null text, language and source count as empty ones, and empty names are names like others. A source without words
of the kept ones, and a language without any (no term rows; pairs of value 0), have rows too. Very long texts are counted whole; ties are ranked by name in
UTF-8 order. Rows that repeat are documents each. An empty table gives no rows. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: ASCII letters lowered, bytes of other characters as they are, all else blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE, SMOOTH = 1_000_000_000, 5
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def counted(docs: DataFrame, flush: int = 600_000) -> DataFrame:
    """lang, source, term, docs, n: documents that hold the term and its occurrences, summed over each task's input or, to bound
    its memory, over stretches of it with ``flush`` different entries."""

    def count(batches):
        n, held = {}, {}

        def rows():
            for group, terms in n.items():
                keys = list(terms)
                columns = [pa.array([group[0]] * len(keys), pa.string()), pa.array([group[1]] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string())]
                columns += [pa.array([held[group][k] for k in keys], pa.int64()), pa.array([terms[k] for k in keys], pa.int64())]
                table = pa.RecordBatch.from_arrays(columns, schema=COUNTED)
                yield from (table.slice(i, 50_000) for i in range(0, len(keys), 50_000))

        seen = 0
        for batch in batches:
            for own, texts in common.texts_of(batch):
                for lang, source, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), texts):
                    words = text.encode().translate(LETTERS).split()
                    terms = n.setdefault((lang, source), Counter())
                    before = len(terms)
                    terms.update(words)
                    held.setdefault((lang, source), Counter()).update(set(words))
                    seen += len(terms) - before
                if seen > flush:
                    yield from rows()
                    n, held, seen = {}, {}, 0
        yield from rows()

    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    each = named.mapInArrow(count, "lang string, source string, term string, docs long, n long")
    return each.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / total), exactly; 0 where there is nothing to share."""
    exact = (n + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(total > 0, 1 + F.call_function("div", exact, total.cast("decimal(19,0)"))).otherwise(0).cast("long")


def vectors(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, vec (source, n; by source): the words that ``least`` documents of the language hold. A vector has an entry
    a source at most."""
    t = counted(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return t.where(F.col("docs") >= least).select("lang", "term", "vec")


def _pair_sums(cell: pa.Table) -> pa.Table:
    """Of one cell: sums over its vectors of times * (|p - q| - |p0 - q0|), and the base in part 0."""
    c = {n: cell.column(n).to_numpy(zero_copy_only=False) for n in ("i", "j", "part", "block", "idx", "p", "times", "kept", "rep", "source")}
    head = c["rep"] == None  # noqa: E711  an array of objects
    i, j, part = c["i"][0], c["j"][0], c["part"][0]
    rows = np.flatnonzero(head)
    rows = rows[np.argsort(c["idx"][rows], kind="stable")]
    names, p0, block = c["source"][rows], c["p"][rows], c["block"][rows]
    place = {x: k for k, x in enumerate(c["idx"][rows].tolist())}
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sums = np.zeros((len(left), len(right)), np.int64)
    zero = np.abs(p0[left][:, None] - p0[right][None, :])
    entry = np.flatnonzero(~head)
    if len(entry):
        reps, of = np.unique(c["rep"][entry].astype(str), return_inverse=True)
        p = np.repeat(p0[None, :], len(reps), axis=0)
        p[of, [place[x] for x in c["idx"][entry].tolist()]] = c["p"][entry]
        times = np.zeros(len(reps), np.int64)
        times[of] = c["times"][entry]
        for k, a in enumerate(left):
            sums[k] = times @ np.abs(p[:, [a]] - p[:, right])
        sums -= times.sum() * zero
    if part == 0:
        sums += c["kept"][rows[0]] * zero
    s, o = np.repeat(left, len(right)), np.tile(right, len(left))
    value, lang = sums.ravel(), cell.column("lang")[0].as_py()
    if i < j:
        s, o, value = np.concatenate([s, o]), np.concatenate([o, s]), np.concatenate([value, value])
    keep = s != o
    return pa.table({"lang": pa.array([lang] * int(keep.sum()), pa.string()), "source": pa.array(names[s[keep]], pa.string()), "item": pa.array(names[o[keep]], pa.string()), "value": pa.array(value[keep], pa.int64())})


def audit(docs: DataFrame, least: int = 30, top: int = 50, block: int = 128, part: int = 500, few: int = 50_000) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the language by the summed differences of their
    shares of the kept words. Part ``term``: the ``top`` words that the source uses more than its language. A cell has ``block``
    sources on each side and about ``part`` vectors; up to ``few`` sources are broadcast to the joins."""
    terms = common.durable(vectors(docs, least))
    distinct = common.durable(terms.groupBy("lang", "vec").agg(F.count("*").alias("times"), F.min("term").alias("rep")))
    n = distinct.select("lang", "times", F.inline("vec")).groupBy("lang", "source").agg(F.sum(F.col("times") * F.col("n")).alias("all_n"))
    langs = distinct.groupBy("lang").agg(F.sum("times").alias("kept"), F.sum(F.col("times") * F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("lang_n"), F.ceil(F.count("*") / part).alias("parts"))
    found = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    sources = found.join(n, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("all_n", "kept", "lang_n", "parts")))
    idx = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sources = common.durable(sources.withColumn("total", F.col("all_n") + SMOOTH * F.col("kept")).withColumn("idx", idx).withColumn("block", F.floor(F.col("idx") / block).cast("int")).withColumn("blocks", F.max("block").over(W.partitionBy("lang")) + 1))
    at_hand = F.broadcast(sources) if sources.count() <= few else sources
    tot = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("tot")
    entries = distinct.select("lang", "rep", "times", tot, F.inline("vec")).join(at_hand, ["lang", "source"])
    entries = entries.select("lang", "source", "rep", "times", share(F.col("n"), F.col("total")).alias("p"), share(F.col("tot"), F.col("lang_n") + SMOOTH * F.col("kept")).alias("q"), "idx", "block", "blocks", "parts", "kept")

    # Pairs.
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    shape = ("lang", "i", "j", "part", "source", "idx", "block", "p", "times", "kept", "rep")
    heads = sources.withColumn("p", share(F.lit(0), F.col("total"))).select("*", F.inline(other)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts") - 1, F.lit(0))))).withColumn("times", F.lit(0).cast("long")).withColumn("rep", F.lit(None).cast("string"))
    dealt = entries.select("*", F.inline(other)).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    cells = heads.select(*shape).unionByName(dealt.select(*shape)).groupBy("lang", "i", "j", "part").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    pairs = cells.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    # Terms.
    more = entries.where(F.col("p") > F.col("q")).select("lang", "rep", "source", (F.col("p") - F.col("q")).alias("value"))
    own = terms.join(distinct.select("lang", "vec", "rep"), ["lang", "vec"]).select("lang", "rep", "term")
    first = own.withColumn("r", F.row_number().over(W.partitionBy("lang", "rep").orderBy("term"))).where(F.col("r") <= top)
    words = more.join(first, ["lang", "rep"]).select("lang", "source", F.col("term").alias("item"), "value")

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    shown = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank)
    return shown(pairs, "pair").unionByName(shown(words, "term").where(F.col("rank") <= top))
