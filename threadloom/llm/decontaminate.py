"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item (or a whole shorter item). Of every 5 consecutive 9-word hashes of
a text the minimum is kept; so a document that shares a window with an item shares at least one kept hash, on the same
words. Kept hashes of documents meet those of items, each meeting is extended word by word over at most 4 words to each
side, and meetings that span a window mark their words. Items under 13 words need a denser sampling: their first words'
hash is looked up at all positions of the documents. Words are compared by 64-bit hashes, of 9 words at least or of a
whole item, after the hash of all of them has met.

An item's row for a kept hash has the 17 word hashes about it and nothing else that grows, about 250 bytes. Up to
``block`` rows go to the executors at once; up to ``passes`` such blocks cost a pass over the documents each, and with
more of them documents' hashes are shuffled once to meet the items', then only documents that met one are extended.

Edge cases: null and empty texts have no words. Very long texts are one row of the same plan; nothing is compared pair by
pair in them. A null item_id still marks words but is not listed. Repeated items count once; rows that repeat doc_id and
text get the same result each. Empty tables give no hits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, GRAM = 13, 9
WINNOW = SPAN - GRAM + 1
REACH = SPAN - GRAM
#: ASCII without letters and digits.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Runs of ASCII letters (lowered), digits and non-ASCII characters: all else becomes a blank, and blanks split."""
    plain = F.translate(F.coalesce(text, F.lit("")), common.UPPER + BREAKS, common.UPPER.lower() + " " * len(BREAKS))
    return F.array_remove(F.split(plain, " ", -1), "")


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def grams(w: Column, n: int) -> Column:
    """Hash of the n words from each on; of fewer at the end, which meets nothing once words are compared. Elements are
    read one by one: a slice inside a lambda would copy the whole array."""
    return F.transform(w, lambda x, i: F.xxhash64(F.lit(n), x, *(F.get(w, i + k) for k in range(1, n))))


def minima(h: Column) -> Column:
    """The minimum of the 5 hashes from each on, or of as many as there are."""
    return F.transform(h, lambda x, i: F.least(x, *(F.get(h, i + k) for k in range(1, WINNOW))))


def kept(h: Column, m: Column) -> Column:
    """Positions of the hashes that are the minimum of a window about them: the largest of those minima is at most the
    hash itself, and equal to it just then."""
    return F.filter(everywhere(h), lambda p: F.greatest(F.get(m, p), *(F.get(m, p - k) for k in range(1, WINNOW))) == F.get(h, p))


def everywhere(h: Column) -> Column:
    return F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer copies the expression to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def winnowed(w: Column) -> Column:
    """(h, p): hashes at the kept positions."""
    return bound(grams(w, GRAM), lambda g: bound(minima(g), lambda m: F.transform(kept(g, m), lambda p: F.struct(F.get(g, p).alias("h"), p.alias("p")))))


def dense(w: Column, n: int) -> Column:
    """(h, p): hashes of n words at all positions."""
    return F.transform(grams(w, n), lambda h, i: F.struct(h.alias("h"), i.alias("p")))


def context(w: Column, p: Column) -> Column:
    """The words from 4 before p to 12 after it; null beyond the ends."""
    return F.array(*(F.get(w, p + k) for k in range(-REACH, GRAM + REACH)))


def numbered(items: DataFrame) -> DataFrame:
    """item_id, iw (the item's words), no (a number) for each different item with words."""
    w = items.select("item_id", hashed(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    return common.durable(w.withColumn("no", F.monotonically_increasing_id()))


def item_prints(listed: DataFrame) -> DataFrame:
    """One row for each kept hash of an item: h, no, need (words of a window), c (the words about it)."""
    size = F.size("iw")
    long = listed.where(size >= SPAN).select("no", "iw", F.explode(winnowed(F.col("iw"))).alias("x")).where(F.col("x.p") <= size - GRAM)
    rows = [long.select(F.col("x.h").alias("h"), "no", F.lit(SPAN).alias("need"), context(F.col("iw"), F.col("x.p")).alias("c"))]
    for n in range(1, GRAM + 1):
        first = F.xxhash64(F.lit(n), *(F.get("iw", F.lit(k)) for k in range(n)))
        short = listed.where((size < SPAN) & (F.least(size, F.lit(GRAM)) == n))
        rows.append(short.select(first.alias("h"), "no", size.alias("need"), context(F.col("iw"), F.lit(0)).alias("c")))
    return reduce(DataFrame.unionByName, rows).distinct()


def equal_run(a: Column, b: Column, step: int, i: Column, j: int, most: int) -> Column:
    """How many words agree one after another from a[i], b[j] on, in steps of +1 or -1, at most ``most``. Plain cases,
    no lambda: so join, filter and extension are one generated loop, and rows that meet nothing are never copied."""
    run = F.lit(most)
    for d in range(most - 1, -1, -1):
        run = F.when(F.coalesce(F.get(a, i + step * d) == F.get(b, F.lit(j + step * d)), F.lit(False)), run).otherwise(F.lit(d))
    return run


def extended(met: DataFrame) -> DataFrame:
    """Word ranges [a, b) of documents that meet whole windows. Of met rows, ``at`` is the position in the document and ``p``
    the same place in ``w``; rows with at = -1 pass, with the document's number of words as b."""
    w, c, p, at = (F.col(x) for x in ("w", "c", "p", "at"))
    row = at < 0
    ranged = met.withColumn("left", F.when(~row, equal_run(w, c, -1, p - 1, REACH - 1, REACH))).withColumn("right", F.when(~row, equal_run(w, c, 1, p, REACH, GRAM + REACH)))
    ranged = ranged.where(row | ((F.col("right") >= F.least("need", F.lit(GRAM))) & (F.col("left") + F.col("right") >= F.col("need"))))
    return ranged.select("doc_id", "tk", "no", F.when(~row, at - F.col("left")).alias("a"), F.when(row, F.size(w)).otherwise(at + F.col("right")).alias("b"))


def hits(docs: DataFrame, sides: DataFrame, block: int, passes: int) -> DataFrame:
    """doc_id, tk (hash of the text), no, a, b: ranges of words inside occurrences of an item's window; and for every row of
    ``docs`` one with a null ``a`` and its number of words in ``b``."""
    rows = sides.count()
    kinds = sorted(r.need for r in sides.select(F.when(F.col("need") < SPAN, F.least("need", F.lit(GRAM))).otherwise(SPAN).alias("need")).distinct().collect())  # at most 10
    w = docs.select("doc_id", common.text_key(F.col("text")).alias("tk"), hashed(F.col("text")).alias("w"))
    mark = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("p")))
    if not kinds:
        return w.select("doc_id", "tk", F.lit(None).cast("long").alias("no"), F.lit(None).cast("int").alias("a"), F.size("w").alias("b"))
    # Outer, so that no filter on the hashes is inferred and computed beside them. Position -1 stands for the row.
    places = lambda more: F.concat(*more, *(winnowed(F.col("w")) if n == SPAN else dense(F.col("w"), n) for n in kinds))
    placed = lambda d, more: d.select("doc_id", "tk", "w", F.explode_outer(places(more)).alias("x")).select("doc_id", "tk", "w", F.col("x.h").alias("h"), F.col("x.p").alias("p"), F.col("x.p").alias("at"))
    blocks = max(1, -(-rows // block))
    if blocks <= passes:
        found = []
        for b in range(blocks):
            part = F.broadcast(sides.where(F.pmod(F.xxhash64("h", "no"), F.lit(blocks)) == b))
            met = placed(w, [mark] if b == 0 else []).join(part, "h", "left").where("at = -1 or need is not null")
            found.append(extended(met))
        return reduce(DataFrame.unionByName, found)
    own = common.text_key(F.col("text"))
    meeting = placed(w, []).select("doc_id", "tk", "h").where("h is not null").join(sides.select("h").distinct(), "h", "left_semi").select("doc_id", "tk").distinct()
    meeting = meeting.select(F.col("doc_id").alias("m_id"), F.col("tk").alias("m_tk"))
    some = docs.select("doc_id", "text").join(meeting, F.col("doc_id").eqNullSafe(F.col("m_id")) & (own == F.col("m_tk")), "left_semi")
    some = placed(some.select("doc_id", own.alias("tk"), hashed(F.col("text")).alias("w")), []).where("h is not null")
    met = some.select("doc_id", "tk", "h", "at", context(F.col("w"), F.col("p")).alias("w"), F.lit(REACH).alias("p")).join(sides, "h")
    marks = w.select("doc_id", "tk", F.lit(None).cast("long").alias("no"), F.lit(None).cast("int").alias("a"), F.size("w").alias("b"))
    return marks.unionByName(extended(met))


def decontaminate(docs: DataFrame, items: DataFrame, block: int = 200_000, passes: int = 2, cut: int = 20) -> DataFrame:
    """doc_id, tk, n_words, n_hit, items (sorted strings), contaminated (a ``cut``-th of the words or more is hit) for every row."""
    known = numbered(items.select("item_id", "text"))
    found = common.durable(hits(docs.select("doc_id", "text"), common.durable(item_prints(known)), block, passes))
    key = ["doc_id", "tk"]
    rows = found.where("a is null").groupBy(*key).agg(F.count("*").cast("int").alias("copies"), F.max("b").cast("long").alias("n_words")).alias("d")
    met = found.where("a is not null")
    places = met.select(*key, F.explode(F.sequence("a", F.col("b") - 1)).alias("i")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit")).alias("p")
    named = known.where("item_id is not null").select("no", F.col("item_id").cast("string").alias("item"))
    listed = met.select(*key, "no").distinct().join(named, "no").select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items")).alias("q")
    same = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("d.tk") == F.col(f"{other}.tk"))
    joined = (
        rows.join(places, same("p"), "left")
        .join(listed, same("q"), "left")
        .select("d.doc_id", "d.tk", "copies", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
    each = joined.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * cut >= F.col("n_words")))
    return each.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies")
