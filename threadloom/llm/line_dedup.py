"""Line dedup, in DataFrame functions only.

Every line's key hash (128 bits) is written once with its document and position. Hashes are range-partitioned with a
secondary sort by document and position; running sums over the sorted rows, from either end, tell first occurrences (in
the largest doc_id) from repeats and how many documents there are, with no frame that waits for the end of a key.
Hashes with more than ``heavy`` rows, a fixed number, never meet in one task: their verdicts come from counts that are
summed before each shuffle, and their rows get them by a join, broadcast only where at most ``small`` such hashes were
counted. What comes back is a compressed bitmap for each document: runs (start, length) of dropped lines. Texts are only
touched when a bitmap is applied.

Edge cases: null or empty text is one empty line. Keys under ``least`` code points never count. Very long texts are split
in one pass, and very long lines are hashed. Rows that repeat doc_id and text are one document; those that repeat the
doc_id alone count each, and all lines of the largest doc_id stay in each of its rows. A null doc_id is smaller than any
other. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, least: int = 20) -> DataFrame:
    """h1, h2, doc_id, tk, at (positions of the key in the document): one row for a key and document."""
    source = docs.select("doc_id", common.text_key(F.col("text")).alias("tk"), F.posexplode(lines(common.ascii_lower(F.col("text")))).alias("p", "line"))
    keyed = source.withColumn("line", F.btrim("line", F.lit(common.BLANK))).where(F.char_length("line") >= least)
    return keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "doc_id", "tk", "p")


def dropped_lines(docs: DataFrame, least: int = 20, documents: int = 3, heavy: int = 1_000, small: int = 100_000) -> DataFrame:
    """doc_id, tk, p for each line to drop: of keys in ``documents`` or more documents, all lines outside the largest doc_id."""
    rows = common.durable(occurrences(docs, least))
    key, doc = ["h1", "h2"], ["doc_id", "tk"]
    hot_keys = common.durable(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > heavy).select(*key))
    few = hot_keys.count() <= small
    at_hand = F.broadcast if few else lambda df: df
    hot = rows.join(at_hand(hot_keys), key, "left_semi")
    first = hot.groupBy(*key, *doc).agg(F.count("*").alias("k"))
    verdict = first.groupBy(*key).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= documents).select(*key, "last")
    hot_dropped = hot.join(at_hand(verdict), key).where(~F.col("doc_id").eqNullSafe(F.col("last"))).select(*doc, "p")
    down, up = [F.col("doc_id").desc_nulls_last(), F.col("tk").desc(), "p"], [F.col("doc_id").asc_nulls_first(), "tk", "p"]
    rest = rows.join(at_hand(hot_keys), key, "left_anti").repartitionByRange(*key).sortWithinPartitions(*key, *down)

    def seen_so_far(order) -> Column:
        """How many documents the rows up to this one are of."""
        run = W.partitionBy(*key).orderBy(*order)
        same = F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id")) & F.lag("tk").over(run).eqNullSafe(F.col("tk"))
        return F.when(same, 0).otherwise(1)

    def running(name: str, order) -> Column:
        return F.sum(name).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))

    largest = F.first(F.struct("doc_id")).over(W.partitionBy(*key).orderBy(*down).rowsBetween(W.unboundedPreceding, W.currentRow))
    seen = rest.withColumn("opens", seen_so_far(down)).withColumn("from_top", running("opens", down)).withColumn("last", largest)
    seen = seen.withColumn("opens", seen_so_far(up)).withColumn("from_bottom", running("opens", up))
    # A document is counted from both ends.
    return hot_dropped.unionByName(seen.where((F.col("from_top") + F.col("from_bottom") - 1 >= documents) & ~F.col("doc_id").eqNullSafe(F.col("last.doc_id"))).select(*doc, "p"))


def bitmaps(docs: DataFrame, **options) -> DataFrame:
    """doc_id, tk, n_dropped, dropped: the document's bitmap as runs (start, length) of dropped lines, for documents that lose lines."""
    p = dropped_lines(docs, **options).distinct()
    run = W.partitionBy("doc_id", "tk").orderBy("p")
    runs = p.withColumn("g", F.col("p") - F.row_number().over(run)).groupBy("doc_id", "tk", "g").agg(F.min("p").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.groupBy("doc_id", "tk").agg(F.sum("length").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines outside the runs, joined."""
    own = lines(text)
    gone = F.flatten(F.transform(dropped, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone)
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (null: none), text (without the dropped lines) for every row."""
    maps = bitmaps(docs.select("doc_id", "text"), **options).alias("m")
    d = docs.select("doc_id", "text", common.text_key(F.col("text")).alias("tk")).alias("d")
    joined = d.join(maps, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.tk") == F.col("m.tk")), "left")
    return joined.select(
        "d.doc_id",
        F.size(lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        "dropped",
        kept_text(F.col("text"), F.col("dropped")).alias("text"),
    )
