"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling: the words of all sources are shared by weight, a source is clamped at ``epochs`` times its size,
and what it can't take goes to the others by weight until no target is above its cap. In closed form the targets are
min(cap, level * weight); ordering the sources by cap / weight gives the level from running sums of one row a source.

A source takes floor(target / size) whole repetitions of each document, and a fractional one: its documents in seeded
order until the rest is used up, the last of them in part. Where the rest ends is found as a radix search over the seeded
order: each round sums one more ``DIGIT`` bits of it (one row a source and digit) and narrows the end to one digit, until
about ``bucket_rows`` rows of the largest source share it; only those are ordered one by one, however large the source is.

Edge cases: null text has size 0, and so do empty ones; very long texts are counted in one pass. A null source is a source,
last in order; sources without words have target 0. Null ids are ordered by a hash of their text, rows that repeat a doc_id
by text and size. Rows alike in both share what their group takes equally, rounded to whole words, so a source mostly of
one repeated row may miss its target by up to half a word a row. An empty table gives no rows. Extra columns may have
any names; a kept one that is named like a result is returned with ``_in`` added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"


BITS, DIGIT = 60, 10
RESULTS = ("mix_source", "size", "source_size", "target", "repeats", "part", "taken")


def seeded(doc_id: Column, text: Column, seed: str) -> Column:
    """``BITS`` bits of a hash of the id, or for a null id of the text."""
    own = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), own)), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """source, source_size, weight, target from one row (source, source_size) a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    t = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_w", F.sum("weight").over(whole))
    # The level if exactly the sources before this one are clamped. The first source below its cap sets it; after that
    # one the levels only fall, so it is the largest.
    free = F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("level", left / free)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole)
    t = t.withColumn("water", level)
    return t.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def measured(docs: DataFrame, seed: str, keep: list[str]) -> DataFrame:
    """k (the kept columns), id, tk, source, size, o for every row."""
    text, doc_id = F.col("text"), F.col("doc_id")
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("k"),
        doc_id.alias("id"),
        common.text_key(text).alias("tk"),
        F.col("source").alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        seeded(doc_id, text, seed).alias("o"),
    )


def of_source(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with the columns of their source's state."""
    return rows.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def ends(rows: DataFrame, goals: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    """One row a source with what it takes, and the digit ``lo`` of its order (of 2^shift values) that the fractional
    repetition ends in; ``before`` words of it lie before that digit. The second result is shift."""
    largest = rows.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = min(BITS // DIGIT, max(1, math.ceil(math.log2(max(largest / bucket_rows, 2)) / DIGIT)))
    zero = F.lit(0).cast("long")
    state = (
        goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .select("source", "source_size", "target", "whole", "rest", zero.alias("lo"), zero.alias("before"))
    )
    for done in range(1, rounds + 1):
        shift = BITS - done * DIGIT
        state = common.durable(state)
        digit = F.shiftright("o", shift)
        narrowed = of_source(rows, state.select("source", "lo")).where(F.shiftright(digit, DIGIT) == F.col("lo"))
        sums = narrowed.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"))
        run = W.partitionBy("source").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
        at = of_source(sums.withColumn("ahead", F.coalesce(F.sum("words").over(run), zero)), state).where(F.col("before") + F.col("ahead") <= F.col("rest"))
        last = at.groupBy("source").agg(F.max(F.struct("digit", "ahead")).alias("e")).select(F.col("source").alias("s"), F.col("e.digit").alias("d"), F.col("e.ahead").alias("ahead"))
        state = state.join(last, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "whole", "rest", F.col("d").alias("lo"), (F.col("before") + F.col("ahead")).alias("before"))
    return common.durable(state), shift


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: str = "mix", bucket_rows: int = 100, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id by default), mix_source, size, source_size, target, repeats, part, taken for every row: ``repeats``
    whole copies of the document, and ``part`` of its words once more."""
    keep = keep or ["doc_id"]
    each = measured(docs, seed, keep)
    rows = common.durable(measured(docs, seed, ["doc_id"]).drop("k"))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    state, shift = ends(rows, goals, bucket_rows)
    # The rows of the last digit, in groups of rows alike, with what each row of a group takes: one short list a source.
    zero = F.lit(0).cast("long")
    alike = ["source", "o", "id", "tk", "size"]
    final = of_source(rows, state.select("source", "lo", "before", "rest")).where(F.shiftright("o", shift) == F.col("lo"))
    final = final.groupBy(*alike, "before", "rest").agg(F.count("*").alias("c"))
    run = W.partitionBy("source").orderBy("o", "id", "size", "tk").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("c") * F.col("size")).over(run), zero)
    final = final.withColumn("left", left).withColumn("part", F.round(F.greatest(zero, F.least(F.col("c") * F.col("size"), "left")) / F.col("c")).cast("long"))
    lists = final.groupBy("source").agg(F.collect_list(F.struct("o", "id", "tk", "size", "part")).alias("last")).withColumnRenamed("source", "s")
    plan = common.durable(state.join(lists, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    own = F.filter("last", lambda e: (e["o"] == F.col("o")) & e["id"].eqNullSafe(F.col("id")) & (e["tk"] == F.col("tk")) & (e["size"] == F.col("size")))
    digit = F.shiftright("o", shift)
    part = F.when(digit < F.col("lo"), F.col("size")).when(digit > F.col("lo"), zero).otherwise(F.get(own, F.lit(0))["part"])
    joined = of_source(each, plan).withColumn("part", part)
    return joined.select(
        *(F.col("k").getField(c).alias(name) for c, name in common.kept_names(keep, RESULTS)),
        F.col("source").alias("mix_source"),
        "size",
        "source_size",
        "target",
        F.col("whole").alias("repeats"),
        "part",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
    )
