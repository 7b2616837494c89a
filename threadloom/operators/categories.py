"""Category predictions, facets; label preparation; agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNCATEGORIZED = "Uncategorized"
ALTERNATE = 0.11


def deduplicated(predictions: DataFrame) -> DataFrame:
    """One prediction (conversation_id, pos, category, score, source) a category, in any case: the model's before the
    baseline's, then the higher score. ``pos`` becomes the category's first position."""
    key = ["conversation_id", F.upper("category")]
    best = W.partitionBy(*key).orderBy((F.col("source") == "model").desc(), F.col("score").desc(), "pos")
    first = F.min("pos").over(W.partitionBy(*key))
    return predictions.withColumn("first", first).withColumn("r", F.row_number().over(best)).where("r = 1").select("conversation_id", F.col("first").alias("pos"), "category", "score", "source")


def selected(predictions: DataFrame, mode: str = "hybrid") -> DataFrame:
    """conversation_id, rank (1 up), category, score, source, is_selected. The baseline opens the order, so where the model
    names its category too, that one is selected."""
    p = deduplicated(predictions if mode != "heuristic" else predictions.where("source = 'baseline'"))
    if mode == "model":
        choice = [(F.col("source") == "model").desc(), F.col("score").desc(), F.upper("category")]
    else:
        choice = [(F.col("source") == "model").desc(), "pos"]
    one = F.row_number().over(W.partitionBy("conversation_id").orderBy(*choice)) == 1
    p = p.withColumn("is_selected", one)
    rank = W.partitionBy("conversation_id").orderBy(F.col("is_selected").desc(), F.col("score").desc(), F.upper("category"))
    return p.withColumn("rank", F.row_number().over(rank)).select("conversation_id", "rank", "category", "score", "source", "is_selected")


def facets(chosen: DataFrame, most: int = 3) -> DataFrame:
    """conversation_id, category, secondary, tertiary: of the first ``most``, those that score enough."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "category", "score")))
    f = chosen.where(F.col("rank") <= most).groupBy("conversation_id").agg(ordered.alias("c"))
    primary = F.get("c", F.lit(0))["category"]
    others = F.filter("c", lambda x: (x["rank"] > 1) & (x["category"] != primary) & (x["score"] >= ALTERNATE))
    return f.select("conversation_id", primary.alias("category"), F.get(others, F.lit(0))["category"].alias("secondary"), F.get(others, F.lit(1))["category"].alias("tertiary"))


def collapsed_labels(examples: DataFrame, least: int = 4) -> DataFrame:
    """label, text: blank labels and those of fewer than ``least`` rows become Uncategorized; of repeats in any case the first by
    ``place`` stays, if there is such a column, as it is written there, else the smallest."""
    named = examples.withColumn("label", F.when(F.trim("label") == "", UNCATEGORIZED).otherwise(F.coalesce(F.trim("label"), F.lit(UNCATEGORIZED))))
    counts = named.groupBy(F.upper("label").alias("l")).agg(F.count("*").alias("n")).where(F.col("n") < least).select("l", F.lit(True).alias("rare"))
    # Labels with fewer rows than ``least``: the others need no join.
    collapsed = named.withColumn("l", F.upper("label")).join(counts, "l", "left").withColumn("label", F.when(F.col("rare"), UNCATEGORIZED).otherwise(F.col("label"))).where(F.trim("text") != "")
    order = F.struct(*([F.col("place")] if "place" in examples.columns else []), F.col("label").alias("_l"), F.col("text").alias("_t"))
    first = collapsed.groupBy(F.upper("label").alias("l"), F.upper("text").alias("t")).agg(F.min(order).alias("f"))
    return first.select(F.col("f._l").alias("label"), F.col("f._t").alias("text"))


def comparison(rows: DataFrame) -> DataFrame:
    """rows_n, agreements, agreement_rate, disagreements from (baseline, model); rows without a model value agree with nothing."""
    c = rows.agg(F.count("*").alias("rows_n"), F.count_if(F.col("baseline") == F.col("model")).alias("agreements"), F.count_if(F.col("model").isNotNull() & (F.col("baseline") != F.col("model"))).alias("disagreements"))
    return c.withColumn("agreement_rate", F.when(F.col("rows_n") == 0, 1.0).otherwise(F.bround(F.col("agreements") / F.col("rows_n"), 4)))


def predictions(baseline: DataFrame, model: DataFrame | None = None, mode: str = "hybrid", baseline_score: float = 0.75) -> DataFrame:
    """conversation_id, pos, category, score, source: the baseline first, unless only the model counts and predicts anything; then
    the model's (conversation_id, pos, category, score)."""
    named = F.coalesce(F.when(F.trim("category") != "", F.trim("category")), F.lit(UNCATEGORIZED)).alias("category")
    own = baseline.select("conversation_id", F.lit(0).alias("pos"), named, F.lit(baseline_score).alias("score"), F.lit("baseline").alias("source"))
    if model is None:
        return own
    theirs = model.where(F.trim("category") != "").select("conversation_id", F.col("pos").cast("int").alias("pos"), named, F.col("score").cast("double").alias("score"), F.lit("model").alias("source"))
    if mode == "mlnet":
        own = own.join(theirs.select("conversation_id"), "conversation_id", "left_anti")
    return own.unionByName(theirs)


def compared_predictions(baseline: DataFrame, model: DataFrame, facets: DataFrame, chosen: DataFrame) -> DataFrame:
    """conversation_id, baseline, model (its first prediction), model_score, agrees, selected_source, selected."""
    first = model.where("pos = 1").select("conversation_id", F.col("category").alias("model"), F.col("score").alias("model_score"))
    source = chosen.where("is_selected").select("conversation_id", F.col("source").alias("selected_source"))
    j = baseline.select("conversation_id", F.col("category").alias("baseline")).join(first, "conversation_id", "left").join(source, "conversation_id", "left").join(facets.select("conversation_id", F.col("category").alias("selected")), "conversation_id", "left")
    return j.withColumn("agrees", F.coalesce(F.upper("baseline") == F.upper("model"), F.lit(False)))


def disagreements(compared: DataFrame, titles: DataFrame, top: int = 100) -> DataFrame:
    """Rows with a model category that differs, by title."""
    wrong = compared.where(F.col("model").isNotNull() & ~F.col("agrees"))
    return wrong.join(titles.select("conversation_id", "title"), "conversation_id").orderBy(F.upper("title"), "conversation_id").limit(top)
