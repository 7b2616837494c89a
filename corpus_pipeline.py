"""A corpus pipeline of five of the training-data operators.

Each stage takes all that the one before kept and returns the columns of documents; the last adds shard and slot.

Edge cases: null and empty texts are documents of no words: the classifier scores them like others, near-duplicate classes hold them
as one text, no benchmark item hits them, and a mix takes them never in part. Null ids are kept apart by their texts. Rows that
repeat id and text are one after the near-duplicate stage. Columns of any name come through; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common, decontaminate, mixing, near_dedup, quality_classifier, sharding

#: Models, verification and sampling can't be said in SQL. tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more stay."""
    scored = quality_classifier.classify(common.packed(docs), common.table(spark, sf_dir, "labels"), keep=["row"])
    return scored.where(F.col("score") >= 0.3).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id."""
    return near_dedup.kept(docs)


#: Items of fewer words are sayings that any text may hold: a document goes only if they make up half of its words.
SHORT_ITEM, SHORT_SHARE = 8, 0.5


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any passage of a benchmark item go: a window of 13 words, or a whole shorter item of ``SHORT_ITEM`` words or more.
    Shorter items count where they fill ``SHORT_SHARE`` of a document."""
    items = common.table(spark, sf_dir, "benchmark")
    n = F.size(decontaminate.words(F.col("text")))
    found = decontaminate.decontaminate(docs, items.where(n >= SHORT_ITEM)).where("n_hit > 0").select("doc_id", "tk")
    short = items.where((n > 0) & (n < SHORT_ITEM))
    if short.limit(1).count():
        most = decontaminate.decontaminate(docs, short).where(F.col("n_hit") >= SHORT_SHARE * F.col("n_words")).where("n_hit > 0")
        found = found.unionByName(most.select("doc_id", "tk"))
    gone = found.distinct().alias("g")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (common.text_key(F.col("d.text")) == F.col("g.tk"))
    return d.join(gone, same, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix repeats it; one taken in part for half its words or more comes once more."""
    mixed = mixing.mix(common.packed(docs), keep=["row"])
    times = (F.col("repeats") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with shard and slot; columns of these names come back with ``_in`` added."""
    return sharding.shuffled(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = common.table(spark, sf_dir, "documents"), f"{common.shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.delete(spark, before)
        before = f"{folder}/{name}"
    return docs
