"""The text classifier: examples, training, metrics, storage, and the best predictions of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def training_text(title: Column, topics: Column, keywords: Column, corpus: Column, most: int = 12) -> Column:
    """Title (unless there is none), topics, the first keywords and the corpus, each on its own line."""
    named = F.when(~X.is_blank(title) & (title != "(untitled)"), title)
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    return F.concat_ws("\n", named, listed(topics), listed(F.slice(keywords, 1, most)), F.when(~X.is_blank(corpus), corpus))


def label_distribution(examples: DataFrame) -> DataFrame:
    """label, n: labels in any case, the most frequent first."""
    n = examples.groupBy(X.folded(F.col("label")).alias("u")).agg(F.min("label").alias("label"), F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "u").select("label", "n")


def softmax(scores: Column) -> Column:
    """Shifted by the largest, so that nothing overflows. The predictor applies it to probabilities, which flattens them; the
    threshold of alternate categories is set for that."""
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def train(examples: DataFrame, features: int = 1 << 16, seed: int = 17):
    """(model, metrics) from (label, text): 80/20 by the seed for the metrics, then refitted on everything. Needs 20 rows and 2
    labels. Metrics: micro and macro accuracy, log loss and the share of true labels among the first five."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    if examples.limit(20).count() < 20 or examples.select("label").distinct().limit(2).count() < 2:
        raise ValueError("training needs 20 rows and 2 labels")
    words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+")
    stages = [StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip"), words, HashingTF(inputCol="w", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", maxIter=20, family="multinomial")]
    learn, test = examples.randomSplit([0.8, 0.2], seed=seed)
    held = Pipeline(stages=stages).fit(learn)
    return Pipeline(stages=stages).fit(examples), metrics(held, test)


def metrics(model, test: DataFrame, k: int = 5) -> dict[str, float]:
    from pyspark.ml.functions import vector_to_array

    p = model.transform(test).select("y", "prediction", vector_to_array("probability").alias("p"))
    own = F.greatest(F.get("p", F.col("y").cast("int")), F.lit(1e-15))
    better = F.size(F.filter("p", lambda x: x > F.get("p", F.col("y").cast("int"))))
    each = p.select("y", (F.col("y") == F.col("prediction")).cast("double").alias("hit"), (-F.log(own)).alias("loss"), (better < k).cast("double").alias("top"))
    by_label = each.groupBy("y").agg(F.avg("hit").alias("hit"))
    whole, macro = each.agg(F.count("*").alias("n"), F.avg("hit").alias("micro"), F.avg("loss").alias("loss"), F.avg("top").alias("top")).first(), by_label.agg(F.avg("hit")).first()[0]
    return {"rows": whole.n, "micro_accuracy": whole.micro or 0.0, "macro_accuracy": macro or 0.0, "log_loss": whole.loss or 0.0, f"top_{k}_accuracy": whole.top or 0.0}


def save(spark: SparkSession, model, found: dict[str, float], distribution: DataFrame, path: str) -> None:
    """The model, and its metrics and label distribution as JSON beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([{k: float(v) for k, v in found.items()}]).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    distribution.coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model")


def score_labels(model) -> list[str]:
    """Names of the scores, in order."""
    return list(model.stages[0].labels)


def predict_top(model, corpora: DataFrame, k: int = 5) -> DataFrame:
    """conversation_id, pos (1 up), category, score: the ``k`` most probable labels of (conversation_id, corpus), by label on
    ties. Conversations with a blank corpus have none."""
    from pyspark.ml.functions import vector_to_array

    labels = F.array(*map(F.lit, score_labels(model)))
    known = corpora.where(~X.is_blank(F.col("corpus"))).select("conversation_id", F.col("corpus").alias("text"), F.lit(score_labels(model)[0]).alias("label"))
    p = model.transform(known).select("conversation_id", softmax(vector_to_array("probability")).alias("p"))
    each = p.select("conversation_id", F.posexplode("p").alias("i", "score")).withColumn("category", F.get(labels, F.col("i")))
    best = W.partitionBy("conversation_id").orderBy(F.col("score").desc(), X.folded(F.col("category")))
    return each.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k).select("conversation_id", "pos", "category", "score")


def no_predictor(corpora: DataFrame) -> DataFrame:
    """The predictor that predicts nothing."""
    return corpora.limit(0).select("conversation_id", F.lit(0).alias("pos"), F.lit("").alias("category"), F.lit(0.0).alias("score"))
