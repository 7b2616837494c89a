"""The typed property graph: edges of all producers, deduplication, nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded, is_blank, preview


def edges(rows: DataFrame, source: Column, target: Column, kind: str, weight: Column | float = 1.0) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return rows.select(source.alias("from_id"), target.alias("to_id"), F.lit(kind).alias("edge_type"), w.cast("double").alias("weight"))


def reply_edges(linked: DataFrame) -> DataFrame:
    return edges(linked.where("parent is not null"), F.col("parent"), F.col("node_id"), "reply")


def keyword_edges(keywords: DataFrame, most: int = 10) -> DataFrame:
    return edges(keywords.where(F.col("rank") < most), F.col("conversation_id"), F.concat(F.lit("kw:"), "keyword"), "has_keyword", F.col("score"))


def category_edges(categories: DataFrame) -> DataFrame:
    """The baseline's edges: its score is below 1 always, so the weight is 1."""
    return edges(categories, F.col("conversation_id"), F.concat(F.lit("cat:"), "category"), "has_category")


#: Edge types of a first analysis that the index replaces by its own.
REPLACED = ("has_category", "has_secondary_category", "has_tertiary_category", "has_topic", "has_model_category", "has_model_topic", "candidate_category", "has_topic_label")


def without_replaced(found: DataFrame) -> DataFrame:
    return found.where(~F.col("edge_type").isin(*REPLACED))


def similar_only(found: DataFrame) -> DataFrame:
    return found.where("edge_type = 'similar_to'")


def facet_edges(chosen: DataFrame, facets: DataFrame) -> DataFrame:
    """has_category with 1 at least, has_secondary_category and has_tertiary_category with their scores, candidate_category for
    every other prediction (conversation_id, category, score, is_selected)."""
    f = facets.select(F.col("conversation_id").alias("c"), F.col("category").alias("c1"), F.col("secondary").alias("c2"), F.col("tertiary").alias("c3"))
    same = lambda name: F.coalesce(folded(F.col("category")) == folded(F.col(name)), F.lit(False))
    kind = F.when(same("c1"), "has_category").when(same("c2"), "has_secondary_category").when(same("c3"), "has_tertiary_category").when(~F.col("is_selected"), "candidate_category")
    p = chosen.join(f, chosen.conversation_id == f.c).withColumn("kind", kind).where("kind is not null")
    weight = F.when(F.col("kind") == "has_category", F.greatest(F.lit(1.0), "score")).otherwise(F.col("score"))
    return p.select(F.col("conversation_id").alias("from_id"), F.concat(F.lit("cat:"), "category").alias("to_id"), F.col("kind").alias("edge_type"), weight.cast("double").alias("weight"))


def topic_edges(topics: DataFrame) -> DataFrame:
    """has_topic and has_topic_label from (conversation_id, topics, topic_label)."""
    each = topics.select("conversation_id", F.explode("topics").alias("topic"))
    labels = topics.where(~is_blank(F.col("topic_label")))
    return edges(each, F.col("conversation_id"), F.concat(F.lit("topic:"), "topic"), "has_topic").unionByName(edges(labels, F.col("conversation_id"), F.concat(F.lit("topiclabel:"), "topic_label"), "has_topic_label"))


def model_edges(told: DataFrame) -> DataFrame:
    """has_model_category and has_model_topic from (conversation_id, model_category, model_topics): of a first analysis; the index has
    facets and merged topics in their place."""
    named = told.where(~is_blank(F.col("model_category")))
    each = told.select("conversation_id", F.explode("model_topics").alias("topic"))
    return edges(named, F.col("conversation_id"), F.concat(F.lit("modelcat:"), "model_category"), "has_model_category").unionByName(edges(each, F.col("conversation_id"), F.concat(F.lit("modeltopic:"), "topic"), "has_model_topic"))


def similar_edges(pairs: DataFrame) -> DataFrame:
    return edges(pairs, F.col("a").cast("string"), F.col("b").cast("string"), "similar_to", F.col("weight"))


def group_edges(records: DataFrame, members: DataFrame, group: str, belongs: str, category: str, keyword: str, most: int = 5) -> DataFrame:
    """Of clusters or communities: membership (``members`` has conversation_id and the group), and the first categories and
    keywords of each record (the group, categories, keywords)."""
    first = lambda column, prefix, kind: edges(records.select(group, F.explode(F.slice(column, 1, most)).alias("x")).where(~is_blank(F.col("x"))), F.col(group), F.concat(F.lit(prefix), "x"), kind)
    return edges(members, F.col("conversation_id"), F.col(group), belongs).unionByName(first("categories", "cat:", category)).unionByName(first("keywords", "kw:", keyword))


def cooccurrence_edges(pairs: DataFrame) -> DataFrame:
    return edges(pairs, F.concat(F.lit("kw:"), "left_keyword"), F.concat(F.lit("kw:"), "right_keyword"), "co_occurs_with", F.col("weight"))


def hierarchy_edges(steps: DataFrame) -> DataFrame:
    return edges(steps, F.concat(F.lit("cat:"), "parent"), F.concat(F.lit("cat:"), "child"), "category_parent", F.col("n"))


def deduplicated(*producers: DataFrame) -> DataFrame:
    """All producers' edges; the heaviest of each (from, to, type)."""
    return reduce(DataFrame.unionByName, producers).groupBy("from_id", "to_id", "edge_type").agg(F.max("weight").alias("weight"))


def scoped(found: DataFrame, scope: Column | str) -> DataFrame:
    """Edges with the scope that the database keeps: the conversation's id, or global. Metadata is never set by a producer."""
    return found.withColumn("scope_id", scope if isinstance(scope, Column) else F.lit(scope)).withColumn("metadata_json", F.lit(None).cast("string"))


def deduplicated_in_scope(found: DataFrame) -> DataFrame:
    """The heaviest of each (scope, from, to, type), the first metadata on ties."""
    best = W.partitionBy("scope_id", "from_id", "to_id", "edge_type").orderBy(F.col("weight").desc(), "metadata_json")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def kind_of(node: Column) -> Column:
    kinds = (("kw:", "keyword"), ("topic:", "topic"), ("topiclabel:", "topic_label"), ("cat:", "category"), ("cluster:", "topic_cluster"), ("catcomm:", "category_community"))
    out = F.lit("node")
    for prefix, kind in kinds:
        out = F.when(node.startswith(prefix), F.lit(kind)).otherwise(out)
    return out


def message_nodes(messages: DataFrame) -> DataFrame:
    """id, label, kind, prio: a message's first value of text, code and output as its preview; its kind is the role."""
    return messages.select(F.col("node_id").alias("id"), preview(F.coalesce("text", "aggregate_code", "execution_output")).alias("label"), F.coalesce("role", F.lit("message")).alias("kind"), F.lit(2).alias("prio"))


def record_nodes(records: DataFrame, group: str, kind: str) -> DataFrame:
    """Clusters or communities with their label, and their categories and keywords."""
    of = lambda column, prefix, name: records.select(F.explode(column).alias("x")).where(~is_blank(F.col("x"))).select(F.concat(F.lit(prefix), "x").alias("id"), F.col("x").alias("label"), F.lit(name).alias("kind"), F.lit(3).alias("prio"))
    own = records.select(F.col(group).alias("id"), F.coalesce("label", group).alias("label"), F.lit(kind).alias("kind"), F.lit(3).alias("prio"))
    return own.unionByName(of("categories", "cat:", "category")).unionByName(of("keywords", "kw:", "keyword"))


def keyword_nodes(keywords: DataFrame) -> DataFrame:
    """All keywords of conversations, also those that have no edge."""
    return keywords.select(F.concat(F.lit("kw:"), "keyword").alias("id"), F.col("keyword").alias("label"), F.lit("keyword").alias("kind"), F.lit(2).alias("prio")).distinct()


def nodes(all_edges: DataFrame, known: DataFrame) -> DataFrame:
    """id, label, kind: known nodes (id, label, kind, prio), the last writer of an id winning; endpoints no one knows are
    inferred from their prefix."""
    last = W.partitionBy("id").orderBy(F.col("prio").desc(), "label")
    own = known.withColumn("r", F.row_number().over(last)).where("r = 1").select("id", "label", "kind")
    ends = all_edges.select(F.col("from_id").alias("id")).union(all_edges.select("to_id")).distinct()
    new = ends.join(own, "id", "left_anti")
    return own.unionByName(new.select("id", F.regexp_replace("id", "^(kw|topic|topiclabel|cat):", "").alias("label"), kind_of(F.col("id")).alias("kind")))
