"""Merged topics and labels of conversations; records of clusters and category communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .categories import UNCATEGORIZED
from .communities import FACET_WEIGHTS

STRINGS = "array<string>"


def listed(rows: DataFrame, value: str, name: str, order: str = "rank") -> DataFrame:
    """conversation_id and the values in order."""
    return rows.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(name))


def grounded(leaf: Column, topics: Column, keywords: Column) -> Column:
    """Whether a token of a category's last part is among the tokens of the extracted terms."""
    own = X.tokens(X.plain_line(leaf))
    theirs = F.flatten(F.transform(F.concat(topics, keywords), lambda t: X.tokens(X.plain_line(t))))
    return F.arrays_overlap(own, theirs)


def merged(topics: DataFrame, keywords: DataFrame, facets: DataFrame, titles: DataFrame, take: int = 8, most: int = 6) -> DataFrame:
    """conversation_id, topics, topic_label. Topics: the own ones, the first keywords, and the selected category's last part if it
    is grounded, chosen greedily. Label: the first three of them, else of the keywords, else the title, else the category."""
    none = F.array().cast(STRINGS)
    j = titles.select("conversation_id", "title").join(listed(topics, "topic", "own"), "conversation_id", "left").join(listed(keywords, "keyword", "kw"), "conversation_id", "left")
    j = j.join(facets.select("conversation_id", "category"), "conversation_id", "left").withColumn("own", F.coalesce("own", none)).withColumn("kw", F.coalesce("kw", none))
    leaf = X.leaf(F.coalesce("category", F.lit(UNCATEGORIZED)))
    counts = leaf.isNotNull() & (X.folded(leaf) != UNCATEGORIZED.upper()) & F.coalesce(grounded(leaf, F.col("own"), F.col("kw")), F.lit(False))
    terms = F.concat("own", F.slice("kw", 1, most), F.when(counts, F.array(leaf)).otherwise(none))
    structs = F.transform(F.filter(F.transform(terms, X.trimmed), lambda t: t != ""), lambda t: F.struct(t.alias("term")))
    j = j.withColumn("topics", F.transform(X.diverse(structs, max(take, 1)), lambda s: s["term"]))
    named = F.when(~X.is_blank(F.col("title")) & (F.col("title") != "(untitled)"), F.col("title"))
    label = F.when(F.size("topics") > 0, X.humanized_terms(F.slice("topics", 1, 3))).when(F.size("kw") > 0, X.humanized_terms(F.slice("kw", 1, 3))).otherwise(F.coalesce(named, "category"))
    return j.select("conversation_id", "topics", label.alias("topic_label"))


def representatives(members: DataFrame, keywords: DataFrame, group: str, per_member: int, top: int) -> DataFrame:
    """group, keywords: summed scores of the members' first keywords, in any case, best first."""
    k = members.join(keywords.where(F.col("rank") < per_member), "conversation_id").select(group, "keyword", F.col("score").cast("decimal(18,4)").alias("score"))
    s = k.groupBy(group, X.folded(F.col("keyword")).alias("u")).agg(F.sum("score").alias("score"), F.min("keyword").alias("keyword"))
    best = s.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.col("score").desc(), "u"))).where(F.col("r") <= top)
    return best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "keyword"))), lambda x: x["keyword"]).alias("keywords"))


def most_frequent(members: DataFrame, group: str) -> DataFrame:
    """group, category: the most frequent category of the members (conversation_id, category), the first by name on ties."""
    n = members.groupBy(group, "category").agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min_by("category", F.struct((-F.col("n")).alias("n"), X.folded(F.col("category")), "category")).alias("category"))


def cluster_records(members: DataFrame, analysis: DataFrame, keywords: DataFrame) -> DataFrame:
    """cluster, label, summary, category, categories (of the category alone), members (n), ids, keywords (8). ``members`` has
    conversation_id, cluster; ``analysis`` title, category, topic_label, model_summary."""
    own = members.join(analysis.select("conversation_id", "title", "category", "topic_label", "model_summary"), "conversation_id")
    of_one = F.coalesce(*(F.when(~X.is_blank(F.col(c)) & (F.col(c) != "(untitled)"), F.col(c)) for c in ("topic_label", "title")))
    summary = F.min_by(F.col("model_summary"), F.struct(X.is_blank(F.col("model_summary")), F.col("conversation_id")))
    g = own.groupBy("cluster").agg(F.count("*").alias("members"), F.array_sort(F.collect_list("conversation_id")).alias("ids"), F.min(of_one).alias("single"), summary.alias("told"))
    g = g.join(representatives(members, keywords, "cluster", 6, 8), "cluster", "left").join(most_frequent(own.fillna(UNCATEGORIZED, ["category"]), "cluster"), "cluster", "left")
    g = g.withColumn("keywords", F.coalesce("keywords", F.array().cast(STRINGS)))
    joined = F.array_join(F.transform(F.slice("keywords", 1, 3), X.humanized), " / ")
    number = F.regexp_replace("cluster", "^.*:", "Cluster ")
    label = F.coalesce(F.when((F.col("members") == 1), F.col("single")), F.when(F.size("keywords") > 0, joined), F.when(~X.is_blank(F.col("category")), F.col("category")), number)
    five = F.concat("category", F.lit(": "), F.array_join(F.slice("keywords", 1, 5), ", "))
    told = F.when(~X.is_blank(F.col("told")), F.col("told")).when(F.size("keywords") == 0, F.col("category")).otherwise(five)
    return g.select("cluster", label.alias("label"), told.alias("summary"), "category", F.array("category").alias("categories"), "members", "ids", "keywords")


def community_records(members: DataFrame, facets: DataFrame, keywords: DataFrame) -> DataFrame:
    """community, label, summary, category, categories (6), members (n), ids, keywords (10). Categories are ordered by their
    members' summed facet weights, then by how few members have them first, then by name."""
    own = members.join(facets.select("conversation_id", "category", "secondary", "tertiary"), "conversation_id")
    weights = F.array(*(F.struct(F.col(c).alias("c"), F.lit(round(w * 100)).alias("w")) for c, w in FACET_WEIGHTS.items()))
    each = own.select("community", "conversation_id", F.inline(weights)).where("c is not null")
    # A category that a conversation has twice counts with its higher weight.
    each = each.groupBy("community", "conversation_id", "c").agg(F.max("w").alias("w"))
    totals = each.groupBy("community", "c").agg(F.sum("w").alias("w"))
    firsts = own.groupBy("community", F.col("category").alias("c")).agg(F.count("*").alias("p"))
    order = F.struct((-F.col("w")).alias("w"), F.coalesce("p", F.lit(0)).alias("p"), X.folded(F.col("c")).alias("u"), F.col("c").alias("name"))
    top = totals.join(firsts, ["community", "c"], "left").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["name"]).alias("all"))
    g = own.groupBy("community").agg(F.count("*").alias("members"), F.array_sort(F.collect_list("conversation_id")).alias("ids"))
    g = g.join(top, "community", "left").join(most_frequent(own, "community"), "community", "left").join(representatives(members, keywords, "community", 8, 10), "community", "left")
    g = g.withColumn("all", F.coalesce("all", F.array().cast(STRINGS)))
    label = F.when(F.size("all") == 0, F.lit(UNCATEGORIZED)).otherwise(F.array_join(F.slice("all", 1, 3), " + "))
    others = F.array_join(F.slice("all", 2, 3), ", ")
    n = F.col("members").cast("string")
    told = F.when(F.size("all") == 0, F.lit(UNCATEGORIZED)).when(others == "", F.concat("category", F.lit(" centered across "), n, F.lit(" conversations."))).otherwise(F.concat("category", F.lit(" centered with "), others, F.lit(" across "), n, F.lit(" conversations.")))
    return g.select("community", label.alias("label"), told.alias("summary"), "category", F.slice("all", 1, 6).alias("categories"), "members", "ids", F.coalesce("keywords", F.array().cast(STRINGS)).alias("keywords"))
