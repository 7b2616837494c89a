"""Catalog and report operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matching_messages(messages: DataFrame, pattern: str = "matplotlib|plot|chart", code_pattern: str = "matplotlib") -> DataFrame:
    """Messages whose text or code matches, in any case, by time."""
    return messages.where(F.col("text").rlike(f"(?i){pattern}") | F.col("aggregate_code").rlike(f"(?i){code_pattern}")).orderBy("create_time", "node_id")


def with_attachments(messages: DataFrame) -> DataFrame:
    return messages.where(F.coalesce(F.col("attachments_json"), F.lit("")) != "")


def facet_rows(catalog: DataFrame) -> DataFrame:
    """id, facet (primary, secondary, tertiary), category: one row a facet that is set."""
    facets = F.expr("stack(3, 'primary', category, 'secondary', secondary, 'tertiary', tertiary) AS (facet, name)")
    return catalog.select("id", "cluster", facets).where("name is not null").withColumnRenamed("name", "category")


def blends(catalog: DataFrame, top: int = 25) -> DataFrame:
    """left_category, right_category, n, examples (first three ids): pairs of facets within a row."""
    f = facet_rows(catalog).select("id", "category").distinct()
    g = f.select("id", F.col("category").alias("right_category"))
    p = f.withColumnRenamed("category", "left_category").join(g, "id").where("left_category < right_category")
    out = p.groupBy("left_category", "right_category").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("id")), 1, 3).alias("examples"))
    return out.orderBy(F.col("n").desc(), "left_category", "right_category").limit(top)


def category_insights(catalog: DataFrame, top: int = 20) -> DataFrame:
    """category, primary_n, secondary_n, tertiary_n, conversations, clusters."""
    f = facet_rows(catalog)
    counts = [F.count_if(F.col("facet") == k).alias(f"{k}_n") for k in ("primary", "secondary", "tertiary")]
    out = f.groupBy("category").agg(*counts, F.countDistinct("id").alias("conversations"), F.countDistinct("cluster").alias("clusters"))
    return out.orderBy(F.col("conversations").desc(), F.upper("category")).limit(top)


def cross_category(edges: DataFrame, catalog: DataFrame, top: int = 100) -> DataFrame:
    """Similar pairs (a, b, weight) whose ends have different primary categories."""
    c = catalog.select("id", "category")
    l, r = c.select(F.col("id").alias("a"), F.col("category").alias("left_category")), c.select(F.col("id").alias("b"), F.col("category").alias("right_category"))
    j = edges.join(l, "a").join(r, "b").where("left_category <> right_category")
    return j.select("a", "b", "weight", "left_category", "right_category").orderBy(F.col("weight").desc(), "a", "b").limit(top)


def bridges(catalog: DataFrame, neighbors: DataFrame, top: int = 100, most: int = 12) -> DataFrame:
    """id, facets, cross_categories, cross_neighbors, bridge_score = 4 (facets - 1) + 2 cross categories + cross neighbours,
    over the first ``most`` neighbours."""
    other = catalog.select(F.col("id").alias("neighbor"), F.col("category").alias("their"))
    near = neighbors.where(F.col("rank") <= most).join(other, "neighbor").join(catalog.select("id", "category"), "id").where("their <> category")
    cross = near.groupBy("id").agg(F.countDistinct("their").alias("cross_categories"), F.count("*").alias("cross_neighbors"))
    n = sum((F.col(c).isNotNull().cast("long") for c in ("category", "secondary", "tertiary")), F.lit(0))
    j = catalog.select("id", n.alias("facets")).join(cross, "id", "left").fillna(0, ["cross_categories", "cross_neighbors"])
    return j.withColumn("bridge_score", 4 * (F.col("facets") - 1) + 2 * F.col("cross_categories") + F.col("cross_neighbors")).orderBy(F.col("bridge_score").desc(), "id").limit(top)


def perspective(disagreements: DataFrame, left: DataFrame, right: DataFrame, top: int = 100) -> DataFrame:
    """id, disagrees, left_only, right_only, difference, score, strong: 100 for a category disagreement plus one for each
    neighbour that only one side has; strong from four on or with a disagreement."""
    l, r = left.select("id", "neighbor", F.lit(1).alias("l")), right.select("id", "neighbor", F.lit(1).alias("r"))
    n = l.join(r, ["id", "neighbor"], "full").groupBy("id").agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    j = disagreements.select("id", "disagrees").join(n, "id", "full").fillna(0, ["left_only", "right_only"]).withColumn("disagrees", F.coalesce("disagrees", F.lit(False)))
    j = j.withColumn("difference", F.col("left_only") + F.col("right_only")).withColumn("score", F.when(F.col("disagrees"), 100).otherwise(0) + F.col("difference"))
    return j.withColumn("strong", F.col("disagrees") | (F.col("difference") >= 4)).orderBy(F.col("score").desc(), "id").limit(top)


def size_histogram(members: DataFrame, group: str) -> DataFrame:
    """groups, singletons, largest, mean_size."""
    n = members.groupBy(group).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.bround(F.avg("n"), 4).alias("mean_size"))


def representative_keywords(members: DataFrame, keywords: DataFrame, group: str, per_member: int = 6, top: int = 8) -> DataFrame:
    """group, keyword, score, rank: summed scores of the members' first keywords."""
    k = members.join(keywords.where(F.col("rank") < per_member).select(F.col("conversation_id").alias("id"), "keyword", "score"), "id")
    s = k.groupBy(group, "keyword").agg(F.bround(F.sum(F.col("score").cast("decimal(18,4)")), 4).cast("double").alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.col("score").desc(), F.upper("keyword")))).where(F.col("rank") <= top)


def primary_category(members: DataFrame, group: str) -> DataFrame:
    """The most frequent category of each group, the first by name on ties."""
    n = members.groupBy(group, "category").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.col("n").desc(), F.upper("category")))).where("r = 1").select(group, "category", "n")


def search_text(columns: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *(F.when(F.trim(c) != "", F.col(c)) for c in columns)))


def select_catalog(catalog: DataFrame, text: str | None = None, primary: str | None = None, any_of: list[str] | None = None, cluster: str | None = None, community: str | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """The navigator's selection; every condition is pushed down as a plain predicate. ``only`` names conditions that must hold:
    disagreements, bridges, strong."""
    conditions = [F.lit(True)]
    if text:
        conditions.append(F.contains(F.col("search_text"), F.lit(text.lower())))
    if primary:
        conditions.append(F.col("category") == primary)
    if any_of:
        conditions.append(reduce(Column.__or__, (F.col(c).isin(any_of) for c in ("category", "secondary", "tertiary"))))
    for name, value in (("cluster", cluster), ("community", community)):
        if value:
            conditions.append(F.col(name) == value)
    holds = {"disagreements": "category_disagrees", "bridges": "bridge_score > 0", "strong": "strong_signal"}
    conditions += [F.expr(holds[name]) for name in only]
    return catalog.where(reduce(Column.__and__, conditions))


#: Columns by which the catalog is shown, the largest first.
SORTS = {"bridge": ["bridge_score", "perspective_score"], "perspective": ["perspective_score", "bridge_score"], "created": ["created"], "title": []}


def sort_catalog(catalog: DataFrame, mode: str) -> DataFrame:
    return catalog.orderBy(*(F.col(c).desc_nulls_last() for c in SORTS[mode]), F.upper("title"), "conversation_id")


def perspective_counts(rows: DataFrame) -> DataFrame:
    """disagreements, divergences, strong signals of perspective rows."""
    return rows.agg(F.count_if("disagrees").alias("category_disagreements"), F.count_if(F.col("difference") > 0).alias("embedding_divergences"), F.count_if("strong").alias("strong_signals"))


def perspective_lists(rows: DataFrame, left: DataFrame, right: DataFrame, most: int = 5) -> DataFrame:
    """The rows with left_examples and right_examples: the first neighbours that only one side has."""
    for a, b, name in ((left, right, "left_examples"), (right, left, "right_examples")):
        only = a.join(b.select("id", "neighbor"), ["id", "neighbor"], "left_anti").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("rank"))).where(F.col("r") <= most)
        rows = rows.join(only.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "neighbor", "weight"))).alias(name)), "id", "left")
    return rows


def profile_matrix(runs: DataFrame) -> DataFrame:
    """id, profiles, categories, max_bridge, avg_bridge, disagrees from (profile, id, category, bridge_score)."""
    return runs.groupBy("id").agg(
        F.count("*").alias("profiles"),
        F.countDistinct("category").alias("categories"),
        F.max("bridge_score").alias("max_bridge"),
        F.bround(F.avg("bridge_score"), 3).alias("avg_bridge"),
        F.array_join(F.array_sort(F.collect_set("category")), " | ").alias("category_list"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "profile", "category"))), "; ").alias("category_map"),
    )


def full_profile_matrix(runs: DataFrame) -> DataFrame:
    """id, title, profiles, distinct categories, topics and clusters, bridge and perspective scores, and the values by profile as
    text, from (profile, id, title, category, topic_label, cluster_label, bridge_score, perspective_score)."""
    mapped = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.concat_ws("=", "profile", c)))), "; ")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    named = {"category": ("categories", "category_list", "category_map"), "topic_label": ("topic_labels", "topic_list", "topic_map"), "cluster_label": ("cluster_labels", "cluster_list", "cluster_map")}
    texts = [x for c, (n, l, m) in named.items() for x in (F.countDistinct(c).alias(n), listed(c).alias(l), mapped(c).alias(m))]
    scores = [F.max("bridge_score").alias("max_bridge"), F.bround(F.avg("bridge_score"), 3).alias("avg_bridge"), F.max("perspective_score").alias("max_perspective"), F.bround(F.avg("perspective_score"), 3).alias("avg_perspective")]
    return runs.groupBy("id").agg(F.min_by("title", F.struct(F.col("title").isNull(), F.col("profile"))).alias("title"), F.count("*").alias("profiles"), *texts, *scores)


def profile_summaries(runs: DataFrame) -> DataFrame:
    """profile, conversations, categories, clusters, bridges, mean_bridge."""
    return runs.groupBy("profile").agg(F.count("*").alias("conversations"), F.countDistinct("category").alias("categories"), F.countDistinct("cluster_label").alias("clusters"), F.count_if(F.col("bridge_score") > 0).alias("bridges"), F.bround(F.avg("bridge_score"), 3).alias("mean_bridge"))


def profile_agreement(runs: DataFrame) -> DataFrame:
    """left_profile, right_profile, compared, match_rate for each pair of profiles."""
    l = runs.select(F.col("profile").alias("left_profile"), "id", F.col("category").alias("c1"))
    r = runs.select(F.col("profile").alias("right_profile"), "id", F.col("category").alias("c2"))
    j = l.join(r, "id").where("left_profile < right_profile")
    return j.groupBy("left_profile", "right_profile").agg(F.count("*").alias("compared"), F.bround(F.avg((F.col("c1") == F.col("c2")).cast("double")), 4).alias("match_rate"))


def hot_paths(matrix: DataFrame, top: int = 75) -> DataFrame:
    return matrix.where("max_bridge > 0 or categories > 1").orderBy(F.col("max_bridge").desc(), F.col("categories").desc(), "id").limit(top)


def top_bridges(runs: DataFrame, top: int = 15) -> DataFrame:
    w = W.partitionBy("profile").orderBy(F.col("bridge_score").desc(), "id")
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("profile", "rank", "id", "bridge_score")


def transcripts(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """conversation_id, branch, n_messages, document: each path's messages under role headings."""
    m = messages.select("conversation_id", "node_id", "role", "text")
    part = F.concat(F.lit("## "), F.coalesce("role", F.lit("unknown")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    j = paths.join(m, ["conversation_id", "node_id"]).select("conversation_id", "branch", F.struct("pos", part.alias("p")).alias("s"))
    return j.groupBy("conversation_id", "branch").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "").alias("document"))
