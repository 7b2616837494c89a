"""The catalog of conversations, its summary, and the insight lists that are drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .reports import search_text

STRINGS = "array<string>"
FACETS = ("category", "secondary", "tertiary")


def facet_count() -> Column:
    """How many different categories, in any case, a row has."""
    return F.size(F.array_distinct(F.filter(F.array(*(X.folded(F.col(c)) for c in FACETS)), lambda c: c.isNotNull() & (F.trim(c) != ""))))


def active_neighbors(analysis: DataFrame, neighbors: DataFrame, most: int = 12) -> DataFrame:
    """conversation_id, neighbors (12: id, title, score, category, cluster), cross_category_neighbors, neighbor_categories."""
    theirs = analysis.select(F.col("conversation_id").alias("neighbor"), F.col("title").alias("t"), F.col("category").alias("c"), F.col("cluster").alias("k"))
    own = analysis.select(F.col("conversation_id").alias("id"), "category")
    near = neighbors.where(F.col("rank") <= most).join(theirs, "neighbor", "left").join(own, "id")
    near = near.withColumn("c", F.coalesce("c", F.lit("Uncategorized"))).withColumn("cross", X.folded(F.col("c")) != X.folded(F.col("category")))
    one = F.struct("rank", F.col("neighbor").alias("id"), F.coalesce("t", "neighbor").alias("title"), F.bround("weight", 4).alias("score"), F.col("c").alias("category"), F.col("k").alias("cluster"))
    crossed = F.collect_set(F.when(F.col("cross"), F.struct(X.folded(F.col("c")).alias("u"), F.col("c").alias("c"))))
    g = near.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("neighbors"), F.count_if("cross").alias("cross_category_neighbors"), F.array_sort(crossed).alias("x"))
    first = F.filter("x", lambda s, i: (i == 0) | (F.get("x", i - 1)["u"] != s["u"]))
    return g.select(F.col("id").alias("conversation_id"), "neighbors", "cross_category_neighbors", F.transform(first, lambda s: s["c"]).alias("neighbor_categories"))


def catalog(analysis: DataFrame, neighbors: DataFrame, branches: DataFrame, clusters: DataFrame, communities: DataFrame, comparison: DataFrame | None = None, perspective: DataFrame | None = None) -> DataFrame:
    """One row a conversation with everything the reports need.

    ``analysis``: conversation_id, title, conversation_time, source_file, category, secondary, tertiary, category_source,
    topic_label, model_summary, topics, keywords (structs), predictions, cluster, community. ``comparison``: conversation_id,
    baseline, model, selected_source, selected, agrees. ``perspective``: id, disagrees, difference, score, strong and lists."""
    a = analysis.join(active_neighbors(analysis, neighbors), "conversation_id", "left").join(branches, "conversation_id", "left")
    a = a.join(clusters.select("cluster", F.col("label").alias("cluster_label"), F.col("summary").alias("cluster_summary")), "cluster", "left")
    a = a.join(communities.select("community", F.col("label").alias("community_label")), "community", "left")
    if comparison is None:
        empty = {"baseline_category": "string", "ml_category": "string", "selected_source": "string", "selected_category": "string", "agrees": "boolean"}
        a = a.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
    else:
        a = a.join(comparison.select("conversation_id", F.col("baseline").alias("baseline_category"), F.col("model").alias("ml_category"), "selected_source", F.col("selected").alias("selected_category"), "agrees"), "conversation_id", "left")
    if perspective is None:
        a = a.withColumns({"p_disagrees": F.lit(None).cast("boolean"), "p_difference": F.lit(None).cast("long"), "p_score": F.lit(None).cast("long")})
    else:
        a = a.join(perspective.select(F.col("id").alias("conversation_id"), F.col("disagrees").alias("p_disagrees"), F.col("difference").alias("p_difference"), F.col("score").alias("p_score")), "conversation_id", "left")
    a = a.withColumn("cross_category_neighbors", F.coalesce("cross_category_neighbors", F.lit(0).cast("long"))).withColumn("neighbor_categories", F.coalesce("neighbor_categories", F.array().cast(STRINGS)))
    disagrees = F.coalesce("p_disagrees", F.coalesce(~F.col("agrees"), F.lit(False)) & ~X.is_blank(F.col("ml_category")))
    a = a.withColumn("category_disagrees", disagrees).withColumn("embedding_differences", F.coalesce("p_difference", F.lit(0).cast("long")))
    a = a.withColumn("perspective_score", F.coalesce("p_score", F.when(F.col("category_disagrees"), 100).otherwise(0) + F.col("embedding_differences")))
    bridge = F.greatest(F.lit(0), 4 * (facet_count() - 1)) + 2 * F.size("neighbor_categories") + F.col("cross_category_neighbors")
    a = a.withColumn("bridge_score", bridge.cast("long")).withColumn("topics_text", F.array_join("topics", " ")).withColumn("keywords_text", F.array_join(F.transform(F.slice("keywords", 1, 18), lambda k: k["keyword"]), " "))
    searched = search_text(["title", *FACETS, "community_label", "topic_label", "cluster_label", "model_summary", "topics_text", "keywords_text"])
    path = F.concat(F.lit("../transcripts/"), X.href(X.stored_name(X.safe_name(F.col("title"), F.col("conversation_id")))), F.lit(".txt"))
    return a.select(
        "conversation_id", "title", X.unix_text(F.col("conversation_time")).alias("created"), "source_file", F.coalesce("branches", F.lit(0).cast("long")).alias("branches"), *FACETS, "category_source",
        "community", "community_label", "cluster", "cluster_label", "cluster_summary", "topic_label", "model_summary", "topics", F.slice("keywords", 1, 18).alias("keywords"), F.slice("predictions", 1, 8).alias("predictions"),
        path.alias("transcript_path"), searched.alias("search_text"), "category_disagrees", "baseline_category", "ml_category", "selected_source", "selected_category", "perspective_score", "embedding_differences",
        "bridge_score", "cross_category_neighbors", "neighbor_categories", "neighbors", (F.col("category_disagrees") | (F.col("embedding_differences") >= 4)).alias("strong_signal"),
    )


def summary(rows: DataFrame, edges: DataFrame, cooccurrences: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    """One row of counts."""
    set_ = lambda c: ~X.is_blank(F.col(c))
    counts = rows.agg(
        F.count("*").alias("conversations"), F.countDistinct("cluster").alias("clusters"), F.countDistinct("community").alias("communities"),
        F.count_if(set_("secondary")).alias("with_secondary"), F.count_if(set_("tertiary")).alias("with_tertiary"),
        F.count_if("category_disagrees").alias("category_disagreements"), F.count_if(F.col("embedding_differences") > 0).alias("embedding_divergences"), F.count_if("strong_signal").alias("strong_signals"),
    )
    names = rows.select(F.explode(F.array(*FACETS)).alias("c")).where(set_("c")).agg(F.countDistinct(X.folded(F.col("c"))).alias("categories"))
    similar = edges.where("edge_type = 'similar_to'").agg(F.count("*").alias("similarity_edges"))
    pairs = cooccurrences.agg(F.count("*").alias("keyword_pairs"))
    return counts.crossJoin(names).crossJoin(similar).crossJoin(pairs).withColumn("embedding_provider", F.lit(provider)).withColumn("embedding_model", F.lit(model))


def firsts(rows: DataFrame, group: str, order: list[Column], value: str, most: int, name: str) -> DataFrame:
    """group and its first values."""
    top = rows.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("r") <= most)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda s: s["v"]).alias(name))


def category_report(rows: DataFrame, top: int = 20) -> DataFrame:
    """category, primary_n, any_n, secondary_n, tertiary_n, clusters, topics (5, of primary rows), examples (3 titles)."""
    each = rows.select("conversation_id", "title", "cluster", "topics", "perspective_score", "bridge_score", F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(c).alias("name")) for f, c in zip(("primary", "secondary", "tertiary"), FACETS)))).alias("f"))
    each = each.select("*", "f.facet", F.col("f.name").alias("name"), X.folded(F.col("f.name")).alias("u")).where(~X.is_blank(F.col("name")))
    counts = each.groupBy("u").agg(
        F.min("name").alias("category"), F.count_if(F.col("facet") == "primary").alias("primary_n"), F.countDistinct("conversation_id").alias("any_n"),
        F.count_if(F.col("facet") == "secondary").alias("secondary_n"), F.count_if(F.col("facet") == "tertiary").alias("tertiary_n"), F.countDistinct(F.when(~X.is_blank(F.col("cluster")), F.col("cluster"))).alias("clusters"),
    )
    best = counts.orderBy(F.col("any_n").desc(), "u").limit(top)
    topic = each.where("facet = 'primary'").select("u", F.explode("topics").alias("topic")).groupBy("u", X.folded(F.col("topic")).alias("t")).agg(F.count("*").alias("n"), F.min("topic").alias("topic"))
    topics = firsts(topic, "u", [F.col("n").desc(), F.col("t")], "topic", 5, "topics")
    once = each.dropDuplicates(["u", "conversation_id"])
    examples = firsts(once, "u", [F.col("perspective_score").desc(), F.col("bridge_score").desc(), X.folded(F.col("title")), F.col("conversation_id")], "title", 3, "examples")
    return best.join(topics, "u", "left").join(examples, "u", "left").orderBy(F.col("any_n").desc(), "u").drop("u")


def group_report(records: DataFrame, rows: DataFrame, group: str, lists: str, top: int = 40) -> DataFrame:
    """The largest clusters or communities with the titles of three members."""
    best = records.orderBy(F.col("members").desc(), X.folded(F.col("label")), group).limit(top)
    examples = firsts(rows.join(best.select(group), group, "left_semi"), group, [F.col("perspective_score").desc(), X.folded(F.col("title")), F.col("conversation_id")], "title", 3, "examples")
    out = best.join(examples, group, "left").select(group, "label", "category", "members", "summary", F.slice(lists, 1, 8).alias(lists), "examples")
    return out.orderBy(F.col("members").desc(), X.folded(F.col("label")), group)


def insights(rows: DataFrame, clusters: DataFrame, communities: DataFrame, edges: DataFrame, cooccurrences: DataFrame) -> dict[str, DataFrame]:
    """The report lists by name."""
    title = X.folded(F.col("title"))
    pair = rows.select("conversation_id", "title", "category")
    l, r = (pair.select(*(F.col(c).alias(f"{side}_{c}") for c in pair.columns)) for side in ("left", "right"))
    similar = edges.where("edge_type = 'similar_to'").join(l, F.col("from_id") == F.col("left_conversation_id")).join(r, F.col("to_id") == F.col("right_conversation_id"))
    cross = similar.where(X.folded(F.col("left_category")) != X.folded(F.col("right_category"))).select(*l.columns, *r.columns, F.bround("weight", 4).alias("weight"))
    names = rows.select("conversation_id", "title", "perspective_score", "bridge_score", F.array_sort(F.array_distinct(F.filter(F.array(*FACETS), lambda c: c.isNotNull()))).alias("f"))
    kept_ = ("conversation_id", "title", "perspective_score", "bridge_score")
    two = names.select(*kept_, F.explode("f").alias("left_category"), "f").select(*kept_, "left_category", F.explode("f").alias("right_category")).where(X.folded(F.col("left_category")) < X.folded(F.col("right_category")))
    pair_of = F.to_json(F.array("left_category", "right_category")).alias("pair")
    most = two.groupBy("left_category", "right_category").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), X.folded(F.col("left_category")), X.folded(F.col("right_category"))).limit(25).withColumn("pair", pair_of)
    place = F.struct((-F.col("perspective_score")).alias("p"), (-F.col("bridge_score")).alias("b"), title.alias("u"), "conversation_id", "title")
    once = two.withColumn("pair", pair_of).join(F.broadcast(most.select("pair")), "pair", "left_semi").groupBy("pair", title).agg(F.min(place).alias("o")).select("pair", "o", F.col("o.title").alias("title"))
    named = firsts(once, "pair", [F.col("o")], "title", 3, "examples")
    blends = most.join(named, "pair", "left").orderBy(F.col("n").desc(), X.folded(F.col("left_category")), X.folded(F.col("right_category"))).select("left_category", "right_category", "n", "examples")
    return {
        "categories": category_report(rows),
        "category_blends": blends,
        "clusters": group_report(clusters, rows, "cluster", "keywords"),
        "communities": group_report(communities, rows, "community", "categories"),
        "bridges": rows.where("bridge_score > 0").orderBy(F.col("bridge_score").desc(), F.col("cross_category_neighbors").desc(), F.col("perspective_score").desc(), title, "conversation_id").limit(100)
        .select("conversation_id", "title", *FACETS, "topic_label", "cluster_label", "bridge_score", "cross_category_neighbors", "neighbor_categories", "transcript_path"),
        "cross_category": cross.orderBy(F.col("weight").desc(), X.folded(F.col("left_title")), "left_conversation_id", "right_conversation_id").limit(100),
        "keyword_hotspots": cooccurrences.orderBy(F.col("weight").desc(), F.col("n").desc(), X.folded(F.col("left_keyword")), X.folded(F.col("right_keyword"))).limit(50),
        "disagreements": rows.where("category_disagrees").orderBy(F.col("perspective_score").desc(), title, "conversation_id").limit(50).select("conversation_id", "title", "baseline_category", "ml_category", "selected_category", "transcript_path"),
        "strong_signals": rows.where("strong_signal").orderBy(F.col("perspective_score").desc(), F.col("bridge_score").desc(), title, "conversation_id").limit(50)
        .select("conversation_id", "title", F.coalesce("selected_category", "category").alias("category"), "perspective_score", "embedding_differences", "category_disagrees", "transcript_path"),
    }
