"""The whole index of a set of messages: every table from one configuration. What several tables need is written once on the way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as K
from ..operators import categories as C
from ..operators import communities as M
from ..operators import classifier, forest, graph, keywords, reports, similarity, topics, wordpiece
from ..operators.store import kept
from . import language_model
from .config import Config

#: Baseline analysis (conversation_id, category, topics, keywords, summary) that a language model may override, or None.
Analyzer = Callable[[DataFrame], DataFrame]
#: Cluster records and their members in, the same records with other labels and summaries out.
Labeler = Callable[[DataFrame, DataFrame], DataFrame]
Embedder = Callable[[DataFrame], DataFrame]


@dataclass
class Providers:
    """What may be plugged in: a classifier's predictions of (conversation_id, corpus), vectors (id, v) of the same, an analysis and a
    labeler by a language model, and a vocabulary. ``description`` names the vectors' provider."""

    predictor: Callable[[DataFrame], DataFrame] | None = None
    embedder: Embedder | None = None
    description: str = ""
    analyzer: Analyzer | None = None
    labeler: Labeler | None = None
    vocabulary: dict[str, int] | None = None
    notes: list[str] = field(default_factory=list)
    #: Two embedders to be compared, or none.
    tokenizers: tuple[Embedder, Embedder] | None = None


def hash_vectors(corpora: DataFrame, dims: int = 384) -> DataFrame:
    """id, v: hashed tokens of each corpus as a dense vector of ``dims``."""
    lines = corpora.select("conversation_id", F.explode(X.split_lines(F.col("corpus"))).alias("raw"))
    counts = lines.select("conversation_id", F.explode(X.tokens(X.plain_line(F.col("raw")))).alias("token")).groupBy("conversation_id", "token").agg(F.count("*").alias("n"))
    return dense(keywords.hash_embedding(counts, dims), max(32, dims))


def dense(sparse: DataFrame, dims: int, some: int = 1_000) -> DataFrame:
    """id, v: sparse rows (conversation_id, bucket, value) as vectors of ``dims``, ``some`` at a time. Each value is put in its place, so
    the work grows with the values and the vectors' lengths, not with their product."""
    listed = sparse.groupBy("conversation_id").agg(F.collect_list(F.struct("bucket", "value")).alias("s"))

    def fill(batches):
        for batch in batches:
            for part in (batch.slice(at, some) for at in range(0, len(batch), some)):
                x = np.zeros((len(part), dims))
                row = np.repeat(np.arange(len(part)), part.column(1).value_lengths().to_numpy())
                x[row, part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), v], names=["id", "v"])

    return listed.select("conversation_id", F.col("s.bucket").alias("bucket"), F.col("s.value").alias("value")).mapInArrow(fill, "id string, v array<double>")


def overridden(own: DataFrame, told: DataFrame) -> DataFrame:
    """A language model's category, topics, keywords and summary in place of the baseline's (conversation_id, category, topics): a category
    that isn't blank, and lists that are there, even if empty."""
    t = told.select("conversation_id", F.col("category").alias("t_category"), "topics", F.col("keywords").alias("model_keywords"), F.col("summary").alias("model_summary")).withColumnRenamed("topics", "t_topics")
    j = own.join(t, "conversation_id", "left")
    category = F.when(~X.is_blank(F.col("t_category")), F.trim("t_category")).otherwise(F.col("category"))
    topics_ = F.coalesce(F.array_distinct("t_topics"), "topics")
    return j.select("conversation_id", category.alias("category"), topics_.alias("topics"), "model_keywords", "model_summary", F.when(~X.is_blank(F.col("t_category")), F.trim("t_category")).alias("model_category"), F.coalesce("t_topics", F.array().cast("array<string>")).alias("model_topics"))


def build(messages: DataFrame, config: Config, providers: Providers | None = None) -> dict[str, DataFrame]:
    """Tables by name. Messages have at least the columns that ``sources.tables.messages`` gives; a conversation with a node id twice
    raises."""
    p = providers or Providers()
    m = kept(forest.checked(messages))
    info, shown = kept(forest.attributes(m)), forest.visible(m)
    corpora = kept(forest.corpus(m))
    found = kept(keywords.keywords(keywords.term_units(shown, info.select("conversation_id", "title")), config.keywords))
    topic = keywords.topics(info.select("conversation_id", "title"), found, config.topics)
    current = kept(forest.current_path(m, info.where("current_node is not null").select("conversation_id", "current_node")))
    order = kept(forest.conversations(m))
    base = info.select("conversation_id").join(keywords.categories(corpora), "conversation_id", "left").select("conversation_id", F.coalesce("category", F.lit(C.UNCATEGORIZED)).alias("category"))
    told = overridden(base.join(topics.listed(topic, "topic", "topics"), "conversation_id", "left"), p.analyzer(language_model.spoken(m, current))) if p.analyzer else None
    of_messages = graph.keyword_edges(found)
    if told is not None:
        told = kept(told)
        theirs = told.where("model_keywords is not null").select("conversation_id", F.posexplode("model_keywords").alias("rank", "k")).select("conversation_id", "rank", "k.keyword", "k.score")
        found = kept(found.join(told.where("model_keywords is not null").select("conversation_id"), "conversation_id", "left_anti").unionByName(theirs))
        base = told.select("conversation_id", "category")
        topic = told.select("conversation_id", F.posexplode("topics").alias("rank", "topic"))
    predicted = kept(p.predictor(corpora)) if p.predictor and config.category_provider != "heuristic" else None
    chosen = kept(C.selected(C.predictions(base, predicted, config.category_provider), {"mlnet": "model"}.get(config.category_provider, config.category_provider)))
    facets = kept(C.facets(chosen))
    merged = kept(topics.merged(topic, found, facets, info))
    vectors = kept(p.embedder(corpora) if p.embedder else hash_vectors(corpora, config.hash_embedding_dim))
    description = p.description or f"hash:{config.hash_embedding_dim}"
    titles = info.select(F.col("conversation_id").alias("id"), "title")
    pairs, neighbors = similarity.snapshot(vectors, titles, config.threshold(description), config.max_similar_neighbors)
    cluster = kept(similarity.numbered(similarity.components(titles.select("id"), pairs)).select(F.col("id").alias("conversation_id"), "cluster"))
    community = kept(M.communities(facets))
    summary = told.select("conversation_id", "model_summary") if told is not None else info.select("conversation_id", F.lit(None).cast("string").alias("model_summary"))
    analysis = info.join(facets, "conversation_id", "left").join(merged, "conversation_id", "left").join(summary, "conversation_id", "left").join(cluster, "conversation_id", "left").join(community, "conversation_id", "left")
    source = chosen.where("is_selected").select("conversation_id", F.col("source").alias("category_source"))
    own = found.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword", "score"))), lambda s: F.struct(s["keyword"].alias("keyword"), s["score"].alias("score"))).alias("keywords"))
    listed = chosen.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "score", "source", "is_selected"))).alias("predictions"))
    analysis = kept(analysis.join(source, "conversation_id", "left").join(own, "conversation_id", "left").join(listed, "conversation_id", "left").fillna(C.UNCATEGORIZED, ["category"]))
    clusters = kept(topics.cluster_records(cluster, analysis, found))
    if p.labeler and config.labels_clusters():
        members = cluster.join(analysis.select("conversation_id", "title", "category", F.col("model_summary").alias("summary")), "conversation_id")
        clusters = kept(p.labeler(clusters, members))
    communities = kept(topics.community_records(community, facets, found))
    together = kept(keywords.cooccurrence(found, config.cooccurrence_keywords, config.cooccurrence_min))
    hierarchy = kept(keywords.hierarchy(facets.select("category")))
    chunking = wordpiece.chunker(config.chunking_provider if p.vocabulary or config.chunking_provider == "char" else "auto", p.vocabulary)
    if chunking == "char":
        chunks = keywords.message_chunks(m, config.chunk_chars).withColumn("tokens", F.lit(None).cast("int"))
    else:
        chunks = wordpiece.token_chunks(m, p.vocabulary, config.chunk_max_tokens, config.chunk_overlap_tokens).withColumn("chunk_hash", X.chunk_hash(F.col("kind"), F.col("chunk")))
    parents = forest.linked(m)
    reply = graph.reply_edges(parents)
    of_conversation = graph.deduplicated(of_messages, graph.facet_edges(chosen, facets), graph.topic_edges(merged)).withColumn("scope", F.col("from_id"))
    of_nodes = reply.join(m.select(F.col("node_id").alias("from_id"), F.col("conversation_id").alias("scope")), "from_id").select(*reply.columns, "scope")
    everywhere = graph.deduplicated(
        graph.similar_edges(pairs),
        graph.group_edges(clusters, cluster, "cluster", "belongs_to_cluster", "cluster_category", "cluster_keyword"),
        graph.group_edges(communities, community, "community", "belongs_to_category_community", "community_category", "community_keyword"),
        graph.cooccurrence_edges(together),
        graph.hierarchy_edges(hierarchy),
    ).withColumn("scope", F.lit("global"))
    edges = of_conversation.unionByName(of_nodes).unionByName(everywhere)
    edges = kept(graph.deduplicated_in_scope(edges.withColumnRenamed("scope", "scope_id").withColumn("metadata_json", F.lit(None).cast("string"))))
    known = info.select(F.col("conversation_id").alias("id"), F.col("title").alias("label"), F.lit("conversation").alias("kind"), F.lit(1).alias("prio"))
    known = known.unionByName(graph.message_nodes(m)).unionByName(graph.keyword_nodes(found))
    for records, group, kind in ((clusters, "cluster", "topic_cluster"), (communities, "community", "category_community")):
        known = known.unionByName(graph.record_nodes(records, group, kind))
    branches = forest.leaves(m).groupBy("conversation_id").agg(F.count("*").alias("branches"))
    comparison = kept(C.compared_predictions(base, predicted, facets, chosen)) if predicted is not None else None
    rows = kept(K.catalog(analysis, neighbors, branches, clusters, communities, comparison))
    tables = {
        "messages": m, "conversations": info, "analysis": analysis, "keywords": found, "topics": merged, "chunks": chunks, "predictions": chosen, "facets": facets, "vectors": vectors, "similar": pairs,
        "neighbors": neighbors, "clusters": clusters, "cluster_members": cluster, "communities": communities, "community_members": community, "cooccurrence": together, "hierarchy": hierarchy, "edges": edges,
        "nodes": graph.nodes(edges, known), "catalog": rows, "summary": K.summary(rows, edges, together, description.split(":")[0], description), "paths": forest.leaf_paths(m), "corpora": corpora, "order": order,
        "current": current,
    }
    if comparison is not None:
        tables |= {"category_comparison": comparison, "category_disagreements": C.disagreements(comparison, info)}
    if told is not None:
        tables["model_edges"] = graph.model_edges(told)
    return tables


def examples(tables: dict[str, DataFrame], least: int = 4) -> DataFrame:
    """label, text of an index's conversations for the classifier: rare labels collapsed, repeats in any case gone."""
    a = tables["analysis"].join(tables["corpora"], "conversation_id")
    text = classifier.training_text(F.col("title"), F.col("topics"), F.transform("keywords", lambda k: k["keyword"]), F.col("corpus"))
    order = tables["order"].select("conversation_id", F.col("conv_idx").alias("place"))
    return C.collapsed_labels(a.join(order, "conversation_id").select(F.col("category").alias("label"), text.alias("text"), "place"), least)


def insights(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return K.insights(tables["catalog"], tables["clusters"], tables["communities"], tables["edges"], tables["cooccurrence"])


def embedding_comparison(corpora: DataFrame, titles: DataFrame, left: Embedder, right: Embedder, left_threshold: float, right_threshold: float, k: int = 4) -> dict[str, DataFrame]:
    """Two providers over the same corpora: their neighbour lists, the overlap of their edges, and where they differ most."""
    (e1, n1), (e2, n2) = similarity.snapshot(left(corpora), titles, left_threshold, k), similarity.snapshot(right(corpora), titles, right_threshold, k)
    overlap, differences = similarity.compared(e1, e2, titles)
    return {"left": n1, "right": n2, "overlap": overlap, "differences": differences}


def size_reports(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"clusters": reports.size_histogram(tables["cluster_members"], "cluster"), "communities": reports.size_histogram(tables["community_members"], "community")}
