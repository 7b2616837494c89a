"""The registered queries, each an application of operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import categories as C
from ..operators import classifier, communities, forest, graph, keywords, reports, similarity, wordpiece
from ..operators.store import kept
from ..sources import sinks
from ..sources.tables import messages, table
from . import config, index
from . import main as runs_of

THRESHOLD = 0.30


def _titles(m: DataFrame) -> DataFrame:
    """The first 40 characters of the first message; conversation 0, 10, 20 ... have none."""
    first = m.groupBy("conversation_id").agg(F.min_by("text", "create_time").alias("t"))
    t = F.when(~F.col("conversation_id").endswith("0"), F.left("t", F.lit(40)))
    return forest.titled(first.select("conversation_id", t.alias("title")))


def _terms(s: SparkSession, d: str) -> DataFrame:
    m = forest.visible(forest.usable(messages(s, d)))
    return keywords.term_units(m, _titles(m))


def _keywords(s: SparkSession, d: str) -> DataFrame:
    return keywords.keywords(_terms(s, d))


_INDEXES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _index(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The index of the folder's conversations, built once a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        m = messages(s, d)
        _INDEXES.clear()
        _INDEXES[key] = index.build(m.join(_titles(forest.usable(m)), "conversation_id", "left"), config.profile("heuristic"))
    return _INDEXES[key]


def _doc_category(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("category"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.similar_pairs(_vectors(s, d), THRESHOLD)


def _best(s: SparkSession, d: str, k: int = 4) -> DataFrame:
    return similarity.best_neighbors(_vectors(s, d), THRESHOLD, k)


def _edges(s: SparkSession, d: str, k: int = 4) -> DataFrame:
    return similarity.edges_of(_best(s, d, k), k)


def _catalog(s: SparkSession, d: str) -> DataFrame:
    """Vectors as a catalog: facets from the label and the id."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    cat = F.concat(F.lit("c"), (F.col("label") % 5).cast("string"))
    second = F.when(F.col("id") % 3 == 0, F.concat(F.lit("c"), ((F.col("label") + 1) % 5).cast("string")))
    third = F.when(F.col("id") % 6 == 0, F.concat(F.lit("c"), ((F.col("label") + 2) % 5).cast("string")))
    return v.select("id", cat.alias("category"), second.alias("secondary"), third.alias("tertiary"), (F.col("id") % 7).cast("string").alias("cluster"))


def _predictions(s: SparkSession, d: str) -> DataFrame:
    """A baseline and four model predictions a conversation, made from the id."""
    c = table(s, d, "conversations").select(F.col("conv_id").alias("k")).distinct()
    rows = F.array(F.struct(F.lit(0).alias("pos"), F.concat(F.lit("c"), (F.col("k") % 4).cast("string")).alias("category"), F.lit(0.75).alias("score"), F.lit("baseline").alias("source")), *(
        F.struct(F.lit(i).alias("pos"), F.concat(F.lit("c"), ((F.col("k") * i + i) % 7).cast("string")).alias("category"), F.lit(w).alias("score"), F.lit("model").alias("source")) for i, w in ((1, 0.40), (2, 0.22), (3, 0.15), (4, 0.10))))
    return c.select(F.col("k").cast("string").alias("conversation_id"), F.inline(rows))


def _runs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(i).alias("i")) for i, p in enumerate(("heuristic", "hybrid", "mlnet", "onnx"))))).alias("p"))
    shift = F.when((F.col("id") % 11) < F.col("p.i"), 1).otherwise(0)
    return e.select("p.profile", "id", F.concat(F.lit("c"), ((F.col("label") + shift) % 5).cast("string")).alias("category"), ((F.col("id") * (F.col("p.i") + 1)) % 13).alias("bridge_score"))


def messages_visible(s, d):
    return forest.message_order(forest.usable(messages(s, d))).select("conversation_id", "node_id", "pos")


def parent_links(s, d):
    return forest.linked(messages(s, d)).select("conversation_id", "node_id", "parent")


def leaf_paths(s, d):
    return forest.leaf_paths(messages(s, d))


def current_path(s, d):
    return forest.current_path(messages(s, d))


def conversation_order(s, d):
    return forest.conversations(messages(s, d))


def corpus_hash(s, d):
    return forest.corpus(messages(s, d)).select("conversation_id", F.char_length("corpus").cast("long").alias("n_chars"), F.sha2("corpus", 256).alias("corpus_sha256"))


def transcripts(s, d):
    m = messages(s, d)
    return reports.transcripts(forest.leaf_paths(m), m).select("conversation_id", "branch", "n_messages", F.sha2("document", 256).alias("document_sha256"))


def token_counts(s, d):
    m = messages(s, d).select(F.explode(X.split_lines(F.col("text"))).alias("raw"))
    return m.select(F.explode(X.tokens(X.plain_line(F.col("raw")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def term_weights(s, d):
    return _terms(s, d)


def keywords_top(s, d):
    return _keywords(s, d)


def topics_top(s, d):
    m = forest.visible(forest.usable(messages(s, d)))
    t = _titles(m)
    return keywords.topics(t, keywords.keywords(keywords.term_units(m, t)))


def category_scores(s, d):
    return keywords.categories(forest.corpus(messages(s, d)))


def keyword_cooccurrence(s, d):
    return keywords.cooccurrence(_keywords(s, d))


def category_hierarchy(s, d):
    return keywords.hierarchy(_doc_category(s, d))


def char_chunks(s, d):
    m = table(s, d, "documents").select(F.col("source").alias("conversation_id"), F.col("doc_id").cast("string").alias("node_id"), "text", F.lit(None).cast("string").alias("aggregate_code"), F.lit(None).cast("string").alias("execution_output"))
    return keywords.message_chunks(m).select("conversation_id", "node_id", "pos", "chunk_hash")


def token_chunks(s, d):
    """Documents cut by a vocabulary of their own."""
    t = table(s, d, "documents")
    none = F.lit(None).cast("string")
    m = t.select("source", F.col("doc_id").cast("string").alias("node_id"), F.col("source").alias("conversation_id"), "text", none.alias("aggregate_code"), none.alias("execution_output"))
    cut = wordpiece.token_chunks(m, wordpiece.found_vocabulary(t.select("text")))
    return cut.select("conversation_id", "node_id", "pos", "tokens", X.chunk_hash(F.col("kind"), F.col("chunk")).alias("chunk_hash"))


def stored_chunks(s, d):
    return keywords.stored_chunks(char_chunks(s, d)).groupBy("conversation_id").agg(F.count("*").alias("chunks"))


def hash_embeddings(s, d):
    m = messages(s, d).select("conversation_id", F.explode(X.split_lines(F.col("text"))).alias("raw"))
    t = m.select("conversation_id", F.explode(X.tokens(X.plain_line(F.col("raw")))).alias("token")).groupBy("conversation_id", "token").agg(F.count("*").alias("n"))
    return keywords.hash_embedding(t).select("conversation_id", "bucket", F.round("value", 6).alias("value"))


def similar_pairs(s, d):
    return _pairs(s, d).select("a", "b", F.round("score", 4).alias("score"))


def similar_classes(s, d):
    return similarity.similar_classes(_vectors(s, d), THRESHOLD)


def similar_edges(s, d):
    return _edges(s, d)


def neighbor_lists(s, d):
    return similarity.neighbors(_edges(s, d))


def clusters(s, d):
    return similarity.numbered(similarity.components(_vectors(s, d).select("id"), _edges(s, d)))


def cluster_sizes(s, d):
    return reports.size_histogram(clusters(s, d), "cluster")


def embedding_overlap(s, d):
    p = kept(_best(s, d))
    return similarity.edge_overlap(similarity.edges_of(p, 4), similarity.edges_of(p, 2))


def neighbor_changes(s, d):
    p = kept(_best(s, d))
    return similarity.neighbor_changes(similarity.edges_of(p, 4), similarity.edges_of(p, 2))


def predictions_selected(s, d):
    return C.selected(_predictions(s, d))


def category_facets(s, d):
    return C.facets(C.selected(_predictions(s, d)))


def category_communities(s, d):
    return communities.communities(C.facets(C.selected(_predictions(s, d))))


def signature_groups(s, d):
    return communities.signatures(C.facets(C.selected(_predictions(s, d)))).select("signature", "n")


def label_examples(s, d):
    return C.collapsed_labels(table(s, d, "pages").select(F.regexp_extract("url", r"//([^/]+)", 1).alias("label"), F.col("html").alias("text"), F.col("page_id").alias("place")))


def category_agreement(s, d):
    return C.comparison(table(s, d, "labels").select(F.col("quality").alias("baseline"), F.col("toxic").alias("model")))


def graph_edges(s, d):
    m = messages(s, d)
    k = kept(_keywords(s, d))
    return graph.deduplicated(graph.reply_edges(forest.linked(m)), graph.keyword_edges(k), graph.category_edges(keywords.categories(forest.corpus(m))), graph.cooccurrence_edges(keywords.cooccurrence(k)), graph.hierarchy_edges(keywords.hierarchy(_doc_category(s, d))))


def graph_nodes(s, d):
    m = messages(s, d)
    e = graph_edges(s, d)
    return graph.nodes(e, graph.message_nodes(m))


def bridge_scores(s, d):
    return reports.bridges(_catalog(s, d), similarity.neighbors(_edges(s, d)))


def category_blends(s, d):
    return reports.blends(_catalog(s, d)).withColumn("examples", F.array_join("examples", ","))


def category_insights(s, d):
    return reports.category_insights(_catalog(s, d))


def cross_category(s, d):
    return reports.cross_category(_edges(s, d), _catalog(s, d))


def perspective(s, d):
    p = kept(_best(s, d))
    wrong = _catalog(s, d).select("id", (F.col("id") % 9 == 0).alias("disagrees"))
    return reports.perspective(wrong, similarity.neighbors(similarity.edges_of(p, 4)), similarity.neighbors(similarity.edges_of(p, 2)))


def primary_categories(s, d):
    return reports.primary_category(_catalog(s, d), "cluster")


def profile_matrix(s, d):
    return reports.profile_matrix(_runs(s, d))


def profile_agreement(s, d):
    return reports.profile_agreement(_runs(s, d))


def profile_hot_paths(s, d):
    return reports.hot_paths(reports.profile_matrix(_runs(s, d))).select("id", "max_bridge", "categories")


def profile_top_bridges(s, d):
    return reports.top_bridges(_runs(s, d))


def catalog_selection(s, d):
    c = _catalog(s, d).withColumn("search_text", reports.search_text(["category", "secondary", "tertiary", "cluster"]))
    return reports.select_catalog(c, text="C1", any_of=["c1", "c2"]).select("id", "search_text")


def text_filter(s, d):
    return reports.matching_messages(messages(s, d), pattern="the|plot|chart").select("conversation_id", "node_id", "role")


def scalar_formats(s, d):
    e = table(s, d, "events")
    unix = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select("event_id", X.unix_text(unix).alias("at"), X.file_name(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).alias("file_name"), X.fnv1a(F.col("event_type")).alias("fnv"), X.leaf(F.concat_ws(" / ", "event_type", F.col("user_id").cast("string"))).alias("leaf"))


def index_catalog(s, d):
    """Lists as texts; scores in ten-thousandths, which is how they are rounded."""
    ten = lambda c: F.round(c * 10_000).cast("long").cast("string")
    text = lambda *parts: F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    listed = {
        "keywords": F.transform("keywords", lambda k: text(k["keyword"], ten(k["score"]))),
        "predictions": F.transform("predictions", lambda p: text(p["rank"], p["category"], ten(p["score"]), p["source"], p["is_selected"])),
        "neighbors": F.transform("neighbors", lambda n: text(n["rank"], n["id"], n["title"], ten(n["score"]), n["category"], n["cluster"])),
        "topics": F.col("topics"),
        "neighbor_categories": F.col("neighbor_categories"),
    }
    return _index(s, d)["catalog"].withColumns({k: F.array_join(v, " | ") for k, v in listed.items()})


def index_summary(s, d):
    return _index(s, d)["summary"]


def index_edges(s, d):
    return _index(s, d)["edges"].drop("metadata_json")


def index_nodes(s, d):
    return _index(s, d)["nodes"]


def index_clusters(s, d):
    return _index(s, d)["clusters"].withColumns({c: F.array_join(c, " | ") for c in ("ids", "keywords", "categories")})


def index_communities(s, d):
    return _index(s, d)["communities"].withColumns({c: F.array_join(c, " | ") for c in ("ids", "keywords", "categories")})


def index_transcripts(s, d):
    return sinks.transcripts(_index(s, d)).select("conversation_id", "branch", "name", F.sha2("document", 256).alias("document_sha256"))


def index_examples(s, d):
    e = index.examples(_index(s, d))
    return e.select("label", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def prediction_edges(s, d):
    chosen = C.selected(_predictions(s, d))
    return graph.facet_edges(chosen, C.facets(chosen))


def prediction_comparison(s, d):
    p = _predictions(s, d)
    chosen = C.selected(p)
    of = lambda source: p.where(F.col("source") == source)
    return C.compared_predictions(of("baseline"), of("model"), C.facets(chosen), chosen)


def label_distribution(s, d):
    return classifier.label_distribution(table(s, d, "pages").select(F.regexp_extract("url", r"//([^/]+)", 1).alias("label")))


def perspective_summary(s, d):
    p = kept(_best(s, d))
    wrong = _catalog(s, d).select("id", (F.col("id") % 9 == 0).alias("disagrees"))
    left, right = (similarity.neighbors(similarity.edges_of(p, k)) for k in (4, 2))
    return reports.perspective_counts(reports.perspective(wrong, left, right, 1 << 30))


def profile_summaries(s, d):
    return reports.profile_summaries(_runs(s, d).withColumn("cluster_label", F.lit("c")))


def profile_full_matrix(s, d):
    r = _runs(s, d)
    named = r.withColumn("title", F.concat(F.lit("t"), "id")).withColumn("topic_label", F.lower("category")).withColumn("cluster_label", F.when(F.col("id") % 2 == 0, F.col("category"))).withColumn("perspective_score", F.col("bridge_score") * 2)
    return runs_of.profile_report(named)["hot_paths"]


def score_softmax(s, d):
    v = _vectors(s, d).select("id", F.posexplode(classifier.softmax(F.col("v").cast("array<double>"))).alias("pos", "score"))
    return v.select("id", "pos", F.round("score", 9).alias("score"))


def scalar_labels(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", X.humanized(F.concat_ws("_", "p_type", "p_name")).alias("label"), X.href(F.col("p_name")).alias("href"), X.short_number(F.col("p_retailprice") / 7).alias("price"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        messages_visible, parent_links, leaf_paths, current_path, conversation_order, corpus_hash, transcripts, token_counts, term_weights, keywords_top, topics_top,
        category_scores, keyword_cooccurrence, category_hierarchy, char_chunks, token_chunks, stored_chunks, hash_embeddings, similar_pairs, similar_classes, similar_edges, neighbor_lists, clusters,
        cluster_sizes, embedding_overlap, neighbor_changes, predictions_selected, category_facets, category_communities, signature_groups, label_examples,
        category_agreement, graph_edges, graph_nodes, bridge_scores, category_blends, category_insights, cross_category, perspective, primary_categories,
        profile_matrix, profile_agreement, profile_hot_paths, profile_top_bridges, catalog_selection, text_filter, scalar_formats,
        index_catalog, index_summary, index_edges, index_nodes, index_clusters, index_communities, index_transcripts, index_examples,
        prediction_edges, prediction_comparison, label_distribution, perspective_summary, profile_summaries, profile_full_matrix, score_softmax, scalar_labels,
    )
}
