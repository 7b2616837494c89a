"""Sinks: relational tables, quoted CSV, JSON, DOT, transcripts, reports."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import files

RULE, LINE = "=" * 80, "-" * 80


# The key of each table.
KEYS = {
    "conversations": ("conversation_id",),
    "messages": ("node_id",),
    "conversation_keywords": ("conversation_id", "keyword"),
    "conversation_topics": ("conversation_id", "topic"),
    "conversation_chunks": ("conversation_id", "chunk_hash"),
    "conversation_category_predictions": ("conversation_id", "category"),
    "conversation_embeddings": ("conversation_id",),
    "topic_clusters": ("cluster_id",),
    "topic_cluster_members": ("cluster_id", "conversation_id"),
    "category_communities": ("community_id",),
    "category_community_members": ("community_id", "conversation_id"),
    "keyword_cooccurrence": ("left_keyword", "right_keyword"),
    "category_hierarchy": ("parent", "child"),
    "graph_edges": ("scope_id", "from_id", "to_id", "edge_type"),
}


def _manifests(path: str) -> list[str]:
    fs, root = files.filesystem(path)
    found = fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith("_manifest-") and f.base_name.endswith(".json"))


def write_database(tables: dict[str, DataFrame], path: str, keys: dict[str, tuple[str, ...]] = KEYS, keep: int = 2) -> None:
    """All tables or none: each is written to a folder of this version and its key is checked there (a null or repeated key raises), then a
    manifest with their places, columns and keys gets its name. Readers follow the last manifest, so they see the old set
    until then. The last ``keep`` versions stay."""
    fs, root = files.filesystem(path)
    before = _manifests(path)
    number, version = int(before[-1][10:18]) + 1 if before else 1, uuid.uuid4().hex
    said = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
        written, key = df.sparkSession.read.parquet(f"{path}/{version}/{name}"), list(keys.get(name, ()))
        wrong = written.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*(F.col(c).isNull() for c in key), F.lit(False))).limit(3).collect() if key else []
        if wrong:
            raise ValueError(f"{name}: null or repeated keys: {[tuple(r)[:-1] for r in wrong]}")
        said[name] = {"path": f"{version}/{name}", "key": key, "columns": [f"{c} {k}" for c, k in written.dtypes]}
    temp = f"{root}/{version}.tmp"
    with fs.open_output_stream(temp) as out:
        out.write(json.dumps({"version": version, "tables": said}, indent=1).encode())
    fs.move(temp, f"{root}/_manifest-{number:08d}.json")
    for old in before[: max(0, len(before) + 1 - keep)]:
        with fs.open_input_stream(f"{root}/{old}") as f:
            gone = json.loads(f.read())["version"]
        fs.delete_file(f"{root}/{old}")
        fs.delete_dir(f"{root}/{gone}")


def read_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last whole version."""
    fs, root = files.filesystem(path)
    found = _manifests(path)
    if not found:
        raise FileNotFoundError(f"no database in {path}")
    with fs.open_input_stream(f"{root}/{found[-1]}") as f:
        said = json.loads(f.read())["tables"]
    return {name: spark.read.schema(", ".join(t["columns"])).parquet(f"{path}/{t['path']}") for name, t in said.items()}


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, lists joined by " | "; lists of structs as JSON."""
    def flat(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith(("array<struct", "struct", "map")):
            return F.to_json(c).alias(name)
        return F.array_join(c.cast("array<string>"), " | ").alias(name) if kind.startswith("array") else c

    df.select(*(flat(*x) for x in df.dtypes)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_normalized(messages: DataFrame, path: str) -> None:
    """Messages as JSON, by time."""
    messages.orderBy(F.col("create_time").asc_nulls_first(), "conversation_id", "node_id").write.mode("overwrite").json(path)


# A node's shape by its kind.
SHAPES = (("conversation", "box"), ("topic_cluster", "oval"), ("category_community", "octagon"), ("keyword", "diamond"), ("category", "hexagon"), ("topic", "ellipse"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines (value, section, a, b, c) of one DOT document: a node's shape tells its kind, an edge's label its type and weight. Line
    ends and quotes in labels are escaped."""
    esc = lambda c: F.regexp_replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), r"\r\n|\r|\n", r"\\n")
    shape = F.lit("plaintext")
    for kind, name in SHAPES:
        shape = F.when(F.col("kind") == kind, name).otherwise(shape)
    spark = nodes.sparkSession
    frame = spark.createDataFrame([("digraph conversations {", 0, "", "", ""), ("  rankdir=LR;", 1, "", "", ""), ("}", 4, "", "", "")], "value string, section int, a string, b string, c string")
    n = nodes.select(F.format_string('  "%s" [shape=%s,label="%s"];', esc(F.col("id")), shape, esc(F.col("label"))).alias("value"), F.lit(2).alias("section"), F.col("kind").alias("a"), X.folded(F.coalesce("label", F.lit(""))).alias("b"), F.col("id").alias("c"))
    e = edges.select(F.format_string('  "%s" -> "%s" [label="%s:%s"];', esc(F.col("from_id")), esc(F.col("to_id")), esc(F.col("edge_type")), X.short_number(F.col("weight"))).alias("value"), F.lit(3).alias("section"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("edge_type").alias("c"))
    return frame.unionByName(n).unionByName(e)


def _listed(df: DataFrame, *order: str) -> DataFrame:
    """key, value: rows as JSON, by the columns of ``order``, which tell rows apart."""
    return df.select(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_graph(t: dict[str, DataFrame], path: str) -> None:
    """Nodes and edges as JSON lines, as one DOT document and one JSON document, and the corpus index as one."""
    nodes, edges = t["nodes"], t["edges"]
    write_json(nodes, f"{path}/nodes")
    write_json(edges, f"{path}/edges")
    files.write_document(dot_lines(nodes, edges), ["section", "a", "b", "c"], f"{path}/conversation-graph.dot")
    graph = {"nodes": _listed(nodes, "kind", "label", "id"), "edges": _listed(edges, "from_id", "to_id", "edge_type", "scope_id")}
    files.write_document(files.json_document(graph), ["section", "key"], f"{path}/conversation-graph.json")
    listed = ["conversation_id", "title", "category", "secondary", "tertiary", "category_source", "community", "community_label", "topic_label", "cluster", "model_summary", "topics", "keywords", "predictions"]
    sections = {
        "conversations": _listed(t["catalog"].select(*listed), "conversation_id"),
        "topic_clusters": _listed(t["clusters"], "cluster"),
        "category_communities": _listed(t["communities"], "community"),
        "keyword_cooccurrences": _listed(t["cooccurrence"], "left_keyword", "right_keyword"),
        "category_hierarchy": _listed(t["hierarchy"], "parent", "child"),
        **{f"graph/{k}": v for k, v in graph.items()},
    }
    files.write_document(files.json_document(sections), ["section", "key"], f"{path}/corpus-index.json")


def database(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relational tables of an index, one row a key; edges carry their scope."""
    members = lambda name, group: t[name].select(F.col(group).alias(f"{group}_id"), "conversation_id")
    c = t["catalog"].select("conversation_id", "title", "created", "source_file", "category", "secondary", "tertiary", "category_source", "community", "community_label", "cluster", "cluster_label", "topic_label", "model_summary", "branches")
    shown = t["messages"].where(F.col("role").isNotNull() | ~X.is_blank(F.col("text")) | ~X.is_blank(F.col("aggregate_code")))
    return {
        "conversations": c.withColumn("embedding_provider", F.lit(None).cast("string")) if "summary" not in t else c.crossJoin(F.broadcast(t["summary"].select("embedding_provider"))),
        "messages": shown.dropDuplicates(["node_id"]),
        "conversation_keywords": t["keywords"].groupBy("conversation_id", "keyword").agg(F.max("score").alias("score")),
        "conversation_topics": t["topics"].join(t["facets"].select("conversation_id", "category"), "conversation_id", "left").select("conversation_id", F.explode(F.array_distinct("topics")).alias("topic"), "category", "topic_label"),
        "conversation_chunks": t["chunks"].dropDuplicates(["conversation_id", "chunk_hash"]).select("conversation_id", "node_id", "kind", "chunk_hash", "chunk", "tokens"),
        "conversation_category_predictions": t["predictions"],
        "conversation_embeddings": t["vectors"].select(F.col("id").alias("conversation_id"), F.to_json("v").alias("vector_json"), F.size("v").alias("dimensions")),
        "topic_clusters": t["clusters"].select(F.col("cluster").alias("cluster_id"), "label", "summary", "category", F.to_json("keywords").alias("keywords_json")),
        "topic_cluster_members": members("cluster_members", "cluster"),
        "category_communities": t["communities"].select(F.col("community").alias("community_id"), "label", "summary", "category", F.to_json("categories").alias("categories_json"), F.to_json("keywords").alias("keywords_json")),
        "category_community_members": members("community_members", "community"),
        "keyword_cooccurrence": t["cooccurrence"],
        "category_hierarchy": t["hierarchy"],
        "graph_edges": t["edges"],
    }


def _line(name: str, value: Column, always: bool = False) -> Column:
    out = F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"))
    return out if always else F.when(~X.is_blank(value.cast("string")), out).otherwise(F.lit(""))


def node_text() -> Column:
    """A message with its heading, and code, output and attachments in blocks of their own."""
    tail = lambda c: F.regexp_replace(F.col(c), r"\s+$", "")
    have = lambda c, body: F.when(~X.is_blank(F.col(c)), body).otherwise(F.lit(""))
    block = lambda c, name: have(c, F.concat(F.lit(f"\n```{name}\n"), tail(c), F.lit("\n```\n")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("] Node="), "node_id", F.lit(" Parent="), empty(F.col("parent_node_id")), F.lit(" Time="), X.unix_text(F.col("create_time")), F.lit(" ContentType="), empty(F.col("content_type")), F.lit("\n"))
    return F.concat(head, have("text", F.concat(tail("text"), F.lit("\n"))), block("aggregate_code", "code"), block("execution_output", "execution_output"), have("attachments_json", F.concat(F.lit("\nAttachments:\n"), tail("attachments_json"), F.lit("\n"))), F.lit(f"\n{LINE}\n\n"))


def _nodes(messages: DataFrame) -> DataFrame:
    missing = [c for c in ("content_type", "attachments_json", "parent_node_id") if c not in messages.columns]
    m = messages.withColumns({c: F.lit(None).cast("string") for c in missing})
    return m.select("conversation_id", "node_id", node_text().alias("part"))


def _joined(paths: DataFrame, nodes: DataFrame, *key: str) -> DataFrame:
    j = paths.join(nodes, ["conversation_id", "node_id"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return j.select(*key, F.array_join(F.transform("p", lambda s: s["part"]), "").alias("body"))


def transcripts(t: dict[str, DataFrame]) -> DataFrame:
    """conversation_id, branch (0: the current path), name, document of every conversation and branch of an index."""
    counts = t["chunks"].groupBy("conversation_id").agg(F.count("*").alias("chunk_n"), F.sum("tokens").alias("chunk_tokens"))
    current = t["conversations"].select("conversation_id", "current_node")
    a = t["catalog"].join(counts, "conversation_id", "left").join(current, "conversation_id", "left")
    comma = lambda c: F.array_join(c, ", ")
    words = comma(F.transform("keywords", lambda k: F.concat(k["keyword"], F.lit(":"), X.short_number(k["score"]))))
    mark = lambda p: F.concat(p["category"], F.lit(":"), X.short_number(p["score"]), F.lit(" ["), p["source"], F.when(p["is_selected"], ",selected").otherwise(""), F.lit("]"))
    col = F.col
    head = [_line("Title", col("title"), True), _line("ConversationId", col("conversation_id"), True)]
    facets = [_line("Category", col("category"), True), _line("SecondaryCategory", col("secondary")), _line("TertiaryCategory", col("tertiary"))]
    community = [_line("CategoryCommunity", col("community")), _line("CategoryCommunityLabel", col("community_label"))]
    sizes = [_line("ChunkCount", col("chunk_n")), _line("ChunkTokens", col("chunk_tokens")), _line("Topics", comma("topics"), True)]
    group = [_line("TopicLabel", col("topic_label")), _line("TopicCluster", col("cluster")), _line("TopicClusterLabel", col("cluster_label"))]
    main = F.concat(*head, _line("SourceFile", col("source_file"), True), _line("Created", col("created"), True), _line("CurrentNode", col("current_node"), True), *facets, _line("CategorySource", col("category_source")), *community, *sizes, *group, _line("TopicClusterSummary", col("cluster_summary")), _line("Keywords", words, True), _line("CategoryCandidates", comma(F.transform("predictions", mark))), _line("ModelSummary", col("model_summary")), F.lit(f"{RULE}\n\n"))
    branch = F.concat(*head, _line("Branch", col("branch"), True), *facets, *community, *sizes, *group, F.lit(f"{LINE}\n\n"))
    nodes, name = _nodes(t["messages"]), X.stored_name(X.safe_name(col("title"), col("conversation_id")))
    body = F.coalesce("body", F.lit(""))
    one = a.join(_joined(t["current"], nodes, "conversation_id"), "conversation_id", "left").select("conversation_id", F.lit(0).alias("branch"), name.alias("name"), F.concat(main, body).alias("document"))
    each = a.join(_joined(t["paths"], nodes, "conversation_id", "branch"), "conversation_id").select("conversation_id", "branch", F.concat(name, F.format_string("__branch-%03d", "branch")).alias("name"), F.concat(branch, body).alias("document"))
    return one.unionByName(each)


def write_transcripts(documents: DataFrame, path: str) -> None:
    """``path``/transcripts/NAME.txt for each conversation, as the catalog links it, and ``path``/branches/NAME.txt for each branch (UTF-8, no
    mark in front)."""
    folder = F.when(F.col("branch") == 0, "transcripts").otherwise("branches").alias("folder")
    files.write_named(documents.select(folder, F.concat("name", F.lit(".txt")).alias("name"), "document", "conversation_id", "branch"), path, ["conversation_id", "branch"])


def markdown(title: str, sections: dict[str, DataFrame], top: int = 25) -> str:
    """A report for reading: the first rows of each list."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(top).collect()
        out += [f"## {name.replace('_', ' ').capitalize()}", ""]
        if not rows:
            out += ["None.", ""]
            continue
        cell = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""]
    return "\n".join(out)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file in a folder of Spark's."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_reports(t: dict[str, DataFrame], lists: dict[str, DataFrame], path: str) -> None:
    """Insights as JSON and Markdown, the four overviews as CSV, and the navigator's data."""
    spark = t["catalog"].sparkSession
    for name, df in lists.items():
        write_json(df, f"{path}/insights/{name}")
    write_text(spark, markdown("Corpus insights", {"summary": t["summary"], **lists}), f"{path}/insights_md")
    short = ["conversation_id", "title", "created", "source_file", "branches", "category", "secondary", "tertiary", "category_source", "community", "community_label", "cluster", "cluster_label", "topic_label", "topics", "keywords", "bridge_score", "perspective_score", "category_disagrees", "transcript_path"]
    write_csv(t["catalog"].select(*short), f"{path}/catalog")
    write_csv(t["communities"], f"{path}/communities")
    write_csv(lists["bridges"], f"{path}/bridges")
    write_csv(t["clusters"], f"{path}/clusters")
    write_json(t["catalog"], f"{path}/navigator/conversations")
    write_json(t["summary"], f"{path}/navigator/summary")


def write_selection(rows: DataFrame, path: str) -> None:
    """A selection of the catalog as JSON and CSV."""
    write_json(rows, f"{path}/json")
    write_csv(rows, f"{path}/csv")
