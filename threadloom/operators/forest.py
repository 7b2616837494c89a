"""Conversation forests: parent links, leaves, paths, order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, or_default
from .store import kept, ranked


def usable(messages: DataFrame) -> DataFrame:
    return messages.where(~is_blank(F.col("conversation_id")) & ~is_blank(F.col("node_id")))


def visible(messages: DataFrame) -> DataFrame:
    """With a role, text or code; output alone doesn't count."""
    return messages.where(F.col("role").isNotNull() | ~is_blank(F.col("text")) | ~is_blank(F.col("aggregate_code")))


def path_visible(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isNotNull() | ~is_blank(F.col("text")) | ~is_blank(F.col("aggregate_code")) | ~is_blank(F.col("execution_output")))


def duplicate_nodes(messages: DataFrame) -> DataFrame:
    """Node ids that a conversation has more than once; a forest needs none."""
    return messages.groupBy("conversation_id", "node_id").count().where("count > 1")


def linked(messages: DataFrame) -> DataFrame:
    """``parent`` is the parent's id if the conversation has it, else null (a root)."""
    p = messages.select(F.col("conversation_id").alias("_c"), F.col("node_id").alias("parent")).distinct()
    return messages.join(p, (F.col("conversation_id") == F.col("_c")) & (F.col("parent_node_id") == F.col("parent")), "left").drop("_c")


def leaves(messages: DataFrame) -> DataFrame:
    p = messages.where("parent_node_id is not null").select("conversation_id", F.col("parent_node_id").alias("node_id")).distinct()
    return messages.join(p, ["conversation_id", "node_id"], "left_anti")


def conversations(messages: DataFrame) -> DataFrame:
    """conversation_id, started, n_messages, conv_idx (by first time, then id). The time of a message is the conversation's, if
    there is such a column and it is set, else its own."""
    own = F.coalesce("conversation_time", "create_time") if "conversation_time" in messages.columns else F.col("create_time")
    c = messages.groupBy("conversation_id").agg(F.min(own).alias("started"), F.count("*").alias("n_messages"))
    return ranked(c, [F.col("started").asc_nulls_last(), F.col("conversation_id")], "conv_idx")


def checked(messages: DataFrame) -> DataFrame:
    """The usable messages; raises if a conversation has a node id twice."""
    out = usable(messages)
    twice = duplicate_nodes(out).limit(5).collect()
    if twice:
        raise ValueError("duplicate node ids: " + ", ".join(f"{r.conversation_id}/{r.node_id}" for r in twice))
    return out


def attributes(messages: DataFrame) -> DataFrame:
    """conversation_id, title, current_node, conversation_time, source_file of each conversation's first row (by ``row_idx``,
    or time and id without it); columns that the messages lack are null."""
    names = ("title", "current_node", "conversation_time", "source_file")
    have = [F.col(c) if c in messages.columns else F.lit(None).cast("double" if c == "conversation_time" else "string").alias(c) for c in names]
    order = ["row_idx"] if "row_idx" in messages.columns else [F.col("create_time").isNull().alias("late"), "create_time", "node_id"]
    first = messages.groupBy("conversation_id").agg(F.min_by(F.struct(*have), F.struct(*order)).alias("f")).select("conversation_id", "f.*")
    return titled(first)


def titled(conversations: DataFrame) -> DataFrame:
    return conversations.withColumn("title", or_default(F.col("title"), "(untitled)"))


def message_order(messages: DataFrame) -> DataFrame:
    return visible(messages).withColumn("pos", F.row_number().over(W.partitionBy("conversation_id").orderBy(F.col("create_time").asc_nulls_last(), "node_id")))


PATHS = "conversation_id string, branch int, leaf string, depth int, pos int, node_id string"


def _paths_of(conversation: str, nodes: list[tuple]) -> list[tuple]:
    """Root-to-leaf paths of one conversation's nodes (id, parent, time or None, shown); a cycle ends where it meets itself.
    Hidden nodes hold a path together but have no pos."""
    parent = {n: p for n, p, _, _ in nodes}
    shown = {n: s for n, _, _, s in nodes}
    time = {n: float("inf") if t is None else t for n, _, t, _ in nodes}
    rows = []
    for k, end in enumerate(sorted(set(parent) - {p for p in parent.values() if p is not None}, key=lambda n: (time[n], n)), 1):
        path, seen, at = [], set(), end
        while at in parent and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[at]
        pos = 0
        for depth, n in enumerate(reversed(path)):
            rows.append((conversation, k, end, depth, pos if shown[n] else None, n))
            pos += shown[n]
    return rows


def _current_of(conversation: str, nodes: list[tuple]) -> list[tuple]:
    """The path to the current node of one conversation's nodes (id, parent, time or None, place in the input, shown, current node),
    else to its latest leaf; in a cycle it ends where it meets itself."""
    parent = {n[0]: n[1] for n in nodes}
    shown = {n[0]: n[4] for n in nodes}
    at = nodes[0][5] if nodes and nodes[0][5] in parent else None
    if at is None and nodes:
        inner = set(parent.values())
        ends = [n for n in nodes if n[0] not in inner]
        at = min(ends, key=lambda n: (n[2] is None, -(n[2] or 0.0), n[3]))[0] if ends else None
    path, seen = [], set()
    while at in parent and at not in seen:
        seen.add(at)
        path.append(at)
        at = parent[at]
    return [(conversation, pos, n) for pos, n in enumerate(n for n in reversed(path) if shown[n])]


def _by_conversation(of, schema: str):
    """Batches sorted by conversation to the rows that ``of`` makes of each; the last conversation of each waits for the next batch."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    def written(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=fields)

    def run(batches):
        at, waiting = None, []
        for batch in batches:
            rows = []
            for conversation, *node in zip(*(c.to_pylist() for c in batch.columns)):
                if conversation != at:
                    rows += of(at, waiting)
                    at, waiting = conversation, []
                waiting.append(tuple(node))
            yield written(rows)
        yield written(of(at, waiting))

    return run


def all_paths(messages: DataFrame) -> DataFrame:
    """conversation_id, branch (1 up, by the leaf's time and id), leaf, depth (from the root), pos (0 up among nodes that a path
    shows, else null), node_id. Conversations come to a task in order, many to a batch."""
    shown = F.col("role").isNotNull() | ~is_blank(F.col("text")) | ~is_blank(F.col("aggregate_code")) | ~is_blank(F.col("execution_output"))
    columns = messages.select("conversation_id", "node_id", "parent_node_id", F.nanvl("create_time", F.lit(None)).alias("create_time"), shown.alias("shown"))
    return columns.repartition("conversation_id").sortWithinPartitions("conversation_id").mapInArrow(_by_conversation(_paths_of, PATHS), PATHS)


def leaf_paths(messages: DataFrame) -> DataFrame:
    """conversation_id, branch, leaf, pos (0 up, from the root), node_id of the nodes that a path shows."""
    return all_paths(messages).where("pos is not null").select("conversation_id", "branch", "leaf", "pos", "node_id")


def current_path(messages: DataFrame, current: DataFrame | None = None, large: int = 10_000) -> DataFrame:
    """The path to the conversation's current node (conversation_id, current_node), else to its latest leaf, the first of the
    input (``row_idx``, or by id without it) on ties; of its nodes those that a path shows, as conversation_id, pos, node_id.

    Conversations come to a task in order, many to a batch, and each is walked once from its end. Those of over ``large`` messages are
    no task's own: their ancestors are found over the tables."""
    shown = F.col("role").isNotNull() | ~is_blank(F.col("text")) | ~is_blank(F.col("aggregate_code")) | ~is_blank(F.col("execution_output"))
    place = F.col("row_idx" if "row_idx" in messages.columns else "node_id").alias("place")
    rows = messages.select("conversation_id", "node_id", "parent_node_id", F.nanvl("create_time", F.lit(None)).alias("create_time"), place, shown.alias("shown"))
    named = current.dropDuplicates(["conversation_id"]).select("conversation_id", "current_node") if current is not None else None
    with_end = rows.join(named, "conversation_id", "left") if named is not None else rows.withColumn("current_node", F.lit(None).cast("string"))
    walk = lambda df: df.repartition("conversation_id").sortWithinPartitions("conversation_id").mapInArrow(_by_conversation(_current_of, CURRENT), CURRENT)
    big = kept(messages.groupBy("conversation_id").agg(F.count("*").alias("n")).where(F.col("n") > large))
    n = big.agg(F.count("*").alias("c"), F.max("n").alias("most")).first()
    if not n.c:
        return walk(with_end)
    # At most one in ``large`` rows of the input.
    own = kept(with_end.join(F.broadcast(big.select("conversation_id")), "conversation_id"))
    return walk(with_end.join(F.broadcast(big.select("conversation_id")), "conversation_id", "left_anti")).unionByName(_ancestors(own, n.most))


CURRENT = "conversation_id string, pos int, node_id string"


def _ancestors(rows: DataFrame, most: int) -> DataFrame:
    """The current paths by pointer doubling: once each node knows its ancestor 2^k steps up, the nodes found within 2^k steps of the end
    find those within twice as many. Nodes are joined with themselves about log2(depth) times, whatever the leaves are."""
    key = ["conversation_id", "node_id"]
    inner = rows.where("parent_node_id is not null").select("conversation_id", F.col("parent_node_id").alias("node_id")).distinct()
    latest = W.partitionBy("conversation_id").orderBy(F.col("create_time").desc_nulls_last(), "place")
    told = rows.where("node_id = current_node").select(*key)
    ends = rows.join(inner, key, "left_anti").join(told.select("conversation_id"), "conversation_id", "left_anti").withColumn("r", F.row_number().over(latest)).where("r = 1").select(*key)
    up = kept(rows.select("conversation_id", "node_id", F.col("parent_node_id").alias("up")).join(rows.select("conversation_id", F.col("node_id").alias("up")), ["conversation_id", "up"]))
    found = kept(told.unionByName(ends).withColumn("steps", F.lit(0).cast("long")))
    step = 1
    while step <= most and not up.isEmpty():
        more = found.join(up, key).select("conversation_id", F.col("up").alias("node_id"), (F.col("steps") + step).alias("steps"))
        nearer = found.unionByName(more).groupBy(*key).agg(F.min("steps").alias("steps"))
        above = up.select("conversation_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        up, found, step = kept(up.join(above, ["conversation_id", "up"]).select("conversation_id", "node_id", F.col("next").alias("up"))), kept(nearer), step * 2
    path = found.join(rows.where("shown").select(*key), key)
    return path.select("conversation_id", (F.row_number().over(W.partitionBy("conversation_id").orderBy(F.col("steps").desc())) - 1).alias("pos"), "node_id")


def corpus(messages: DataFrame) -> DataFrame:
    """conversation_id, corpus: text, code and output of visible messages in order, each with a line feed."""
    m = visible(messages)
    parts = F.concat_ws("", *(F.when(~is_blank(F.col(c)), F.concat(F.col(c), F.lit("\n"))) for c in ("text", "aggregate_code", "execution_output")))
    order = F.struct(F.col("create_time").isNull().alias("late"), "create_time", "node_id", parts.alias("part"))
    return m.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["part"]), "").alias("corpus"))
