"""Tables as messages, and readers for exports."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

S, D = T.StringType(), T.DoubleType()
#: The flat message; field names are those of the input files.
FLAT = T.StructType(
    [T.StructField(n, D if n in ("ConversationTime", "CreateTime", "UpdateTime") else S) for n in (
        "SourceFile", "ConversationId", "Title", "ConversationTime", "CurrentNode", "NodeId", "ParentNodeId", "ChildNodeIds", "Role", "AuthorName",
        "CreateTime", "UpdateTime", "Channel", "Recipient", "ContentType", "Text", "AttachmentsJson", "AggregateCode", "ExecutionOutput")]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


#: A string, a comment, or a comma that only a bracket follows; strings come first, so what is inside them stays.
MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
TRAILING = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])', re.S)


def lenient(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON."""
    bare = MARKS.sub(lambda m: m.group() if m.group()[0] == '"' else " ", text)
    return TRAILING.sub(lambda m: m.group(1) or "", bare)


def flat_json(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """Messages of flat JSON arrays, one file or several: comments and trailing commas allowed, names in any case, null as no
    messages. ``row_idx`` is the place in the input: files by name, then the place in the array. A file is read in ranges of
    ``range_bytes``, each by a task."""
    schema = "row_idx long, " + ", ".join(f"{snake(f.name)} {f.dataType.simpleString()}" for f in FLAT)
    kinds = [pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in FLAT]

    def parse(texts: list[str]) -> list[list]:
        low = [{key.lower(): v for key, v in json.loads(lenient(t)).items()} for t in texts]
        out = []
        for f, kind in zip(FLAT, kinds):
            values = [o.get(f.name.lower()) for o in low]
            out.append([v if v is None or isinstance(v, str) else json.dumps(v) for v in values] if kind == pa.string() else values)
        return out

    return arrays.array_objects(spark, path, parse, [snake(f.name) for f in FLAT], kinds, schema, range_bytes)


def child_ids(c: Column) -> Column:
    """A comma list of ids; they inform, but parents make the tree."""
    return F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")


def content_text(kind: Column, parts: Column, text: Column) -> Column:
    """The text of a message's parts, given as JSON texts: for ``text`` content only texts, else also tags for images and other
    typed parts and the JSON of the rest; without any the plain text."""
    of = lambda part, key: F.get_json_object(part, f"$.{key}")
    is_text = lambda part: part.startswith('"')
    plain = lambda part: F.get_json_object(F.concat(F.lit('{"v":'), part, F.lit("}")), "$.v")
    tag = lambda part: F.when(is_text(part), plain(part)).when(of(part, "content_type") == "image_asset_pointer", F.concat(F.lit("[image_asset_pointer] "), F.coalesce(of(part, "asset_pointer"), F.lit("")))).when(of(part, "content_type").isNotNull(), F.concat(F.lit("[part:"), of(part, "content_type"), F.lit("]"))).otherwise(part)
    known = F.filter(parts, lambda p: p.isNotNull() & (p != "null"))
    shown = F.when(kind == "text", F.transform(F.filter(known, is_text), plain)).otherwise(F.transform(known, tag))
    return F.coalesce(F.nullif(F.array_join(shown, "\n"), F.lit("")), text)


def raw_export(spark: SparkSession, path: str) -> DataFrame:
    """One message a row from nested exports (a glob of files): the map of nodes is exploded, null messages skipped. Parts of any
    type are read as JSON texts; attachments come from the message's or the aggregate's metadata."""
    v = lambda c, key, kind="string": F.try_variant_get(c, f"$.{key}" if key else "$", kind)
    c = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path).withColumn("source_file", F.col("_metadata.file_name"))
    # A file holds one conversation or an array of them.
    c = c.select("source_file", F.explode(F.coalesce(v("v", "", "array<variant>"), F.array("v"))).alias("v"))
    c = c.select("source_file", F.coalesce(v("v", "conversation_id"), v("v", "id")).alias("conversation_id"), v("v", "title").alias("title"), v("v", "create_time", "double").alias("conversation_time"), v("v", "current_node").alias("current_node"), v("v", "mapping", "map<string,variant>").alias("mapping"))
    n = c.where("mapping is not null").select("*", F.explode("mapping").alias("node_id", "node")).withColumn("m", v("node", "message", "variant")).where("m is not null and to_json(m) <> 'null'")
    parts = F.transform(v("m", "content.parts", "array<variant>"), lambda p: F.to_json(p))
    attachments = F.to_json(v("m", "metadata.attachments", "variant"))
    result = lambda key: v("m", f"metadata.aggregate_result.{key}")
    return n.select(
        "source_file", "conversation_id", "title", "conversation_time", "current_node", "node_id", v("node", "parent").alias("parent_node_id"), F.array_join(v("node", "children", "array<string>"), ",").alias("child_node_ids"),
        v("m", "author.role").alias("role"), v("m", "author.name").alias("author_name"), v("m", "create_time", "double").alias("create_time"), v("m", "update_time", "double").alias("update_time"), v("m", "channel").alias("channel"),
        v("m", "recipient").alias("recipient"), v("m", "content.content_type").alias("content_type"), content_text(v("m", "content.content_type"), parts, v("m", "content.text")).alias("text"),
        F.when(~attachments.isin("null", "[]"), attachments).alias("attachments_json"), result("code").alias("aggregate_code"), result("final_expression_output").alias("execution_output"),
    )


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A side file, or None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(schema).option("multiLine", True).json(path) if there else None


PNG = b"\x89PNG\r\n\x1a\n"


def png_texts(content: bytes) -> list[tuple[str, str]]:
    """(keyword, text) of a PNG's tEXt chunks: length and type in front of each chunk, four bytes of checksum behind."""
    out, at = [], len(PNG)
    if content[:at] != PNG:
        return out
    while at + 8 <= len(content):
        length, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + length]
        if kind == b"tEXt" and b"\0" in body:
            key, _, text = body.partition(b"\0")
            out.append((key.decode("latin-1"), text.decode("latin-1")))
        if kind == b"IEND":
            break
        at += 12 + length
    return out


def png_text_chunks(spark: SparkSession, path: str) -> DataFrame:
    """name, keyword, value: the texts inside PNG files."""

    def read(batches):
        for batch in batches:
            rows = [(name, *x) for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in png_texts(content)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["name", "keyword", "value"])

    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(read, "name string, keyword string, value string")


def number_or_zero(c: Column) -> Column:
    """A number in plain notation; blank or anything else is 0."""
    return F.coalesce(F.try_to_number(F.trim(c), F.lit("S999999999999D999999")).cast("double"), c.try_cast("double"), F.lit(0.0))


def profile_run(spark: SparkSession, name: str, path: str) -> DataFrame:
    """profile, id, title, category, topic_label, cluster_label, bridge_score, perspective_score of a profile's catalog CSV; a missing
    file raises."""
    c = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(f"{path}/catalog")
    have = lambda n: F.nullif(F.trim(n), F.lit("")) if n in c.columns else F.lit(None).cast("string")
    return c.select(F.lit(name).alias("profile"), F.col("conversation_id").alias("id"), *(have(n).alias(n) for n in ("title", "category", "topic_label", "cluster_label")), *(number_or_zero(F.col(n)).alias(n) for n in ("bridge_score", "perspective_score")))


def profile_insights(spark: SparkSession, names: tuple[str, ...], root: str, what: str) -> DataFrame | None:
    """An insight list of the profiles' runs in ``root``/profile, with the column ``profile``; None where no run has rows of it."""
    each = [spark.read.json(f"{root}/{n}/reports/insights/{what}") for n in names]
    each = [df.withColumn("profile", F.lit(n)) for n, df in zip(names, each) if df.columns]
    out = each[0] if each else None
    for df in each[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, length, kind by first bytes and SHA-256 of each file."""
    f = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head == "89504E470D0A1A0A", "png").when(F.substring(head, 1, 2).isin("5B", "7B"), "json").otherwise("binary")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", kind.alias("kind"), F.upper(F.sha2("content", 256)).alias("sha256"))


def messages(spark: SparkSession, sf_dir: str, branched: bool = True) -> DataFrame:
    """The conversations table as messages; if ``branched``, every third turn answers the one three before."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    back = F.when((turn >= 3) & (turn % 3 == 0), turn - 3).when(turn > 0, turn - 1) if branched else F.when(turn > 0, turn - 1)
    node = lambda t: F.concat_ws(":", conv, t.cast("string"))
    return c.select(
        conv.alias("conversation_id"),
        node(turn).alias("node_id"),
        F.when(back.isNotNull(), node(back)).alias("parent_node_id"),
        turn.cast("double").alias("create_time"),
        turn.alias("row_idx"),
        "role",
        "text",
        F.lit(None).cast("string").alias("aggregate_code"),
        F.lit(None).cast("string").alias("execution_output"),
    )
