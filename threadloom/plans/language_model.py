"""Analyses and cluster labels by a language model behind a plain HTTP service, as plug-ins of the index. Off by default; whatever
fails leaves the baseline as it is."""

from __future__ import annotations

import hashlib
import json
import urllib.request
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import filesystem
from .config import Config

ANALYSIS_SECONDS, LABEL_SECONDS = 300, 180
ANALYSIS = "Classify this conversation. Answer as JSON with category (text), topics (at most 8 texts), keywords (texts) and summary (one sentence).\n\n"
LABEL = "Name this group of conversations. Answer as JSON with label (at most six words) and summary (one sentence).\n\n"


def _ledger_file(ledger: str, model: str, prompt: str) -> tuple:
    key = hashlib.sha256(f"{model}\n{prompt}".encode()).hexdigest()
    fs, root = filesystem(ledger)
    return fs, f"{root}/{key[:2]}", f"{root}/{key[:2]}/{key}.json"


def asked(url: str, model: str, prompt: str, seconds: float, ledger: str | None = None) -> dict | None:
    """The service's answer as JSON, or None where there is none in time or it is something else. Answers are kept in the folder ``ledger``,
    which all executors share, by a hash of model and prompt, and what is there is not asked again: a task that is tried
    again, or a later run, asks for the rest only."""
    if ledger:
        fs, folder, at = _ledger_file(ledger, model, prompt)
        if fs.get_file_info(at).type == pa.fs.FileType.File:
            with fs.open_input_stream(at) as f:
                return json.loads(f.read())
    body = json.dumps({"model": model, "prompt": prompt, "stream": False, "format": "json"}).encode()
    try:
        request = urllib.request.Request(f"{url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            out = json.loads(json.loads(answer.read())["response"])
    except (OSError, ValueError, KeyError, TypeError):
        return None
    if not isinstance(out, dict):
        return None
    if ledger:
        fs.create_dir(folder)
        temp = f"{at}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temp) as f:
            f.write(json.dumps(out).encode())
        fs.move(temp, at)
    return out


def _text(v) -> str | None:
    return v.strip() if isinstance(v, str) and v.strip() else None


def _texts(v) -> list[str] | None:
    """The different texts of a list, in any case; None where there is no list."""
    if not isinstance(v, list):
        return None
    out: dict[str, str] = {}
    for x in v:
        if _text(x):
            out.setdefault(x.strip().upper(), x.strip())
    return list(out.values())


def _scored(v) -> list[tuple[str, float]] | None:
    """Keywords with scores, given as objects or plain texts; None where there is no list."""
    if not isinstance(v, list):
        return None
    each = [(x.get("keyword"), x.get("score")) if isinstance(x, dict) else (x, None) for x in v]
    return [(k.strip(), float(s) if isinstance(s, int | float) else 0.0) for k, s in each if _text(k)]


def spoken(messages: DataFrame, current: DataFrame) -> DataFrame:
    """conversation_id, corpus: the current path (conversation_id, pos, node_id) as ``[role] text`` with blank lines between; of
    messages without text nothing, and no row where none has any."""
    said = messages.where(~X.is_blank(F.col("text"))).select("conversation_id", "node_id", F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("] "), "text").alias("line"))
    lines = current.join(said, ["conversation_id", "node_id"]).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return lines.select("conversation_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("corpus"))


def analyzer(c: Config, characters: int | None = None, at_once: int = 4, ledger: str | None = None):
    """conversation_id, category, topics, keywords, summary of (conversation_id, corpus): whole texts, or the first ``characters`` of each for
    a service that needs an end. Null where the service says nothing. Each task asks for ``at_once`` at a time."""

    def run(corpora: DataFrame) -> DataFrame:
        def ask(batches):
            for batch in batches:
                ids, texts = (col.to_pylist() for col in batch.columns)
                with ThreadPoolExecutor(at_once) as pool:
                    got = list(pool.map(lambda t: asked(c.ollama_url, c.ollama_model, ANALYSIS + (t or "")[:characters], ANALYSIS_SECONDS, ledger) or {}, texts))
                words = [None if (k := _scored(g.get("keywords"))) is None else [{"keyword": w, "score": s} for w, s in k] for g in got]
                lists = [pa.array([_texts(g.get("topics")) for g in got], pa.list_(pa.string())), pa.array(words, pa.list_(pa.struct([("keyword", pa.string()), ("score", pa.float64())])))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([_text(g.get("category")) for g in got], pa.string()), *lists, pa.array([_text(g.get("summary")) for g in got], pa.string())], names=["conversation_id", "category", "topics", "keywords", "summary"])

        return corpora.select("conversation_id", "corpus").mapInArrow(ask, "conversation_id string, category string, topics array<string>, keywords array<struct<keyword:string,score:double>>, summary string")

    return run


def labeler(c: Config, titles: int = 6, categories: int = 4, summaries: int = 4, at_once: int = 4, ledger: str | None = None):
    """Cluster records with the service's label and summary where it gives any. A request has the keywords, and the first titles, categories
    and summaries of members (cluster, conversation_id, title, category, summary), each once in any case."""

    def run(records: DataFrame, members: DataFrame) -> DataFrame:
        request = records.select("cluster", "keywords")
        for name, n in (("title", titles), ("category", categories), ("summary", summaries)):
            one = members.where(~X.is_blank(F.col(name))).groupBy("cluster", X.folded(F.col(name))).agg(F.min(F.struct("conversation_id", name)).alias("f"))
            some = one.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("f"))).where(F.col("r") <= n)
            request = request.join(some.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", f"f.{name}"))), lambda x: x[name]).alias({"title": "titles", "category": "categories", "summary": "summaries"}[name])), "cluster", "left")  # noqa: B023
        prompts = request.select("cluster", F.to_json(F.struct(*(x for x in request.columns if x != "cluster"))).alias("prompt"))

        def ask(batches):
            for batch in batches:
                names, texts = (col.to_pylist() for col in batch.columns)
                with ThreadPoolExecutor(at_once) as pool:
                    got = list(pool.map(lambda t: asked(c.ollama_url, c.ollama_model, LABEL + t, LABEL_SECONDS, ledger) or {}, texts))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([_text(g.get(k)) for g in got], pa.string()) for k in ("label", "summary"))], names=["cluster", "own_label", "own_summary"])

        told = prompts.mapInArrow(ask, "cluster string, own_label string, own_summary string")
        j = records.join(told, "cluster", "left")
        return j.withColumn("label", F.coalesce("own_label", "label")).withColumn("summary", F.coalesce("own_summary", "summary")).select(*records.columns)

    return run
