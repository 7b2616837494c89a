"""Weighted terms, keywords, topics and rule categories of conversations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .store import small_parts

# Categories in order, with the terms that count for them.
CATEGORY_RULES = (
    ("Identity/PKI", "certificate certutil ca adcs enrollment ldap ocsp crl template aia cdp x509".split()),
    ("Observability/Telemetry", "grafana loki tempo otel etw metrics trace tracing alloy prometheus kql logql".split()),
    ("C#/.NET", ["c#", "dotnet", "roslyn", "blazor", "asp.net", "entityframework", "linq", "visual studio"]),
    ("Infrastructure/Cloud", ["azure", "kubernetes", "docker", "terraform", "vm", "openstack", "oracle cloud", "cloud"]),
    ("Security", "security acl sddl kerberos delegation credential attack threat auth".split()),
    ("Creative/Visualization", "matplotlib plotly visualization graph render logo image 3d".split()),
    ("PowerShell", "powershell script cmdlet psobject where-object convertfrom-json".split()),
    ("General Engineering", "architecture design build implementation refactor parser database".split()),
)
UNCATEGORIZED = "Uncategorized"


def term_units(messages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """conversation_id, term, units (weight in whole units): tokens of all lines, and phrases of structured ones."""
    parts = [
        messages.select("conversation_id", "text", X.role_units(F.col("role")).alias("units"), F.lit(True).alias("phrased"), F.lit(False).alias("forced")),
        messages.select("conversation_id", F.col("aggregate_code"), F.lit(round(X.CODE * X.UNIT)), F.lit(False), F.lit(False)),
        messages.select("conversation_id", F.col("execution_output"), F.lit(round(X.OUTPUT * X.UNIT)), F.lit(False), F.lit(False)),
    ]
    if titles is not None:
        parts.append(titles.select("conversation_id", F.col("title"), F.lit(round(X.TITLE * X.UNIT)), F.lit(True), F.lit(True)))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    raw = every.where((F.col("units") > 0) & ~X.is_blank(F.col("text"))).select("*", F.explode(X.split_lines(F.col("text"))).alias("raw")).drop("text")
    lines = raw.withColumn("line", X.plain_line(F.col("raw"))).where("line <> ''")
    marked = lines.select("conversation_id", "phrased", F.col("forced").__or__(X.is_structured(F.col("raw"), F.col("line"))).alias("structured"), "units", X.tokens(F.col("line")).alias("t"))
    weight = F.when(F.col("structured"), F.col("units") * F.lit(115)).otherwise(F.col("units") * F.lit(100))
    weighed = marked.select("conversation_id", "t", (F.col("phrased") & F.col("structured")).alias("pairs"), weight.cast("long").alias("w"))
    one = F.transform("t", lambda t: F.struct(t.alias("term"), (F.col("w") * 100).alias("w")))
    two = F.when(F.col("pairs"), F.transform(X.phrases(F.col("t")), lambda t: F.struct(t.alias("term"), (F.col("w") * 175).alias("w"))))
    both = F.concat(one, F.coalesce(two, F.array().cast("array<struct<term:string,w:bigint>>")))
    return weighed.select("conversation_id", F.inline(both)).groupBy("conversation_id", "term").agg(F.sum("w").alias("units"))


def _greedy(take: int):
    """Rows (conversation_id, ranked terms, their units) to the chosen terms. A conversation's list is left once enough are chosen."""
    short = frozenset(X.SHORT_TOKENS)

    def work(batches):
        for part in small_parts(batches, 1):
            rows = []
            for conversation, terms, units in zip(*(c.to_pylist() for c in part.columns)):
                chosen: list[tuple[str, frozenset]] = []
                for term, n in zip(terms, units):
                    own = frozenset(w for w in term.split(" ") if len(w) >= 3 or w in short)
                    if any(term == t or (own and s and (own <= s or s <= own)) for t, s in chosen):
                        continue
                    rows.append((conversation, len(chosen), term, n, units[0]))
                    chosen.append((term, own))
                    if len(chosen) >= take:
                        break
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["conversation_id", "rank", "keyword", "units", "top"])

    return work


def keywords(terms: DataFrame, take: int = 18) -> DataFrame:
    """conversation_id, rank (0 up), keyword, score: the diverse top terms; scores are relative to the first ranked term
    without its phrase boost, so a phrase may lead with 1.0 and single words exceed it."""
    words = X.word_count(F.col("term"))
    boost = F.when(words > 1, F.col("units") * 175).otherwise(F.col("units") * 100)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("boosted")).alias("b"), (-F.col("words")).alias("n"), X.folded(F.col("term")).alias("u"), F.col("term"), F.col("units"))))
    ranked = terms.withColumn("words", words).withColumn("boosted", boost).groupBy("conversation_id").agg(ordered.alias("c"))
    lists = ranked.select("conversation_id", F.transform("c", lambda x: x["term"]).alias("t"), F.transform("c", lambda x: x["units"]).alias("u"))
    picked = lists.mapInArrow(_greedy(max(6, take)), "conversation_id string, rank int, keyword string, units long, top long")
    return picked.select("conversation_id", "rank", "keyword", F.bround(F.col("units") / F.col("top"), 4).alias("score"))


def topics(titles: DataFrame, found: DataFrame, take: int = 8) -> DataFrame:
    """conversation_id, rank, topic: the best title phrase, title tokens by score, then keywords, chosen greedily."""
    t = titles.select("conversation_id", X.tokens(X.plain_line(F.col("title"))).alias("t"))
    k = found.groupBy("conversation_id").agg(F.map_from_entries(F.collect_list(F.struct("keyword", "score"))).alias("s"), F.collect_list(F.struct("keyword", "score")).alias("k"))
    j = t.join(k, "conversation_id", "left")
    score = lambda term: F.coalesce(F.try_element_at("s", term), F.lit(0.0))
    total = lambda p: F.aggregate(X.term_tokens(p), F.lit(0.0), lambda a, x: a + score(x))
    best = F.slice(F.array_sort(F.transform(X.phrases(F.col("t")), lambda p, i: F.struct((-total(p)).alias("a"), i.alias("b"), p.alias("term")))), 1, 1)
    own = F.array_sort(F.transform(F.array_distinct("t"), lambda x: F.struct((-score(x)).alias("a"), X.folded(x).alias("b"), x.alias("term"))))
    many = lambda x: X.word_count(x["keyword"])
    rest = F.array_sort(F.transform(F.coalesce("k", F.array().cast("array<struct<keyword:string,score:double>>")), lambda x: F.struct((-x["score"] * F.when(many(x) > 1, 2.1).otherwise(1.0)).alias("a"), (-many(x)).alias("n"), X.folded(x["keyword"]).alias("b"), x["keyword"].alias("term"))))
    term = lambda a: F.transform(a, lambda x: F.struct(x["term"].alias("term")))
    return j.select("conversation_id", F.posexplode(X.diverse(F.concat(term(best), term(own), term(rest)), max(4, take))).alias("rank", "x")).select("conversation_id", "rank", F.col("x.term").alias("topic"))


def categories(corpora: DataFrame, rules=CATEGORY_RULES) -> DataFrame:
    """conversation_id, category, score: the rule with the most contained terms (substrings count), the first on ties."""
    low = F.lower("corpus")
    scores = [F.struct(sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("category")) for i, (name, terms) in enumerate(rules)]
    best = corpora.select("conversation_id", F.greatest(*scores).alias("b"))
    return best.select("conversation_id", F.when(F.col("b.score") > 0, F.col("b.category")).otherwise(UNCATEGORIZED).alias("category"), F.col("b.score").alias("score"))


def cooccurrence(found: DataFrame, keep: int = 6, least: int = 2) -> DataFrame:
    """left_keyword, right_keyword, n, weight: pairs among each conversation's first keywords; weights are relative to
    the largest count of any pair."""
    own = found.where(F.col("rank") < max(2, keep)).groupBy("conversation_id").agg(F.collect_set(F.struct(X.folded(F.col("keyword")).alias("u"), "keyword")).alias("k"))
    each = own.select(F.explode("k").alias("l"), "k").select("l", F.explode("k").alias("r")).where(F.col("l.u") < F.col("r.u"))
    counts = each.groupBy(F.col("l.keyword").alias("left_keyword"), F.col("r.keyword").alias("right_keyword")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).where(F.col("n") >= least).select("left_keyword", "right_keyword", "n", F.bround(F.col("n") / F.col("most"), 4).alias("weight"))


def hierarchy(categorized: DataFrame) -> DataFrame:
    """parent, child, n: every step of each category's path."""
    parts = F.filter(F.transform(F.split("category", "/"), X.trimmed), lambda p: p != "")
    p = categorized.select(parts.alias("p")).where(F.size("p") > 1)
    steps = p.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    return steps.groupBy(F.array_join(F.slice("p", 1, F.col("i")), "/").alias("parent"), F.array_join(F.slice("p", 1, F.col("i") + 1), "/").alias("child")).agg(F.count("*").alias("n"))


def message_chunks(messages: DataFrame, width: int = 1200) -> DataFrame:
    """conversation_id, node_id, kind, pos, chunk, chunk_hash."""
    kinds = (("text", "text"), ("code", "aggregate_code"), ("execution_output", "execution_output"))
    each = [messages.select("conversation_id", "node_id", F.lit(kind).alias("kind"), F.posexplode(X.chunks(F.col(c), width)).alias("pos", "chunk")) for kind, c in kinds]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.withColumn("chunk_hash", X.chunk_hash(F.col("kind"), F.col("chunk")))


def stored_chunks(found: DataFrame) -> DataFrame:
    return found.dropDuplicates(["conversation_id", "chunk_hash"])


def hash_embedding(terms: DataFrame, dims: int = 384) -> DataFrame:
    """conversation_id, bucket, value: signed counts of hashed tokens, scaled to length 1, as sparse rows. ``terms`` has
    one row (conversation_id, token, n) a token."""
    dims = max(32, dims)
    h = terms.withColumn("h", X.fnv1a(F.col("token")))
    sign = F.when(F.col("h").bitwiseAND(F.lit(2)) == 0, F.col("n")).otherwise(-F.col("n"))
    v = h.groupBy("conversation_id", (F.col("h") % dims).alias("bucket")).agg(F.sum(sign).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("conversation_id")).cast("double"))
    return v.withColumn("norm", norm).where("norm > 0").select("conversation_id", "bucket", (F.col("v") / F.col("norm")).alias("value"))
