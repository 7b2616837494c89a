"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns give spans by position: the text is split by the pattern, matches become rows with the lengths of gap and
match, and running sums of those are the positions, so a text's work grows with its matches only in proportion. Beside
them, wider candidates (long tokens mixing letters and digits that overlap no base match) and the values of base matches
are hashed and counted over the whole corpus by distinct repositories and owners, summed before each shuffle, one row a
candidate. A candidate of few owners and repositories is live-looking and its bare occurrences are added as spans of kind
``owned``; one that more owners or very many repositories share is a copied example and is not.

The documents have no owner column, so by default a document stands for a repository and its source for the owner.

Edge cases: null and empty texts have no spans. A null repository or owner counts as one of its own. Very long texts and
texts of very many matches are linear work. Rows that repeat doc_id and text get the same spans each, and are one
repository. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Patterns of the base kinds; what a match must have besides is in ``passes``.
PATTERNS = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Runs of the class that are long enough are the same matches, and need no filter afterwards.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
WIDE = r"[A-Za-z0-9+/_-]{20,}"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def matches(text: Column, pattern: str, rank: int) -> Column:
    """(rank, j, value, gap, n) of all matches, left to right: the lengths in code points of what lies before each since the
    last one, and of itself."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("value"), F.char_length(g).alias("gap"), F.char_length(m).alias("n")))
    numbered = F.transform(pairs, lambda x, j: F.struct(F.lit(rank).alias("rank"), j.alias("j"), x["value"].alias("value"), x["gap"].alias("gap"), x["n"].alias("n")))
    return F.when(text.rlike(pattern), numbered).otherwise(F.array().cast("array<struct<rank:int,j:int,value:string,gap:int,n:int>>"))


def value_of(match: Column) -> Column:
    """What an assignment assigns."""
    return F.regexp_extract(match, PATTERNS["assign"], 2)


def found_matches(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """doc_id, tk, repo, own, rank (of the pattern), j, value, gap, n: one row a match."""
    patterns = (PATTERNS["assign"], QUICK["access"], QUICK["hex"], WIDE)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", F.col(repository).cast("string").alias("repo"), F.col(owner).cast("string").alias("own"), text.alias("text")).where(F.col("text").rlike("|".join(patterns)))
    each = F.concat(*(matches(F.col("text"), p, r) for r, p in enumerate(patterns)))
    return named.select("doc_id", common.text_key(F.col("text")).alias("tk"), "repo", "own", F.explode(each).alias("m")).select("doc_id", "tk", "repo", "own", "m.*")


def placed(found: DataFrame) -> DataFrame:
    """doc_id, tk, start, rank, end, value: the matches that pass, by position, once for rows that repeat; of wide ones
    those that overlap no base match."""
    key = ["doc_id", "tk"]
    once = found.groupBy(*key, "rank", "j").agg(F.first("value").alias("value"), F.first("gap").alias("gap"), F.first("n").alias("n"))
    run = W.partitionBy(*key, "rank").orderBy("j").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = once.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    v = F.col("value")
    passes = F.when(F.col("rank") == 0, F.char_length(value_of(v)) >= 6).when(F.col("rank") == 3, v.rlike("[A-Za-z]") & v.rlike("[0-9]")).otherwise(True)
    spans = spans.where(passes).select(*key, "start", "rank", "end", "value")
    wide = F.col("rank") == 3
    # The furthest end of base spans that begin no later, and the first start of those that begin no earlier.
    upto = W.partitionBy(*key).orderBy("start", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    back = W.partitionBy(*key).orderBy(F.col("start").desc(), F.col("rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    reach, ahead = F.max(F.when(~wide, F.col("end"))).over(upto), F.min(F.when(~wide, F.col("start"))).over(back)
    clear = (F.coalesce(F.col("reach"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("ahead"), F.col("end")) >= F.col("end"))
    return spans.withColumn("reach", reach).withColumn("ahead", ahead).where(~wide | clear).drop("reach", "ahead")


def ownership(found: DataFrame) -> DataFrame:
    """secret (hash of the value), repos, owners, n: distinct counts over the corpus and matches, partly summed before each shuffle."""
    bare = F.when(F.col("rank") == 0, value_of(F.col("value"))).otherwise(F.col("value"))
    each = found.select(F.sha2(bare, 256).alias("secret"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("own", F.lit("")).alias("own"))
    return each.groupBy("secret").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("own").alias("owners"), F.count("*").alias("n"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", most_repos: int = 20, most_owners: int = 1, heavy: int = 1_000, few: int = 100_000) -> DataFrame:
    """doc_id, base, owned (arrays of start, rank, kind, end, value), copied (spans of shared candidates) for every row. Candidates of over
    ``heavy`` matches never meet in one task: up to ``few`` of them are settled by a broadcast."""
    found = common.durable(found_matches(docs, repository, owner))
    judged_by = common.durable(ownership(found).select("secret", "n", ((F.col("repos") <= most_repos) & (F.col("owners") <= most_owners)).alias("live")).where(F.col("live") | (F.col("n") > heavy)))
    large = judged_by.where(F.col("n") > heavy).select("secret", F.col("live").alias("settled"))
    live = judged_by.where((F.col("n") <= heavy) & F.col("live")).select("secret", "live")
    spans = placed(found)
    base = spans.where("rank < 3").withColumn("live", F.lit(None).cast("boolean"))
    wide = spans.where("rank = 3").withColumn("secret", F.sha2("value", 256))
    if large.limit(few + 1).count() <= few:
        # A settled row needs no other row: in place of its secret it has its own place, by which it is spread.
        wide = wide.join(F.broadcast(large), "secret", "left").withColumn("secret", F.when(F.col("settled").isNull(), F.col("secret")).otherwise(F.concat_ws(":", "tk", "start")))
    else:
        wide = wide.join(large, "secret", "left")
    wide = wide.join(live, "secret", "left").select(*base.columns[:-1], F.coalesce("settled", "live", F.lit(False)).alias("live"))
    kind = F.element_at(F.array(*map(F.lit, (*PATTERNS, "owned"))), F.col("rank") + 1)
    span = F.struct("start", "rank", kind.alias("kind"), "end", "value")
    gathered = lambda keep, name: F.array_sort(F.collect_list(F.when(keep, span))).alias(name)
    judged = base.unionByName(wide).groupBy("doc_id", "tk").agg(gathered(F.col("live").isNull(), "base"), gathered(F.col("live"), "owned"), gathered(~F.col("live"), "copied")).alias("j")
    d = docs.select("doc_id", common.text_key(F.col("text")).alias("tk")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("d.tk") == F.col("j.tk"))
    return d.join(judged, same, "left").select("d.doc_id", *(F.coalesce(x, F.array().cast(SPANS)).alias(x) for x in ("base", "owned", "copied")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
