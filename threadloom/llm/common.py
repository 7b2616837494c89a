"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none (tests), one of this process, which the session is not
    told of."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = _LOCAL.setdefault("path", "file://" + tempfile.mkdtemp(prefix="threadloom-"))
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote for the tables. Nothing that is still to be computed may read them."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else. A text of one byte a character takes the quick way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def kept_names(keep: list[str], results: tuple[str, ...]) -> list[tuple[str, str]]:
    """(column, name to return it by): kept columns named like a result get ``_in`` added until the name is free."""
    out, taken = [], {r.lower() for r in results} | {k.lower() for k in keep if k not in results}
    for k in keep:
        name = k
        if k.lower() in {r.lower() for r in results}:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        out.append((k, name))
    return out


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and source as they are and the whole row in the struct ``row``, so that no other name can clash."""
    return docs.select(*(c for c in ("doc_id", "text", "lang", "source") if c in docs.columns), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def text_key(text: Column) -> Column:
    """With the id, the key of a row in joins back: rows that repeat both share their results. Null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def spans(lengths: np.ndarray, limit: int):
    """Slices of rows with about ``limit`` bytes each (a longer row has its own), so that memory stays bounded."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def texts_of(batch, name: str = "text", limit: int = 2 << 20):
    """(rows, texts) pieces of an Arrow batch; null texts are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    values = ["" if x is None else x for x in column.to_pylist()]
    for a, b in spans(np.fromiter(map(len, values), np.int64, len(values)), limit):
        yield batch.slice(a, b - a), values[a:b]


def sampled_texts(texts: DataFrame, n: int, seed: int) -> DataFrame:
    """(key, _text): at most ``n`` different texts of the column ``_text``, first by a seeded hash. Only keys are ordered, those
    under a cut that leaves a few times ``n`` of them however many there are, and repeats are summed before; so no task and
    no driver sees more than that."""
    key = F.xxhash64(F.lit(seed), "_text")
    different = max(1, texts.agg(F.approx_count_distinct(key, 0.05)).first()[0])
    share = min(1.0, 4 * n / different)
    keys = texts.select(key.alias("key")).where(F.shiftrightunsigned("key", 11) <= int(share * (1 << 53)))
    first = keys.groupBy("key").agg(F.lit(1).alias("one")).orderBy("key").limit(n).select("key")
    return texts.withColumn("key", key).join(F.broadcast(first), "key").groupBy("key").agg(F.min("_text").alias("_text"))


def sampled_rows(docs: DataFrame, keys: DataFrame, n: int, most_bytes: int = 64 << 20, on: tuple[str, ...] = ("doc_id",), seed: int = 17) -> DataFrame:
    """doc_id, part, y, text for at most ``n`` of the different ``keys`` (doc_id, part, y) of each part, first by a seeded hash,
    and of whole texts that are at most ``most_bytes`` in all for a part. Only keys under a cut that leaves about twice
    ``n`` are looked up and ranked, and of rows that repeat a key the smallest text counts; so neither tasks nor the driver
    see more than that, however many rows there are."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    totals = keys.groupBy("part").agg(F.count("*").alias("total"))
    few = durable(keys.join(totals, "part").where(F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) <= F.lit(2.0 * n + 50) / F.col("total")).select(*keys.columns))
    held = docs.select(*on, F.col("text").alias("_text")).join(F.broadcast(few) if few.count() <= 200_000 else few, list(on))
    held = held.groupBy(*keys.columns).agg(F.min("_text").alias("text")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    first = W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    held = held.where(F.col("bytes") <= most_bytes // 8).withColumn("r", F.row_number().over(first)).withColumn("sum", F.sum("bytes").over(first.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return held.where((F.col("r") <= n) & (F.col("sum") <= most_bytes)).select("doc_id", "part", "y", "text")
