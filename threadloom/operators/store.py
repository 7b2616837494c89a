"""Intermediate tables in the shared folder, and numbering in a global order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where none is set, one of this process, if it is the only one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _LOCAL.setdefault("path", "file://" + tempfile.mkdtemp(prefix="threadloom-"))
    return path


def kept(df: DataFrame) -> DataFrame:
    """Written and read back, so that lineage ends here."""
    path = f"{folder(df.sparkSession)}/threadloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``kept`` has written so far. What reads them can no longer be computed."""
    for path in _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _WRITTEN.clear()


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a number from 1 in the given order, which must be total. Rows are sorted in range partitions, and only the
    partitions' sizes meet in one task."""
    place = F.spark_partition_id().alias("_part")
    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_before") + F.col("_row") + 1).cast("int").alias(name))


def small_parts(batches, column: int, most_bytes: int = 1 << 20, most_rows: int = 1_000):
    """Arrow batches in parts whose values in ``column`` have about ``most_bytes`` (a larger one is alone), so that a worker holds few
    rows as Python objects, however many a batch has."""
    for batch in batches:
        start = 0
        while start < len(batch):
            n = min(most_rows, len(batch) - start)
            while n > 1 and batch.column(column).slice(start, n).nbytes > most_bytes:
                n = (n + 1) // 2
            yield batch.slice(start, n)
            start += n
