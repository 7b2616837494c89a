"""Two-pass external shuffle into shards.

Pass one scatters records uniformly over memory-sized buckets by a seeded hash of id and text. Pass two sorts each
bucket into a fixed order, permutes it by Fisher-Yates with the bucket's own seed, and deals the permuted records to the
shards in turn, from where the bucket before left off; so shard sizes differ by one record at most, positions in a shard
have no gaps, and a rerun or a lost executor's retry gives the same shards.

Edge cases: null and empty texts are records like others, and so are very long ones, which may make their bucket larger by
their own length. Null ids scatter by text. Rows alike in id and text are interchangeable; where more than ``hot`` rows are
alike, these are numbered, written once and scattered by number too, so that no bucket gathers them. An empty table gives
no rows. Extra columns may have any names; one that is named like a result is returned with ``_in`` added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of n positions: each, from the last, is swapped with a random one not after it."""
    order = np.arange(n)
    draws = (np.random.default_rng(seed).random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64)
    for i, j in zip(range(n - 1, 0, -1), draws.tolist()):
        order[i], order[j] = order[j], order[i]
    return order


RESULTS = ("shard", "slot")


def spread(docs: DataFrame, seed: int, hot: int) -> DataFrame:
    """own (the seeded hash), id, tk, bytes, row for every row."""
    tk = common.text_key(F.col("text"))
    d = docs.select(F.col("doc_id").alias("id"), tk.alias("tk"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    alike = common.durable(d.groupBy("id", "tk").agg(F.count("*").alias("c")).where(F.col("c") > hot).select(F.col("id").alias("hot_id"), F.col("tk").alias("hot_tk")))
    own = lambda *more: F.xxhash64(F.lit(seed), "id", "tk", *more).alias("own")
    if not alike.limit(1).count():
        return d.select(own(), *d.columns)
    same = d.id.eqNullSafe(F.col("hot_id")) & (d.tk == F.col("hot_tk"))
    many = common.durable(d.join(alike, same, "left_semi").withColumn("number", F.monotonically_increasing_id()))
    return d.join(alike, same, "left_anti").select(own(), *d.columns).unionByName(many.select(own("number"), *d.columns))


def shuffled(docs: DataFrame, shards: int = 24, bucket_bytes: int = 32 << 20, seed: int = 41, hot: int = 10_000, most_tasks: int = 1 << 16) -> DataFrame:
    """The columns of ``docs`` with shard (0 to ``shards`` - 1) and slot (from 0, without gaps) for every row. ``most_tasks``
    bounds the tasks of pass two, not the buckets: a task permutes its buckets one after another."""
    rows = spread(docs, seed, hot)
    volume = rows.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0
    buckets = max(1, int(volume // bucket_bytes))
    bucket = F.pmod(F.shiftrightunsigned("own", 20), F.lit(buckets)).cast("int").alias("bucket")
    # Offsets: where each bucket's records begin in the global order; one row a bucket.
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = common.durable(sizes.select("bucket", before.alias("offset")))
    scattered = rows.select(bucket, "own", "id", "row").join(F.broadcast(offsets) if buckets < 100_000 else offsets, "bucket")
    names = [name for _, name in common.kept_names(docs.columns, RESULTS)]
    kept = [T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema.fields)]
    schema = T.StructType([*kept, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    text = docs.columns.index("text")

    def permuted(group: pa.Table) -> pa.Table:
        row = group.column("row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        columns = row.flatten()
        keys = pa.table({"own": group.column("own"), "id": group.column("id"), "text": columns[text]})
        fixed = pc.sort_indices(keys, [("own", "ascending"), ("id", "ascending"), ("text", "ascending")])
        number, offset = group.column("bucket")[0].as_py(), group.column("offset")[0].as_py()
        order = fixed.take(pa.array(fisher_yates(len(row), seed * 1_000_003 + number)))
        at = offset + np.arange(len(row))
        return pa.table([*(c.take(order) for c in columns), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=schema.names)

    # A task for each bucket, by its number: hashed numbers would leave some tasks several buckets and others none.
    tasks = min(buckets, most_tasks)
    dealt = scattered.withColumn("task", F.pmod("bucket", F.lit(tasks))).repartitionById(tasks, F.col("task"))
    return dealt.select("task", "bucket", "offset", "own", "id", "row").groupBy("task", "bucket").applyInArrow(permuted, schema)


def write(docs: DataFrame, path: str, rows_per_part: int = 1 << 17, **options) -> None:
    """A folder shard=S/part=P for each ``rows_per_part`` slots of a shard, so that a shard of any size is written by many
    tasks; records in slot order in each."""
    out = shuffled(docs, **options).withColumn("part", F.floor(F.col("slot") / rows_per_part))
    tasks = max(1, out.select("shard", "part").distinct().count())
    out.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "slot").write.partitionBy("shard", "part").mode("overwrite").parquet(path)
