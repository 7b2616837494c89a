"""Messages as a stream: files that arrive are appended to a messages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_messages(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files as they arrive and appends each batch once to ``target``."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
