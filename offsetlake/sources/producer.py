"""Synthetic messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def messages(spark: SparkSession, count: int, keys: int, partitions: int, topic: str = "bench", timestamp_ns: int = 0) -> DataFrame:
    """topic, part, off, key, value: message i has key key-(i % keys), sequence i // keys in its JSON value, and partition i % partitions."""
    i = F.col("id")
    key = F.concat(F.lit("key-"), (i % keys).cast("string"))
    value = F.to_json(F.struct(key.alias("key"), F.floor(i / keys).alias("sequence"), F.lit(timestamp_ns).cast("long").alias("timestamp")))
    return spark.range(count).select(F.lit(topic).alias("topic"), (i % partitions).cast("int").alias("part"), F.floor(i / partitions).alias("off"), key.cast("binary").alias("key"), value.cast("binary").alias("value"))
