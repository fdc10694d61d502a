"""Routing, ordering and scheduling order of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offsetlake.operators.ranges import ranked

TP = ["topic", "part"]


def ingest(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """Records without error, with topic, partition and offset, of an assigned partition."""
    good = records.where(F.col("topic").isNotNull() & F.col("part").isNotNull() & F.col("off").isNotNull())
    if "error" in records.columns:
        good = good.where(F.col("error").isNull())
    return good.join(assigned.select(*TP), TP, "left_semi")


def route_key(mode: str) -> Column:
    """Key of the virtual queue: the partition, the message key (null is a queue of its own), or none for unordered work."""
    if mode not in ("partition", "key_hash", "unordered"):
        raise ValueError(f"unknown ordering mode {mode!r}")
    return F.col("part").cast("string") if mode == "partition" else F.col("k") if mode == "key_hash" else F.lit(None).cast("string")


def queue_ranks(records: DataFrame, mode: str) -> DataFrame:
    """All columns, then route and queue_pos: the place in the FIFO of (topic, part, route), from 0."""
    return ranked(records.withColumn("route", route_key(mode)), [*TP, "route"], "off", "queue_pos")


def grouped_batches(records: DataFrame, mode: str, size: int = 1000) -> DataFrame:
    """topic, part, route, batch, offsets: the offsets of each queue in arrival order, in batches of `size`."""
    placed = queue_ranks(records, mode).withColumn("batch", F.floor(F.col("queue_pos") / size).cast("long"))
    return placed.groupBy(*TP, "route", "batch").agg(F.array_sort(F.collect_list("off")).alias("offsets"))


def round_robin(heads: DataFrame, flying: DataFrame, mode: str, rounds: DataFrame) -> DataFrame:
    """The order in which runnable queues are picked, one item each in turn: heads (topic, part, route, activated) by activation, the eligible only.

    rounds: topic, part, route, queue_pos of the queued items. Returns them with `turn`: all first items in the order of activation, then all second ones.
    """
    runnable = eligible(heads, flying, mode).select(*[F.col(c).alias(f"h_{c}") for c in (*TP, "route")], "activated")
    same = (F.col("topic") == F.col("h_topic")) & (F.col("part") == F.col("h_part")) & F.col("route").eqNullSafe(F.col("h_route"))
    turns = rounds.join(runnable, same).select(*TP, "route", "queue_pos", "activated")
    before = turns.groupBy("queue_pos").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("queue_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("queue_pos").orderBy("activated", *TP, "route")) - 1
    return turns.withColumn("inside", inside).join(before, "queue_pos").select(*TP, "route", "queue_pos", (F.col("base") + F.col("inside")).alias("turn"))


def in_flight_counts(flying: DataFrame) -> DataFrame:
    """topic, part, in_flight; a row with null topic and part has the total."""
    return flying.rollup("topic", "part").agg(F.count("*").alias("in_flight"), F.grouping_id().alias("g")).where("g <> 1").select(*TP, "in_flight")


def queue_sizes(records: DataFrame, mode: str) -> DataFrame:
    return records.withColumn("route", route_key(mode)).groupBy(*TP, "route").agg(F.count("*").alias("queued"))


def lowest_blocking_head(heads: DataFrame, blocking: DataFrame) -> DataFrame:
    """The queue to serve first: the one whose head is its partition's blocking offset, smallest offset first, then first partition."""
    return heads.join(blocking, TP).where("off = blocking").orderBy("off", *TP, "route").limit(1).select(*TP, "route", "off")


def eligible(heads: DataFrame, flying: DataFrame, mode: str) -> DataFrame:
    """Queue heads that may start: no work of the same queue (key_hash) or partition (partition) is in flight; unordered work always may."""
    if mode == "unordered":
        return heads
    if mode == "partition":
        return heads.join(flying.select(*TP).distinct(), TP, "left_anti")
    f = flying.select(*[F.col(c).alias(f"f_{c}") for c in (*TP, "route")]).distinct()
    same = (F.col("topic") == F.col("f_topic")) & (F.col("part") == F.col("f_part")) & F.col("route").eqNullSafe(F.col("f_route"))
    return heads.join(f, same, "left_anti")


def sequence_violations(records: DataFrame, keys: list[str], seq: str, order: list[str], start: int | None = 0) -> DataFrame:
    """Rows whose seq is not the one before plus 1, within keys and in processing order; the first must be `start`, or anything if None."""
    before = F.lag(seq).over(Window.partitionBy(*keys).orderBy(*order))
    expected = F.coalesce(before + 1, F.lit(start).cast("long") if start is not None else F.col(seq))
    return records.withColumn("expected", expected).where(F.col(seq) != F.col("expected"))


def disorder(records: DataFrame, keys: list[str], seq: str, order: list[str]) -> DataFrame:
    """Rows whose seq is smaller than the one before (equal and missing numbers are fine)."""
    return records.withColumn("before", F.lag(seq).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(seq) < F.col("before"))
