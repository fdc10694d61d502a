"""A partitioned log and what happened to its records, derived from the `events` table.

The rules are this project's fixture design: partition = user_id % 8, offsets are dense in event order, every 50th event is
still unfinished, errors are terminal failures, every 200th error has a dead letter that is not published yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.operators.ranges import ranked

PARTITIONS = 8
MAX_RETRIES = 3

#: The same tables as DuckDB common table expressions.
LOG_SQL = """log AS (SELECT 'events' AS topic, CAST(user_id % 8 AS INTEGER) AS part, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS off,
  CAST(user_id AS VARCHAR) AS k, props AS v, ts, event_type, value AS latency_ms, event_id FROM events),
done AS (SELECT * FROM log WHERE event_id % 50 <> 7 AND NOT (event_type = 'error' AND event_id % 200 = 3)),
assign AS (SELECT DISTINCT topic, part, CAST(part * 3 - 1 AS BIGINT) AS committed FROM log),
fetched AS (SELECT topic, part, max(off) AS fetched FROM log GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, part, off, k, v, ts, event_type, latency_ms, event_id."""
    part = (F.col("user_id") % PARTITIONS).cast("int")
    log = ranked(table(spark, sf_dir, "events").withColumn("part", part), ["part"], "event_id", "off")
    return log.select(F.lit("events").alias("topic"), "part", "off", F.col("user_id").cast("string").alias("k"), F.col("props").alias("v"), "ts", "event_type", F.col("value").alias("latency_ms"), "event_id")


def finished(log: DataFrame) -> DataFrame:
    """Records whose offset is complete."""
    return log.where((F.col("event_id") % 50 != 7) & ~((F.col("event_type") == "error") & (F.col("event_id") % 200 == 3)))


def last_committed() -> Column:
    return (F.col("part") * 3 - 1).cast("long")


def assignments(log: DataFrame) -> DataFrame:
    """topic, part, committed: the last committed offset at assignment."""
    return log.select("topic", "part").distinct().withColumn("committed", last_committed())


def fetched(log: DataFrame) -> DataFrame:
    """topic, part, fetched: the last fetched offset."""
    return log.groupBy("topic", "part").agg(F.max("off").alias("fetched"))


def completions(log: DataFrame) -> DataFrame:
    """topic, part, off, k, v, ts, epoch, status, error, attempt, latency_ms, event_id: one event for each record but the unfinished ones."""
    failed = F.col("event_type") == "error"
    return log.where(F.col("event_id") % 50 != 7).select(
        "topic", "part", "off", "k", "v", "ts", F.when(F.col("event_id") % 97 == 0, 1).otherwise(2).cast("long").alias("epoch"), F.when(failed, "failure").otherwise("success").alias("status"),
        F.when(failed & (F.col("event_id") % 3 > 0), F.concat(F.lit("boom "), F.col("k"))).alias("error"), F.when(failed, F.when(F.col("event_id") % 7 == 0, 1).otherwise(MAX_RETRIES)).otherwise(1).cast("int").alias("attempt"), "latency_ms", "event_id",
    )


COMPLETIONS_SQL = LOG_SQL + """,
comp AS (SELECT topic, part, off, k, v, ts, CAST(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 2 END AS BIGINT) AS epoch, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN 'boom ' || k END AS error, CAST(CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 0 THEN 1 ELSE 3 END ELSE 1 END AS INTEGER) AS attempt, latency_ms, event_id
  FROM log WHERE event_id % 50 <> 7)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of benchmark runs, one for each event type: run, seq (from 0, in event order), ts seconds, latency ms."""
    return ranked(table(spark, sf_dir, "events"), ["event_type"], "event_id", "seq").select(F.col("event_type").alias("run"), "seq", micros("ts").alias("us"), F.col("value").alias("latency_ms"), "event_id")


RUNS_SQL = "runs AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, epoch_us(ts) AS us, value AS latency_ms, event_id FROM events)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark results: a row for each artifact (user_id % 4) and combination of mode, workload and ordering taken from the events."""
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_id") % 3 == 0, "baseline").when(F.col("event_id") % 3 == 1, "async").otherwise("process")
    keyed = e.select((F.col("user_id") % 4).alias("artifact"), mode.alias("mode"), F.when(F.col("event_type").isin("view", "click"), "sleep").when(F.col("event_type") == "error", "io").otherwise("cpu").alias("workload"), F.when(F.col("user_id") % 2 == 0, "key_hash").otherwise("partition").alias("ordering"), "value", "event_id", "user_id")
    return keyed.groupBy("artifact", "mode", "workload", "ordering").agg(F.min("event_id").alias("seq"), F.count("*").alias("messages"), F.round(F.sum("value"), 4).alias("tps"), F.round(F.max("value"), 4).alias("p99_ms"), (F.max("user_id") % 3).alias("final_lag"), (F.min("user_id") % 2).alias("final_gaps"))


RESULTS_SQL = """results AS (SELECT user_id % 4 AS artifact, CASE event_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'async' ELSE 'process' END AS mode,
  CASE WHEN event_type IN ('view', 'click') THEN 'sleep' WHEN event_type = 'error' THEN 'io' ELSE 'cpu' END AS workload, CASE WHEN user_id % 2 = 0 THEN 'key_hash' ELSE 'partition' END AS ordering,
  min(event_id) AS seq, count(*) AS messages, round(sum(value), 4) AS tps, round(max(value), 4) AS p99_ms, max(user_id) % 3 AS final_lag, min(user_id) % 2 AS final_gaps FROM events GROUP BY 1, 2, 3, 4)"""
