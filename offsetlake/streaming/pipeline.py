"""A log pipeline: records of a stream go through a worker, failures to dead letters, finished offsets into commits."""

from __future__ import annotations

import inspect
import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offsetlake.operators.failures import as_kafka, dead_letters
from offsetlake.operators.offsets import TP
from offsetlake.options import LogOptions
from offsetlake.streaming.worker import run_async, run_sync

RUNS = "array<struct<a: long, b: long>>"
STATE = f"topic string, part int, next_offset long, runs {RUNS}"


class StaleGeneration(RuntimeError):
    """A newer pipeline works in the same folder; this one must not commit any more."""


def from_kafka(stream: DataFrame) -> DataFrame:
    """topic, part, off, k, v of rows with the columns of Spark's Kafka source; rows without topic, partition or offset are left out."""
    rows = stream.select("topic", F.col("partition").cast("int").alias("part"), F.col("offset").cast("long").alias("off"), F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))
    return rows.where("topic IS NOT NULL AND part IS NOT NULL AND off IS NOT NULL")


def joined_runs(runs: DataFrame) -> DataFrame:
    """(topic, part, a, b) as disjoint runs with a gap between any two; runs may overlap and repeat."""
    before = Window.partitionBy(*TP).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*TP).orderBy("a", "b")
    opens = F.coalesce(F.col("a") > F.max("b").over(before) + 1, F.lit(True))
    marked = runs.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(along))
    return marked.groupBy(*TP, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def advanced(state: DataFrame, seen: DataFrame, done: DataFrame) -> DataFrame:
    """The next state (topic, part, next_offset, runs) from the state before, the records seen and the offsets done.

    A partition without a state starts at its smallest offset seen. next_offset is the first offset that is not done; runs are the done offsets beyond,
    so the state is as large as the gaps are many.
    """
    first = seen.groupBy(*TP).agg(F.min("off").alias("first"))
    base = state.select(*TP, "next_offset").join(first, TP, "full").select(*TP, F.coalesce("next_offset", "first").alias("base"))
    islands = done.select(*TP, F.col("off").alias("a"), F.col("off").alias("b"))
    held = state.select(*TP, F.explode("runs").alias("r")).select(*TP, "r.a", "r.b")
    edge = base.select(*TP, (F.col("base") - 1).alias("a"), (F.col("base") - 1).alias("b"))  # the run that joins this one moves the mark
    every = joined_runs(islands.unionByName(held).unionByName(edge)).join(base, TP)
    at = (F.col("a") <= F.col("base") - 1) & (F.col("b") >= F.col("base") - 1)
    beyond = F.array_sort(F.collect_list(F.when(F.col("a") > F.col("base"), F.struct("a", "b"))))
    return every.groupBy(*TP).agg(F.max(F.when(at, F.col("b") + 1)).alias("next_offset"), beyond.cast(RUNS).alias("runs"))


class LogPipeline:
    """stream -> worker -> dead letters -> commits, one micro-batch after another.

    `publish` gets the dead letters (columns of `dead_letters`, with topic, part and off before them); an error in it is tried again, then the letters stay
    pending, come before fresh ones in the next batch, and their offsets are not committed until then. Without `publish` failures count as finished.
    Everything is in `folder` (shared by driver and executors): checkpoint, and for each batch the events, pending letters and commits. A batch that runs again
    overwrites its own results, so records are worked on at least once and commits never go back. Of several pipelines on one folder only the latest started
    commits; the others stop with StaleGeneration.
    """

    def __init__(self, options: LogOptions, worker: Callable, folder: str, publish: Callable[[DataFrame], None] | None = None, publish_tries: int = 3):
        if not callable(worker):
            raise TypeError("the worker must be a function")
        self.options, self.worker, self.folder, self.publish, self.publish_tries = options, worker, folder.rstrip("/"), publish, publish_tries
        self.query: StreamingQuery | None = None
        self.generation = 0

    def kafka_stream(self, spark: SparkSession) -> DataFrame:
        """The topic's stream, from the commits in the folder on (for a new checkpoint)."""
        commits = {r.part: r.next_offset for r in self.commits(spark).where(F.col("topic") == self.options.topic).collect()}
        return spark.readStream.format("kafka").options(**self.options.source(commits)).load()

    def kafka_publish(self, letters: DataFrame) -> None:
        """A `publish` that writes to the dead-letter topic."""
        as_kafka(letters).write.format("kafka").options(**self.options.dlq_sink()).save()

    # folders

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = files.Path(f"{self.folder}/{kind}")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(files.Path(f"{self.folder}/{kind}/{n}/{'.' if kind == 'generation' else '_SUCCESS'}")))

    def _read(self, spark: SparkSession, kind: str, schema: str, before: int | None = None) -> DataFrame:
        there = [n for n in self._numbers(spark, kind) if before is None or n < before]
        return spark.read.schema(schema).parquet(f"{self.folder}/{kind}/batch={there[-1]}") if there else spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{kind}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _forget(self, spark: SparkSession, kind: str, batch: int) -> None:
        """Delete what no batch needs: all before the batch before this one."""
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        for n in [n for n in self._numbers(spark, kind) if n < batch][:-1]:
            path = files.Path(f"{self.folder}/{kind}/batch={n}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def commits(self, spark: SparkSession) -> DataFrame:
        """topic, part, next_offset, runs: the latest commit of each partition, and finished offsets beyond it."""
        return self._read(spark, "commits", STATE)

    # work

    def _fence(self, spark: SparkSession) -> None:
        latest = max(self._numbers(spark, "generation"), default=0)
        if latest != self.generation:
            raise StaleGeneration(f"generation {self.generation} of {self.folder} was followed by {latest}")

    def _published(self, letters: DataFrame) -> bool:
        o = self.options.execution
        for turn in range(self.publish_tries):
            try:
                self.publish(letters)
                return True
            except Exception:  # whatever the sink raises: the letters are kept
                if turn + 1 < self.publish_tries:
                    wait = o.retry_backoff_ms * 2**turn if o.exponential else o.retry_backoff_ms
                    time.sleep((min(wait, o.max_retry_backoff_ms) + random.uniform(0, o.retry_jitter_ms)) / 1000)
        return False

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of records with Kafka's columns; for foreachBatch."""
        spark, o = batch.sparkSession, self.options
        self._fence(spark)
        records = self._write(from_kafka(batch).dropDuplicates([*TP, "off"]), "records", batch_id)
        run = run_async if inspect.iscoroutinefunction(self.worker) else run_sync
        events = self._write(run(records, self.worker, o.ordering, o.execution), "events", batch_id)
        done = events.select(*TP, "off")
        if self.publish:
            failed = events.where("status = 'failure'").withColumn("epoch", F.lit(self.generation).cast("long"))
            rows = failed.join(records.select(*TP, "off", "k", "v"), [*TP, "off"])
            named = dead_letters(rows, rows if o.dlq_payload == "full" else None, o.dlq_suffix, o.dlq_payload == "full")
            fresh = named.select(F.col("source_topic").alias("topic"), F.col("part_header").cast("int").alias("part"), F.col("offset_header").cast("long").alias("off"), *named.columns)
            fresh = self._write(fresh, "letters", batch_id)
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema.fields)
            pending = self._read(spark, "pending", schema, batch_id)
            done = events.where("status = 'success'").select(*TP, "off")
            old = pending.isEmpty() or self._published(pending)
            new = old and (fresh.isEmpty() or self._published(fresh))
            if old:
                done = done.unionByName(pending.select(*TP, "off"))
            if new:
                done = done.unionByName(fresh.select(*TP, "off"))
            left = [df for df, sent in ((pending, old), (fresh, new)) if not sent]
            kept = left[0] if len(left) == 1 else pending.unionByName(fresh) if left else fresh.where("false")
            self._write(kept, "pending", batch_id)
        state = self._read(spark, "commits", STATE, batch_id)
        self._fence(spark)
        self._write(advanced(state, records, done).coalesce(1), "commits", batch_id)
        for kind in ("records", "events", "letters", "pending", "commits"):
            self._forget(spark, kind, batch_id)

    # lifecycle

    def start(self, stream: DataFrame, **trigger: object) -> StreamingQuery:
        """Begin a new generation on a stream with Kafka's columns; trigger as for DataStreamWriter.trigger. A running pipeline is an error."""
        if self.query is not None and self.query.isActive:
            raise RuntimeError("the pipeline is running")
        spark = stream.sparkSession
        self.generation = max(self._numbers(spark, "generation"), default=0) + 1
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generation/batch={self.generation}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        self.query = (writer.trigger(**trigger) if trigger else writer).start()
        return self.query

    def drain(self, deadline_s: float = 30.0) -> bool:
        """Wait until nothing waits or runs; false if that is not so by the deadline or the query has failed."""
        end = time.monotonic() + deadline_s
        while self.query is not None and self.query.isActive and time.monotonic() < end:
            status = self.query.status
            if self.query.lastProgress and not status["isDataAvailable"] and not status["isTriggerActive"]:
                return True
            time.sleep(0.05)
        return self.query is not None and not self.query.isActive and self.query.exception() is None

    def stop(self, graceful: bool = True, deadline_s: float = 30.0) -> bool:
        """Stop, after a drain if graceful; true if nothing was left. What was left is worked on at the next start from the checkpoint."""
        clean = self.drain(deadline_s) if graceful else False
        if self.query is not None:
            self.query.stop()
        return clean

    def failure(self) -> Exception | None:
        """The error that ended the query, if one did."""
        return self.query.exception() if self.query is not None else None

    def reset(self, spark: SparkSession, tries: int = 3) -> None:
        """Delete the folder with checkpoint, commits and pending letters, so that the next start begins anew. A running pipeline is an error."""
        if self.query is not None and self.query.isActive:
            raise RuntimeError("the pipeline is running")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for turn in range(tries):
            if not fs.exists(path) or fs.delete(path, True):
                return
            time.sleep(0.2 * 2**turn)
        raise OSError(f"could not delete {self.folder}")
