"""Retries, dead letters, payload cache and the poison-key circuit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offsetlake.operators.ranges import range_of

TP = ["topic", "part"]


def backoff_ms(attempt: Column, base: int = 1000, cap: int = 30000, exponential: bool = True, cap_linear: bool = False) -> Column:
    """Wait before the next try after the 1-based attempt, without jitter; linear waits are capped only where cap_linear says so."""
    if exponential:
        return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap))).cast("long")
    return F.lit(min(base, cap) if cap_linear else base).cast("long")


def retry_schedule(items: DataFrame, max_retries: int = 3, **how) -> DataFrame:
    """A row for each attempt of each item with the wait after it; none after the last."""
    tries = items.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(max_retries))))
    return tries.withColumn("wait_ms", F.when(F.col("attempt") < max_retries, backoff_ms(F.col("attempt"), **how)).otherwise(F.lit(0).cast("long")))


def first_success(attempts: DataFrame, keys: list[str], max_retries: int = 3) -> DataFrame:
    """keys, status, attempt from rows (keys, attempt, ok): the first success, or failure at the last attempt."""
    won = attempts.groupBy(*keys).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"))
    return won.select(*keys, F.when(F.col("won").isNotNull(), "success").otherwise("failure").alias("status"), F.coalesce("won", F.lit(max_retries)).alias("attempt"))


def fence(completions: DataFrame, assigned: DataFrame) -> DataFrame:
    """All completions of assigned partitions with `stale`: of another generation than the assignment's."""
    return completions.join(assigned.select(*TP, F.col("epoch").alias("now_epoch")), TP).withColumn("stale", F.col("epoch") != F.col("now_epoch")).drop("now_epoch")


def disposition(dlq_enabled: bool = True, max_retries: int = 3) -> Column:
    """complete, dlq, or complete_no_dlq (a failure before the last attempt, or without a dead-letter topic)."""
    return F.when(F.col("status") == "success", "complete").when(F.lit(dlq_enabled) & (F.col("attempt") >= max_retries), "dlq").otherwise("complete_no_dlq")


def without_pending(events: DataFrame, pending: DataFrame) -> DataFrame:
    """Events of offsets that are not in the pending ledger, each offset once."""
    return events.join(pending.select(*TP, "off"), [*TP, "off"], "left_anti").dropDuplicates([*TP, "off"])


def dead_letters(failed: DataFrame, cached: DataFrame | None = None, suffix: str = ".dlq", full: bool = True) -> DataFrame:
    """Dead-letter records: topic, key, value and the six headers, as columns. Without a cached payload (or not full) key and value are null."""
    if cached is not None and full:
        rows = failed.drop("k", "v").join(cached.select(*TP, "off", "k", "v"), [*TP, "off"], "left")
    else:
        rows = failed if full else failed.withColumns({"k": F.lit(None).cast("string"), "v": F.lit(None).cast("string")})
    return rows.select(
        F.concat("topic", F.lit(suffix)).alias("dlq_topic"), F.col("k").alias("key"), F.col("v").alias("value"), F.coalesce("error", F.lit("Unknown error")).alias("x_error_reason"), F.col("attempt").cast("string").alias("x_retry_attempt"),
        F.col("topic").alias("source_topic"), F.col("part").cast("string").alias("part_header"), F.col("off").cast("string").alias("offset_header"), F.col("epoch").cast("string").alias("epoch_header"),
    )


def as_kafka(letters: DataFrame) -> DataFrame:
    """Dead letters in the shape of Spark's Kafka sink with headers."""
    names = {"x-error-reason": "x_error_reason", "x-retry-attempt": "x_retry_attempt", "source-topic": "source_topic", "partition": "part_header", "offset": "offset_header", "epoch": "epoch_header"}
    headers = F.array(*[F.struct(F.lit(h).alias("key"), F.col(c).cast("binary").alias("value")) for h, c in names.items()])
    return letters.select(F.col("dlq_topic").alias("topic"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), headers.alias("headers"))


def cache_survivors(entries: DataFrame, budget: int, order: str = "seq", scope: tuple[str, ...] = ()) -> DataFrame:
    """Payload entries that a FIFO cache of `budget` bytes still holds: those that fit at all, from the newest back while their sum fits.

    One cache holds all partitions' entries, or one for each value of the `scope` columns. `order` is a distinct whole number. Sums by ranges of it
    tell which ranges are held as a whole, so only the one in which the budget ends is summed by rows.
    """
    fit = entries.where(F.col("size") <= budget).withColumn("range_", range_of(F.col(order)))
    keys = list(scope)
    per = fit.groupBy(*keys, "range_").agg(F.sum("size").alias("n_"))
    after = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy(F.col("range_").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("after_", after).where(F.col("after_") <= budget).drop("n_")
    # Summed from the newest on: a frame that ends with the partition would be summed anew for every row.
    near = F.sum("size").over(Window.partitionBy(*keys, "range_").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fit.join(per, [*keys, "range_"]).withColumn("behind_", near + F.col("after_")).where(F.col("behind_") <= budget).select(*entries.columns)


def cache_without(entries: DataFrame, taken: DataFrame, revoked: DataFrame | None = None) -> DataFrame:
    """Cached entries without the offsets that were taken out (topic, part, off) and without those of revoked partitions."""
    left = entries.join(taken.select(*TP, "off"), [*TP, "off"], "left_anti")
    return left if revoked is None else left.join(revoked.select(*TP), TP, "left_anti")


def publish_order(pending: DataFrame, fresh: DataFrame, max_attempts: int) -> DataFrame:
    """Dead letters to publish: the pending ledger (topic, part, off, publish_attempts) first, then fresh ones; `exhausted` ones are not tried again."""
    both = pending.select(*TP, "off", F.lit(0).alias("stage"), F.col("publish_attempts").cast("int").alias("publish_attempts"))
    both = both.unionByName(without_pending(fresh, pending).select(*TP, "off", F.lit(1).alias("stage"), F.lit(0).alias("publish_attempts")))
    return both.withColumn("exhausted", F.col("publish_attempts") >= max_attempts)


def completed_offsets(done: DataFrame, published: DataFrame, pending: DataFrame) -> DataFrame:
    """Offsets that are complete once the pending ones are held back: a dead letter that is not published yet stays a gap."""
    waiting = pending.join(published.select(*TP, "off"), [*TP, "off"], "left_anti")
    return done.select(*TP, "off").unionByName(published.select(*TP, "off")).distinct().join(waiting.select(*TP, "off"), [*TP, "off"], "left_anti")


def registry_state(events: DataFrame) -> DataFrame:
    """worker, item, requeue_attempts, timed_out, attempt, timeout_error of the items in flight, from events (worker, item, seq, kind, requeue_attempts, attempt, timeout_error).

    A start puts an item in with a clean state, done takes it out; a timeout marks an item that is in.
    """
    keys = ["worker", "item"]
    life = events.where(F.col("kind").isin("start", "done", "timeout"))
    begun = life.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "start", F.col("seq"))).alias("from"), F.max(F.when(F.col("kind") == "done", F.col("seq"))).alias("end"))
    open_ = begun.where("from IS NOT NULL AND (end IS NULL OR end < from)").select(*keys, "from")
    own = life.join(open_, keys).where(F.col("seq") >= F.col("from"))
    late = F.when(F.col("kind") == "timeout", F.struct("seq", F.coalesce("attempt", F.lit(1)).alias("attempt"), F.coalesce("timeout_error", F.lit("task_timeout")).alias("error")))
    out = own.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "start", F.coalesce("requeue_attempts", F.lit(0)))).alias("requeue_attempts"), F.max(late).alias("late"))
    return out.select(*keys, "requeue_attempts", F.col("late").isNotNull().alias("timed_out"), F.col("late.attempt").alias("attempt"), F.col("late.error").alias("timeout_error"))


def recover_dead_workers(registry: DataFrame, dead: DataFrame, max_retries: int = 3) -> DataFrame:
    """What becomes of a dead worker's items: requeue with one attempt more, or failure after a timeout (which is final) or max_retries requeues."""
    lost = registry.join(dead.select("worker"), "worker", "left_semi")
    spent = F.col("requeue_attempts") >= max_retries
    action = F.when(F.col("timed_out") | spent, "failure").otherwise("requeue")
    error = F.when(F.col("timed_out"), F.col("timeout_error")).when(spent, "worker_died_max_retries")
    attempt = F.when(F.col("timed_out"), F.col("attempt")).when(spent, F.col("requeue_attempts")).otherwise(F.col("requeue_attempts") + 1)
    return lost.select("worker", "item", action.alias("action"), error.alias("error"), attempt.alias("attempt"))


def forced_failures(blocked: DataFrame, limit_s: float, max_retries: int = 3) -> DataFrame:
    """Failure events for gap heads (topic, part, head, age) at least limit_s old."""
    text = F.format_string("Blocking offset %d exceeded %.3fs", F.col("head"), F.lit(limit_s))
    return blocked.where(F.col("age") >= limit_s).select(*TP, F.col("head").alias("off"), F.lit("failure").alias("status"), F.lit(max_retries).alias("attempt"), text.alias("error"))


class Circuit:
    """State of one poison key: terminal failures counted, and until when it is open.

    A success clears it. A failure before the last attempt does not count. At `threshold` failures it opens for `cooldown`; expiry clears it. While
    it is open, work is failed without being run, and such a failure counts like any other, so the cooldown slides on.
    """

    def __init__(self, threshold: int = 3, cooldown: float = 30.0, max_retries: int = 3):
        self.threshold, self.cooldown, self.least = threshold, cooldown, max(1, max_retries)
        self.failures, self.open_until = 0, None

    def is_open(self, now: float) -> bool:
        if self.open_until is not None and now >= self.open_until:
            self.failures, self.open_until = 0, None
        return self.open_until is not None

    def record(self, now: float, ok: bool, attempt: int) -> None:
        if ok:
            self.failures, self.open_until = 0, None
        elif attempt >= self.least:
            self.failures += 1
            if self.failures >= self.threshold:
                self.open_until = now + self.cooldown

    def step(self, now: float, ok: bool, attempt: int) -> tuple[bool, bool]:
        """(forced, open after) of one piece of work that would end so."""
        forced = self.is_open(now)
        self.record(now, ok and not forced, self.least if forced else attempt)
        return forced, self.open_until is not None


def poison_circuit(events: DataFrame, threshold: int = 3, cooldown: float = 30.0, max_retries: int = 3) -> DataFrame:
    """Fold of the circuit over events (topic, part, poison_key, seq, at seconds, ok, attempt) in order of seq: adds forced and open_after.

    One group is one key of one partition, whose events must be taken in order; they are streamed by sorted partitions, not held.
    """
    schema = "topic string, part int, poison_key string, seq long, at double, ok boolean, attempt int, forced boolean, open_after boolean"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, circuit = None, None
        for frame in frames:
            forced, after = [], []
            for r in frame.itertuples(index=False):
                key = tuple(None if pd.isna(k) else k for k in (r.topic, r.part, r.poison_key))
                if key != now:
                    now, circuit = key, Circuit(threshold, cooldown, max_retries)
                a, b = circuit.step(r.at, bool(r.ok), int(r.attempt))
                forced.append(a)
                after.append(b)
            yield frame.assign(forced=forced, open_after=after)

    rows = events.select("topic", "part", F.col("poison_key").cast("string"), F.col("seq").cast("long"), F.col("at").cast("double"), "ok", F.col("attempt").cast("int"))
    return rows.repartition("topic", "part", "poison_key").sortWithinPartitions("topic", "part", "poison_key", "seq").mapInPandas(fold, schema)
