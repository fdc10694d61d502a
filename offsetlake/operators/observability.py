"""Snapshots, counters, histograms and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offsetlake.operators.offsets import TP, gaps, progress, true_lag
from offsetlake.options import LogOptions

#: The default latency buckets (seconds) of the usual metrics client.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def partition_metrics(done: DataFrame, state: DataFrame, queued: DataFrame) -> DataFrame:
    """topic, part, lag, gap_count, blocking, queued."""
    q = queued.groupBy(*TP).agg(F.count("*").alias("queued"))
    lag = F.greatest(F.lit(0).cast("long"), F.col("fetched") - F.col("committed")).alias("lag")
    return progress(done, state).join(q, TP, "left").select(*TP, lag, "gap_count", "blocking", F.coalesce("queued", F.lit(0)).alias("queued"))


def snapshot(metrics: DataFrame, paused: bool = False) -> DataFrame:
    """One row: totals and an array of partitions sorted by topic and partition. There are as many entries as partitions of the log."""
    return metrics.agg(F.sum("lag").alias("total_lag"), F.sum("queued").alias("total_queued"), F.lit(paused).alias("paused"), F.array_sort(F.collect_list(F.struct(*TP, "lag", "gap_count", "blocking", "queued"))).alias("partitions"))


def partition_runtime(done: DataFrame, state: DataFrame, queued: DataFrame, flying: DataFrame, ages: DataFrame) -> DataFrame:
    """One row a partition: epoch, committed, fetched, lag, gaps (sorted), blocking, blocked_s, queued, in_flight, min_in_flight.

    state: topic, part, epoch, committed, fetched. queued and flying: one row an offset. ages: topic, part, head, age in seconds; a blocking offset without
    one gets null. A partition's gaps are one array.
    """
    g = gaps(done, state).groupBy(*TP).agg(F.array_sort(F.collect_list(F.struct("gap_start", "gap_end"))).alias("gaps")).withColumn("blocking", F.col("gaps")[0]["gap_start"])
    g = g.join(ages.select(*TP, F.col("head").alias("blocking"), F.col("age").cast("double").alias("blocked_s")), [*TP, "blocking"], "left")
    q = queued.groupBy(*TP).agg(F.count("*").alias("queued"))
    f = flying.groupBy(*TP).agg(F.count("*").alias("in_flight"), F.min("off").alias("min_in_flight"))
    out = state.join(true_lag(state), TP).join(g, TP, "left").join(q, TP, "left").join(f, TP, "left")
    none = F.array().cast("array<struct<gap_start: long, gap_end: long>>")
    return out.select(*TP, "epoch", "committed", "fetched", "lag", F.coalesce("gaps", none).alias("gaps"), "blocking", "blocked_s", F.coalesce("queued", F.lit(0)).alias("queued"), F.coalesce("in_flight", F.lit(0)).alias("in_flight"), "min_in_flight")


def full_snapshot(parts: DataFrame, options: LogOptions, cached: DataFrame, circuits: DataFrame | None = None, poison: dict | None = None, concurrency: dict | None = None, backpressure: dict | None = None, limit: int | None = None, paused: bool = False, rebalancing: bool = False) -> DataFrame:
    """One row with the sections queue, retry, dlq, poison_message, adaptive_concurrency, adaptive_backpressure and partitions (of `partition_runtime`, in order).

    cached: one row a cached payload, with bytes. circuits: one row a key, with open. poison, concurrency, backpressure: a controller's settings; its section
    is null where it has none. No section holds a secret.
    """
    e = options.execution

    def section(values: dict | None, *more: Column) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()], *more) if values is not None else F.lit(None)

    of_parts = parts.agg(F.coalesce(F.sum("in_flight"), F.lit(0)).alias("flying"), F.coalesce(F.sum("queued"), F.lit(0)).alias("waiting"), F.array_sort(F.collect_list(F.struct(*parts.columns))).alias("partitions"))
    of_cache = cached.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"), F.count("*").alias("entries"))
    of_keys = circuits.agg(F.count_if("open").alias("open_count")) if circuits is not None else parts.sparkSession.range(1).select(F.lit(0).cast("long").alias("open_count"))
    one = F.lit(1)
    row = of_parts.withColumn("one", one).join(of_cache.withColumn("one", one), "one").join(of_keys.withColumn("one", one), "one")  # three tables of one row
    queue = {"max_in_flight": e.max_in_flight if limit is None else limit, "configured_max_in_flight": e.max_in_flight, "is_paused": paused, "is_rebalancing": rebalancing, "ordering_mode": options.ordering}
    retry = {"max_retries": e.max_retries, "retry_backoff_ms": e.retry_backoff_ms, "exponential_backoff": e.exponential, "max_retry_backoff_ms": e.max_retry_backoff_ms, "retry_jitter_ms": e.retry_jitter_ms}
    dlq = {"enabled": bool(options.dlq_suffix), "topic": options.topic + options.dlq_suffix, "payload_mode": options.dlq_payload}
    return row.select(
        section(queue, F.col("flying").alias("total_in_flight"), F.col("waiting").alias("total_queued")).alias("queue"), section(retry).alias("retry"),
        section(dlq, F.col("size").alias("message_cache_size_bytes"), F.col("entries").alias("message_cache_entry_count")).alias("dlq"),
        section(poison, F.col("open_count").alias("open_circuit_count")).alias("poison_message"), section(concurrency).alias("adaptive_concurrency"), section(backpressure).alias("adaptive_backpressure"), "partitions",
    )


def processed_total(completions: DataFrame) -> DataFrame:
    return completions.groupBy(*TP, "status").agg(F.count("*").alias("processed"))


def latency_histogram(events: DataFrame, seconds: str, keys: list[str] | None = None, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """keys, le, cumulative: a row for each bucket, +Inf last. One pass, one partial aggregate; no row is multiplied."""
    keys = TP if keys is None else keys
    sums = [F.sum(F.when(F.col(seconds) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(buckets)] + [F.count(seconds).alias(f"b{len(buckets)}")]
    wide = events.groupBy(*keys).agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate((*buckets, float("inf")))])
    return wide.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.le", "x.cumulative")


def histogram_samples(events: DataFrame, seconds: str, name: str, keys: list[str] | None = None, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """keys, metric, le, value: the buckets (le as text, +Inf last), the sum and the count of a histogram, from one aggregate."""
    keys = TP if keys is None else keys
    sums = [F.sum(F.when(F.col(seconds) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = events.groupBy(*keys).agg(*sums, F.count(seconds).alias("n"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total"))

    def row(kind: str, le: str, value: Column) -> Column:
        return F.struct(F.lit(f"{name}_{kind}").alias("metric"), F.lit(le).alias("le"), value.cast("double").alias("value"))

    rows = [row("bucket", str(float(b)), F.col(f"b{i}")) for i, b in enumerate(buckets)] + [row("bucket", "+Inf", F.col("n")), row("sum", "", F.col("total")), row("count", "", F.col("n"))]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def histogram_quantile(histogram: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """keys, quantile: linear inside the bucket that holds rank q * count; in the +Inf bucket the largest finite bound."""
    w = Window.partitionBy(*keys).orderBy("le")
    rows = histogram.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("cumulative").over(w), F.lit(0))).withColumn("rank", F.lit(q) * F.max("cumulative").over(Window.partitionBy(*keys)))
    hit = rows.where((F.col("cumulative") >= F.col("rank")) & (F.col("cumulative") > F.col("under")))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("under")) / (F.col("cumulative") - F.col("under")))
    return hit.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def one_hot(current: DataFrame, column: str, values: list[str]) -> DataFrame:
    """All other columns, value and is_current (1 or 0) for each value of a closed domain."""
    rest = [c for c in current.columns if c != column]
    return current.withColumn("value", F.explode(F.array(*[F.lit(v) for v in values]))).select(*rest, "value", (F.col("value") == F.col(column)).cast("int").alias("is_current"))


def last_gauges(samples: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last value of each gauge; a missing one counts as 0."""
    return samples.groupBy(*keys).agg(*[F.coalesce(F.max_by(c, order), F.lit(0)).alias(c) for c in columns])


def per_second(events: DataFrame, ts: str, keys: list[str], window: str = "1 minute", step: str = "1 minute", seconds: int = 60) -> DataFrame:
    """keys, start, rate: events a second in tumbling or sliding windows."""
    return events.groupBy(F.window(ts, window, step), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), (F.col("n") / F.lit(float(seconds))).alias("rate"))


def counter_increase(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds increase since the sample before; a counter that fell was reset and counts from 0."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return samples.withColumn("increase", F.when(before.isNull(), F.lit(0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def held_longer(samples: DataFrame, keys: list[str], order: str, flag: str, seconds: str, limit: float) -> DataFrame:
    """keys, since, lasted: runs of samples in which the flag holds for more than `limit`."""
    turn = Window.partitionBy(*keys).orderBy(order)
    runs = samples.withColumn("stretch", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(turn)).where(flag)
    out = runs.groupBy(*keys, "stretch").agg(F.min(seconds).alias("since"), (F.max(seconds) - F.min(seconds)).alias("lasted"))
    return out.where(F.col("lasted") > limit).drop("stretch")


def growing(samples: DataFrame, keys: list[str], at_us: str, value: str, minutes: int = 5) -> DataFrame:
    """Samples at whose time the value has grown for `minutes`: it is higher than the first sample of that span, never fell in it, and the span is full.

    at_us holds whole microseconds. Samples of equal time count together in a span; which of them comes first does not matter, as a fall is told by times:
    the least value of a time below the greatest of the time before.
    """
    span = minutes * 60_000_000
    once = samples.groupBy(*keys, at_us).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    order = Window.partitionBy(*keys).orderBy(at_us)
    marked = once.withColumn("fell", (F.col("low") < F.lag("high").over(order)).cast("int")).withColumn("begun", F.min(at_us).over(Window.partitionBy(*keys)))
    # a fall into the span's first sample lies before it
    back = order.rangeBetween(-span, Window.currentRow)
    out = marked.withColumns({"first": F.first("low").over(back), "falls": F.sum("fell").over(back) - F.first(F.coalesce("fell", F.lit(0))).over(back)})
    return out.where((F.col(at_us) - F.col("begun") >= span) & (F.coalesce("falls", F.lit(0)) == 0) & (F.col("high") > F.col("first"))).select(*keys, at_us, F.col("high").alias("value"))


def failure_share(completions: DataFrame, ts: str, keys: list[str], window: str = "1 minute", limit: float = 0.01) -> DataFrame:
    """keys, start, failures, completions, alert: windows' completions by status, alert where more than `limit` of them failed."""
    per = completions.groupBy(F.window(ts, window), *keys).agg(F.count_if(F.col("status") == "failure").alias("failures"), F.count("*").alias("completions"))
    return per.select(*keys, F.col("window.start").alias("start"), "failures", "completions", (F.col("failures") / F.col("completions") > limit).alias("alert"))


def over_labels(samples: DataFrame, label: str, pattern: str, value: str) -> DataFrame:
    """One row: largest and summed value of the samples whose label matches the whole pattern."""
    return samples.where(F.col(label).rlike(rf"\A(?:{pattern})\z")).agg(F.max(value).alias("largest"), F.sum(value).alias("total"))


def flush_metrics(flushes: DataFrame) -> DataFrame:
    """reason, flushes, items, average: of micro-batches by what flushed them."""
    return flushes.groupBy("reason").agg(F.count("*").alias("flushes"), F.sum("items").alias("items"), (F.sum("items") / F.count("*")).alias("average"))


def top_blocking(ages: DataFrame, k: int) -> DataFrame:
    """The k partitions that are blocked longest (a report)."""
    return ages.orderBy(F.col("age").desc(), *TP).limit(k)


#: The decisions of the adaptive backpressure controller, and the fields of the two controllers that are shown as gauges.
DECISIONS = ("scale_up", "scale_down", "hold", "cooldown", "disabled")
BACKPRESSURE_FIELDS = ("configured_max_in_flight", "effective_max_in_flight", "min_in_flight", "scale_up_step", "scale_down_step", "cooldown_ms", "lag_scale_up_threshold", "low_latency_threshold_ms", "high_latency_threshold_ms", "avg_completion_latency_seconds")
CONCURRENCY_FIELDS = ("configured_max_in_flight", "effective_max_in_flight", "min_in_flight", "scale_up_step", "scale_down_step", "cooldown_ms")


def adaptive_gauges(snapshots: DataFrame, keys: list[str], backpressure: str = "backpressure", concurrency: str = "concurrency") -> DataFrame:
    """keys, gauge, label, value: the gauges of both controllers, from struct columns that are null where a controller is off (0 then, decision disabled)."""
    rows = [F.struct(F.lit(f"adaptive_backpressure_{f}").alias("gauge"), F.lit("").alias("label"), F.coalesce(F.col(f"{backpressure}.{f}").cast("double"), F.lit(0.0)).alias("value")) for f in BACKPRESSURE_FIELDS]
    last = F.when(F.col(backpressure).isNull(), "disabled").otherwise(F.col(f"{backpressure}.last_decision"))
    rows += [F.struct(F.lit("adaptive_backpressure_last_decision").alias("gauge"), F.lit(d).alias("label"), F.coalesce((last == d).cast("double"), F.lit(0.0)).alias("value")) for d in DECISIONS]
    rows += [F.struct(F.lit(f"adaptive_concurrency_{f}").alias("gauge"), F.lit("").alias("label"), F.coalesce(F.col(f"{concurrency}.{f}").cast("double"), F.lit(0.0)).alias("value")) for f in CONCURRENCY_FIELDS]
    return snapshots.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def diagnostics_line(metrics: DataFrame, warn_s: float = 5.0) -> DataFrame:
    """topic, part, line, warn of partitions (topic, part, queued, gap_count, blocking, age in seconds or null)."""
    age = F.coalesce(F.when(F.col("blocking").isNotNull(), F.format_string("%.2fs", F.col("age").cast("double"))), F.lit("n/a"))
    age = F.when(F.col("blocking").isNull() | F.col("age").isNull(), "n/a").otherwise(age)
    line = F.concat(F.col("topic"), F.lit("-"), F.col("part").cast("string"), F.lit(" queued="), F.col("queued").cast("string"), F.lit(" gaps="), F.col("gap_count").cast("string"), F.lit(" blocking="), F.coalesce(F.col("blocking").cast("string"), F.lit("none")), F.lit(" age="), age)
    return metrics.select(*TP, line.alias("line"), F.coalesce(F.col("blocking").isNotNull() & (F.col("age") >= warn_s), F.lit(False)).alias("warn"))


def exposition(samples: DataFrame, labels: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """One row a sample with its line in the text exposition format: name{label="value",...} number. Backslash, quote and newline are escaped."""

    def escaped(c: str):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))

    inner = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels])
    return samples.select(F.col(metric).alias("metric"), F.concat(F.col(metric), F.lit("{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))
