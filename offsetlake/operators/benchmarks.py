"""Benchmark analytics: run summaries, windowed throughput, comparisons and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offsetlake.operators.ranges import ranked

#: The release thresholds: mode, workload, ordering, least TPS, greatest p99 in ms.
THRESHOLDS = (
    ("async", "sleep", "key_hash", 4900.0, 13.0),
    ("async", "sleep", "partition", 2950.0, 2.0),
    ("async", "cpu", "key_hash", 2050.0, 30.0),
    ("async", "cpu", "partition", 2050.0, 3.0),
    ("async", "io", "key_hash", 4950.0, 15.0),
    ("async", "io", "partition", 2950.0, 2.0),
    ("process", "sleep", "key_hash", 2550.0, 30.0),
    ("process", "sleep", "partition", 380.0, 11.0),
    ("process", "cpu", "key_hash", 2100.0, 30.0),
    ("process", "cpu", "partition", 390.0, 11.0),
    ("process", "io", "key_hash", 2650.0, 30.0),
    ("process", "io", "partition", 390.0, 10.0),
)


def run_summary(runs: DataFrame, us: str = "us", latency: str = "latency_ms") -> DataFrame:
    """run, messages, total_s, tps, avg_ms, p99_ms: exact percentile with linear interpolation; 0 TPS for a run without length."""
    total = (F.max(us) - F.min(us)) / F.lit(1e6)
    return runs.groupBy("run").agg(F.count("*").alias("messages"), total.alias("total_s"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.percentile(latency, F.lit(0.99)), F.lit(0.0)).alias("p99_ms")).withColumn("tps", F.when(F.col("total_s") > 0, F.col("messages") / F.col("total_s")).otherwise(0.0))


def window_tps(runs: DataFrame, size: int = 100, us: str = "us", start: DataFrame | None = None) -> DataFrame:
    """run, window, tps: throughput of every full window of `size` completions in record order (seq from 0).

    A window starts where the one before ended; the first at the run's start (start: run, start_us) or its first completion. Counts are by window, so a
    long run is spread over many groups; only window ends are put in order.
    """
    ends = runs.groupBy("run", F.floor(F.col("seq") / size).cast("long").alias("window")).agg(F.count("*").alias("n"), F.max_by(us, "seq").alias("end"))
    first = start if start is not None else runs.groupBy("run").agg(F.min_by(us, "seq").alias("start_us"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("run").orderBy("window")), F.col("start_us"))
    timed = ends.where(F.col("n") == size).join(first, "run").withColumn("elapsed", (F.col("end") - before) / F.lit(1e6))
    return timed.select("run", "window", F.when(F.col("elapsed") > 0, size / F.col("elapsed")).otherwise(0.0).alias("tps"))


def window_tps_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("run").agg(F.count("*").alias("windows"), F.percentile("tps", F.lit(0.5)).alias("tps_p50"), F.percentile("tps", F.lit(0.1)).alias("tps_p10"), F.min("tps").alias("tps_min"))


def final_observation(observations: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    return observations.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def best_runs(results: DataFrame, keys: list[str]) -> DataFrame:
    """The result with the greatest tps for each key, the first (by seq) of equals."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("tps").desc(), "seq"))
    return results.withColumn("rank", rank).where("rank = 1").drop("rank")


def improvement(candidate: Column, reference: Column) -> list[Column]:
    """delta, pct and ratio, rounded to 6 places; pct and ratio are null for a reference of 0 or less."""
    pos = reference > 0
    return [F.bround(candidate - reference, 6).alias("delta"), F.when(pos, F.bround((candidate - reference) / reference * 100, 6)).alias("pct"), F.when(pos, F.bround(candidate / reference, 6)).alias("ratio")]


def best_against_baseline(results: DataFrame) -> DataFrame:
    """workload, ordering, mode, reference_tps, candidate_tps and the improvement of the best other run over the best baseline."""
    keys = ["workload", "ordering"]
    base = best_runs(results.where("mode = 'baseline'"), keys).select(*keys, F.col("tps").alias("reference_tps"))
    best = best_runs(results.where("mode <> 'baseline'"), keys).select(*keys, "mode", F.col("tps").alias("candidate_tps"))
    return base.join(best, keys).select(*keys, "mode", "reference_tps", "candidate_tps", *improvement(F.col("candidate_tps"), F.col("reference_tps")))


def adaptive_on_off(results: DataFrame) -> DataFrame:
    """name, on_tps, off_tps and the improvement, of runs named <name>-adaptive-on and -off; of several off runs the last counts."""
    named = results.withColumn("name", F.regexp_replace("run", "-adaptive-(on|off)$", ""))
    off = named.where(F.col("run").endswith("-adaptive-off")).groupBy("name").agg(F.max_by("tps", "seq").alias("off_tps"))
    on = named.where(F.col("run").endswith("-adaptive-on")).select("name", "seq", F.col("tps").alias("on_tps"))
    return on.join(off, "name").select("name", "seq", "on_tps", "off_tps", *improvement(F.col("on_tps"), F.col("off_tps")))


def release_gate(results: DataFrame, messages: int = 10000, repetitions: int = 2) -> DataFrame:
    """A row for each threshold: runs, verdict and reason. Thresholds left join results, so combinations without results are found.

    In this order: too few artifacts, wrong message counts, lag or gaps left (null fails), worst TPS too low, worst p99 too high.
    """
    spark = results.sparkSession
    limits = spark.createDataFrame(THRESHOLDS, "mode string, workload string, ordering string, tps_floor double, p99_ceiling double")
    keys = ["mode", "workload", "ordering"]
    seen = results.groupBy(*keys).agg(
        F.count_distinct("artifact").alias("artifacts"), F.min("tps").alias("worst_tps"), F.max("p99_ms").alias("worst_p99"), F.max(F.when(F.col("messages") == messages, 0).otherwise(1)).alias("wrong"),
        F.max(F.when((F.col("final_lag") == 0) & (F.col("final_gaps") == 0), 0).otherwise(1)).alias("left_over"),
    )
    reason = (
        F.when(F.coalesce("artifacts", F.lit(0)) == 0, "missing").when(F.col("artifacts") < repetitions, "repetitions").when(F.col("wrong") == 1, "messages").when(F.col("left_over") == 1, "lag or gaps")
        .when(F.col("worst_tps") < F.col("tps_floor"), "tps").when(F.col("worst_p99") > F.col("p99_ceiling"), "p99")
    )
    out = limits.join(seen, keys, "left").withColumn("reason", F.coalesce(reason, F.lit("ok")))
    return out.select(*keys, F.coalesce("artifacts", F.lit(0)).cast("long").alias("artifacts"), "reason", F.when(F.col("reason") == "ok", "PASS").otherwise("FAIL").alias("status"))


def measurement_conditions(options: DataFrame, messages: int = 10000, partitions: int = 8) -> DataFrame:
    """A row for each artifact's options that break a condition: artifact, reason, status FAIL. Options: num_messages, num_partitions, strict (array), profile, py_spy.

    A missing number or strict list breaks its condition; a missing profiling flag means off.
    """
    broken = F.array(
        F.when(~F.col("num_messages").eqNullSafe(F.lit(messages)), "num_messages"), F.when(~F.col("num_partitions").eqNullSafe(F.lit(partitions)), "num_partitions"),
        F.when(~F.col("strict").eqNullSafe(F.array(F.lit("on"))), "strict"), F.when(F.coalesce("profile", F.lit(False)) | F.coalesce("py_spy", F.lit(False)), "profiling"),
    )
    return options.select("artifact", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("reason"), F.lit("FAIL").alias("status"))


def persistent_gaps(observations: DataFrame, order: str = "seq", limit_s: float = 60.0) -> DataFrame:
    """Artifacts (artifact, run, seq, elapsed_sec, gap_count) with a gap open for more than limit_s: artifact, reason, status FAIL.

    The time starts anew at a gap count of 0 and wherever the run's name changes from one observation to the next.
    """
    along = Window.partitionBy("artifact").orderBy(order)
    turn = F.when((F.col("gap_count") > 0) & F.lag("run").over(along).eqNullSafe(F.col("run")), 0).otherwise(1)
    # a stretch starts at a turn; one that starts with an open gap counts from there
    runs = observations.withColumn("turn", turn).withColumn("stretch", F.sum("turn").over(along)).where(F.col("gap_count") > 0)
    first = F.min(F.when(F.col("gap_count") > 0, F.col("elapsed_sec")))
    held = runs.groupBy("artifact", "stretch").agg((F.max("elapsed_sec") - first).alias("t")).groupBy("artifact").agg(F.max("t").alias("t"))
    return held.where(F.col("t") > limit_s).select("artifact", F.lit("persistent_gap").alias("reason"), F.lit("FAIL").alias("status"))


def gate_verdict(*checks: DataFrame) -> DataFrame:
    """NO-GO if any row of any of the checks (thresholds, conditions, persistent gaps) fails, and how many do."""
    every = checks[0].select("status")
    for c in checks[1:]:
        every = every.unionByName(c.select("status"))
    return every.agg(F.when(F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False)), "NO-GO").otherwise("PASS").alias("verdict"), F.count_if(F.col("status") == "FAIL").alias("failed"))


def longest_gap(observations: DataFrame, keys: list[str], order: str, seconds: str, gaps: str) -> DataFrame:
    """keys, longest: the longest time without a break in which gaps were open."""
    runs = observations.withColumn("stretch", F.sum(F.when(F.col(gaps) > 0, 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(order)))
    held = runs.where(F.col(gaps) > 0).groupBy(*keys, "stretch").agg((F.max(seconds) - F.min(seconds)).alias("t"))
    return observations.select(*keys).distinct().join(held.groupBy(*keys).agg(F.max("t").alias("t")), keys, "left").select(*keys, F.coalesce("t", F.lit(0)).alias("longest"))


def batch_advice(metrics: DataFrame, ratio: float = 0.8, small: float = 2.5) -> DataFrame:
    """Adds flushes, timer_ratio, avg_batch and advise, for process runs with flushes: mostly timer flushes of small batches want no batching."""
    flushes = F.col("size_flush") + F.col("timer_flush") + F.col("close_flush") + F.col("demand_flush")
    out = metrics.where(F.col("mode") == "process").withColumn("flushes", flushes).where("flushes > 0")
    out = out.withColumn("timer_ratio", F.col("timer_flush") / F.col("flushes")).withColumn("avg_batch", F.col("items") / F.col("flushes"))
    return out.withColumn("advise", (F.col("timer_ratio") >= ratio) & (F.col("avg_batch") <= small))


def overview(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set("workload")), ",").alias("workloads"), F.max("tps").alias("best_tps"))


def benchmark_matrix(spark, workloads: list[str], orderings: list[str], modes: list[str], skip_baseline: bool = False, strict: list[str] | None = None, adaptive: list[str] | None = None) -> DataFrame:
    """All combinations to run, of a few short lists of options; strict and adaptive (on, off) are columns only where they are given."""
    one = spark.range(1)
    for name, values in (("workload", workloads), ("ordering", orderings), ("strict", strict), ("adaptive", adaptive), ("mode", [m for m in modes if not (skip_baseline and m == "baseline")])):
        if values is not None:
            one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return one.drop("id")


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """kind, topic, run, tps, processed of benchmark log lines; other lines are left out."""
    v = F.col(value)
    topic = F.nullif(F.regexp_extract(v, r"for topic '([^']+)'", 1), F.lit(""))
    tps = F.nullif(F.regexp_extract(v, r"(?i)final tps:?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
    done = F.nullif(F.regexp_extract(v, r"(?i)processed\s+([0-9]+)", 1), F.lit(""))
    kind = F.when(topic.isNotNull(), "start").when(tps.isNotNull(), "result").when(done.isNotNull(), "progress").when(v.contains("JSON summary written to"), "summary")
    return lines.select(kind.alias("kind"), topic.alias("topic"), tps.cast("double").alias("tps"), done.cast("long").alias("processed")).where("kind IS NOT NULL")


def log_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """All other columns, then kind, topic, workload, ordering, phase, strict, target, processed, tps, path of a benchmark's log lines.

    Kinds: start (a line that starts with Starting and names a topic), target, processed, result, summary, reset; other lines are left out. What a line does not
    say is null. A run is (workload, ordering, strict, phase), read from its topic's name.
    """
    v = F.trim(F.col(value))

    def part(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    topic = part(v, r"topic '([^']+)'")
    start = F.coalesce(v.startswith("Starting ") & topic.isNotNull(), F.lit(False))
    target = F.coalesce(part(v, r"Will process up to (\d+) messages"), part(v, r"Target messages to process:\s*(\d+)")).cast("long")
    processed = F.coalesce(part(v, r"Total messages processed(?: \(approx\))?:\s*(\d+)"), part(v, r"Processed (\d+) messages")).cast("long")
    tps, path = part(v, r"Final TPS:\s*([0-9]+(?:\.[0-9]+)?)").cast("double"), part(v, r"JSON summary written to (.+)$")
    kind = F.when(v.contains("Resetting benchmark topics/groups:"), "reset").when(target.isNotNull(), "target").when(start, "start").when(path.isNotNull(), "summary").when(tps.isNotNull(), "result").when(processed.isNotNull(), "processed")
    named = F.when(start, topic)
    phase = F.coalesce(part(named, r"(?:^|-)(async|process)(?:$|-strict-)"), F.when(named.contains("baseline"), "baseline"))
    found = lines.select(
        *[c for c in lines.columns if c != value], kind.alias("kind"), topic.alias("topic"), part(named, r"(?:^|-)(sleep|cpu|io)-").alias("workload"), part(named, r"(?:^|-)(key_hash|partition|unordered)(?:-|$)").alias("ordering"),
        phase.alias("phase"), part(named, r"(?:^|-)strict-(on|off)(?:$|[.-])").alias("strict"), target.alias("target"), processed.alias("processed"), tps.alias("tps"), path.alias("path"),
    )
    return found.where("kind IS NOT NULL")


def run_progress(events: DataFrame, keys: list[str], order: str, total: int) -> DataFrame:
    """keys, order, kind, then what is known after each of the `log_events`: run_topic, target, processed, started, completed, progress.

    The topic is that of the last start, target and processed are the last ones since then (0 before any). A run counts once, at its first start, if workload,
    ordering and phase are known; a result completes the oldest run that is not complete, and none when there is none: a queue whose length never falls below
    0, so it is the running sum of steps less its running minimum. progress = completed + half of the others, `total` at most.
    """
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = [F.coalesce(c, F.lit("")) for c in ("workload", "ordering", "strict", "phase")]
    counts = (F.col("kind") == "start") & F.col("workload").isNotNull() & F.col("ordering").isNotNull() & F.col("phase").isNotNull()
    marked = events.withColumn("counts", F.coalesce(counts, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*keys, "counts", *run).orderBy(order))
    marked = marked.withColumn("opens", (F.col("counts") & (nth == 1)).cast("long")).withColumn("step", F.col("opens") - (F.col("kind") == "result").cast("long"))
    marked = marked.withColumns({"started": F.sum("opens").over(along), "level": F.sum("step").over(along), "stretch": F.sum(F.col("counts").cast("long")).over(along)})
    active = F.col("level") - F.least(F.lit(0), F.min("level").over(along))
    within = Window.partitionBy(*keys, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.select(
        *keys, order, "kind", F.last(F.when(F.col("kind") == "start", F.col("topic")), ignorenulls=True).over(along).alias("run_topic"), F.coalesce(F.last("target", ignorenulls=True).over(within), F.lit(0)).alias("target"),
        F.coalesce(F.last("processed", ignorenulls=True).over(within), F.lit(0)).alias("processed"), "started", (F.col("started") - active).alias("completed"),
    )
    return out.withColumn("progress", F.least(F.lit(float(total)), F.col("completed") + F.lit(0.5) * (F.col("started") - F.col("completed"))))


def best_run(results: DataFrame, run: str = "run", tps: str = "tps") -> DataFrame:
    """One row: runs, workloads (sorted, comma-joined), and name and TPS of the fastest run (the first by name of equally fast ones)."""
    best = F.min(F.struct((-F.col(tps)).alias("fast"), F.col(run).alias("name")))
    return results.agg(F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set("workload")), ",").alias("workloads"), best.alias("best")).select("runs", "workloads", F.col("best.name").alias("best_run"), (-F.col("best.fast")).alias("best_tps"))


def baseline_commits(records: DataFrame, keys: list[str], order: str, value: str, every: int = 100) -> DataFrame:
    """keys, order, seen, commits: the records a sequential consumer works on (value not null and valid UTF-8), numbered from 1, and whether it commits there."""
    good = records.where(F.col(value).isNotNull() & F.is_valid_utf8(F.col(value).cast("string")))
    seen = ranked(good, keys, order, "seen").withColumn("seen", F.col("seen") + 1)
    return seen.select(*keys, order, "seen", (F.col("seen") % every == 0).alias("commits"))


def order_of(run: Column, topic: Column) -> Column:
    """Ordering mode by name: of the run, else of the topic, else key_hash."""
    def found(c: Column) -> Column:
        return F.when(c.rlike("key[-_]hash"), "key_hash").when(c.rlike("unordered"), "unordered").when(c.rlike("partition"), "partition")

    return F.coalesce(found(run), found(topic), F.lit("key_hash"))


def merge_observations(results: DataFrame) -> DataFrame:
    """One row for each observation, with its run: observations is an array of (elapsed_sec, lag, gap_count)."""
    return results.select("run", F.posexplode("observations").alias("seq", "o")).select("run", "seq", "o.*")


def text_table(rows: DataFrame) -> str:
    """The rows of a report as an aligned text table: columns joined by " | ", a line of dashes under the names. All rows come to the driver."""
    cells = [list(rows.columns), *[["" if x is None else str(x) for x in r] for r in rows.collect()]]
    wide = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    lines = [" | ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in wide), *lines[1:]])


def human(value: Column, digits: int = 2) -> Column:
    """Thousands separators and fixed digits; n/a for null."""
    return F.coalesce(F.format_number(value, digits), F.lit("n/a"))


def signed(value: Column, digits: int = 2, suffix: str = "") -> Column:
    """A number with its sign, halves rounded to even; n/a for null."""
    text = F.concat(F.when(value >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits)), F.lit(suffix))
    return F.when(value.isNotNull(), text).otherwise("n/a")


def times(value: Column) -> Column:
    """A ratio as 1.25x; n/a for null."""
    return F.when(value.isNotNull(), F.concat(F.format_string("%.2f", F.bround(value.cast("double"), 2)), F.lit("x"))).otherwise("n/a")


def auto_batching(options: DataFrame) -> DataFrame:
    """Adds effective_size and effective_wait_ms: 1 and 0 for strict process runs of short sleeps by partition without batch options of their own."""
    tuned = ~F.coalesce("skip_process", F.lit(False)) & F.array_contains("workloads", "sleep") & F.array_contains("orderings", "partition") & F.array_contains("strict", "on") & (F.col("sleep_ms") <= 0.5)
    for c in ("batch_size", "max_wait_ms", "flush_policy", "min_residence_ms"):
        tuned = tuned & F.col(c).isNull()
    tuned = F.coalesce(tuned, F.lit(False))
    return options.withColumn("effective_size", F.when(tuned, 1).otherwise(F.col("batch_size"))).withColumn("effective_wait_ms", F.when(tuned, 0).otherwise(F.col("max_wait_ms")))


def whole_number(json: Column, *paths: str) -> Column:
    """The first of the JSON paths that holds a whole number; true, false, fractions and texts are none."""
    found = [F.get_json_object(json, p) for p in paths]
    kinds = [F.try_variant_get(F.try_parse_json(json), p, "variant") for p in paths]
    return F.coalesce(*[F.when(F.schema_of_variant(k) == "BIGINT", f.try_cast("bigint")) for f, k in zip(found, kinds, strict=True)])
