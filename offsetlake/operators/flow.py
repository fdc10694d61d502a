"""Flow control over a series of load samples: hysteresis, adaptive limits, latency averages, micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hysteresis(samples: DataFrame, keys: list[str], order: str, max_load: int = 1000, queue_max: int = 0) -> DataFrame:
    """Adds paused: set above max_load (or at queue_max queued), reset below 0.7 of both, else as before; starts running."""
    load = F.col("in_flight") + F.col("queued")
    resume, queue_resume = max(1, int(max_load * 0.7)), int(queue_max * 0.7)
    pause = (load > max_load) | (F.lit(queue_max > 0) & (F.col("queued") >= queue_max))
    run = (load < resume) & (F.lit(queue_resume == 0) | (F.col("queued") <= queue_resume))
    signal = F.when(pause, 1).when(run, 0)
    last = F.last(signal, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return samples.withColumn("paused", F.coalesce(last, F.lit(0)) == 1)


@dataclass
class ConcurrencyLimit:
    """Raises the limit by `up` when it is used up and nothing queues, lowers it by `down` under pressure; waits `cooldown` after each real change."""

    ceiling: int
    minimum: int = 0
    up: int = 32
    down: int = 64
    cooldown: float = 1.0
    changed: float | None = None

    def __post_init__(self):
        self.minimum = max(1, self.ceiling // 4) if self.minimum <= 0 else min(max(1, self.minimum), self.ceiling)

    def evaluate(self, now: float, limit: int, in_flight: int, queued: int, lag: int, paused: bool, queue_max: int = 0) -> int | None:
        if self.changed is not None and now - self.changed < self.cooldown:
            return None
        new = limit
        if paused or (queue_max > 0 and queued >= queue_max) or in_flight + queued > limit:
            new = max(self.minimum, limit - self.down)
        elif lag >= limit and queued == 0:
            new = min(self.ceiling, limit + self.up)
        if new == limit:
            return None
        self.changed = now
        return new


@dataclass
class BackpressureLimit:
    """Raises the cap by `up` at low latency with lag and empty queues, lowers it by `down` when paused or slow."""

    ceiling: int
    minimum: int = 1
    up: int = 16
    down: int = 16
    cooldown: float = 1.0
    lag_threshold: int = 0
    low_s: float = 0.025
    high_s: float = 0.1
    changed: float | None = None

    def evaluate(self, now: float, limit: int, queued: int, lag: int, paused: bool, latency: float | None) -> tuple[int, str]:
        if self.changed is not None and now - self.changed < self.cooldown:
            return limit, "cooldown"
        new, decision = limit, "hold"
        if paused or (latency is not None and latency >= self.high_s):
            new, decision = max(self.minimum, limit - self.down), "scale_down"
        elif lag >= self.lag_threshold and queued == 0 and latency is not None and latency <= self.low_s:
            new, decision = min(self.ceiling, limit + self.up), "scale_up"
        if new == limit:
            return limit, "hold"
        self.changed = now
        return new, decision


def ordered_fold(frame: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """A sequential fold by key over sorted partitions: start() makes a step function (row -> dict of added columns). Keys are streamed, not held."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for f in frames:
            added = []
            for r in f.itertuples(index=False):
                key = tuple(None if pd.isna(k) else k for k in (getattr(r, k) for k in keys))  # nulls of numbers come as NaN
                if key != now:
                    now, step = key, start()
                added.append(step(r))
            extra = pd.DataFrame(added, index=f.index)
            yield pd.concat([f, extra], axis=1)

    return frame.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)


def adaptive_concurrency(samples: DataFrame, keys: list[str], ceiling: int, start_limit: int, **how) -> DataFrame:
    """Adds limit_after over samples with at (seconds), in_flight, queued, lag, paused; keys must be strings or numbers."""

    def start():
        control, limit = ConcurrencyLimit(ceiling, **how), start_limit

        def step(r):
            nonlocal limit
            limit = control.evaluate(r.at, limit, r.in_flight, r.queued, r.lag, bool(r.paused)) or limit
            return {"limit_after": limit}

        return step

    names = [*keys, "at", "in_flight", "queued", "lag", "paused"]
    frame = samples.select(*keys, F.col("at").cast("double"), *[F.col(c).cast("long") for c in names[-4:-1]], "paused")
    return ordered_fold(frame, keys, ["at"], start, f"{frame.schema.simpleString()[7:-1].replace(':', ' ')}, limit_after long")


def adaptive_backpressure(samples: DataFrame, keys: list[str], ceiling: int, start_limit: int, **how) -> DataFrame:
    """Adds limit_after and decision over samples with at (seconds), queued, lag, paused, latency."""

    def start():
        control, limit = BackpressureLimit(ceiling, **how), start_limit

        def step(r):
            nonlocal limit
            limit, decision = control.evaluate(r.at, limit, r.queued, r.lag, bool(r.paused), None if pd.isna(r.latency) else r.latency)
            return {"limit_after": limit, "decision": decision}

        return step

    frame = samples.select(*keys, F.col("at").cast("double"), F.col("queued").cast("long"), F.col("lag").cast("long"), "paused", F.col("latency").cast("double"))
    return ordered_fold(frame, keys, ["at"], start, f"{frame.schema.simpleString()[7:-1].replace(':', ' ')}, limit_after long, decision string")


def latency_average(samples: DataFrame, keys: list[str], order: list[str], value: str, keep: float = 0.8) -> DataFrame:
    """Adds average: keep * average before + (1 - keep) * value; the first value starts it. A null value leaves the average as it is, null before any.

    A linear recurrence: each key's stretch of a batch is one array operation, and the last average goes on to the next batch.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mean = None, float("nan")
        for f in frames:
            parts = []
            for key, rows in f.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                before = pd.Series([mean if key == last else float("nan")])
                run = pd.concat([before, rows[value]]).ewm(alpha=1 - keep, adjust=False, ignore_na=True).mean().iloc[1:]
                parts.append(run)
                last, mean = key, float(run.iloc[-1])
            yield f.assign(average=pd.concat(parts)) if parts else f.assign(average=0.0)

    frame = samples.select(*keys, *order, F.col(value).cast("double"))
    schema = f"{frame.schema.simpleString()[7:-1].replace(':', ' ')}, average double"
    return frame.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema).withColumn("average", F.nanvl("average", F.lit(None).cast("double")))


def recent_rate(events: DataFrame, keys: list[str], seconds_col: str, window_s: int = 5, most: int = 256) -> DataFrame:
    """Adds rate: completions of the last window_s seconds (bounds included, `most` at most) a second. The column holds whole microseconds."""
    span = Window.partitionBy(*keys).orderBy(seconds_col).rangeBetween(-window_s * 1_000_000, Window.currentRow)
    return events.withColumn("rate", F.least(F.count("*").over(span), F.lit(most)) / F.lit(float(window_s)))


def size_batches(items: DataFrame, keys: list[str], order: str, size: int = 64) -> DataFrame:
    """Adds batch: the number of the micro-batch when only size flushes it."""
    return items.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size).cast("long"))


def timed_batches(items: DataFrame, keys: list[str], size: int = 64, wait_s: float = 0.005, policy: str = "size_or_timer", residence_s: float = 0.0) -> DataFrame:
    """Adds batch and reason (size, timer, demand or close, on a batch's last row) over items with `at` seconds, flushed at `size` or `wait_s` after the first.

    Policy demand also flushes what is held before each further item, demand_min_residence only if its first item has waited residence_s.
    """
    if policy not in ("size_or_timer", "demand", "demand_min_residence"):
        raise ValueError(f"unknown flush policy {policy!r}")
    least = {"size_or_timer": float("inf"), "demand": 0.0, "demand_min_residence": residence_s}[policy]
    # A batch's first row tells what flushed the batch before; equal times keep the fold's order of batches.
    w = Window.partitionBy(*keys).orderBy("batch", "at", F.col("flushed").isNull(), "full")

    def start():
        first, count, number = None, 0, 0

        def step(r):
            nonlocal first, count, number
            age, flushed = None if first is None else r.at - first, None
            if age is not None and (age >= wait_s or age >= least):
                flushed = "timer" if age >= wait_s else "demand"
                number, first, count = number + 1, None, 0
            if first is None:
                first, count = r.at, 0
            count += 1
            mine, full = number, count >= size
            if full:
                number, first = number + 1, None
            return {"batch": mine, "full": full, "flushed": flushed}

        return step

    frame = items.select(*keys, F.col("at").cast("double"))
    out = ordered_fold(frame, keys, ["at"], start, f"{frame.schema.simpleString()[7:-1].replace(':', ' ')}, batch long, full boolean, flushed string")
    after, why = F.lead("batch").over(w), F.lead("flushed").over(w)
    return out.withColumn("reason", F.when(F.col("full"), "size").when(after.isNull(), "close").when(after != F.col("batch"), why)).drop("full", "flushed")


def runtime_limits(samples: DataFrame, keys: list[str], ceiling: int, backpressure: dict, concurrency: dict) -> DataFrame:
    """Adds limit_after, decision and paused_after over samples with at (seconds), in_flight, queued, lag, latency: both controllers and the pause in one fold.

    The limit starts at the ceiling. For every sample the backpressure controller moves it, then the concurrency controller, both seeing the pause as it was
    before, each result within 1 and the ceiling; then the pause is set above the limit and reset below 0.7 of it (1 at least).
    """

    def start():
        cap, use, limit, paused = BackpressureLimit(ceiling, **backpressure), ConcurrencyLimit(ceiling, **concurrency), ceiling, False

        def step(r):
            nonlocal limit, paused
            limit, decision = cap.evaluate(r.at, limit, r.queued, r.lag, paused, None if pd.isna(r.latency) else r.latency)
            limit = max(1, min(ceiling, limit))
            limit = max(1, min(ceiling, use.evaluate(r.at, limit, r.in_flight, r.queued, r.lag, paused) or limit))
            load = r.in_flight + r.queued
            paused = load > limit or (paused and load >= max(1, int(limit * 0.7)))
            return {"limit_after": limit, "decision": decision, "paused_after": paused}

        return step

    frame = samples.select(*keys, F.col("at").cast("double"), *[F.col(c).cast("long") for c in ("in_flight", "queued", "lag")], F.col("latency").cast("double"))
    return ordered_fold(frame, keys, ["at"], start, f"{frame.schema.simpleString()[7:-1].replace(':', ' ')}, limit_after long, decision string, paused_after boolean")
