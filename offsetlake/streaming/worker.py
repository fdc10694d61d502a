"""User workers over records, in order within a key and in parallel across keys."""

from __future__ import annotations

import asyncio
import inspect
import random
import signal
import time
from contextlib import contextmanager
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.options import ExecutionOptions

OUTPUT = "topic string, part int, off long, status string, error string, attempt int"


def _wait(attempt: int, o: ExecutionOptions) -> float:
    ms = min(o.retry_backoff_ms * 2 ** (attempt - 1), o.max_retry_backoff_ms) if o.exponential else o.retry_backoff_ms
    return (ms + random.uniform(0, o.retry_jitter_ms)) / 1000


class TaskTimeout(Exception):
    """A worker took longer than task_timeout_ms."""


@contextmanager
def _limit(seconds: float):
    """Raise TaskTimeout in the main thread of the Python worker after so many seconds."""

    def ring(signum, frame):
        raise TaskTimeout(f"task_timeout after {seconds:g}s")

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _routed(records: DataFrame, ordering: str) -> DataFrame:
    keys = {"key_hash": ["topic", "part", "k"], "partition": ["topic", "part"], "unordered": []}[ordering]
    return records.repartition(*keys).sortWithinPartitions(*keys, "off") if keys else records


def run_sync(records: DataFrame, worker: Callable[[object], object], ordering: str = "key_hash", options: ExecutionOptions | None = None) -> DataFrame:
    """Completion events of a synchronous worker: it gets each row (topic, part, off, k, v ...); an exception is a failure and is tried again.

    A call that takes longer than task_timeout_ms is stopped; a timeout is final, with the attempt at which it happened.
    """
    if not callable(worker) or inspect.iscoroutinefunction(worker):
        raise TypeError("a synchronous worker must be a plain function")
    cloudpickle.dumps(worker)
    o = options or ExecutionOptions()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                status, error, attempt = "failure", None, 0
                while status == "failure" and attempt < o.max_retries:
                    attempt += 1
                    try:
                        with _limit(o.task_timeout_ms / 1000):
                            worker(row)
                        status, error = "success", None
                    except TaskTimeout as e:
                        error = str(e)
                        break
                    except Exception as e:  # the worker's failure is data
                        error = str(e)
                        if attempt < o.max_retries:
                            time.sleep(_wait(attempt, o))
                out.append((row.topic, row.part, row.off, status, error, attempt))
            yield pd.DataFrame(out, columns=["topic", "part", "off", "status", "error", "attempt"])

    return _routed(records, ordering).withColumn("part", F.col("part").cast("int")).mapInPandas(run, OUTPUT)


def run_async(records: DataFrame, worker: Callable[[object], Awaitable], ordering: str = "key_hash", options: ExecutionOptions | None = None) -> DataFrame:
    """Completion events of an async worker: up to max_in_flight at once in each task, one at a time in a key's queue; timeouts are tried again."""
    if not inspect.iscoroutinefunction(worker):
        raise TypeError("an async worker must be a coroutine function")
    cloudpickle.dumps(worker)
    o = options or ExecutionOptions()

    async def one(row, gate: asyncio.Semaphore) -> tuple:
        error = None
        for attempt in range(1, o.max_retries + 1):
            try:
                async with gate:
                    await asyncio.wait_for(worker(row), o.task_timeout_ms / 1000)
                return (row.topic, row.part, row.off, "success", None, attempt)
            except Exception as e:
                error = str(e) or type(e).__name__
                if attempt < o.max_retries:
                    await asyncio.sleep(_wait(attempt, o))
        return (row.topic, row.part, row.off, "failure", error, o.max_retries)

    async def batch(frame: pd.DataFrame) -> list[tuple]:
        gate = asyncio.Semaphore(o.max_in_flight)
        names = {"key_hash": ["topic", "part", "k"], "partition": ["topic", "part"]}.get(ordering)
        queues = [g for _, g in frame.groupby(names, dropna=False, sort=False)] if names else [frame.iloc[[i]] for i in range(len(frame))]

        async def queue(rows: pd.DataFrame) -> list[tuple]:
            return [await one(r, gate) for r in rows.itertuples(index=False)]

        return [x for part in await asyncio.gather(*(queue(q) for q in queues)) for x in part]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(asyncio.run(batch(frame)), columns=["topic", "part", "off", "status", "error", "attempt"])

    return _routed(records, ordering).withColumn("part", F.col("part").cast("int")).mapInPandas(run, OUTPUT)
