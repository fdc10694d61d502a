"""Offset tracking and commits on a stream of completions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "committed long, runs array<struct<a: long, b: long>>"
OUTPUT = "topic string, part int, committed long, open_runs int"


def advance(committed: int, runs: list[tuple[int, int]], offsets: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """Completed offsets as sorted disjoint runs; those that reach committed + 1 raise the mark. State is as large as the gaps are many."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted([*runs, *((o, o) for o in offsets if o > committed)]):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    while merged and merged[0][0] <= committed + 1:
        committed = max(committed, merged[0][1])
        merged.pop(0)
    return committed, merged


def track(completions: DataFrame, start: int = -1) -> DataFrame:
    """Streaming (topic, part, off) to (topic, part, committed, open_runs): the contiguous mark of each partition after each micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        committed, runs = state.get if state.exists else (start, [])
        offsets = [int(o) for f in frames for o in f["off"]]
        committed, runs = advance(int(committed), [(int(r[0]), int(r[1])) for r in runs], offsets)
        state.update((committed, runs))
        yield pd.DataFrame({"topic": [key[0]], "part": [key[1]], "committed": [committed], "open_runs": [len(runs)]})

    keyed = completions.select("topic", F.col("part").cast("int").alias("part"), F.col("off").cast("long").alias("off"))
    return keyed.groupBy("topic", "part").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def commit_sink(path: str):
    """foreachBatch writer of commits (topic, part, committed). Each batch writes the latest commit of every partition to its own folder.

    A batch that runs again starts from the batches before it and leaves one copy. A commit never goes back. Folders older than the batch before are
    deleted, so there are two, each of one row a partition of the log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = files.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")) if fs.exists(root) else []
        earlier = [b for b in there if b < batch_id]
        now = batch.select("topic", "part", (F.col("committed") + 1).alias("next_offset"))
        if earlier:
            now = now.unionByName(spark.read.parquet(f"{path}/batch={earlier[-1]}").select("topic", "part", "next_offset"))
        now.groupBy("topic", "part").agg(F.max("next_offset").alias("next_offset")).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for b in earlier[:-1]:
            fs.delete(files.Path(f"{path}/batch={b}"), True)

    return write


def committed_offsets(spark, path: str) -> DataFrame:
    """topic, part, next_offset: the latest commit of each partition."""
    return spark.read.parquet(path).groupBy("topic", "part").agg(F.max_by("next_offset", "batch").alias("next_offset"))
