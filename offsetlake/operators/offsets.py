"""Offset algebra: contiguous progress, gaps and lag of partitioned logs.

Tables are keyed by (topic, part). `done` has one row a completed offset (off); `state` one row a partition with committed and fetched, both inclusive.
Every operator is an aggregate by partition or a window inside ranges of offsets (see ranges); no offset set is ever collected into one row but
for the codec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offsetlake.operators.ranges import previous, ranked, run_end

TP = ["topic", "part"]
PIECE = 10_000  # offsets of a gap that one array holds at most


def open_completions(done: DataFrame, state: DataFrame) -> DataFrame:
    """Completed offsets that count: beyond committed, each once."""
    return done.select(*TP, "off").distinct().join(state.select(*TP, "committed"), TP).where("off > committed")


def high_water_mark(done: DataFrame, state: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """topic, part, hwm: the end of the run of completed offsets that starts at committed + 1, held below the smallest in-flight offset."""
    run = run_end(open_completions(done, state).withColumn("place", F.col("off") - F.col("committed") - 1), TP, "place")
    out = state.select(*TP, "committed").join(run, TP, "left").withColumn("hwm", F.col("committed") + F.coalesce("run", F.lit(0)))
    if in_flight is not None:
        out = out.join(in_flight.groupBy(*TP).agg(F.min("off").alias("low")), TP, "left")
        out = out.withColumn("hwm", F.when(F.col("low") <= F.col("hwm"), F.col("low") - 1).otherwise(F.col("hwm")))
    return out.select(*TP, F.col("hwm").cast("long").alias("hwm"))


def gaps(done: DataFrame, state: DataFrame) -> DataFrame:
    """topic, part, gap_start, gap_end: maximal runs of incomplete offsets in (committed, fetched]."""
    inside = open_completions(done, state).join(state.select(*TP, "fetched"), TP).where("off <= fetched").select(*TP, "off", "committed")
    ends = inside.unionByName(state.where("fetched > committed").select(*TP, (F.col("fetched") + 1).alias("off"), "committed"))
    return previous(ends, TP, "off", "near").withColumn("before", F.coalesce("near", "committed")).where("off > before + 1").select(*TP, (F.col("before") + 1).alias("gap_start"), (F.col("off") - 1).alias("gap_end"))


def progress(done: DataFrame, state: DataFrame) -> DataFrame:
    """topic, part, committed, fetched, hwm, gap_count, blocking: mark and gaps of every partition from one pass over the completed offsets."""
    opened = done.select(*TP, "off").distinct().join(state.select(*TP, "committed", "fetched"), TP).where("off > committed")
    seen = previous(opened, TP, "off", "near").withColumn("before", F.coalesce("near", "committed"))
    broken = F.col("off") > F.col("before") + 1
    inside = broken & (F.col("before") < F.col("fetched"))
    found = seen.groupBy(*TP).agg(F.max("off").alias("top"), F.min(F.when(broken, F.col("before"))).alias("end"), F.count_if(inside).alias("holes"), F.min(F.when(inside, F.col("before") + 1)).alias("hole"))
    out = state.select(*TP, "committed", "fetched").join(found, TP, "left").withColumn("top", F.coalesce("top", "committed"))
    tail = F.col("top") < F.col("fetched")  # nothing is done between the last completed offset and the last fetched one
    hwm = F.coalesce("end", "top").cast("long").alias("hwm")
    return out.select(*TP, "committed", "fetched", hwm, (F.coalesce("holes", F.lit(0)) + tail.cast("long")).alias("gap_count"), F.coalesce("hole", F.when(tail, F.col("top") + 1)).alias("blocking"))


def blocking_offsets(done: DataFrame, state: DataFrame) -> DataFrame:
    """topic, part, blocking: the first incomplete offset, or null."""
    return progress(done, state).select(*TP, "blocking")


def true_lag(state: DataFrame) -> DataFrame:
    """topic, part, lag: fetched - committed, never below 0."""
    return state.select(*TP, F.greatest(F.lit(0).cast("long"), F.col("fetched") - F.col("committed")).alias("lag"))


def in_flight(done: DataFrame, state: DataFrame) -> DataFrame:
    """topic, part, off: symmetric difference of the completed offsets and (committed, fetched]: the offsets of the gaps, and those completed beyond fetched."""
    start, piece = F.col("gap_start") + F.col("p") * PIECE, gaps(done, state).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("gap_end") - F.col("gap_start")) / PIECE).cast("long"))))
    inside = piece.select(*TP, F.explode(F.sequence(start, F.least(start + PIECE - 1, F.col("gap_end")))).alias("off"))
    beyond = open_completions(done, state).join(state.select(*TP, "fetched"), TP).where(F.col("off") > F.col("fetched")).select(*TP, "off")
    return inside.unionByName(beyond)


def commit_candidates(done: DataFrame, state: DataFrame, flying: DataFrame | None = None) -> DataFrame:
    """topic, part, committed, hwm of partitions whose mark is beyond committed."""
    return state.select(*TP, "committed").join(high_water_mark(done, state, flying), TP).where("hwm > committed")


def beyond_marks(done: DataFrame, marks: DataFrame) -> DataFrame:
    """topic, part, off, next_offset: completed offsets beyond the marks (topic, part, hwm), with the offset that follows the mark."""
    return done.select(*TP, "off").distinct().join(marks.select(*TP, (F.col("hwm") + 1).alias("next_offset")), TP).where("off >= next_offset")


def commit_through(done: DataFrame, marks: DataFrame) -> DataFrame:
    """Completed offsets that stay in the set once the marks (topic, part, hwm) are committed."""
    return beyond_marks(done, marks).select(*TP, "off")


def commit_payload(done: DataFrame, marks: DataFrame, limit: int | None = 2048) -> DataFrame:
    """topic, part, next_offset and the lowest `limit` completed offsets from there, one a row (off); None for all, as on revocation.

    Ranges of offsets that cannot be among the lowest are left out by their counts, so no partition is one task's.
    """
    kept = beyond_marks(done, marks)
    if limit is not None:
        kept = ranked(kept, TP, "off", "place", below=limit)
    return kept.select(*TP, "next_offset", "off")


def build_assignments(partitions: DataFrame, committed: DataFrame, restored: DataFrame) -> DataFrame:
    """State of newly assigned partitions.

    partitions: topic, part, start, generation. committed: topic, part, next_offset (below 0: none). restored: topic, part, off, completed
    beyond the commit. Returns start, committed, fetched and a generation one higher, so that two assignments never look alike.
    """
    base = partitions.join(committed, TP, "left")
    has = F.coalesce(F.col("next_offset") >= 0, F.lit(False))
    last = F.when(has, F.col("next_offset") - 1).when(F.col("start") > 0, F.col("start") - 1).otherwise(F.lit(-1))
    base = base.select(*TP, F.when(has, F.col("next_offset")).otherwise(F.col("start")).alias("start"), last.cast("long").alias("committed"), (F.col("generation") + 1).alias("generation"))
    top = restored.join(base.select(*TP, "committed"), TP).where("off > committed").groupBy(*TP).agg(F.max("off").alias("top"))
    return base.join(top, TP, "left").select(*TP, "start", "committed", F.greatest(F.col("committed"), F.coalesce("top", "committed")).alias("fetched"), "generation")


def revoke(done: DataFrame, state: DataFrame, revoked: DataFrame) -> DataFrame:
    """Final commits of revoked partitions: topic, part, next_offset, where at least one offset is safe. In-flight work does not hold the mark back."""
    own = state.join(revoked.select(*TP), TP, "left_semi")
    return high_water_mark(done, own).where("hwm >= 0").select(*TP, (F.col("hwm") + 1).alias("next_offset"))


def blocking_ages(observations: DataFrame) -> DataFrame:
    """Age of each gap head at every observation (topic, part, head, tick, at): since it was first seen without a break.

    tick numbers the observations of a partition from 0. A head that was not there at the tick before starts anew.
    """
    runs = observations.withColumn("run", F.col("tick") - F.row_number().over(Window.partitionBy(*TP, "head").orderBy("tick")))
    return runs.withColumn("age", F.col("at") - F.min("at").over(Window.partitionBy(*TP, "head", "run"))).drop("run")
