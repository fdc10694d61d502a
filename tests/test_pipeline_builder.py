import random

import pytest
from pyspark.sql import functions as F

from offsetlake.options import ExecutionOptions, LogOptions
from offsetlake.sources.log_source import OffsetLogSource
from offsetlake.streaming.pipeline import LogPipeline, advanced

QUICK = ExecutionOptions(max_retries=2, retry_backoff_ms=0, task_timeout_ms=5000)


def test_advanced_against_sets(spark):
    rng, done, state = random.Random(3), set(), spark.createDataFrame([], "topic string, part int, next_offset long, runs array<struct<a: long, b: long>>")
    for turn in range(4):
        offs = [5] * (turn == 0) + [rng.randrange(6, 60) for _ in range(18)]
        seen = spark.createDataFrame([("t", 0, o) for o in offs], "topic string, part int, off long")
        done |= set(offs) - {7}
        out = advanced(state, seen, seen.where("off <> 7")).collect()[0]
        mark = 5
        while mark in done:
            mark += 1
        assert out.next_offset == mark and sorted(o for r in out.runs for o in range(r.a, r.b + 1)) == sorted(o for o in done if o > mark)
        state = spark.createDataFrame([out], state.schema)


def source(spark, messages):
    spark.dataSource.register(OffsetLogSource)
    return spark.readStream.format("offsetlog").options(messages=str(messages), keys="5", partitions="2", batch="20").load()


def worker():
    """A function of no module, so that executors need not import this file."""

    def work(row):
        if row.off in (3, 12):
            raise ValueError(f"bad {row.off}")

    return work


def test_stream_to_commits_and_dead_letters(spark, tmp_path):
    sent, down = [], [True]

    def publish(letters):
        if down[0]:
            raise OSError("broker away")
        sent.extend((r.part, r.off, r.x_error_reason, r.epoch_header) for r in letters.collect())

    p = LogPipeline(LogOptions("bench", execution=QUICK), worker(), str(tmp_path / "p"), publish, publish_tries=2)
    with pytest.raises(RuntimeError):
        p.start(source(spark, 40))
        p.start(source(spark, 40))
    assert p.drain(120) and p.stop(deadline_s=60)
    # no letter is out, so neither failed offset is committed, and all other offsets are kept beyond the mark
    assert {r.part: (r.next_offset, [(x.a, x.b) for x in r.runs]) for r in p.commits(spark).collect()} == {0: (3, [(4, 11), (13, 19)]), 1: (3, [(4, 11), (13, 19)])}
    down[0] = False
    p.start(source(spark, 60))
    assert p.drain(120) and p.stop(deadline_s=60) and p.failure() is None
    assert {r.part: (r.next_offset, r.runs) for r in p.commits(spark).collect()} == {0: (30, []), 1: (30, [])}
    assert sorted(sent) == [(part, off, f"bad {off}", "1") for part in (0, 1) for off in (3, 12)]
    p.reset(spark)
    assert p.commits(spark).isEmpty() and not (tmp_path / "p").exists()


def test_an_older_generation_does_not_commit(spark, tmp_path):
    old = LogPipeline(LogOptions("bench", execution=QUICK), worker(), str(tmp_path / "p"))
    new = LogPipeline(LogOptions("bench", execution=QUICK), worker(), str(tmp_path / "p"))
    old.start(source(spark, 20), availableNow=True)
    assert old.drain(120)
    new.start(source(spark, 20), availableNow=True)
    assert new.drain(120)
    batch = spark.createDataFrame([("bench", 0, 50, b"k", b"v")], "topic string, partition int, offset long, key binary, value binary")
    with pytest.raises(RuntimeError, match="generation 1"):
        old.process(batch, 9)
    new.process(batch, 9)
    assert {r.part: (r.next_offset, [(x.a, x.b) for x in r.runs]) for r in new.commits(spark).collect()} == {0: (10, [(50, 50)]), 1: (10, [])}
