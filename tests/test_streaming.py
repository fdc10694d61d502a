import json
import random

import pytest
from pyspark.sql import functions as F

from offsetlake.__main__ import main
from offsetlake.options import ExecutionOptions, LogOptions
from offsetlake.sources.artifacts import read_results, write_results
from offsetlake.sources.log_source import OffsetLogSource
from offsetlake.streaming.tracker import advance, commit_sink, committed_offsets, track
from offsetlake.streaming.worker import run_async, run_sync


def test_advance_against_sets():
    rng, committed, runs, done = random.Random(4), -1, [], set()
    for _ in range(200):
        batch = [rng.randrange(0, 300) for _ in range(rng.randrange(0, 6))]
        done |= set(batch)
        committed, runs = advance(committed, runs, batch)
        mark = -1
        while mark + 1 in done:
            mark += 1
        assert committed == mark and sum(b - a + 1 for a, b in runs) == len([o for o in done if o > mark])


def test_stream_commits(spark, tmp_path):
    spark.dataSource.register(OffsetLogSource)
    log = spark.readStream.format("offsetlog").options(messages="400", keys="7", partitions="4", batch="100").load()
    events = log.select("topic", F.col("partition").alias("part"), F.col("offset").alias("off")).where("NOT (part = 2 AND off = 50)")
    query = track(events).writeStream.foreachBatch(commit_sink(str(tmp_path / "commits"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.part: r.next_offset for r in committed_offsets(spark, str(tmp_path / "commits")).collect()}
    assert got == {0: 100, 1: 100, 2: 50, 3: 100}


def test_workers(spark):
    records = spark.createDataFrame([("t", 0, i, f"k{i % 3}", "v") for i in range(12)], "topic string, part int, off long, k string, v string")
    quick = ExecutionOptions(max_retries=2, retry_backoff_ms=0, task_timeout_ms=1000)

    def sync(row):
        if row.off == 5:
            raise ValueError("bad")

    async def later(row):
        if row.off == 7:
            raise ValueError("worse")

    a = {r.off: (r.status, r.error, r.attempt) for r in run_sync(records, sync, options=quick).collect()}
    b = {r.off: (r.status, r.error, r.attempt) for r in run_async(records, later, options=quick).collect()}
    assert a[5] == ("failure", "bad", 2) and b[7] == ("failure", "worse", 2)
    assert sum(s == "success" for s, _, _ in a.values()) == sum(s == "success" for s, _, _ in b.values()) == 11
    with pytest.raises(TypeError):
        run_async(records, sync)
    with pytest.raises(TypeError):
        run_sync(records, later)


def test_a_timeout_is_final(spark):
    import time

    records = spark.createDataFrame([("t", 0, i, "k", "v") for i in range(3)], "topic string, part int, off long, k string, v string").coalesce(1)

    def slow(row):
        if row.off == 1:
            time.sleep(30)

    out = {r.off: (r.status, r.error, r.attempt) for r in run_sync(records, slow, "partition", ExecutionOptions(max_retries=3, retry_backoff_ms=0, task_timeout_ms=200)).collect()}
    assert out[0][0] == out[2][0] == "success" and out[1] == ("failure", "task_timeout after 0.2s", 1)


def test_commits_keep_the_latest_state(spark, tmp_path):
    write, path = commit_sink(str(tmp_path / "c")), str(tmp_path / "c")
    for batch, rows in enumerate([[("t", 0, 4), ("t", 1, 9)], [("t", 0, 7)], [("t", 1, 3), ("t", 2, 0)]]):
        for _ in range(2):  # a batch may run again
            write(spark.createDataFrame(rows, "topic string, part int, committed long"), batch)
    assert {r.part: r.next_offset for r in committed_offsets(spark, path).collect()} == {0: 8, 1: 10, 2: 1}
    assert len([f for f in (tmp_path / "c").iterdir() if f.name.startswith("batch=")]) == 2


def test_artifacts(spark, tmp_path):
    rows = [("a", "async", "sleep", "key_hash", 0, 10, 5.0, 1.0, 0, 0, [(1.0, 2, 1)]), ("b", "process", "io", "partition", 1, 20, 6.0, 2.0, 0, 0, None)]
    results = spark.createDataFrame(rows, "run string, mode string, workload string, ordering string, seq long, messages long, tps double, p99_ms double, final_lag long, final_gaps long, observations array<struct<elapsed_sec: double, lag: long, gap_count: long>>")
    write_results(results, str(tmp_path / "r"), {"x": "1"})
    back = read_results(spark, str(tmp_path / "r"))
    assert sorted((r.run, r.tps) for r in back.collect()) == [("a", 5.0), ("b", 6.0)]


def test_report_of_an_artifact(spark, tmp_path, capsys):
    rows = [("a", "baseline", "io", "key_hash", 0, 10, 5.0, 1.0, 0, 0, [(1.0, 2, 1)]), ("b", "async", "io", "key_hash", 1, 20, 15.0, 2.0, 0, 0, None)]
    results = spark.createDataFrame(rows, "run string, mode string, workload string, ordering string, seq long, messages long, tps double, p99_ms double, final_lag long, final_gaps long, observations array<struct<elapsed_sec: double, lag: long, gap_count: long>>")
    write_results(results, str(tmp_path / "r"), {})
    whole = json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("part-*")))
    assert [(x["mode"], x["ratio"]) for x in whole["performance_improvements"]] == [("async", 3.0)] and [x["run"] for x in whole["metrics_observations"]] == ["a"]
    assert main(["report", str(tmp_path / "r")]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("run | mode     | workload") and lines[2].startswith("a   | baseline | io") and lines[-1].startswith("io       | key_hash | async | 5.0")
    assert main(["queries"]) == 0 and "gap_ranges: " in capsys.readouterr().out


def test_options():
    o = LogOptions("t", "a:1, b:2", start="none", security={"sasl_password": "x", "security_protocol": "SSL"})
    assert o.bootstrap == "a:1,b:2" and o.source({0: 7, 1: 0})["kafka.sasl.password"] == "x" and "kafka.sasl.password" not in o.public()
    assert o.source({1: 0, 0: 7})["startingOffsets"] == '{"t": {"0": 7, "1": 0}}' and LogOptions("t").source()["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        o.source()
    for bad in ({"topic": "a b"}, {"topic": "t", "ordering": "x"}, {"topic": "t\n"}):
        with pytest.raises(ValueError):
            LogOptions(**bad)
    with pytest.raises(ValueError):
        ExecutionOptions(max_retries=0)
