import random
import time

from pyspark.sql import functions as F

from offsetlake.operators import benchmarks as B
from offsetlake.operators import failures as D
from offsetlake.operators import flow as L


def test_limits():
    up = L.ConcurrencyLimit(128, 32, 16, 24)
    assert up.evaluate(0, 64, 64, 0, 256, False) == 80
    assert L.ConcurrencyLimit(128, 32, 16, 24).evaluate(0, 80, 70, 20, 0, True) == 56
    slow = L.ConcurrencyLimit(128, 32, 16, 24, cooldown=5)
    assert slow.evaluate(10, 64, 64, 0, 256, False) == 80 and slow.evaluate(12, 80, 80, 0, 256, False) is None
    assert L.ConcurrencyLimit(128, 0, down=64).evaluate(0, 40, 0, 0, 0, True) == 32
    b = L.BackpressureLimit(100, 40, down=15, cooldown=0, high_s=0.075)
    assert b.evaluate(0, 100, 0, 0, False, 0.08) == (85, "scale_down") and b.evaluate(1, 85, 0, 0, True, None) == (70, "scale_down")
    b = L.BackpressureLimit(120, up=20, cooldown=0, lag_threshold=200)
    assert b.evaluate(0, 60, 0, 250, False, 0.015)[0] == 80 and b.evaluate(1, 80, 0, 250, False, 0.01)[0] == 100


def test_hysteresis_against_a_fold(spark):
    rng = random.Random(1)
    loads = [(0, t, rng.randrange(0, 140), rng.randrange(0, 9)) for t in range(300)]
    got = L.hysteresis(spark.createDataFrame(loads, "c int, t int, in_flight int, queued int"), ["c"], "t", 100, 8).orderBy("t").collect()
    paused = False
    for (_, _, f, q), r in zip(loads, got):
        if not paused:
            paused = f + q > 100 or q >= 8
        elif f + q < 70 and q <= 5:
            paused = False
        assert r.paused == paused


def test_circuit_slides():
    c = D.Circuit(2, 10, 3)
    assert c.step(0, False, 1) == (False, False)  # not the last attempt
    assert c.step(1, False, 3) == (False, False)
    assert c.step(2, False, 3) == (False, True)
    assert c.step(11, True, 1) == (True, True)  # forced, which extends the cooldown
    assert c.step(20, True, 1) == (True, True)
    assert c.step(30, True, 1) == (False, False)


def test_poison_fold_matches(spark):
    rng = random.Random(5)
    rows = [("t", 0, str(rng.randrange(3)), i, float(i), rng.random() > 0.6, rng.choice([1, 3])) for i in range(200)]
    out = D.poison_circuit(spark.createDataFrame(rows, "topic string, part int, poison_key string, seq long, at double, ok boolean, attempt int"), 2, 7.0).collect()
    circuits, want = {}, {}
    for _, _, k, i, at, ok, attempt in rows:
        want[i] = circuits.setdefault(k, D.Circuit(2, 7.0)).step(at, ok, attempt)
    assert {r.seq: (r.forced, r.open_after) for r in out} == want


def test_cache_against_a_queue(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(0, 40) for _ in range(200)]
    cache, total = [], 0
    for i, s in enumerate(sizes):
        if s <= 30:
            cache.append((i, s))
            total += s
            while total > 30:
                total -= cache.pop(0)[1]
    got = D.cache_survivors(spark.createDataFrame([("t", 0, i, s) for i, s in enumerate(sizes)], "topic string, part int, seq long, size long"), 30)
    assert {r.seq for r in got.collect() if r["size"]} == {i for i, s in cache if s}


def test_cache_takes_time_linear_in_a_range(spark):
    """A range's rows are summed once: with a sum that starts anew at every row, 60,000 rows of one range are 1.8 billion steps."""
    sizes = [i * 7 % 31 for i in range(60_000)]
    want, total = set(), 0
    for i in reversed(range(len(sizes))):
        total += sizes[i]
        if total > 500_000:
            break
        want.add(i)
    entries = spark.range(len(sizes)).select(F.lit("t").alias("topic"), F.lit(0).alias("part"), F.col("id").alias("seq"), (F.col("id") * 7 % 31).alias("size"))
    start = time.monotonic()
    assert {r.seq for r in D.cache_survivors(entries, 500_000).select("seq").collect()} == want
    assert time.monotonic() - start < 30


def test_caches_by_scope(spark):
    rows = [("t", i % 2, i, 10) for i in range(20)]
    entries = spark.createDataFrame(rows, "topic string, part int, seq long, size long")
    assert {r.seq for r in D.cache_survivors(entries, 30).collect()} == {17, 18, 19}
    assert {r.seq for r in D.cache_survivors(entries, 30, scope=("topic", "part")).collect()} == set(range(14, 20))


def test_null_keys_are_one_key(spark):
    rows = [(None, i, float(i)) for i in range(4)] + [(1, i, 8.0) for i in range(3)]
    got = L.latency_average(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], ["t"], "v").orderBy("k", "t").collect()
    assert [round(r.average, 6) for r in got] == [0.0, 0.2, 0.56, 1.048, 8.0, 8.0, 8.0]
    calm = [(None, float(t), 64, 0, 256, False) for t in range(3)]
    limits = L.adaptive_concurrency(spark.createDataFrame(calm, "k int, at double, in_flight long, queued long, lag long, paused boolean"), ["k"], 128, 64, up=16).orderBy("at").collect()
    assert [r.limit_after for r in limits] == [80, 96, 112]
    first = L.latency_average(spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None)], "k int, t int, v double"), ["k"], ["t"], "v").orderBy("t").collect()
    assert [r.average for r in first] == [None, 2.0, 2.0]


def test_verdict_needs_conditions_and_gaps(spark):
    good = spark.createDataFrame([("PASS",)], "status string")
    options = spark.createDataFrame([("a", 10000, 8, ["on"], None, False), ("b", 10000, 8, ["on", "off"], True, None), ("c", None, 8, None, None, None)], "artifact string, num_messages long, num_partitions long, strict array<string>, profile boolean, py_spy boolean")
    broken = B.measurement_conditions(options)
    assert sorted((r.artifact, r.reason) for r in broken.collect()) == [("b", "profiling"), ("b", "strict"), ("c", "num_messages"), ("c", "strict")]
    seen = [("a", 0, "x", 0.0, 1), ("a", 1, "x", 61.0, 1), ("b", 0, "x", 0.0, 1), ("b", 1, "y", 61.0, 1), ("b", 2, "y", 62.0, 0), ("b", 3, "y", 130.0, 2), ("c", 0, "x", 0.0, 1), ("c", 1, "x", 60.0, 1)]
    held = B.persistent_gaps(spark.createDataFrame(seen, "artifact string, seq int, run string, elapsed_sec double, gap_count int"))
    assert [r.artifact for r in held.collect()] == ["a"]
    assert tuple(B.gate_verdict(good).first()) == ("PASS", 0)
    assert tuple(B.gate_verdict(good, broken).first()) == ("NO-GO", 4) and tuple(B.gate_verdict(good, held).first()) == ("NO-GO", 1)
    assert tuple(B.gate_verdict(good.limit(0)).first()) == ("PASS", 0)


def test_window_tps(spark):
    rows = [("r", i, t * 1_000_000) for i, t in enumerate([1] * 100 + [3] * 100 + [4] * 100)]
    runs = spark.createDataFrame(rows, "run string, seq long, us long")
    start = spark.createDataFrame([("r", 0)], "run string, start_us long")
    r = B.window_tps_summary(B.window_tps(runs, start=start)).first()
    assert (r.tps_min, r.tps_p10, r.tps_p50) == (50, 60, 100)
    assert B.window_tps(runs.where("seq < 99"), start=start).count() == 0


def test_timed_batches(spark):
    rows = [(0, t) for t in (0.0, 0.1, 0.2, 5.0, 5.1, 20.0)]
    got = L.timed_batches(spark.createDataFrame(rows, "part int, at double"), ["part"], 3, 1.0).orderBy("at").collect()
    assert [(r.batch, r.reason) for r in got] == [(0, None), (0, None), (0, "size"), (1, None), (1, "timer"), (2, "close")]
