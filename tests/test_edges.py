"""Empty tables, nulls, ties and repeated rows in the core operators."""

from offsetlake.operators import benchmarks as B
from offsetlake.operators import codec as C
from offsetlake.operators import flow as L
from offsetlake.operators import observability as M
from offsetlake.operators import offsets as O
from offsetlake.operators import ordering as R

OFFS, STATE = "topic string, part int, off long", "topic string, part int, committed long, fetched long"


def test_empty_tables(spark):
    done, state = spark.createDataFrame([], OFFS), spark.createDataFrame([], STATE)
    for found in (O.high_water_mark(done, state), O.gaps(done, state), O.in_flight(done, state), C.final_commits(done, state, state), C.run_lengths(done, O.TP), M.growing(done, O.TP, "off", "off"), M.histogram_samples(done.withColumn("s", done.off / 2), "s", "x")):
        assert found.isEmpty()
    assert B.gate_verdict(spark.createDataFrame([], "status string")).first().verdict == "PASS"
    assert B.text_table(done) == "topic | part | off\n------+------+----"


def test_repeated_offsets_and_null_keys(spark):
    done = spark.createDataFrame([("t", 0, o) for o in (0, 1, 1, 3, 3)], OFFS)
    state = spark.createDataFrame([("t", 0, -1, 5)], STATE)
    assert [(r.gap_start, r.gap_end) for r in O.gaps(done, state).orderBy("gap_start").collect()] == [(2, 2), (4, 5)]
    assert O.high_water_mark(done, state).first().hwm == 1
    assert C.final_commits(done, state, state).first()[2:] == (2, "R3")
    rows = spark.createDataFrame([("t", 0, 0, None), ("t", 0, 1, None), ("t", 0, 2, "a")], OFFS + ", k string")
    assert sorted((r.off, r.queue_pos) for r in R.queue_ranks(rows, "key_hash").collect()) == [(0, 0), (1, 1), (2, 0)]


def test_restore_prefers_the_commit_and_fails_closed(spark):
    rows = [("t", 0, 3, "R2-5", "R9"), ("t", 1, 3, "", "R9"), ("t", 2, 3, None, None), ("t", 3, 3, "R5-", "R9"), ("t", 4, 3, "R1-999999999999999999", None)]
    found = C.restore(spark.createDataFrame(rows, "topic string, part int, committed long, metadata string, partition_metadata string")).collect()
    assert sorted((r.part, r.off) for r in found) == [(0, 4), (0, 5), (1, 9)]


def test_flush_policies_with_equal_times(spark):
    items = spark.createDataFrame([("a", t) for t in (0.0, 0.0, 0.0, 1.0, 9.0)] + [(None, 5.0)], "k string, at double")
    reasons = {p: sorted((r.k or "", r.batch, r.reason) for r in L.timed_batches(items, ["k"], 2, 4.0, p, 0.5).where("reason IS NOT NULL").collect()) for p in ("size_or_timer", "demand", "demand_min_residence")}
    assert reasons["size_or_timer"] == [("", 0, "close"), ("a", 0, "size"), ("a", 1, "size"), ("a", 2, "close")]
    assert reasons["demand"] == [("", 0, "close"), ("a", 0, "demand"), ("a", 1, "demand"), ("a", 2, "demand"), ("a", 3, "timer"), ("a", 4, "close")]
    assert reasons["demand_min_residence"] == [("", 0, "close"), ("a", 0, "size"), ("a", 1, "demand"), ("a", 2, "timer"), ("a", 3, "close")]


def test_growth_starts_anew_after_a_fall(spark):
    m = 60_000_000
    rows = [("c", t * m, v) for t, v in enumerate([5, 1, 2, 3, 4, 5, 6, 6, 6, 6, 6, 6, 6])]
    found = M.growing(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", "v", 5)
    assert sorted((r.at // m, r.value) for r in found.collect()) == [(6, 6), (7, 6), (8, 6), (9, 6), (10, 6)]
