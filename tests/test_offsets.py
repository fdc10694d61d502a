import random

import pytest
from pyspark.sql import functions as F

from offsetlake.operators import offsets as O

T = "topic string, part int, "


def frames(spark, committed, fetched, done):
    state = spark.createDataFrame([("t", 0, committed, fetched)], T + "committed long, fetched long")
    return spark.createDataFrame([("t", 0, o) for o in done], T + "off long"), state


def gaps(spark, *a):
    return sorted((r.gap_start, r.gap_end) for r in O.gaps(*frames(spark, *a)).collect())


@pytest.mark.parametrize(
    "fetched,done,expected",
    [(5, {0, 2}, [(1, 1), (3, 5)]), (10, {0, 2, 3, 5, 8}, [(1, 1), (4, 4), (6, 7), (9, 10)]), (5, set(), [(0, 5)]), (10, {1, 3, 4}, [(0, 0), (2, 2), (5, 10)]), (-1, set(), [])],
)
def test_gaps(spark, fetched, done, expected):
    assert gaps(spark, -1, fetched, done) == expected


def test_high_water_mark(spark):
    assert O.high_water_mark(*frames(spark, -1, 3, {0, 1, 3})).first().hwm == 1
    assert O.high_water_mark(*frames(spark, 4, 9, {5, 6, 8})).first().hwm == 6
    low = spark.createDataFrame([("t", 0, 2)], T + "off long")
    assert O.high_water_mark(*frames(spark, -1, 2, {0, 1, 2}), low).first().hwm == 1


def test_random_against_a_fold(spark):
    rng = random.Random(3)
    for _ in range(4):
        committed, fetched = rng.randrange(-1, 5), rng.randrange(0, 40)
        done = {rng.randrange(0, 45) for _ in range(rng.randrange(0, 40))}
        hwm = committed
        while hwm + 1 in done:
            hwm += 1
        open_, run = [o for o in range(committed + 1, fetched + 1) if o not in done], []
        for o in open_:
            if run and run[-1][1] == o - 1:
                run[-1] = (run[-1][0], o)
            else:
                run.append((o, o))
        assert gaps(spark, committed, fetched, done) == run
        assert O.high_water_mark(*frames(spark, committed, fetched, done)).first().hwm == hwm
        one = O.progress(*frames(spark, committed, fetched, done)).first()
        assert (one.hwm, one.gap_count, one.blocking) == (hwm, len(run), run[0][0] if run else None)


def test_payload_keeps_the_lowest(spark):
    done, state = frames(spark, -1, 99, {0, *range(5, 90, 3)})
    got = O.commit_payload(done, O.high_water_mark(done, state), 7).orderBy("off").collect()
    assert [(r.next_offset, r.off) for r in got] == [(1, o) for o in range(5, 26, 3)]
    plan = O.commit_payload(done, O.high_water_mark(done, state))._jdf.queryExecution().optimizedPlan().toString()
    assert all("range_" in line for line in plan.splitlines() if "row_number() windowspecdefinition" in line and "off#" in line)


def test_blocking_ages(spark):
    seen = [("t", 0, 1, 0, 1000), ("t", 0, 3, 0, 1000), ("t", 0, 1, 1, 1010), ("t", 0, 3, 1, 1010), ("t", 0, 3, 2, 1015)]
    ages = O.blocking_ages(spark.createDataFrame(seen, T + "head long, tick long, at long")).where("tick > 0").orderBy("tick", "head")
    assert [(r.head, r.age) for r in ages.collect()] == [(1, 10), (3, 10), (3, 15)]


def test_generation_grows(spark):
    parts = spark.createDataFrame([("t", 0, 7, 1), ("t", 1, 0, 4)], T + "start long, generation long")
    comm = spark.createDataFrame([("t", 0, 5)], T + "next_offset long")
    done = spark.createDataFrame([("t", 0, 9)], T + "off long")
    got = {r.part: (r.start, r.committed, r.fetched, r.generation) for r in O.build_assignments(parts, comm, done).collect()}
    assert got == {0: (5, 4, 9, 2), 1: (0, -1, -1, 5)}


def test_ranges_against_folds(spark, monkeypatch):
    """Ranges of a few offsets: the same marks, gaps, offsets in flight and ranks as by plain folds, null keys included."""
    from offsetlake.operators import ranges

    rng = random.Random(8)
    for size in (1, 3, 10):
        for run in (0, 1, 4, 9, 30):
            committed = rng.randrange(-1, 6)
            done = {committed + 1 + k for k in range(run)} | {committed + run + 2 + rng.randrange(40) for _ in range(12)}
            frame, state = frames(spark, committed, committed + 35, done)
            place = frame.withColumn("place", F.col("off") - committed - 1)
            found = ranges.run_end(place, O.TP, "place", size).collect()
            assert [r.run for r in found] == ([run] if run else [])
        near = ranges.previous(frame.distinct(), O.TP, "off", "before", size).orderBy("off").collect()
        assert [r.before for r in near] == [None, *sorted(done)[:-1]]
        flying = sorted(r.off for r in O.in_flight(frame, state).collect())
        assert flying == sorted(set(range(committed + 1, committed + 36)) ^ done)
        rows = [(rng.choice(["a", "b", None]), o) for o in rng.sample(range(200), 60)]
        ranked = ranges.ranked(spark.createDataFrame(rows, "k string, off long"), ["k"], "off", "rank", size).collect()
        places = sorted((str(k), o, sum(p < o for j, p in rows if j == k)) for k, o in rows)
        assert sorted((str(r.k), r.off, r["rank"]) for r in ranked) == places
        lowest = ranges.ranked(spark.createDataFrame(rows, "k string, off long"), ["k"], "off", "rank", size, below=9).collect()
        assert sorted((str(r.k), r.off, r["rank"]) for r in lowest) == [p for p in places if p[2] < 9]
    plan = O.high_water_mark(frame, state)._jdf.queryExecution().optimizedPlan().toString() + O.gaps(frame, state)._jdf.queryExecution().optimizedPlan().toString()
    assert "range_" in plan


def test_in_flight_of_wide_gaps(spark):
    frame, state = frames(spark, -1, 25_000, {3, 30_000})
    assert O.in_flight(frame, state).count() == 25_001 - 1 + 1
    assert O.in_flight(*frames(spark, 9, 4, {10, 12})).count() == 2
