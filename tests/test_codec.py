import random

import pytest
from pyspark.sql import functions as F

from offsetlake.operators import codec as C
from offsetlake.operators import ranges


def table(spark, offsets, base=0):
    return spark.createDataFrame([("t", o, base) for o in offsets], "k string, off long, base long")


@pytest.mark.parametrize("offsets,expected", [({0}, "0"), ({0, 1, 2, 3}, "0-3"), ({0, 2, 3, 5, 6, 7}, "0,2-3,5-7"), ({10, 11, 13, 15}, "10-11,13,15")])
def test_run_lengths(spark, offsets, expected):
    assert C.run_lengths(table(spark, offsets), ["k"]).first().rle == expected


@pytest.mark.parametrize("offsets,base,expected", [({0}, 0, "0:01"), ({5}, 0, "0:20"), ({0, 1, 2, 3}, 0, "0:0f"), ({0, 2, 3, 5}, 0, "0:2d"), ({10, 11, 13, 15}, 10, "10:2b"), ({0, 20}, 0, "0:010010")])
def test_bitset(spark, offsets, base, expected):
    assert C.bitset(table(spark, offsets, base), ["k"]).first().bits == expected


def test_choice(spark):
    assert C.encode(table(spark, range(4)), ["k"]).first().metadata == "R0-3"
    assert C.encode(table(spark, [0, 5, 10]), ["k"]).first().metadata == "R0,5,10"
    assert C.encode(table(spark, [1, 2, 3, 5], 1), ["k"]).first().metadata.startswith("B1:")
    assert C.encode(table(spark, range(500)), ["k"], max_size=5).first().metadata == "O"


def test_budget(spark):
    """Only what the budget can hold is gathered; texts of just the budget's length still fit."""
    assert C.encode(table(spark, [0, 2, 4]), ["k"], max_size=6).first().metadata == "B0:15"
    assert [C.encode(table(spark, [0, 200, 400]), ["k"], max_size=n).first().metadata for n in (10, 9)] == ["R0,200,400", "O"]
    assert C.encode(table(spark, [0, 2, 4, 40]), ["k"], max_size=7).first().metadata == "O"
    assert C.encode(table(spark, range(0, 4000, 2)), ["k"], max_size=300).first().metadata == "O"
    assert C.encode(table(spark, [0, 1, 2, 3, 900]), ["k"], max_size=8).first().metadata == "R0-3,900"
    assert C.bitset(table(spark, [0, 9, 900]), ["k"], max_bytes=2).first().bits == ""
    assert C.run_lengths(table(spark, range(0, 100, 2)), ["k"]).first().rle == ",".join(str(o) for o in range(0, 100, 2))


def test_runs_over_ranges(spark, monkeypatch):
    """Runs that cross ranges of offsets, and ranges without offsets, against a fold."""
    rng = random.Random(5)
    monkeypatch.setattr(C, "range_of", lambda order: ranges.range_of(order, 4))
    for size in (12, 30, 60):
        offsets = sorted(rng.sample(range(70), size))
        runs = []
        for o in offsets:
            if runs and runs[-1][1] == o - 1:
                runs[-1][1] = o
            else:
                runs.append([o, o])
        text = ",".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)
        assert C.run_lengths(table(spark, offsets), ["k"]).first().rle == text
        assert C.run_lengths(table(spark, offsets), ["k"], len(runs) + 1).first().rle == text
        short = C.run_lengths(table(spark, offsets), ["k"], 3).first().rle
        assert short.split(",")[:2] == text.split(",")[:2] and len(short) >= 5


def test_decode(spark):
    rows = ["R0-3", "R0,5,10", "B10:2b", "O", "X10:110101", "Rbad-range", "Bnotint:zz", "", "R", None]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, m string").select("i", C.decode(F.col("m")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [[0, 1, 2, 3], [0, 5, 10], [10, 11, 13, 15], [], [], [], [], [], [], []]


def test_decode_fails_closed_on_wide_runs(spark):
    rows = ["R1-999999999999999999", "R0-3000000000", "R0-1048576", "R0-600000,700000-1300000", "R5-1", "R0-9,3-4", "R0-999999999999999999,1-2"]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, m string").select("i", C.decode(F.col("m")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [[], [], [], [], [], list(range(10)), []]
    assert spark.createDataFrame([("R0-1048575",)], "m string").select(F.size(C.decode(F.col("m"))).alias("n")).first().n == 1 << 20
