"""Ranks and neighbours along a long sequence without one task for the sequence.

Rows are cut by ranges of their order column. A window runs inside a range only; what lies before it is one number for each range, summed up over the
short table of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets (or ids) of a range.
RANGE = 100_000


def range_of(order: Column, size: int = RANGE) -> Column:
    return F.floor(order / F.lit(size)).cast("long")


def ranked(rows: DataFrame, keys: list[str], order: str, name: str, size: int = RANGE, below: int | None = None) -> DataFrame:
    """Adds `name`: the place of a row among those of its keys by `order` (an integer column, distinct within the keys), from 0.

    below keeps the rows with a place below it; ranges that cannot have one are left out before the rows are sorted.
    """
    cut = rows.withColumn("range_", range_of(F.col(order), size))
    per = cut.groupBy(*keys, "range_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("range_").alias("at_"), before.alias("before_"))
    if below is not None:
        per = per.where(F.col("before_") < below)
    same = F.col("range_") == F.col("at_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    inside = F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(order)) - 1
    out = cut.join(per, same).withColumn("inside_", inside).withColumn(name, (F.col("before_") + F.col("inside_")).cast("long")).select(*rows.columns, name)
    return out if below is None else out.where(F.col(name) < below)


def previous(rows: DataFrame, keys: list[str], order: str, name: str, size: int = RANGE) -> DataFrame:
    """Adds `name`: the order value before a row's within its keys (not null), or null for the first."""
    cut = rows.withColumn("range_", range_of(F.col(order), size))
    last = cut.groupBy(*keys, "range_").agg(F.max(order).alias("last_")).withColumn("before_", F.lag("last_").over(Window.partitionBy(*keys).orderBy("range_"))).drop("last_")
    near = F.lag(order).over(Window.partitionBy(*keys, "range_").orderBy(order))
    return cut.withColumn("near_", near).join(last, [*keys, "range_"]).withColumn(name, F.coalesce("near_", "before_")).select(*rows.columns, name)


def run_end(rows: DataFrame, keys: list[str], place: str, size: int = RANGE) -> DataFrame:
    """keys, run: how many of the places 0, 1, 2 ... (distinct, integer) are there without a hole from 0. Keys without place 0 have no row.

    Ranges that are full count as a whole; only the first one that is not is looked at by rows.
    """
    cut = rows.select(*keys, place).where(F.col(place) >= 0).withColumn("range_", range_of(F.col(place), size))
    per = cut.groupBy(*keys, "range_").agg(F.count("*").alias("n_"))
    full = per.where(F.col("n_") == size).withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy("range_")) - 1)
    whole = full.where(F.col("range_") == F.col("rank_")).groupBy(*keys).agg(F.count("*").alias("whole_"))
    every = per.select(*keys).distinct().join(whole, keys, "left").withColumn("range_", F.coalesce("whole_", F.lit(0)))
    rest = cut.join(every, [*keys, "range_"])
    rank = F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(place)) - 1
    inner = rest.withColumn("rank_", rank).where(F.col(place) == F.col("range_") * size + F.col("rank_")).groupBy(*keys).agg(F.count("*").alias("part_"))
    out = every.join(inner, keys, "left").withColumn("run", F.col("range_") * size + F.coalesce("part_", F.lit(0)))
    return out.where("run > 0").select(*keys, "run")
