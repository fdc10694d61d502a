"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A key is hot if it has more rows than this and than a 1 / MOST_HOT part of all, so there are fewer than MOST_HOT hot keys.
LEAST_ROWS, MOST_HOT = 256, 4096


@dataclass(frozen=True)
class Hot:
    """Hot keys of a table: rows (key columns, n) and the number of rows that one salted part should hold."""

    keys: tuple[str, ...]
    rows: list[Row]
    limit: int


def hot_keys(counts: DataFrame, *keys: str) -> Hot:
    """The hot keys by counts (keys, n), one row a key. At most MOST_HOT rows come to the driver, whatever the table's size."""
    found = counts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    limit = max(LEAST_ROWS, -(-(found["all"] or 0) // MOST_HOT))
    rows = counts.where(F.col("n") > limit).select(*keys, "n").collect() if (found["most"] or 0) > limit else []
    return Hot(keys, rows, limit)


def hot_join(many: DataFrame, few: DataFrame, keys: list[str], hot: Hot, how: str = "inner") -> DataFrame:
    """many.join(few, keys, how) for how inner or left, where `hot` has the hot keys of `many` (by some or all of the join's keys).

    Rows of a hot key are split into salted parts of about hot.limit rows by a hash of their columns, and each part meets its own copy of the
    key's rows of `few`. The list of hot keys is broadcast; its size is bounded by MOST_HOT. Without hot keys it is the plain join.
    """
    if not hot.rows:
        return many.join(few, keys, how)
    fields = [many.schema[k].dataType for k in hot.keys]
    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in zip(hot.keys, fields, strict=True)) + ", parts_ int"
    parts = F.broadcast(many.sparkSession.createDataFrame([(*[r[k] for k in hot.keys], -(-r["n"] // hot.limit)) for r in hot.rows], schema))
    count = F.coalesce("parts_", F.lit(1))
    split = many.withColumn("part_", F.xxhash64(*many.columns)).join(parts, list(hot.keys), "left").withColumn("part_", F.pmod("part_", count).cast("int")).drop("parts_")
    copies = few.join(parts, list(hot.keys), "left").withColumn("part_", F.explode(F.sequence(F.lit(0), count - 1))).drop("parts_")
    return split.join(copies, [*keys, "part_"], how).drop("part_")
