"""Commit metadata: sparse sets of completed offsets as short strings, run-length or bitset coded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offsetlake.operators.offsets import TP, beyond_marks, high_water_mark
from offsetlake.operators.ranges import range_of

#: Longest metadata, the sentinel of a set that does not fit, and the marks of the two codes.
MAX_METADATA = 4000
OVERFLOW, RUNS, BITS = "O", "R", "B"
MAX_DECODED = 1 << 20  # offsets that a decoded text may stand for: a short text can name runs of any width


def run_lengths(offsets: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys, rle: sorted runs as a or a-b, joined by commas; `most` leaves out what follows that many runs.

    Runs are found inside ranges of offsets; a range's first run goes on with the range before where there is no hole between them.
    """
    inside, along = Window.partitionBy(*keys, "range_").orderBy("off"), Window.partitionBy(*keys).orderBy("range_")
    seen = offsets.select(*keys, "off").distinct().withColumn("range_", range_of(F.col("off"))).withColumn("near", F.lag("off").over(inside))
    opens = F.col("near").isNull() | (F.col("off") > F.col("near") + 1)
    per = seen.groupBy(*keys, "range_").agg(F.min("off").alias("first"), F.max("off").alias("last"), F.array_sort(F.collect_list(F.when(opens, F.struct(F.col("off").alias("a"), "near")))).alias("runs"))
    rest = F.slice("runs", 2, F.size("runs"))
    head = F.array(F.struct(F.col("first").alias("a"), F.col("prior").alias("near")))
    per = per.withColumn("prior", F.lag("last").over(along)).withColumn("runs", F.when(F.col("first") == F.col("prior") + 1, rest).otherwise(F.concat(head, rest)))
    if most is not None:
        before = F.coalesce(F.sum(F.size("runs")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.withColumn("runs", F.slice("runs", 1, most)).withColumn("before", before).where(F.col("before") < most)
    parts = F.array_sort(F.collect_list(F.struct("range_", "runs")))
    runs = per.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda x: x.runs)).alias("runs"), F.max("last").alias("top"))
    # A run ends at the offset before the next run's start, the last one at the largest offset.
    ends = F.transform("runs", lambda x, i: F.struct(x.a.alias("a"), F.coalesce(F.get(F.col("runs"), i + 1)["near"], F.col("top")).alias("b")))
    text = F.transform(ends, lambda x: F.when(x.a == x.b, x.a.cast("string")).otherwise(F.concat_ws("-", x.a, x.b)))
    return runs.select(*keys, F.array_join(text, ",").alias("rle"))


def bitset(offsets: DataFrame, keys: list[str], base: str = "base", max_bytes: int = MAX_METADATA) -> DataFrame:
    """keys, base, bits: base:hex, bit i of byte j standing for base + 8j + i; offsets below base are dropped; "" if there are more than max_bytes bytes."""
    place = F.col("off") - F.col(base)
    by_byte = offsets.where(place >= 0).groupBy(*keys, base, F.floor(place / 8).alias("j")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))).alias("v"))
    packed = by_byte.groupBy(*keys, base).agg(F.max("j").alias("top"), F.map_from_entries(F.collect_list(F.when(F.col("j") < max_bytes, F.struct("j", "v")))).alias("m"))
    digits = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("top"), F.lit(max_bytes).cast("long"))), lambda j: F.lower(F.lpad(F.hex(F.coalesce(F.try_element_at("m", j), F.lit(0))), 2, "0")))
    return packed.select(*keys, base, F.when(F.col("top") + 1 <= max_bytes, F.concat(F.col(base).cast("string"), F.lit(":"), F.array_join(digits, ""))).otherwise("").alias("bits"))


def choose(rle: Column, bits: Column, max_size: int = MAX_METADATA) -> Column:
    """The shorter code that fits, run lengths on a tie; the overflow mark if neither fits."""
    r, b = F.concat(F.lit(RUNS), rle), F.concat(F.lit(BITS), bits)
    fits_r, fits_b = F.length(r) <= max_size, (F.length(b) <= max_size) & (bits != "")
    return F.when(~fits_r & ~fits_b, OVERFLOW).when(~fits_b, r).when(~fits_r, b).when(F.length(r) <= F.length(b), r).otherwise(b)


def encode(offsets: DataFrame, keys: list[str], base: str = "base", max_size: int = MAX_METADATA) -> DataFrame:
    """keys, base, metadata of each set. Runs and bytes beyond the budget are not gathered: of more than max_size / 2 runs the first already overflow it."""
    both = run_lengths(offsets, keys, max_size // 2 + 1).join(bitset(offsets, keys, base, max_size), keys)
    return both.select(*keys, base, choose(F.col("rle"), F.col("bits"), max_size).alias("metadata"))


def decode(metadata: Column) -> Column:
    """Sorted array of offsets; anything malformed, or of more than MAX_DECODED offsets, gives an empty array and never an error."""
    none = F.array().cast("array<bigint>")
    body = F.substring(metadata, 2, 1 << 20)
    runs_ok = body.rlike(r"\A[0-9]{1,18}(-[0-9]{1,18})?(,[0-9]{1,18}(-[0-9]{1,18})?)*\z")
    ends = F.transform(F.split(body, ","), lambda p: F.struct(F.split(p, "-")[0].cast("bigint").alias("a"), F.element_at(F.split(p, "-"), -1).cast("bigint").alias("b")))
    held = F.aggregate(ends, F.lit(0.0), lambda n, e: n + F.when(e.a <= e.b, (e.b - e.a).cast("double") + 1).otherwise(0.0))
    runs = F.flatten(F.transform(F.filter(ends, lambda e: (e.a <= e.b) & (held <= MAX_DECODED)), lambda e: F.sequence(e.a, e.b)))
    bits_ok = body.rlike(r"\A[0-9]{1,18}:([0-9a-fA-F]{2})*\z")
    start = F.split(body, ":")[0].cast("bigint")
    pairs = F.regexp_extract_all(F.split(body, ":")[1], F.lit("(..)"), F.lit(1))
    listed = F.flatten(F.transform(pairs, lambda h, j: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.conv(h, 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0, start + j.cast("bigint") * 8 + i.cast("bigint"))), lambda x: x.isNotNull())))
    kind = F.substring(metadata, 1, 1)
    return F.when((kind == RUNS) & runs_ok, F.array_sort(F.array_distinct(runs))).when((kind == BITS) & bits_ok, listed).otherwise(none)


def restore(commits: DataFrame) -> DataFrame:
    """topic, part, off: the finished offsets beyond the commit that its metadata tells, else the partition's own metadata (partition_metadata), else none.

    commits: topic, part, committed, metadata, partition_metadata. Empty text counts as none; malformed text gives no offsets.
    """
    text = F.coalesce(F.nullif(F.col("metadata"), F.lit("")), F.nullif(F.col("partition_metadata"), F.lit("")))
    return commits.select(*TP, "committed", F.explode(decode(text)).alias("off")).where("off > committed").select(*TP, "off")


def final_commits(done: DataFrame, state: DataFrame, revoked: DataFrame, max_size: int = MAX_METADATA) -> DataFrame:
    """topic, part, next_offset, metadata of revoked partitions with at least one safe offset; no runs (R) where nothing is finished beyond the mark."""
    own = state.join(revoked.select(*TP), TP, "left_semi")
    marks = high_water_mark(done, own).where("hwm >= 0")
    beyond = beyond_marks(done, marks).withColumnRenamed("next_offset", "base")
    return marks.select(*TP, (F.col("hwm") + 1).alias("next_offset")).join(encode(beyond, TP, max_size=max_size).select(*TP, "metadata"), TP, "left").withColumn("metadata", F.coalesce("metadata", F.lit(RUNS)))
