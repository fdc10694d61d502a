"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offsetlake.llm.scratch import fresh


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int | None = None) -> DataFrame:
    """All columns, then shard and slot: row counts of shards differ by one at most, and each shard has the sources' mixture.

    Rows are shuffled by a seeded hash and ranked within their source; all rows are sorted by the fractional rank (rank + 1/2) / rows of the source;
    that order is cut into `shards` runs of equal length. Slots count from 0 in each shard, along that order.

    No rank needs one task for a source or the table: rows are ranked inside buckets of the hash (then of the fractional rank), and the counts of
    the buckets before are added. Only (source, bucket) counts are summed up in order: `buckets` rows a source, by default one for
    every 50,000 rows and 256 at least.

    Defined results: a null source is a source of its own; null ids and texts are placed like others; equal rows get different slots, and which
    of them gets which does not matter; sources with fewer rows than shards lie in some shards only; an empty table gives no rows. The added columns get
    underscores where docs has their names, and are always the last two.
    """
    buckets = buckets or max(256, docs.count() // 50_000)
    taken = list(docs.columns)
    names = {}
    for n in ("stratum", "key", "bucket", "rank", "before", "rows", "part", "slot_of", "all", "shard", "slot"):
        names[n] = fresh(n, taken)
        taken.append(names[n])
    c = {k: F.col(v) for k, v in names.items()}
    keyed = docs.withColumns({names["stratum"]: F.xxhash64(F.lit(seed), F.col(source_col)), names["key"]: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))})
    keyed = keyed.withColumn(names["bucket"], F.pmod(F.shiftrightunsigned(c["key"], 32), F.lit(buckets)))
    narrow = keyed.groupBy(names["stratum"], names["bucket"]).agg(F.count("*").alias(names["part"]))
    along = Window.partitionBy(names["stratum"]).orderBy(names["bucket"])
    counts = narrow.select(names["stratum"], names["bucket"], (F.sum(names["part"]).over(along) - c["part"]).alias(names["before"]), F.sum(names["part"]).over(Window.partitionBy(names["stratum"])).alias(names["rows"]))
    inside = Window.partitionBy(names["stratum"], names["bucket"]).orderBy(names["key"])
    ranked = keyed.withColumn(names["rank"], F.row_number().over(inside) - 1).join(counts, [names["stratum"], names["bucket"]])
    n = names
    twice = f"(2 * (`{n['before']}` + `{n['rank']}`) + 1)"
    placed = ranked.withColumn(n["bucket"], F.expr(f"{twice} * {buckets} div (2 * `{n['rows']}`)")).withColumn(n["rank"], F.expr(f"{twice} / `{n['rows']}`"))
    # How many rows of each source lie in each range of the fractional rank follows from the source's size alone. A source with fewer rows than
    # ranges gives a row for each of its rows, so there are never more of them than rows of the table.
    size, at = c["rows"], F.col(n["slot_of"])
    source = counts.select(n["stratum"], n["rows"]).distinct().select(n["rows"], F.explode(F.sequence(F.lit(0).cast("long"), F.least(size, F.lit(buckets).cast("long")) - 1)).alias(n["slot_of"]))
    source = source.withColumn(n["bucket"], F.when(size < buckets, F.expr(f"(2 * `{n['slot_of']}` + 1) * {buckets} div (2 * `{n['rows']}`)")).otherwise(at))
    below = "((2 * {b} * `{r}` - 1) div {k} + 1) div 2"
    upto = F.expr(f"{below.format(b=f'(`{n["bucket"]}` + 1)', r=n['rows'], k=buckets)} - {below.format(b=f'`{n["bucket"]}`', r=n['rows'], k=buckets)}")
    upto = F.when(size < buckets, F.lit(1).cast("long")).otherwise(upto)
    per = source.groupBy(names["bucket"]).agg(F.sum(upto).alias(names["part"]))
    whole = Window.orderBy(names["bucket"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = per.select(names["bucket"], (F.sum(names["part"]).over(whole) - c["part"]).alias(names["before"]), F.sum(names["part"]).over(Window.partitionBy()).alias(names["all"]))
    order = Window.partitionBy(names["bucket"]).orderBy(names["rank"], names["stratum"], names["key"])
    final = placed.drop(names["before"]).withColumn(names["slot_of"], F.row_number().over(order) - 1).join(starts, names["bucket"])
    at = F.col(names["before"]) + c["slot_of"]
    shard = F.expr(f"(`{names['before']}` + `{names['slot_of']}`) * {shards} div `{names['all']}`")
    first = F.expr(f"(`{names['shard']}` * `{names['all']}` + {shards - 1}) div {shards}")
    return final.withColumn(names["shard"], shard.cast("int")).withColumn(names["slot"], (at - first).cast("long")).select(*[F.col(f"`{x}`") for x in docs.columns], names["shard"], names["slot"])
