"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_topic(name: Column) -> Column:
    """Whether a topic name has only letters, digits, dot, underscore and minus, and at least one."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]+\z"), F.lit(False))


def csv_choices(text: Column, choices: list[str]) -> Column:
    """Trimmed distinct entries in order; an error for an unknown entry or an empty list."""
    parts = F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))
    unknown = F.array_except(parts, F.array(*[F.lit(c) for c in choices]))
    return F.when((F.size(parts) > 0) & (F.size(unknown) == 0), parts).otherwise(F.raise_error(F.concat(F.lit("bad selection: "), text)))


def sha256_chain(payload: Column, times: int) -> Column:
    """digest = sha256(digest + payload), `times` times from an empty digest, as lower-case hex. Stays in the JVM."""
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(b""), lambda d, _: F.unhex(F.sha2(F.concat(d, payload.cast("binary")), 256)))
    return F.lower(F.hex(chain))


def json_sequence(value: Column) -> Column:
    """(key, sequence, timestamp) of a JSON payload; null fields for malformed text."""
    return F.from_json(value, "key string, sequence bigint, timestamp bigint", {"mode": "PERMISSIVE"})


def shard_index(key: Column, shards: int) -> Column:
    """A stable shard of a key; a null key has one too."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
