"""queries() and oracle_sql() of the offset-log operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.functions import csv_choices, json_sequence, sha256_chain, valid_topic
from offsetlake.operators import benchmarks as B
from offsetlake.operators import codec as C
from offsetlake.operators import failures as D
from offsetlake.operators import flow as L
from offsetlake.operators import observability as M
from offsetlake.operators import offsets as O
from offsetlake.operators import ordering as R
from offsetlake.plans.fixtures import COMPLETIONS_SQL, LOG_SQL, RESULTS_SQL, RUNS_SQL, assignments, completions, fetched, finished, last_committed, message_log, micros, results, runs, table
from offsetlake.options import LogOptions
from offsetlake.sources.producer import messages
from offsetlake.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _state(log: DataFrame) -> DataFrame:
    return fetched(log).withColumn("committed", last_committed())


def _flying(log: DataFrame) -> DataFrame:
    return log.where("event_id % 50 = 7 AND event_id % 4 = 1").select(*O.TP, "off")


STATE = LOG_SQL + """,
opened AS (SELECT d.topic, d.part, d.off, a.committed FROM done d JOIN assign a USING (topic, part) WHERE d.off > a.committed),
runsx AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY off) AS rn FROM opened),
mark AS (SELECT a.topic, a.part, a.committed, coalesce(max(r.off) FILTER (WHERE r.off - r.rn = a.committed), a.committed) AS hwm FROM assign a LEFT JOIN runsx r USING (topic, part) GROUP BY a.topic, a.part, a.committed),
ends AS (SELECT o.topic, o.part, o.off, o.committed FROM opened o JOIN fetched f USING (topic, part) WHERE o.off <= f.fetched UNION ALL SELECT topic, part, fetched + 1, committed FROM fetched JOIN assign USING (topic, part) WHERE fetched > committed),
gap AS (SELECT topic, part, b + 1 AS gap_start, off - 1 AS gap_end FROM (SELECT *, coalesce(lag(off) OVER (PARTITION BY topic, part ORDER BY off), committed) AS b FROM ends) WHERE off > b + 1)"""


@query("WITH " + STATE + """, g AS (SELECT topic, part, count(*) n, min(gap_start) b FROM gap GROUP BY ALL)
SELECT m.topic, m.part, f.fetched, m.hwm, greatest(0, f.fetched - m.hwm) AS true_lag, coalesce(g.n, 0) AS gap_count, g.b AS blocking FROM mark m JOIN fetched f USING (topic, part) LEFT JOIN g USING (topic, part)""")
def offset_progress(spark, d):
    """Mark, lag, gaps and blocking offset of each partition."""
    log = message_log(spark, d)
    out = O.progress(finished(log), _state(log))
    return out.select(*O.TP, "fetched", "hwm", F.greatest(F.lit(0).cast("long"), F.col("fetched") - F.col("hwm")).alias("true_lag"), "gap_count", "blocking")


@query("WITH " + STATE + " SELECT * FROM gap")
def gap_ranges(spark, d):
    """O6, O17."""
    log = message_log(spark, d)
    return O.gaps(finished(log), _state(log))


@query("WITH " + STATE + ", fly AS (SELECT topic, part, min(off) low FROM log WHERE event_id % 50 = 7 AND event_id % 4 = 1 GROUP BY ALL) SELECT topic, part, CASE WHEN low <= hwm THEN low - 1 ELSE hwm END AS hwm FROM mark LEFT JOIN fly USING (topic, part)")
def clamped_high_water_mark(spark, d):
    """The mark held below the smallest in-flight offset."""
    log = message_log(spark, d)
    return O.high_water_mark(finished(log), _state(log), _flying(log))


@query("WITH " + STATE + " SELECT topic, part, min(gap_start) AS blocking FROM assign LEFT JOIN gap USING (topic, part) GROUP BY ALL")
def blocking_offsets(spark, d):
    """O7."""
    log = message_log(spark, d)
    return O.blocking_offsets(finished(log), _state(log))


@query("WITH " + STATE + " SELECT topic, part, greatest(0, fetched - committed) AS lag FROM assign JOIN fetched USING (topic, part)")
def true_lag(spark, d):
    """O9."""
    return O.true_lag(_state(message_log(spark, d)))


@query("WITH " + LOG_SQL + ", span AS (SELECT topic, part, unnest(range(committed + 1, fetched + 1)) off FROM assign JOIN fetched USING (topic, part)), c AS (SELECT DISTINCT topic, part, off FROM done JOIN assign USING (topic, part) WHERE off > committed) (SELECT * FROM span EXCEPT SELECT * FROM c) UNION ALL (SELECT * FROM c EXCEPT SELECT * FROM span)")
def in_flight_offsets(spark, d):
    """O10."""
    log = message_log(spark, d)
    return O.in_flight(finished(log), _state(log))


@query("WITH " + STATE + " SELECT topic, part, committed, hwm FROM mark WHERE hwm > committed")
def commit_candidates(spark, d):
    """O13."""
    log = message_log(spark, d)
    return O.commit_candidates(finished(log), _state(log))


@query("WITH " + STATE + " SELECT topic, part, count(*) AS left_over, min(off) AS first_left FROM opened JOIN mark USING (topic, part) WHERE off > hwm GROUP BY ALL")
def commit_through(spark, d):
    """What stays completed beyond the advanced mark."""
    log = message_log(spark, d)
    done, state = finished(log), _state(log)
    return O.commit_through(done, O.high_water_mark(done, state)).groupBy(*O.TP).agg(F.count("*").alias("left_over"), F.min("off").alias("first_left"))


@query("WITH " + STATE + ", k AS (SELECT topic, part, hwm + 1 AS next_offset, off, row_number() OVER (PARTITION BY topic, part ORDER BY off) rn FROM opened JOIN mark USING (topic, part) WHERE off > hwm) SELECT topic, part, next_offset, count(*) AS kept, max(off) AS last_kept FROM k WHERE rn <= 2048 GROUP BY ALL")
def commit_payload(spark, d):
    """O15 with the limit of 2048 offsets."""
    log = message_log(spark, d)
    done, state = finished(log), _state(log)
    return O.commit_payload(done, O.high_water_mark(done, state)).groupBy(*O.TP, "next_offset").agg(F.count("*").alias("kept"), F.max("off").alias("last_kept"))


_PARTS = "parts AS (SELECT DISTINCT topic, part, CAST(part * 2 AS BIGINT) AS start, CAST(part AS BIGINT) AS generation FROM log), comm AS (SELECT topic, part, CAST(part * 3 - 4 AS BIGINT) AS next_offset FROM parts WHERE part <> 5)"


@query("WITH " + LOG_SQL + ", " + _PARTS + """, b AS (SELECT topic, part, CASE WHEN coalesce(next_offset >= 0, false) THEN next_offset ELSE start END AS start, CASE WHEN coalesce(next_offset >= 0, false) THEN next_offset - 1 WHEN start > 0 THEN start - 1 ELSE -1 END AS committed, generation + 1 AS generation FROM parts LEFT JOIN comm USING (topic, part)),
t AS (SELECT b.topic, b.part, max(off) top FROM done JOIN b USING (topic, part) WHERE off > committed GROUP BY ALL)
SELECT topic, part, start, committed, greatest(committed, coalesce(top, committed)) AS fetched, generation FROM b LEFT JOIN t USING (topic, part)""")
def assignment_state(spark, d):
    """Restart positions from commits and restored metadata, with a growing generation."""
    log = message_log(spark, d)
    parts = log.select(*O.TP).distinct().select(*O.TP, (F.col("part") * 2).cast("long").alias("start"), F.col("part").cast("long").alias("generation"))
    comm = parts.where("part <> 5").select(*O.TP, (F.col("part") * 3 - 4).cast("long").alias("next_offset"))
    return O.build_assignments(parts, comm, finished(log))


@query("WITH " + STATE + " SELECT topic, part, hwm + 1 AS next_offset FROM mark WHERE hwm >= 0 AND part % 2 = 1")
def revoked_commits(spark, d):
    """O12."""
    log = message_log(spark, d)
    state = _state(log)
    return O.revoke(finished(log), state, state.where("part % 2 = 1"))


_OBS = "obs AS (SELECT topic, part, (off // 7) * 7 AS head, off // 3 AS tick, CAST(off * 2 AS BIGINT) AS t FROM log WHERE event_id % 5 <> 2)"


@query("WITH " + LOG_SQL + ", " + _OBS + ", o AS (SELECT DISTINCT topic, part, head, tick, min(t) OVER (PARTITION BY topic, part, head, tick) AS t FROM obs), r AS (SELECT *, tick - row_number() OVER (PARTITION BY topic, part, head ORDER BY tick) run FROM o) SELECT topic, part, head, tick, t AS \"at\", t - min(t) OVER (PARTITION BY topic, part, head, run) AS age FROM r")
def blocking_ages(spark, d):
    """Ages of gap heads over a series of observations."""
    log = message_log(spark, d).where("event_id % 5 <> 2")
    seen = log.select(*O.TP, F.expr("(off div 7) * 7").alias("head"), F.expr("off div 3").alias("tick"), (F.col("off") * 2).alias("at")).groupBy(*O.TP, "head", "tick").agg(F.min("at").alias("at"))
    return O.blocking_ages(seen)


_LEFT = ", left_over AS (SELECT o.topic, o.part, off, hwm + 1 AS base FROM opened o JOIN mark USING (topic, part) WHERE off > hwm)"
_RLE = ", isl AS (SELECT topic, part, base, off, off - row_number() OVER (PARTITION BY topic, part ORDER BY off) i FROM left_over), rr AS (SELECT topic, part, base, min(off) a, max(off) b FROM isl GROUP BY topic, part, base, i), rle AS (SELECT topic, part, base, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS rle FROM rr GROUP BY topic, part, base)"
_BITS = """, byt AS (SELECT topic, part, base, (off - base) // 8 j, bit_or((1 << ((off - base) % 8))::INTEGER) v FROM left_over GROUP BY ALL), top AS (SELECT topic, part, base, max(j) t FROM byt GROUP BY ALL),
dense AS (SELECT topic, part, base, unnest(range(0, t + 1)) j FROM top), bits AS (SELECT topic, part, base, CASE WHEN max(j) < 4000 THEN base || ':' || string_agg(printf('%02x', coalesce(v, 0)), '' ORDER BY j) ELSE '' END AS bits FROM dense LEFT JOIN byt USING (topic, part, base, j) GROUP BY topic, part, base)"""


def _left_over(spark, d) -> DataFrame:
    """The whole set beyond the mark."""
    log = message_log(spark, d)
    done, state = finished(log), _state(log)
    marks = O.high_water_mark(done, state)
    return O.beyond_marks(done, marks).withColumnRenamed("next_offset", "base")


@query("WITH " + STATE + _LEFT + _RLE + " SELECT topic, part, rle FROM rle")
def rle_metadata(spark, d):
    """C1."""
    return C.run_lengths(_left_over(spark, d), O.TP)


@query("WITH " + STATE + _LEFT + _BITS + " SELECT topic, part, base, bits FROM bits")
def bitset_metadata(spark, d):
    """C2."""
    return C.bitset(_left_over(spark, d), O.TP)


@query("WITH " + STATE + _LEFT + _RLE + _BITS + " SELECT topic, part, base, CASE WHEN length(rle) + 1 > 200 AND length(bits) + 1 > 200 THEN 'O' WHEN length(bits) + 1 > 200 THEN 'R' || rle WHEN length(rle) + 1 > 200 THEN 'B' || bits WHEN length(rle) <= length(bits) THEN 'R' || rle ELSE 'B' || bits END AS metadata FROM rle JOIN bits USING (topic, part, base)")
def commit_metadata(spark, d):
    """C3, C4 with a budget of 200 characters."""
    return C.encode(_left_over(spark, d), O.TP, max_size=200)


@query("WITH " + STATE + _LEFT + " SELECT topic, part, off FROM left_over")
def metadata_round_trip(spark, d):
    """Encode, decode, one row an offset."""
    coded = C.encode(_left_over(spark, d), O.TP)
    return coded.select(*O.TP, F.explode(C.decode(F.col("metadata"))).alias("off"))


@query("WITH " + LOG_SQL + " SELECT topic, part, k AS route, count(*) AS queued, min(off) AS head, max(off) AS tail FROM log WHERE part <> 3 AND event_id % 11 <> 0 GROUP BY ALL")
def virtual_queues(spark, d):
    """Ingest filter, routing and the queues."""
    log = message_log(spark, d).withColumn("error", F.when(F.col("event_id") % 11 == 0, "broker"))
    q = R.queue_ranks(R.ingest(log, log.where("part <> 3")), "key_hash")
    return q.groupBy(*O.TP, "route").agg(F.count("*").alias("queued"), F.min("off").alias("head"), F.max("off").alias("tail"))


@query("WITH " + LOG_SQL + " SELECT topic, part, off, k AS route, row_number() OVER (PARTITION BY topic, part, k ORDER BY off) - 1 AS queue_pos FROM log")
def queue_positions(spark, d):
    """R1."""
    return R.queue_ranks(message_log(spark, d), "key_hash").select(*O.TP, "off", "route", "queue_pos")


@query("WITH " + LOG_SQL + " SELECT topic, part, count(*) AS batch_size, max(off) AS last_fetched, topic || '-' || part || '-' || min(off) AS first_id FROM log GROUP BY topic, part")
def work_items(spark, d):
    """Deterministic ids and the last fetched offset."""
    log = message_log(spark, d)
    return log.groupBy(*O.TP).agg(F.count("*").alias("batch_size"), F.max("off").alias("last_fetched"), F.concat_ws("-", "topic", "part", F.min("off")).alias("first_id"))


@query("WITH " + STATE + """, undone AS (SELECT * FROM log WHERE event_id % 50 = 7 OR (event_type = 'error' AND event_id % 200 = 3)), h AS (SELECT topic, part, k AS route, min(off) off FROM undone JOIN assign USING (topic, part) WHERE off > committed GROUP BY ALL),
b AS (SELECT topic, part, min(gap_start) blocking FROM gap GROUP BY ALL) SELECT topic, part, route, off FROM h JOIN b USING (topic, part) WHERE off = blocking ORDER BY off, topic, part, route LIMIT 1""")
def next_queue(spark, d):
    """R2: the queue whose head is the lowest blocking offset."""
    log = message_log(spark, d)
    done, state = finished(log), _state(log)
    undone = log.join(done.select(*O.TP, "off"), [*O.TP, "off"], "left_anti").join(state.select(*O.TP, "committed"), O.TP).where("off > committed")
    heads = undone.groupBy(*O.TP, F.col("k").alias("route")).agg(F.min("off").alias("off"))
    return R.lowest_blocking_head(heads, O.blocking_offsets(done, state))


@query("WITH " + LOG_SQL + ", h AS (SELECT topic, part, k AS route, min(off) off FROM log WHERE off >= 5 GROUP BY ALL), f AS (SELECT DISTINCT topic, part, k AS route FROM log WHERE event_id % 50 = 7 AND event_id % 4 = 1) SELECT h.* FROM h ANTI JOIN f ON h.topic = f.topic AND h.part = f.part AND h.route = f.route")
def eligible_queues(spark, d):
    """Heads of queues without work in flight."""
    log = message_log(spark, d)
    heads = log.where("off >= 5").groupBy(*O.TP, F.col("k").alias("route")).agg(F.min("off").alias("off"))
    return R.eligible(heads, log.where("event_id % 50 = 7 AND event_id % 4 = 1").select(*O.TP, F.col("k").alias("route")), "key_hash")


@query("SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn % 3, turn) + 1, 0) AS expected FROM conversations) WHERE turn <> expected")
def key_order_violations(spark, d):
    """R10 by key, over a shuffled processing order."""
    conv = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("slot"))
    return R.sequence_violations(conv, ["conv_id"], "turn", ["slot", "turn"]).select("conv_id", "turn", "expected")


@query("WITH " + LOG_SQL + " SELECT part, off, expected FROM (SELECT part, off, coalesce(lag(off) OVER (PARTITION BY part ORDER BY event_id) + 1, off) AS expected FROM log WHERE event_id % 13 <> 4) WHERE off <> expected")
def partition_order_violations(spark, d):
    """R10 by partition: the first offset is accepted."""
    log = message_log(spark, d).where("event_id % 13 <> 4")
    return R.sequence_violations(log, ["part"], "off", ["event_id"], None).select("part", "off", "expected")


@query("SELECT conv_id, turn, before FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) AS before FROM conversations) WHERE turn < before")
def disorder(spark, d):
    """R11."""
    conv = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 2).alias("slot"))
    return R.disorder(conv, ["conv_id"], "turn", ["slot", "turn"]).select("conv_id", "turn", "before")


@query("WITH " + LOG_SQL + " SELECT topic, part, off, a AS attempt, CASE WHEN a < 3 THEN least(1000 * 2 ** (a - 1), 30000)::BIGINT ELSE 0 END AS wait_ms FROM log, unnest([1, 2, 3]) t(a) WHERE event_type = 'error'")
def retry_schedule(spark, d):
    """E5, E6."""
    return D.retry_schedule(message_log(spark, d).where("event_type = 'error'").select(*O.TP, "off"))


@query("SELECT a::BIGINT AS attempt, least(500 * 2 ** (a - 1), 4000)::BIGINT AS exponential_ms, 500::BIGINT AS linear_ms, 300::BIGINT AS capped_ms FROM range(1, 11) t(a)")
def backoff_table(spark, d):
    """The three backoff rules."""
    a = F.col("id")
    return spark.range(1, 11).select(a.alias("attempt"), D.backoff_ms(a, 500, 4000).alias("exponential_ms"), D.backoff_ms(a, 500, 300, False).alias("linear_ms"), D.backoff_ms(a, 500, 300, False, True).alias("capped_ms"))


@query("WITH " + LOG_SQL + ", a AS (SELECT topic, part, off, t AS attempt, (event_id * t) % 3 = 0 ok FROM log, unnest([1, 2, 3]) x(t)) SELECT topic, part, off, CASE WHEN bool_or(ok) THEN 'success' ELSE 'failure' END AS status, coalesce(min(attempt) FILTER (WHERE ok), 3) AS attempt FROM a GROUP BY topic, part, off")
def first_success(spark, d):
    """E5 as data: the first attempt that succeeds."""
    tries = message_log(spark, d).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("ok", F.col("event_id") * F.col("attempt") % 3 == 0)
    return D.first_success(tries, [*O.TP, "off"])


@query("WITH " + COMPLETIONS_SQL + " SELECT topic, part, epoch <> 2 AS stale, count(*) AS n FROM comp GROUP BY ALL")
def epoch_fence(spark, d):
    """P10."""
    log = message_log(spark, d)
    return D.fence(completions(log), assignments(log).withColumn("epoch", F.lit(2))).groupBy(*O.TP, "stale").agg(F.count("*").alias("n"))


@query("WITH " + COMPLETIONS_SQL + " SELECT topic, part, CASE WHEN status = 'success' THEN 'complete' WHEN attempt >= 3 THEN 'dlq' ELSE 'complete_no_dlq' END AS disposition, count(*) AS n FROM comp GROUP BY ALL")
def dispositions(spark, d):
    """D1."""
    return completions(message_log(spark, d)).withColumn("disposition", D.disposition()).groupBy(*O.TP, "disposition").agg(F.count("*").alias("n"))


@query("WITH " + COMPLETIONS_SQL + " SELECT topic || '.dlq' AS dlq_topic, CASE WHEN event_id % 2 = 0 THEN k END AS key, CASE WHEN event_id % 2 = 0 THEN v END AS value, coalesce(error, 'Unknown error') AS x_error_reason, attempt::VARCHAR AS x_retry_attempt, topic AS source_topic, part::VARCHAR AS part_header, off::VARCHAR AS offset_header, epoch::VARCHAR AS epoch_header FROM comp WHERE status = 'failure' AND attempt >= 3")
def dlq_records(spark, d):
    """Dead letters; half of the payloads are still cached."""
    done = completions(message_log(spark, d))
    return D.dead_letters(done.where(D.disposition() == "dlq"), done.where("event_id % 2 = 0"))


@query("WITH " + COMPLETIONS_SQL + " SELECT topic, part, off, status FROM comp WHERE NOT (event_type_error AND event_id % 200 = 3)".replace("event_type_error", "status = 'failure'"))
def fresh_events(spark, d):
    """Events of offsets that are not in the pending ledger, each once."""
    done = completions(message_log(spark, d))
    pending = done.where("status = 'failure' AND event_id % 200 = 3")
    return D.without_pending(done.unionByName(done), pending).select(*O.TP, "off", "status")


@query("WITH " + LOG_SQL + ", e AS (SELECT topic, part, off, event_id, strlen(k) + strlen(v) AS size FROM log), f AS (SELECT *, sum(size) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) s FROM e WHERE size <= 300) SELECT topic, part, off, size FROM f WHERE s <= 300")
def dlq_cache_survivors(spark, d):
    """D3: what one FIFO cache of 300 bytes, over all partitions and in order of arrival, still holds."""
    e = message_log(spark, d).select(*O.TP, "off", (F.octet_length("k") + F.octet_length("v")).cast("long").alias("size"), "event_id")
    return D.cache_survivors(e, 300, "event_id").drop("event_id")


@query("WITH " + LOG_SQL + " SELECT topic, part, off, 'failure' AS status, 3 AS attempt, printf('Blocking offset %d exceeded %.3fs', off, 2.5) AS error FROM log WHERE latency_ms / 10 >= 2.5")
def forced_failures(spark, d):
    """D11."""
    heads = message_log(spark, d).select(*O.TP, F.col("off").alias("head"), (F.col("latency_ms") / 10).alias("age"))
    return D.forced_failures(heads, 2.5)


@query("WITH " + COMPLETIONS_SQL + " SELECT topic, part, coalesce(split_part(error, ' ', 1), 'unknown') AS reason, count(*) AS failures FROM comp WHERE status = 'failure' GROUP BY ALL")
def failure_counters(spark, d):
    """D12."""
    bad = completions(message_log(spark, d)).where("status = 'failure'")
    return bad.groupBy(*O.TP, F.coalesce(F.split("error", " ")[0], F.lit("unknown")).alias("reason")).agg(F.count("*").alias("failures"))


def _circuit_events(spark, d) -> DataFrame:
    log = message_log(spark, d)
    return log.select(*O.TP, (F.col("k").cast("int") % 20).cast("string").alias("poison_key"), F.col("event_id").alias("seq"), (micros("ts") / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(3).alias("attempt"))


@query("""WITH RECURSIVE o AS (SELECT 'events' AS topic, CAST(user_id % 8 AS INTEGER) AS part, CAST(user_id % 20 AS VARCHAR) AS poison_key, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS ok, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 3 END AS attempt,
  row_number() OVER (PARTITION BY user_id % 8, user_id % 20 ORDER BY event_id) AS rn FROM events),
f AS (SELECT DISTINCT topic, part, poison_key, 0::BIGINT AS rn, 0::BIGINT AS seq, 0::BIGINT AS failures, NULL::DOUBLE AS until, false AS forced FROM o
  UNION ALL
  SELECT topic, part, poison_key, rn, seq, CASE WHEN ok AND NOT fo THEN 0 WHEN fo OR attempt >= 3 THEN fl + 1 ELSE fl END, CASE WHEN ok AND NOT fo THEN NULL WHEN (fo OR attempt >= 3) AND fl + 1 >= 2 THEN t + 600 ELSE un END, fo
  FROM (SELECT o.*, CASE WHEN f.until <= o.t THEN 0 ELSE f.failures END AS fl, CASE WHEN f.until > o.t THEN f.until END AS un, coalesce(f.until > o.t, false) AS fo FROM f JOIN o ON o.part = f.part AND o.poison_key = f.poison_key AND o.rn = f.rn + 1))
SELECT topic, part, poison_key, seq, forced, until IS NOT NULL AS open_after FROM f WHERE rn > 0""")
def poison_circuit(spark, d):
    """The fold of each key's circuit, with the sliding cooldown."""
    ship(spark)
    return D.poison_circuit(_circuit_events(spark, d), 2, 600.0).select(*O.TP, "poison_key", "seq", "forced", "open_after")


_LOAD = "s AS (SELECT user_id % 4 AS consumer, event_id, CAST(floor(value) AS BIGINT) AS in_flight, CAST(user_id % 13 AS BIGINT) AS queued FROM events)"


def _load(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 4).alias("consumer"), "event_id", F.floor("value").alias("in_flight"), (F.col("user_id") % 13).alias("queued"), (micros("ts") / 1e6).alias("at"), "value")


@query("WITH " + _LOAD + ", g AS (SELECT *, CASE WHEN in_flight + queued > 60 OR queued >= 12 THEN 1 WHEN in_flight + queued < 42 AND queued <= 8 THEN 0 END sig FROM s) SELECT consumer, event_id, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY consumer ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS paused FROM g")
def backpressure_state(spark, d):
    """F1."""
    return L.hysteresis(_load(spark, d), ["consumer"], "event_id", 60, 12).select("consumer", "event_id", "paused")


def _paused(spark, d) -> DataFrame:
    return L.hysteresis(_load(spark, d), ["consumer"], "event_id", 60, 12).withColumn("lag", F.col("in_flight") * 3).withColumn("latency", F.col("value") / 1000)


_SAMPLES = _LOAD.replace("FROM events", ", epoch_us(ts) / 1e6 AS t, value / 1000 AS latency FROM events").replace("queued ,", "queued,") + """,
g AS (SELECT *, CASE WHEN in_flight + queued > 60 OR queued >= 12 THEN 1 WHEN in_flight + queued < 42 AND queued <= 8 THEN 0 END AS sig FROM s),
p AS (SELECT consumer, t, in_flight, queued, in_flight * 3 AS lag, latency, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY consumer ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS paused,
  row_number() OVER (PARTITION BY consumer ORDER BY t, event_id) AS rn FROM g)"""


@query("WITH RECURSIVE " + _SAMPLES + """,
f AS (SELECT DISTINCT consumer, 0::BIGINT AS rn, 0::DOUBLE AS t, 64::BIGINT AS lim, NULL::DOUBLE AS changed FROM p
  UNION ALL
  SELECT consumer, rn, t, CASE WHEN held THEN lim ELSE now END, CASE WHEN held OR now = lim THEN changed ELSE t END
  FROM (SELECT p.consumer, p.rn, p.t, f.lim, f.changed, coalesce(p.t - f.changed < 600, false) AS held, CASE WHEN paused OR in_flight + queued > lim THEN greatest(32, lim - 24) WHEN lag >= lim AND queued = 0 THEN least(128, lim + 16) ELSE lim END AS now
        FROM f JOIN p ON p.consumer = f.consumer AND p.rn = f.rn + 1))
SELECT consumer, t AS "at", lim AS limit_after FROM f WHERE rn > 0""")
def adaptive_concurrency(spark, d):
    """F2, F3, F5."""
    ship(spark)
    return L.adaptive_concurrency(_paused(spark, d), ["consumer"], 128, 64, up=16, down=24, cooldown=600.0).select("consumer", "at", "limit_after")


@query("WITH RECURSIVE " + _SAMPLES + """,
f AS (SELECT DISTINCT consumer, 0::BIGINT AS rn, 0::DOUBLE AS t, 60::BIGINT AS lim, NULL::DOUBLE AS changed, '' AS decision FROM p
  UNION ALL
  SELECT consumer, rn, t, CASE WHEN held THEN lim ELSE now END, CASE WHEN held OR now = lim THEN changed ELSE t END, CASE WHEN held THEN 'cooldown' WHEN now = lim THEN 'hold' WHEN now < lim THEN 'scale_down' ELSE 'scale_up' END
  FROM (SELECT p.consumer, p.rn, p.t, f.lim, f.changed, coalesce(p.t - f.changed < 600, false) AS held, CASE WHEN paused OR latency >= 0.05 THEN greatest(1, lim - 16) WHEN lag >= 20 AND queued = 0 AND latency <= 0.02 THEN least(120, lim + 20) ELSE lim END AS now
        FROM f JOIN p ON p.consumer = f.consumer AND p.rn = f.rn + 1))
SELECT consumer, t AS "at", lim AS limit_after, decision FROM f WHERE rn > 0""")
def adaptive_backpressure(spark, d):
    """F4, F5."""
    ship(spark)
    return L.adaptive_backpressure(_paused(spark, d), ["consumer"], 120, 60, up=20, cooldown=600.0, lag_threshold=20, low_s=0.02, high_s=0.05).select("consumer", "at", "limit_after", "decision")


@query("""WITH RECURSIVE o AS (SELECT user_id % 4 AS consumer, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn, event_id, value FROM events),
f AS (SELECT consumer, rn, event_id, value AS average FROM o WHERE rn = 1 UNION ALL SELECT o.consumer, o.rn, o.event_id, 0.8 * f.average + (1 - 0.8) * o.value FROM f JOIN o ON o.consumer = f.consumer AND o.rn = f.rn + 1)
SELECT consumer, event_id, round(average, 6) AS average FROM f""")
def latency_average(spark, d):
    """F6."""
    ship(spark)
    return L.latency_average(_load(spark, d), ["consumer"], ["event_id"], "value").select("consumer", "event_id", F.round("average", 6).alias("average"))


@query("SELECT user_id % 8 AS part, event_id, least(count(*) OVER (PARTITION BY user_id % 8 ORDER BY epoch_us(ts) RANGE BETWEEN 5000000 PRECEDING AND CURRENT ROW), 256) / 5.0::DOUBLE AS rate FROM events")
def recent_rate(spark, d):
    """F7."""
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("part"), "event_id", micros("ts").alias("us"))
    return L.recent_rate(e, ["part"], "us").select("part", "event_id", "rate")


@query("WITH " + LOG_SQL + ", b AS (SELECT part, off, off // 64 AS batch FROM log) SELECT part, batch, count(*) AS items, min(off) AS first_off FROM b GROUP BY ALL")
def size_batches(spark, d):
    """E13 with size flushes only."""
    return L.size_batches(message_log(spark, d), ["part"], "off").groupBy("part", "batch").agg(F.count("*").alias("items"), F.min("off").alias("first_off"))


@query("""WITH RECURSIVE o AS (SELECT user_id % 8 AS part, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT DISTINCT part, 0::BIGINT AS rn, 0::BIGINT AS batch, 0::BIGINT AS number, NULL::DOUBLE AS began, 0::BIGINT AS n, false AS filled FROM o
  UNION ALL
  SELECT part, rn, nb, nb + CASE WHEN nn >= 8 THEN 1 ELSE 0 END, CASE WHEN nn < 8 THEN nf END, nn, nn >= 8
  FROM (SELECT o.part, o.rn, f.number + CASE WHEN o.t - f.began >= 1800 THEN 1 ELSE 0 END AS nb, CASE WHEN o.t - f.began < 1800 THEN f.began ELSE o.t END AS nf, CASE WHEN o.t - f.began < 1800 THEN f.n + 1 ELSE 1 END AS nn FROM f JOIN o ON o.part = f.part AND o.rn = f.rn + 1)),
b AS (SELECT part, batch, count(*) AS items, bool_or(filled) AS filled, max(batch) OVER (PARTITION BY part) AS latest FROM f WHERE rn > 0 GROUP BY part, batch),
r AS (SELECT items, CASE WHEN filled THEN 'size' WHEN batch = latest THEN 'close' ELSE 'timer' END AS reason FROM b)
SELECT reason, count(*) AS flushes, sum(items)::BIGINT AS items, sum(items) / count(*) AS average FROM r GROUP BY reason""")
def timed_batches(spark, d):
    """E13 with size, timer and close flushes, then M8."""
    ship(spark)
    items = table(spark, d, "events").select((F.col("user_id") % 8).alias("part"), (micros("ts") / 1e6).alias("at"))
    out = L.timed_batches(items, ["part"], 8, 1800.0)
    sizes = out.groupBy("part", "batch").agg(F.count("*").alias("items"), F.max("reason").alias("reason"))
    return M.flush_metrics(sizes)


@query("""WITH RECURSIVE o AS (SELECT user_id % 8 AS part, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT DISTINCT part, 0::BIGINT AS rn, 0::BIGINT AS batch, 0::BIGINT AS number, NULL::DOUBLE AS began, 0::BIGINT AS n, false AS filled, NULL::VARCHAR AS why FROM o
  UNION ALL
  SELECT part, rn, nb, nb + CASE WHEN nn >= 8 THEN 1 ELSE 0 END, CASE WHEN nn < 8 THEN nf END, nn, nn >= 8, why
  FROM (SELECT o.part, o.rn, f.number + CASE WHEN o.t - f.began >= 600 THEN 1 ELSE 0 END AS nb, CASE WHEN o.t - f.began < 600 THEN f.began ELSE o.t END AS nf, CASE WHEN o.t - f.began < 600 THEN f.n + 1 ELSE 1 END AS nn,
          CASE WHEN o.t - f.began >= 1800 THEN 'timer' WHEN o.t - f.began >= 600 THEN 'demand' END AS why FROM f JOIN o ON o.part = f.part AND o.rn = f.rn + 1)),
b AS (SELECT part, batch, count(*) AS items, bool_or(filled) AS filled, max(why) AS why FROM f WHERE rn > 0 GROUP BY part, batch),
r AS (SELECT items, CASE WHEN filled THEN 'size' ELSE coalesce(lead(why) OVER (PARTITION BY part ORDER BY batch), 'close') END AS reason FROM b)
SELECT reason, count(*) AS flushes, sum(items)::BIGINT AS items, sum(items) / count(*) AS average FROM r GROUP BY reason""")
def demand_batches(spark, d):
    """E13 with the policy that flushes on demand after a residence, then M8."""
    ship(spark)
    items = table(spark, d, "events").select((F.col("user_id") % 8).alias("part"), (micros("ts") / 1e6).alias("at"))
    out = L.timed_batches(items, ["part"], 8, 1800.0, "demand_min_residence", 600.0)
    return M.flush_metrics(out.groupBy("part", "batch").agg(F.count("*").alias("items"), F.max("reason").alias("reason")))


@query("WITH RECURSIVE " + _SAMPLES + """,
f AS (SELECT DISTINCT consumer, 0::BIGINT AS rn, 0::DOUBLE AS t, 90::BIGINT AS lim, NULL::DOUBLE AS c1, NULL::DOUBLE AS c2, '' AS decision, false AS stopped FROM p
  UNION ALL
  SELECT consumer, rn, t, l2, CASE WHEN held1 OR l1 = lim THEN c1 ELSE t END, CASE WHEN held2 OR l2 = l1 THEN c2 ELSE t END, CASE WHEN held1 THEN 'cooldown' WHEN l1 = lim THEN 'hold' WHEN l1 < lim THEN 'scale_down' ELSE 'scale_up' END,
    in_flight + queued > l2 OR (stopped AND in_flight + queued >= greatest(1, floor(l2 * 0.7::DOUBLE)))
  FROM (SELECT *, CASE WHEN held2 THEN l1 WHEN stopped OR in_flight + queued > l1 THEN greatest(22, l1 - 24) WHEN lag >= l1 AND queued = 0 THEN least(90, l1 + 16) ELSE l1 END AS l2
    FROM (SELECT *, CASE WHEN held1 THEN lim WHEN stopped OR latency >= 0.05 THEN greatest(1, lim - 16) WHEN lag >= 20 AND queued = 0 AND latency <= 0.02 THEN least(90, lim + 20) ELSE lim END AS l1
      FROM (SELECT p.*, f.lim, f.c1, f.c2, f.stopped, coalesce(p.t - f.c1 < 600, false) AS held1, coalesce(p.t - f.c2 < 900, false) AS held2 FROM f JOIN p ON p.consumer = f.consumer AND p.rn = f.rn + 1))))
SELECT consumer, t AS "at", lim AS limit_after, decision, stopped AS paused_after FROM f WHERE rn > 0""")
def runtime_limits(spark, d):
    """backpressure, concurrency and the pause, composed in one fold."""
    ship(spark)
    out = L.runtime_limits(_paused(spark, d), ["consumer"], 90, {"up": 20, "cooldown": 600.0, "lag_threshold": 20, "low_s": 0.02, "high_s": 0.05}, {"up": 16, "down": 24, "cooldown": 900.0})
    return out.select("consumer", "at", "limit_after", "decision", "paused_after")


@query("WITH " + LOG_SQL + " SELECT topic, part, off, lower(hex(unhex(sha256(unhex(sha256(v::BLOB) || hex(v::BLOB)))))) AS digest FROM log")
def cpu_worker_chain(spark, d):
    """The CPU worker's hash chain of length 2 over the whole log, in the JVM."""
    return message_log(spark, d).select(*O.TP, "off", sha256_chain(F.col("v"), 2).alias("digest"))


@query("WITH " + STATE + ", g AS (SELECT topic, part, count(*) n, min(gap_start) b FROM gap GROUP BY ALL), q AS (SELECT topic, part, count(*) n FROM log WHERE event_id % 50 = 7 GROUP BY ALL) SELECT topic, part, greatest(0, fetched - committed) AS lag, coalesce(g.n, 0) AS gap_count, b AS blocking, coalesce(q.n, 0) AS queued FROM assign JOIN fetched USING (topic, part) LEFT JOIN g USING (topic, part) LEFT JOIN q USING (topic, part)")
def partition_metrics(spark, d):
    """M1."""
    log = message_log(spark, d)
    return M.partition_metrics(finished(log), _state(log), log.where("event_id % 50 = 7"))


@query("WITH " + STATE + ", x AS (SELECT topic, part, greatest(0, fetched - committed) AS lag FROM assign JOIN fetched USING (topic, part)), q AS (SELECT count(*) n FROM log WHERE event_id % 50 = 7) SELECT sum(lag)::BIGINT AS total_lag, any_value(q.n) AS total_queued, string_agg(part::VARCHAR, ',' ORDER BY topic, part) AS parts FROM x, q")
def runtime_snapshot(spark, d):
    """M2: the nested snapshot, with its partitions' order shown."""
    log = message_log(spark, d)
    s = M.snapshot(M.partition_metrics(finished(log), _state(log), log.where("event_id % 50 = 7")))
    return s.select("total_lag", "total_queued", F.array_join(F.transform("partitions", lambda p: p.part.cast("string")), ",").alias("parts"))


@query("WITH " + COMPLETIONS_SQL + " SELECT topic, part, status, count(*) AS processed FROM comp GROUP BY ALL")
def processed_total(spark, d):
    """M3."""
    return M.processed_total(completions(message_log(spark, d)))


_LE = "(SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 'Infinity'::DOUBLE])::DOUBLE AS le)"


@query("WITH " + COMPLETIONS_SQL + f" SELECT topic, part, le, count(*) FILTER (WHERE latency_ms / 1000 <= le) AS cumulative FROM comp, {_LE} GROUP BY ALL")
def latency_histogram(spark, d):
    """M4."""
    return M.latency_histogram(completions(message_log(spark, d)).withColumn("s", F.col("latency_ms") / 1000), "s")


@query("WITH " + COMPLETIONS_SQL + f""", h AS (SELECT part, le, count(*) FILTER (WHERE latency_ms / 1000 <= le) c FROM comp, {_LE} GROUP BY ALL), x AS (SELECT *, coalesce(lag(le) OVER w, 0) lo, coalesce(lag(c) OVER w, 0) u, 0.99 * max(c) OVER (PARTITION BY part) r FROM h WINDOW w AS (PARTITION BY part ORDER BY le))
SELECT part, round(arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (r - u) / (c - u) END, le), 6) AS quantile FROM x WHERE c >= r AND c > u GROUP BY part""")
def histogram_p99(spark, d):
    """M13."""
    h = M.latency_histogram(completions(message_log(spark, d)).withColumn("s", F.col("latency_ms") / 1000), "s", ["part"])
    return M.histogram_quantile(h, 0.99, ["part"]).select("part", F.round("quantile", 6).alias("quantile"))


@query("SELECT user_id % 8 AS part, v AS value, (v = arg_max(event_type, event_id))::INTEGER AS is_current FROM events, (SELECT unnest(['view', 'signup', 'error', 'click', 'purchase']) v) GROUP BY 1, 2")
def one_hot_status(spark, d):
    """M5, M6: last value, one-hot over a closed domain."""
    last = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("part")).agg(F.max_by("event_type", "event_id").alias("status"))
    return M.one_hot(last, "status", ["view", "signup", "error", "click", "purchase"])


@query("SELECT user_id % 8 AS part, coalesce(arg_max(value, event_id), 0) AS value, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def last_gauges(spark, d):
    """M5, M14."""
    e = table(spark, d, "events").withColumn("part", F.col("user_id") % 8)
    return M.last_gauges(e, ["part"], "event_id", ["value", "user_id"])


@query("SELECT event_type AS status, time_bucket(INTERVAL 1 minute, ts) AS start, count(*) / 60.0::DOUBLE AS rate FROM events GROUP BY 1, 2")
def event_rate_1m(spark, d):
    """M12."""
    return M.per_second(table(spark, d, "events").withColumnRenamed("event_type", "status"), "ts", ["status"])


@query("SELECT part, event_id, CASE WHEN b IS NULL THEN 0 WHEN c < b THEN c ELSE c - b END AS increase FROM (SELECT user_id % 8 AS part, event_id, (event_id % 37)::BIGINT c, lag(event_id % 37) OVER (PARTITION BY user_id % 8 ORDER BY event_id) b FROM events)")
def counter_increase(spark, d):
    """Increases of a counter with resets."""
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("part"), "event_id", (F.col("event_id") % 37).alias("c"))
    return M.counter_increase(e, ["part"], "event_id", "c").select("part", "event_id", "increase")


@query("WITH " + _LOAD.replace("FROM events", ", epoch_us(ts) AS us FROM events").replace("queued ,", "queued,") + ", r AS (SELECT *, sum(CASE WHEN in_flight + queued > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY consumer ORDER BY event_id) run FROM s) SELECT consumer, min(us) AS since, max(us) - min(us) AS lasted FROM r WHERE in_flight + queued > 20 GROUP BY consumer, run HAVING max(us) - min(us) > 60000000")
def alert_overload(spark, d):
    """Times of overload of more than a minute."""
    s = table(spark, d, "events").select((F.col("user_id") % 4).alias("consumer"), "event_id", micros("ts").alias("us"), (F.floor("value") + F.col("user_id") % 13 > 20).alias("hot"))
    return M.held_longer(s, ["consumer"], "event_id", "hot", "us", 60_000_000)


@query("WITH " + LOG_SQL + " SELECT topic, part, max(latency_ms) AS age FROM log GROUP BY ALL ORDER BY age DESC, topic, part LIMIT 3")
def top_blocking(spark, d):
    """M17."""
    return M.top_blocking(message_log(spark, d).groupBy(*O.TP).agg(F.max("latency_ms").alias("age")), 3)


@query("WITH " + RUNS_SQL + " SELECT run, count(*) AS messages, round((max(us) - min(us)) / 1e6, 6) AS total_s, round(avg(latency_ms), 6) AS avg_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, round(CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6) ELSE 0 END, 9) AS tps FROM runs GROUP BY run")
def run_summary(spark, d):
    """A1 to A3."""
    return B.run_summary(runs(spark, d)).select("run", "messages", *[F.round(c, 6).alias(c) for c in ("total_s", "avg_ms", "p99_ms")], F.round("tps", 9).alias("tps"))


_WIN = ", e AS (SELECT run, seq // 100 AS w, count(*) n, arg_max(us, seq) e FROM runs GROUP BY ALL), f AS (SELECT run, arg_min(us, seq) s FROM runs GROUP BY run), x AS (SELECT run, w, n, (e - coalesce(lag(e) OVER (PARTITION BY run ORDER BY w), s)) / 1e6 el FROM e JOIN f USING (run)), t AS (SELECT run, w, CASE WHEN el > 0 THEN 100 / el ELSE 0 END AS tps FROM x WHERE n = 100)"


@query("WITH " + RUNS_SQL + _WIN + ' SELECT run, w AS "window", round(tps, 9) AS tps FROM t')
def windowed_tps(spark, d):
    """A4."""
    return B.window_tps(runs(spark, d)).select("run", "window", F.round("tps", 9).alias("tps"))


@query("WITH " + RUNS_SQL + _WIN + " SELECT run, count(*) AS windows, round(quantile_cont(tps, 0.5), 9) AS tps_p50, round(quantile_cont(tps, 0.1), 9) AS tps_p10, round(min(tps), 9) AS tps_min FROM t GROUP BY run")
def windowed_tps_summary(spark, d):
    """A5."""
    return B.window_tps_summary(B.window_tps(runs(spark, d))).select("run", "windows", *[F.round(c, 9).alias(c) for c in ("tps_p50", "tps_p10", "tps_min")])


@query("SELECT event_type AS run, arg_max(user_id % 9, event_id) AS lag, arg_max(user_id % 4, event_id) AS gap_count FROM events GROUP BY 1")
def final_observation(spark, d):
    """A6."""
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), "event_id", (F.col("user_id") % 9).alias("lag"), (F.col("user_id") % 4).alias("gap_count"))
    return B.final_observation(e, ["run"], "event_id", ["lag", "gap_count"])


@query("WITH " + RESULTS_SQL + " SELECT workload, ordering, mode, tps FROM (SELECT *, row_number() OVER (PARTITION BY workload, ordering ORDER BY tps DESC, seq) r FROM results) WHERE r = 1")
def winners(spark, d):
    """A8, A18."""
    return B.best_runs(results(spark, d), ["workload", "ordering"]).select("workload", "ordering", "mode", "tps")


@query("WITH " + RESULTS_SQL + """, b AS (SELECT workload, ordering, max(tps) r FROM results WHERE mode = 'baseline' GROUP BY ALL), c AS (SELECT workload, ordering, arg_max(mode, tps) mode, max(tps) c FROM results WHERE mode <> 'baseline' GROUP BY ALL)
SELECT workload, ordering, mode, r AS reference_tps, c AS candidate_tps, round(c - r, 4) AS delta, round((c - r) / r * 100, 4) AS pct, round(c / r, 4) AS ratio FROM b JOIN c USING (workload, ordering)""")
def best_vs_baseline(spark, d):
    """A10, A11."""
    return B.best_against_baseline(results(spark, d)).select("workload", "ordering", "mode", "reference_tps", "candidate_tps", *[F.round(c, 4).alias(c) for c in ("delta", "pct", "ratio")])


_ADAPT = "r AS (SELECT artifact || '-' || mode || '-' || workload || '-adaptive-' || CASE WHEN ordering = 'key_hash' THEN 'on' ELSE 'off' END AS run, seq, tps FROM results), n AS (SELECT *, regexp_replace(run, '-adaptive-(on|off)$', '') AS name FROM r)"


@query("WITH " + RESULTS_SQL.replace("user_id % 4 AS artifact", "user_id % 3 AS artifact") + ", " + _ADAPT + ", f AS (SELECT name, arg_max(tps, seq) AS off_tps FROM n WHERE run LIKE '%-adaptive-off' GROUP BY name) SELECT name, tps AS on_tps, off_tps, round(tps - off_tps, 4) AS delta FROM n JOIN f USING (name) WHERE run LIKE '%-adaptive-on'")
def adaptive_comparison(spark, d):
    """A9."""
    e = table(spark, d, "events")
    mode = F.when(F.col("event_id") % 3 == 0, "baseline").when(F.col("event_id") % 3 == 1, "async").otherwise("process")
    load = F.when(F.col("event_type").isin("view", "click"), "sleep").when(F.col("event_type") == "error", "io").otherwise("cpu")
    run = F.concat_ws("-", (F.col("user_id") % 3).cast("string"), mode, load, F.when(F.col("user_id") % 2 == 0, "adaptive-on").otherwise("adaptive-off"))
    rows = e.groupBy(run.alias("run")).agg(F.min("event_id").alias("seq"), F.round(F.sum("value"), 4).alias("tps"))
    return B.adaptive_on_off(rows).select("name", "on_tps", "off_tps", F.round("delta", 4).alias("delta"))


_LIMITS = "lim(mode, workload, ordering, floor_tps, ceil_p99) AS (VALUES " + ", ".join(f"('{m}', '{w}', '{o}', {t}, {p})" for m, w, o, t, p in B.THRESHOLDS) + ")"
_GATE = """, s AS (SELECT mode, workload, ordering, count(DISTINCT artifact) n, min(tps) t, max(p99_ms) p, max(CASE WHEN messages > 3 THEN 0 ELSE 1 END) w, max(CASE WHEN final_lag = 0 AND final_gaps = 0 THEN 0 ELSE 1 END) g FROM results WHERE mode <> 'process' OR workload <> 'io' GROUP BY ALL),
c AS (SELECT lim.mode, lim.workload, lim.ordering, coalesce(n, 0) AS artifacts, CASE WHEN n IS NULL THEN 'missing' WHEN n < 2 THEN 'repetitions' WHEN g = 1 THEN 'lag or gaps' WHEN t < floor_tps THEN 'tps' WHEN p > ceil_p99 THEN 'p99' ELSE 'ok' END AS reason
  FROM lim LEFT JOIN s ON s.mode = lim.mode AND s.workload = lim.workload AND s.ordering = lim.ordering)"""


def _gated(spark, d) -> DataFrame:
    # every run counts as one of the right size: the fixture's groups have no fixed number of messages
    return B.release_gate(results(spark, d).where("mode <> 'process' OR workload <> 'io'").withColumn("messages", F.lit(10000)))


@query("WITH " + RESULTS_SQL + ", " + _LIMITS + _GATE + " SELECT mode, workload, ordering, artifacts, reason, CASE WHEN reason = 'ok' THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def release_gate_checks(spark, d):
    """A12, A13, A15."""
    return _gated(spark, d)


@query("WITH " + RESULTS_SQL + ", " + _LIMITS + _GATE + " SELECT CASE WHEN bool_or(reason <> 'ok') THEN 'NO-GO' ELSE 'PASS' END AS verdict, count(*) FILTER (WHERE reason <> 'ok') AS failed FROM c")
def release_verdict(spark, d):
    """The verdict."""
    return B.gate_verdict(_gated(spark, d))


@query("WITH o AS (SELECT event_type AS run, event_id, epoch_us(ts) AS us, user_id % 5 AS gaps FROM events), r AS (SELECT *, sum(CASE WHEN gaps > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY event_id) i FROM o), h AS (SELECT run, i, max(us) - min(us) t FROM r WHERE gaps > 0 GROUP BY run, i) SELECT run, coalesce(max(t), 0) AS longest FROM (SELECT DISTINCT run FROM o) LEFT JOIN h USING (run) GROUP BY run")
def persistent_gap(spark, d):
    """A14."""
    o = table(spark, d, "events").select(F.col("event_type").alias("run"), "event_id", micros("ts").alias("us"), (F.col("user_id") % 5).alias("gaps"))
    return B.longest_gap(o, ["run"], "event_id", "us", "gaps")


@query("WITH m AS (SELECT user_id % 20 AS run, CASE WHEN user_id % 3 = 0 THEN 'async' ELSE 'process' END AS mode, count(*) FILTER (WHERE event_type = 'view') AS a, 9 * count(*) FILTER (WHERE event_type <> 'view') AS b, count(*) * 15 AS items FROM events GROUP BY 1, 2) SELECT run, a + b AS flushes, round(b / (a + b), 6) AS timer_ratio, round(items / (a + b), 6) AS avg_batch, b / (a + b) >= 0.8 AND items / (a + b) <= 2.5 AS advise FROM m WHERE mode = 'process' AND a + b > 0")
def batch_advice(spark, d):
    """A21, M8."""
    e = table(spark, d, "events")
    m = e.groupBy((F.col("user_id") % 20).alias("run"), F.when(F.col("user_id") % 3 == 0, "async").otherwise("process").alias("mode")).agg(F.count_if(F.col("event_type") == "view").alias("size_flush"), (9 * F.count_if(F.col("event_type") != "view")).alias("timer_flush"), (F.count("*") * 15).alias("items"))
    m = m.withColumn("close_flush", F.lit(0)).withColumn("demand_flush", F.lit(0))
    return B.batch_advice(m).select("run", "flushes", F.round("timer_ratio", 6).alias("timer_ratio"), F.round("avg_batch", 6).alias("avg_batch"), "advise")


@query("WITH " + RESULTS_SQL + " SELECT count(*) AS runs, string_agg(DISTINCT workload, ',' ORDER BY workload) AS workloads, max(tps) AS best_tps FROM results")
def results_overview(spark, d):
    """A17."""
    return B.overview(results(spark, d))


@query("SELECT w AS workload, o AS ordering, m AS mode FROM (SELECT unnest(['sleep', 'cpu', 'io']) w), (SELECT unnest(['key_hash', 'partition']) o), (SELECT unnest(['async', 'process']) m)")
def benchmark_matrix(spark, d):
    """A23."""
    return B.benchmark_matrix(spark, ["sleep", "cpu", "io"], ["key_hash", "partition"], ["baseline", "async", "process"], True)


@query("""WITH l AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Starting run for topic ''t-' || user_id || '''' WHEN 'click' THEN 'Final TPS: ' || event_id || '.5' WHEN 'error' THEN 'Processed ' || event_id || ' messages' WHEN 'signup' THEN 'JSON summary written to x' ELSE 'noise' END v FROM events)
SELECT CASE WHEN v LIKE 'Starting%' THEN 'start' WHEN v LIKE 'Final%' THEN 'result' WHEN v LIKE 'Processed%' THEN 'progress' ELSE 'summary' END AS kind, nullif(regexp_extract(v, 'for topic ''([^'']+)''', 1), '') AS topic, nullif(regexp_extract(v, 'Final TPS: ([0-9.]+)', 1), '')::DOUBLE AS tps, nullif(regexp_extract(v, 'Processed ([0-9]+)', 1), '')::BIGINT AS processed FROM l WHERE v <> 'noise'""")
def log_lines(spark, d):
    """A16, S17."""
    e, i = table(spark, d, "events"), F.col("event_id").cast("string")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("Starting run for topic 't-"), F.col("user_id").cast("string"), F.lit("'"))).when(F.col("event_type") == "click", F.concat(F.lit("Final TPS: "), i, F.lit(".5"))).when(F.col("event_type") == "error", F.concat(F.lit("Processed "), i, F.lit(" messages"))).when(F.col("event_type") == "signup", "JSON summary written to x").otherwise("noise")
    return B.parse_log_lines(e.select(line.alias("value")))


@query("WITH " + RUNS_SQL + ", f AS (SELECT run, min(us) s FROM runs GROUP BY run) SELECT run, seq, CASE WHEN us > s THEN round((seq + 1) / ((us - s) / 1e6), 9) ELSE 0 END AS tps FROM runs JOIN f USING (run)")
def progress_tps(spark, d):
    """A24."""
    r = runs(spark, d)
    elapsed = (F.col("us") - F.col("s")) / F.lit(1e6)
    return r.join(r.groupBy("run").agg(F.min("us").alias("s")), "run").select("run", "seq", F.when(elapsed > 0, F.round((F.col("seq") + 1) / elapsed, 9)).otherwise(0.0).alias("tps"))


@query("""SELECT 'key-' || (i % 7) AS key, (i // 7)::BIGINT AS sequence, (i % 3)::INTEGER AS part FROM range(1000) t(i)""")
def produced_messages(spark, d):
    """Synthetic messages, with the payload read back as JSON."""
    return messages(spark, 1000, 7, 3).select(json_sequence(F.col("value").cast("string")).alias("j"), "part").select("j.key", "j.sequence", "part")


@query("SELECT event_type || CASE WHEN user_id % 3 = 0 THEN '!' ELSE '.x-1' END AS topic, user_id % 3 <> 0 AS valid, count(*) AS n FROM events GROUP BY 1, 2")
def topic_names(spark, d):
    """S7."""
    t = F.concat("event_type", F.when(F.col("user_id") % 3 == 0, "!").otherwise(".x-1"))
    return table(spark, d, "events").select(t.alias("topic"), valid_topic(t).alias("valid")).groupBy("topic", "valid").agg(F.count("*").alias("n"))


@query("SELECT 'sleep|io' AS picked")
def csv_selection(spark, d):
    """P8."""
    return spark.range(1).select(F.array_join(csv_choices(F.lit(" sleep, io ,sleep,"), ["sleep", "cpu", "io"]), "|").alias("picked"))


@query("WITH " + LOG_SQL + ", f AS (SELECT topic, part FROM log WHERE event_id % 50 = 7 AND event_id % 4 = 1) SELECT topic, part, count(*) AS in_flight FROM f GROUP BY topic, part UNION ALL SELECT NULL, NULL, count(*) FROM f")
def in_flight_counts(spark, d):
    """Work in flight by partition, and in all."""
    return R.in_flight_counts(_flying(message_log(spark, d)))


_TURNS = "h AS (SELECT topic, part, k AS route, min(event_id) AS activated FROM log GROUP BY ALL), q AS (SELECT topic, part, k AS route, row_number() OVER (PARTITION BY topic, part, k ORDER BY off) - 1 AS queue_pos FROM log), busy AS (SELECT DISTINCT topic, part, k AS route FROM log WHERE event_id % 50 = 7 AND event_id % 4 = 1)"


@query("WITH " + LOG_SQL + ", " + _TURNS + " SELECT topic, part, route, queue_pos, row_number() OVER (ORDER BY queue_pos, activated, topic, part, route) - 1 AS turn FROM q JOIN h USING (topic, part, route) WHERE (topic, part, route) NOT IN (SELECT topic, part, route FROM busy)")
def round_robin_turns(spark, d):
    """The order in which runnable queues give their items, one each in turn."""
    log = message_log(spark, d)
    heads = log.groupBy(*O.TP, F.col("k").alias("route")).agg(F.min("event_id").alias("activated"))
    busy = log.where("event_id % 50 = 7 AND event_id % 4 = 1").select(*O.TP, F.col("k").alias("route"))
    return R.round_robin(heads, busy, "key_hash", R.queue_ranks(log, "key_hash"))


@query("WITH " + COMPLETIONS_SQL + ", bad AS (SELECT topic, part, off, event_id FROM comp WHERE status = 'failure' AND attempt >= 3), pend AS (SELECT topic, part, off, (event_id % 6)::INTEGER AS n FROM bad WHERE event_id % 5 = 0) SELECT topic, part, off, 0 AS stage, n AS publish_attempts, n >= 4 AS exhausted FROM pend UNION ALL SELECT topic, part, off, 1, 0, false FROM bad ANTI JOIN pend USING (topic, part, off)")
def pending_ledger(spark, d):
    """Pending dead letters come before fresh ones, up to their publish attempts."""
    bad = completions(message_log(spark, d)).where(D.disposition() == "dlq")
    return D.publish_order(bad.where("event_id % 5 = 0").withColumn("publish_attempts", F.col("event_id") % 6), bad, 4)


@query("WITH " + COMPLETIONS_SQL + ", ok AS (SELECT topic, part, off FROM comp WHERE status = 'success'), bad AS (SELECT topic, part, off, event_id FROM comp WHERE status = 'failure'), d AS (SELECT topic, part, off FROM ok UNION SELECT topic, part, off FROM bad WHERE event_id % 3 = 0) SELECT topic, part, count(*) AS complete FROM d GROUP BY ALL")
def pending_hold_offsets(spark, d):
    """An offset whose dead letter is not published yet is not complete."""
    done = completions(message_log(spark, d))
    bad = done.where("status = 'failure'")
    return D.completed_offsets(done.where("status = 'success'"), bad.where("event_id % 3 = 0"), bad).groupBy(*O.TP).agg(F.count("*").alias("complete"))


@query("WITH " + LOG_SQL + " SELECT topic, part, count(*) AS cached FROM log WHERE event_id % 3 <> 0 AND part % 4 <> 1 GROUP BY ALL")
def cache_after_revoke(spark, d):
    """The payload cache without entries that were taken and without revoked partitions."""
    log = message_log(spark, d)
    return D.cache_without(log, log.where("event_id % 3 = 0"), log.where("part % 4 = 1").select(*O.TP).distinct()).groupBy(*O.TP).agg(F.count("*").alias("cached"))


_REG = "ev AS (SELECT user_id % 16 AS worker, event_id % 37 AS item, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'timeout' ELSE 'start' END AS kind, (user_id % 5)::INTEGER AS tries FROM events)"


@query("WITH " + _REG + """, l AS (SELECT worker, item, max(seq) FILTER (WHERE kind = 'start') AS s, max(seq) FILTER (WHERE kind = 'done') AS e FROM ev GROUP BY ALL),
o AS (SELECT worker, item, s FROM l WHERE s IS NOT NULL AND (e IS NULL OR e < s)), r AS (SELECT ev.worker, ev.item, max(tries) FILTER (WHERE kind = 'start') AS n, max(seq) FILTER (WHERE kind = 'timeout') AS late FROM ev JOIN o ON o.worker = ev.worker AND o.item = ev.item AND ev.seq >= o.s GROUP BY ALL)
SELECT worker, item, CASE WHEN late IS NOT NULL OR n >= 3 THEN 'failure' ELSE 'requeue' END AS action, CASE WHEN late IS NOT NULL THEN 'task_timeout' WHEN n >= 3 THEN 'worker_died_max_retries' END AS error, CASE WHEN late IS NOT NULL THEN 2 WHEN n >= 3 THEN n ELSE n + 1 END AS attempt FROM r WHERE worker % 4 = 0""")
def dead_worker_recovery(spark, d):
    """The registry of items in flight, and what becomes of those of dead workers."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "timeout").otherwise("start")
    events = e.select((F.col("user_id") % 16).alias("worker"), (F.col("event_id") % 37).alias("item"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("user_id") % 5).cast("int").alias("requeue_attempts"), F.lit(2).alias("attempt"), F.lit(None).cast("string").alias("timeout_error"))
    return D.recover_dead_workers(D.registry_state(events), events.where("worker % 4 = 0").select("worker").distinct())


@query("""WITH s AS (SELECT user_id % 6 AS consumer, max(event_id) AS top, count(*) AS n FROM events GROUP BY 1), f AS (SELECT unnest(['configured_max_in_flight', 'effective_max_in_flight', 'min_in_flight', 'scale_up_step', 'scale_down_step', 'cooldown_ms']) AS f),
g AS (SELECT unnest(['lag_scale_up_threshold', 'low_latency_threshold_ms', 'high_latency_threshold_ms', 'avg_completion_latency_seconds']) AS f), d AS (SELECT unnest(['scale_up', 'scale_down', 'hold', 'cooldown', 'disabled']) AS v)
SELECT consumer, 'adaptive_backpressure_' || f AS gauge, '' AS label, CASE WHEN consumer % 2 = 0 THEN 0 WHEN f = 'effective_max_in_flight' THEN n WHEN f = 'avg_completion_latency_seconds' THEN 0 ELSE top END::DOUBLE AS value FROM s, (FROM f UNION ALL FROM g)
UNION ALL SELECT consumer, 'adaptive_backpressure_last_decision', v, (v = CASE WHEN consumer % 2 = 0 THEN 'disabled' ELSE 'hold' END)::INTEGER::DOUBLE FROM s, d
UNION ALL SELECT consumer, 'adaptive_concurrency_' || f, '', CASE WHEN consumer % 3 = 0 THEN 0 WHEN f = 'effective_max_in_flight' THEN n ELSE top END::DOUBLE FROM s, f""")
def adaptive_gauges(spark, d):
    """M7: the gauges of both adaptive controllers, some of them off."""
    s = table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("consumer")).agg(F.max("event_id").alias("top"), F.count("*").alias("n"))

    def fields(names, *more):
        return F.struct(*[F.when(F.lit(f == "effective_max_in_flight"), F.col("n")).when(F.lit(f == "avg_completion_latency_seconds"), F.lit(None)).otherwise(F.col("top")).alias(f) for f in names], *more)

    s = s.withColumn("backpressure", F.when(F.col("consumer") % 2 != 0, fields(M.BACKPRESSURE_FIELDS, F.lit("hold").alias("last_decision")))).withColumn("concurrency", F.when(F.col("consumer") % 3 != 0, fields(M.CONCURRENCY_FIELDS)))
    return M.adaptive_gauges(s, ["consumer"])


@query("WITH " + STATE + """, g AS (SELECT topic, part, count(*) AS n, min(gap_start) AS b FROM gap GROUP BY ALL), x AS (SELECT topic, part, coalesce(n, 0) AS n, b, CASE WHEN part % 3 > 0 THEN b / 4.0 END AS age FROM assign LEFT JOIN g USING (topic, part))
SELECT topic, part, topic || '-' || part || ' queued=' || part || ' gaps=' || n || ' blocking=' || coalesce(b::VARCHAR, 'none') || ' age=' || CASE WHEN b IS NULL OR age IS NULL THEN 'n/a' ELSE printf('%.2fs', age) END AS line, coalesce(b IS NOT NULL AND age >= 5, false) AS warn FROM x""")
def diagnostics(spark, d):
    """The diagnostics line of each partition, and whether its blocking offset is to be warned of."""
    log = message_log(spark, d)
    m = M.partition_metrics(finished(log), _state(log), log.where("event_id % 50 = 7")).withColumn("queued", F.col("part")).withColumn("age", F.when(F.col("part") % 3 > 0, F.col("blocking") / 4.0))
    return M.diagnostics_line(m)


@query("WITH " + COMPLETIONS_SQL + " SELECT 'processed_total' AS metric, 'processed_total{topic=\"' || topic || '\",part=\"' || part || '\",status=\"' || status || '\"} ' || count(*) AS line FROM comp GROUP BY topic, part, status")
def metric_lines(spark, d):
    """Counters in the text exposition format."""
    return M.exposition(M.processed_total(completions(message_log(spark, d))).withColumn("metric", F.lit("processed_total")), ["topic", "part", "status"], value="processed")


_ART = "SELECT user_id AS artifact, CASE WHEN user_id % 5 = 1 THEN 9000 WHEN user_id % 5 = 2 THEN NULL ELSE 10000 END::BIGINT AS num_messages, CASE WHEN user_id % 7 = 3 THEN 4 ELSE 8 END::BIGINT AS num_partitions, user_id % 11 = 4 AS profile, user_id % 3 = 0 AS mixed FROM (SELECT DISTINCT user_id FROM events)"
_CONDITIONS = f"o AS ({_ART}), cond AS (SELECT artifact, 'num_messages' AS reason FROM o WHERE num_messages IS DISTINCT FROM 10000 UNION ALL SELECT artifact, 'num_partitions' FROM o WHERE num_partitions <> 8 UNION ALL SELECT artifact, 'strict' FROM o WHERE mixed UNION ALL SELECT artifact, 'profiling' FROM o WHERE profile)"


def _conditions(spark, d) -> DataFrame:
    u = F.col("user_id")
    o = table(spark, d, "events").select("user_id").distinct().select(u.alias("artifact"), F.when(u % 5 == 1, 9000).when(u % 5 == 2, None).otherwise(10000).cast("long").alias("num_messages"), F.when(u % 7 == 3, 4).otherwise(8).cast("long").alias("num_partitions"), F.when(u % 3 == 0, F.array(F.lit("on"), F.lit("off"))).otherwise(F.array(F.lit("on"))).alias("strict"), (u % 11 == 4).alias("profile"), F.lit(None).cast("boolean").alias("py_spy"))
    return B.measurement_conditions(o)


@query("WITH " + _CONDITIONS + " SELECT artifact, reason, 'FAIL' AS status FROM cond")
def gate_conditions(spark, d):
    """Artifacts that were not measured as the gate asks."""
    return _conditions(spark, d)


_HELD = """ob AS (SELECT user_id % 40 AS artifact, event_id AS seq, CAST(event_id // 97 AS VARCHAR) AS run, event_id / 10.0 AS el, user_id % 6 AS g FROM events),
ob2 AS (SELECT *, CASE WHEN g > 0 AND lag(run) OVER w IS NOT DISTINCT FROM run THEN 0 ELSE 1 END AS turn FROM ob WINDOW w AS (PARTITION BY artifact ORDER BY seq)), ob3 AS (SELECT *, sum(turn) OVER (PARTITION BY artifact ORDER BY seq) AS st FROM ob2),
held AS (SELECT artifact FROM (SELECT artifact, st, max(el) - min(el) AS t FROM ob3 WHERE g > 0 GROUP BY artifact, st) GROUP BY artifact HAVING max(t) > 5)"""


def _held(spark, d) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("artifact"), F.col("event_id").alias("seq"), F.expr("event_id div 97").cast("string").alias("run"), (F.col("event_id") / 10.0).alias("elapsed_sec"), (F.col("user_id") % 6).alias("gap_count"))
    return B.persistent_gaps(e, limit_s=5.0)


@query("WITH " + _HELD + " SELECT artifact, 'persistent_gap' AS reason, 'FAIL' AS status FROM held")
def gate_persistent_gaps(spark, d):
    """Artifacts in which a gap stayed open too long, with a limit of 5 seconds for these data."""
    return _held(spark, d)


@query("WITH " + RESULTS_SQL + ", " + _LIMITS + _GATE + ", " + _CONDITIONS + ", " + _HELD + ", a AS (SELECT reason <> 'ok' AS bad FROM c UNION ALL SELECT true FROM cond UNION ALL SELECT true FROM held) SELECT CASE WHEN bool_or(bad) THEN 'NO-GO' ELSE 'PASS' END AS verdict, count(*) FILTER (WHERE bad) AS failed FROM a")
def release_decision(spark, d):
    """The verdict from thresholds, conditions and persistent gaps."""
    return B.gate_verdict(_gated(spark, d), _conditions(spark, d), _held(spark, d))


@query("SELECT event_id, CASE WHEN t THEN 1 ELSE b END AS effective_size, CASE WHEN t THEN 0 END AS effective_wait_ms FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 32 END AS b, user_id % 2 = 0 AND event_id % 3 > 0 AND value <= 5 AND user_id % 4 <> 0 AS t FROM events)")
def auto_batching(spark, d):
    """Effective micro-batch options of process runs."""
    u = F.col("user_id")
    o = table(spark, d, "events").select("event_id", F.lit(False).alias("skip_process"), F.array(F.lit("sleep"), F.lit("io")).alias("workloads"), F.array(F.when(u % 2 == 0, "partition").otherwise("key_hash")).alias("orderings"), F.array(F.when(F.col("event_id") % 3 > 0, "on").otherwise("off")).alias("strict"), (F.col("value") / 10).alias("sleep_ms"), F.when(u % 4 == 0, 32).alias("batch_size"), *[F.lit(None).cast("int").alias(c) for c in ("max_wait_ms", "flush_policy", "min_residence_ms")])
    return B.auto_batching(o).select("event_id", "effective_size", "effective_wait_ms")


@query("SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'n/a' ELSE (CASE WHEN v >= 0 THEN '+' ELSE '' END) || printf('%.2f', v) || '%' END AS change, CASE WHEN user_id % 9 = 0 THEN 'n/a' ELSE printf('%.2f', v) || 'x' END AS ratio, CASE WHEN user_id % 9 = 0 THEN 'n/a' ELSE printf('%,d', event_id) END AS whole FROM (SELECT *, ((event_id * 37) % 4001 - 2000) / 8.0 AS v FROM events)".replace("printf('%,d', event_id)", "format('{:,}', event_id)"))
def number_formats(spark, d):
    """Signed numbers, ratios and thousands, n/a where there is none."""
    v = F.when(F.col("user_id") % 9 != 0, ((F.col("event_id") * 37) % 4001 - 2000) / 8.0)
    return table(spark, d, "events").select("event_id", B.signed(v, 2, "%").alias("change"), B.times(v).alias("ratio"), B.human(F.when(F.col("user_id") % 9 != 0, F.col("event_id")), 0).alias("whole"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'key_hash' WHEN 1 THEN 'unordered' WHEN 2 THEN 'partition' ELSE 'key_hash' END AS ordering FROM events")
def ordering_of_runs(spark, d):
    """The ordering mode by the name of the run, else of the topic, else key_hash."""
    k = F.col("event_id") % 4
    run = F.when(k == 0, "async-key_hash-1").when(k == 1, "process-unordered").otherwise("x")
    return table(spark, d, "events").select("event_id", B.order_of(run, F.when(k == 2, "bench-partition-8").otherwise("bench")).alias("ordering"))


@query("SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, event_id / 4.0 AS elapsed_sec, user_id % 9 AS lag, user_id % 4 AS gap_count FROM events WHERE event_id % 20 = 0")
def merged_observations(spark, d):
    """Observations of all results, with their runs."""
    e = table(spark, d, "events").where("event_id % 20 = 0")
    o = F.struct("event_id", (F.col("event_id") / 4.0).alias("elapsed_sec"), (F.col("user_id") % 9).alias("lag"), (F.col("user_id") % 4).alias("gap_count"))
    results_ = e.groupBy(F.col("event_type").alias("run")).agg(F.transform(F.array_sort(F.collect_list(o)), lambda x: F.struct(x.elapsed_sec.alias("elapsed_sec"), x.lag.alias("lag"), x.gap_count.alias("gap_count"))).alias("observations"))
    return B.merge_observations(results_).withColumn("seq", F.col("seq").cast("long"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 WHEN 2 THEN event_id + 2 END AS final_lag FROM events")
def coalesced_finals(spark, d):
    """The first whole number of three places; true and fractions are no numbers of messages."""
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    one = F.when(k == 0, F.concat(F.lit('{"final_lag": '), i, F.lit("}"))).when(k == 1, F.concat(F.lit('{"final_lag": true, "consumer_parallel_lag": '), (F.col("event_id") + 1).cast("string"), F.lit("}")))
    two = F.when(k == 2, F.concat(F.lit('{"final_lag": 1.5, "completion_metrics": {"consumer_parallel_lag": '), (F.col("event_id") + 2).cast("string"), F.lit("}}"))).when(k == 3, F.lit('{"final_lag": "7"}')).otherwise(F.lit("not json"))
    return table(spark, d, "events").select("event_id", B.whole_number(F.coalesce(one, two), "$.final_lag", "$.consumer_parallel_lag", "$.completion_metrics.consumer_parallel_lag").alias("final_lag"))


@query("WITH " + STATE + """, g AS (SELECT topic, part, count(*) AS n, min(gap_start) AS b FROM gap GROUP BY ALL), q AS (SELECT topic, part, count(*) AS n FROM log WHERE event_id % 50 = 7 GROUP BY ALL),
fl AS (SELECT topic, part, count(*) AS n, min(off) AS lo FROM log WHERE event_id % 50 = 7 AND event_id % 4 = 1 GROUP BY ALL),
x AS (SELECT topic, part, concat_ws('|', part, part + 1, committed, fetched, greatest(0, fetched - committed), coalesce(g.n, 0), coalesce(b, -1), CASE WHEN b % 2 = 0 THEN b * 2 ELSE -1 END, coalesce(q.n, 0), coalesce(fl.n, 0), coalesce(lo, -1)) AS line
  FROM assign JOIN fetched USING (topic, part) LEFT JOIN g USING (topic, part) LEFT JOIN q USING (topic, part) LEFT JOIN fl USING (topic, part))
SELECT (SELECT count(*) FROM log WHERE event_id % 50 = 7 AND event_id % 4 = 1) AS total_in_flight, (SELECT count(*) FROM log WHERE event_id % 50 = 7) AS total_queued, 1000 AS max_in_flight, 'key_hash' AS ordering_mode, 3 AS max_retries, 'events.dlq' AS dlq_topic,
  (SELECT sum(strlen(v))::BIGINT FROM log WHERE event_id % 3 = 0) AS cache_bytes, (SELECT count(*) FROM log WHERE event_id % 3 = 0) AS cache_entries,
  (SELECT count(*) FROM (SELECT topic, part, k FROM log WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 3)) AS open_circuits, true AS not_adaptive, string_agg(line, ';' ORDER BY topic, part) AS parts FROM x""")
def snapshot_sections(spark, d):
    """The whole snapshot with its queue, retry, dead-letter, poison and adaptive sections, shown flat."""
    log = message_log(spark, d)
    state = _state(log).withColumn("epoch", F.col("part") + 1)
    ages = log.where("event_id % 50 = 7 OR (event_type = 'error' AND event_id % 200 = 3)").where("off % 2 = 0").select(*O.TP, F.col("off").alias("head"), (F.col("off") * 2).alias("age"))
    parts = M.partition_runtime(finished(log), state, log.where("event_id % 50 = 7"), _flying(log), ages)
    circuits = log.groupBy(*O.TP, "k").agg((F.count_if(F.col("event_type") == "error") >= 3).alias("open"))
    s = M.full_snapshot(parts, LogOptions("events"), log.where("event_id % 3 = 0").select(F.octet_length("v").alias("bytes")), circuits, {"enabled": True, "failure_threshold": 3, "cooldown_ms": 30000})
    shown = F.transform("partitions", lambda p: F.concat_ws("|", *[F.coalesce(x.cast("long").cast("string"), F.lit("-1")) for x in (p.part, p.epoch, p.committed, p.fetched, p.lag, F.size(p.gaps), p.blocking, p.blocked_s, p.queued, p.in_flight, p.min_in_flight)]))
    return s.select(
        "queue.total_in_flight", "queue.total_queued", "queue.max_in_flight", "queue.ordering_mode", "retry.max_retries", F.col("dlq.topic").alias("dlq_topic"), F.col("dlq.message_cache_size_bytes").alias("cache_bytes"), F.col("dlq.message_cache_entry_count").alias("cache_entries"),
        F.col("poison_message.open_circuit_count").alias("open_circuits"), (F.col("adaptive_concurrency").isNull() & F.col("adaptive_backpressure").isNull()).alias("not_adaptive"), F.array_join(shown, ";").alias("parts"),
    )


@query("""WITH RECURSIVE l AS (SELECT user_id % 10 AS series, event_id, user_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'result' WHEN 'error' THEN 'processed' WHEN 'signup' THEN 'target' END AS kind, event_id % 4 <> 0 AS known,
  'bench-' || CASE event_id % 3 WHEN 0 THEN 'sleep' WHEN 1 THEN 'cpu' ELSE 'io' END || CASE WHEN event_id % 2 = 0 THEN '-key_hash' ELSE '-partition' END || CASE event_id % 4 WHEN 1 THEN '-async' WHEN 2 THEN '-process' WHEN 3 THEN '-baseline' ELSE '-other' END || CASE WHEN event_id % 5 < 3 THEN '-strict-on' ELSE '-strict-off' END AS topic FROM events),
e AS (SELECT *, kind = 'start' AND known AS counts, row_number() OVER (PARTITION BY series ORDER BY event_id) AS rn, kind = 'start' AND known AND row_number() OVER (PARTITION BY series, kind, topic ORDER BY event_id) = 1 AS opens FROM l WHERE kind IS NOT NULL),
f AS (SELECT DISTINCT series, 0::BIGINT AS rn, 0::BIGINT AS event_id, '' AS kind, NULL::VARCHAR AS run_topic, 0::BIGINT AS target, 0::BIGINT AS processed, 0::BIGINT AS started, 0::BIGINT AS completed FROM e
  UNION ALL
  SELECT e.series, e.rn, e.event_id, e.kind, CASE WHEN e.kind = 'start' THEN e.topic ELSE f.run_topic END, CASE WHEN e.counts THEN 0 WHEN e.kind = 'target' THEN e.user_id ELSE f.target END, CASE WHEN e.counts THEN 0 WHEN e.kind = 'processed' THEN e.event_id ELSE f.processed END,
    f.started + CASE WHEN e.opens THEN 1 ELSE 0 END, CASE WHEN e.kind = 'result' THEN least(f.started, f.completed + 1) ELSE f.completed END FROM f JOIN e ON e.series = f.series AND e.rn = f.rn + 1)
SELECT series, event_id, kind, run_topic, target, processed, started, completed, least(24.0, completed + 0.5 * (started - completed))::DOUBLE AS progress FROM f WHERE rn > 0""")
def log_progress(spark, d):
    """Runs, targets and progress after each line of benchmark logs."""
    e, i = table(spark, d, "events"), F.col("event_id")
    load = F.when(i % 3 == 0, "sleep").when(i % 3 == 1, "cpu").otherwise("io")
    topic = F.concat(F.lit("bench-"), load, F.when(i % 2 == 0, "-key_hash").otherwise("-partition"), F.when(i % 4 == 1, "-async").when(i % 4 == 2, "-process").when(i % 4 == 3, "-baseline").otherwise("-other"), F.when(i % 5 < 3, "-strict-on").otherwise("-strict-off"))
    t = F.col("event_type")
    line = F.when(t == "view", F.concat(F.lit(" Starting consumer for topic '"), topic, F.lit("'"))).when(t == "click", F.concat(F.lit("Final TPS: "), i.cast("string"), F.lit(".5")))
    line = F.coalesce(line, F.when(t == "error", F.concat(F.lit("Processed "), i.cast("string"), F.lit(" messages"))).when(t == "signup", F.concat(F.lit("Target messages to process: "), F.col("user_id").cast("string"))), F.lit("noise"))
    return B.run_progress(B.log_events(e.select((F.col("user_id") % 10).alias("series"), "event_id", line.alias("value"))), ["series"], "event_id", 24)


@query("WITH " + RESULTS_SQL + ", n AS (SELECT *, mode || '-' || workload || '-' || ordering || '-' || artifact AS run FROM results) SELECT count(*) AS runs, string_agg(DISTINCT workload, ',' ORDER BY workload) AS workloads, (SELECT run FROM n ORDER BY tps DESC, run LIMIT 1) AS best_run, max(tps) AS best_tps FROM n")
def best_run(spark, d):
    """The overview with the fastest run."""
    return B.best_run(results(spark, d).withColumn("run", F.concat_ws("-", "mode", "workload", "ordering", F.col("artifact").cast("string"))))


@query("WITH " + LOG_SQL + " SELECT part, off, row_number() OVER (PARTITION BY part ORDER BY off) AS seen, row_number() OVER (PARTITION BY part ORDER BY off) % 100 = 0 AS commits FROM log WHERE event_id % 11 <> 0 AND event_id % 13 <> 0")
def baseline_commits(spark, d):
    """What a sequential consumer works on, and where it commits."""
    v = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.unhex(F.lit("FF41"))).otherwise(F.coalesce("v", F.lit("")).cast("binary"))
    return B.baseline_commits(message_log(spark, d).withColumn("payload", v), ["part"], "off", "payload")


_FINAL = "CASE WHEN length(rle) + 1 > 4000 AND (length(bits) + 1 > 4000 OR bits = '') THEN 'O' WHEN length(bits) + 1 > 4000 OR bits = '' THEN 'R' || rle WHEN length(rle) + 1 > 4000 THEN 'B' || bits WHEN length(rle) <= length(bits) THEN 'R' || rle ELSE 'B' || bits END AS metadata"


@query("WITH " + STATE + _LEFT + _RLE + _BITS + ", coded AS (SELECT topic, part, " + _FINAL + " FROM rle JOIN bits USING (topic, part, base)) SELECT topic, part, hwm + 1 AS next_offset, coalesce(metadata, 'R') AS metadata FROM mark LEFT JOIN coded USING (topic, part) WHERE hwm >= 0 AND part % 2 = 1")
def final_commits(spark, d):
    """The last commits of revoked partitions, with the metadata of what is finished beyond them."""
    log = message_log(spark, d)
    state = _state(log)
    return C.final_commits(finished(log), state, state.where("part % 2 = 1"))


@query("WITH " + STATE + _LEFT + _RLE + _BITS + ", coded AS (SELECT topic, part, " + _FINAL + " FROM rle JOIN bits USING (topic, part, base)) SELECT topic, part, off FROM left_over JOIN coded USING (topic, part) WHERE metadata <> 'O' AND part % 4 < 2 AND off > base + 5")
def restored_offsets(spark, d):
    """Finished offsets from the commit's metadata, else from the partition's, else none."""
    coded, p = C.encode(_left_over(spark, d), O.TP), F.col("part") % 4
    return C.restore(coded.select(*O.TP, (F.col("base") + 5).alias("committed"), F.when(p == 0, F.col("metadata")).when(p == 1, "").when(p == 2, "Rx-1").alias("metadata"), F.when(p == 1, F.col("metadata")).alias("partition_metadata")))


@query("WITH " + COMPLETIONS_SQL + f", b AS (SELECT topic, part, 'latency_seconds_bucket' AS metric, CASE WHEN le = 'Infinity' THEN '+Inf' ELSE le::VARCHAR END AS le, count(*) FILTER (WHERE latency_ms / 1000 <= le)::DOUBLE AS value FROM comp, {_LE} GROUP BY ALL) FROM b UNION ALL SELECT topic, part, 'latency_seconds_sum', '', round(sum(latency_ms / 1000), 6) FROM comp GROUP BY ALL UNION ALL SELECT topic, part, 'latency_seconds_count', '', count(*)::DOUBLE FROM comp GROUP BY ALL")
def histogram_samples(spark, d):
    """M4: buckets, sum and count."""
    e = completions(message_log(spark, d)).withColumn("seconds", F.col("latency_ms") / 1000)
    return M.histogram_samples(e, "seconds", "latency_seconds").withColumn("value", F.round("value", 6))


_GROW = "s AS (SELECT user_id % 25 AS consumer, epoch_us(ts) // 60000000 AS minute, event_id, value FROM events), v AS (SELECT consumer, minute * 60000000 AS us, count(*) + max(event_id) // 40 AS lag FROM s GROUP BY ALL)"


@query("WITH " + _GROW + ", x AS (SELECT a.consumer, a.us, a.lag, (SELECT list(b.lag ORDER BY b.us) FROM v b WHERE b.consumer = a.consumer AND b.us BETWEEN a.us - 3600000000 AND a.us) AS h, (SELECT min(us) FROM v c WHERE c.consumer = a.consumer) AS begun FROM v a) SELECT consumer, us, lag AS value FROM x WHERE us - begun >= 3600000000 AND h = list_sort(h) AND lag > h[1]")
def alert_growth(spark, d):
    """A lag that has grown for an hour (these data are too thin for five minutes)."""
    e = table(spark, d, "events").select((F.col("user_id") % 25).alias("consumer"), micros("ts").alias("at"), "event_id")
    v = e.groupBy("consumer", (F.expr("at div 60000000") * 60_000_000).alias("us")).agg((F.count("*") + F.expr("max(event_id) div 40")).alias("lag"))
    return M.growing(v, ["consumer"], "us", "lag", 60)


@query("WITH " + COMPLETIONS_SQL + " SELECT topic, epoch_us(date_trunc('minute', ts)) AS start_us, count(*) FILTER (WHERE status = 'failure') AS failures, count(*) AS completions, count(*) FILTER (WHERE status = 'failure') / count(*) > 0.01 AS alert FROM comp GROUP BY ALL")
def alert_failures(spark, d):
    """Minutes in which more than 1 % of the completions failed."""
    out = M.failure_share(completions(message_log(spark, d)), "ts", ["topic"])
    return out.select("topic", micros("start").alias("start_us"), "failures", "completions", "alert")


@query("SELECT max(event_id) AS largest, sum(event_id)::BIGINT AS total FROM events WHERE event_type IN ('view', 'click')")
def gauge_totals(spark, d):
    """Largest and summed gauge over the labels that match a pattern."""
    return M.over_labels(table(spark, d, "events"), "event_type", "view|click", "event_id")


@query("SELECT w AS workload, o AS ordering, s AS strict, a AS adaptive, m AS mode FROM (SELECT unnest(['sleep', 'io']) w), (SELECT unnest(['key_hash', 'partition']) o), (SELECT unnest(['on', 'off']) s), (SELECT unnest(['on', 'off']) a), (SELECT unnest(['baseline', 'async', 'process']) m)")
def full_matrix(spark, d):
    """A23 with strict and adaptive runs."""
    return B.benchmark_matrix(spark, ["sleep", "io"], ["key_hash", "partition"], ["baseline", "async", "process"], strict=["on", "off"], adaptive=["on", "off"])
