"""Queries on delivery, pending entries, dead letters, retries and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import delivery as D
from millrace.operators import log as L
from millrace.operators import ranking
from millrace.sources import tables as T

from .registry import EV, LOG, query

MOST = 3
_ATT = f"att AS (SELECT ev.*, a.attempt::INT AS attempt, a.attempt <= event_id % 5 AS failed FROM ev, (SELECT unnest([1, 2, 3]) AS attempt) a WHERE a.attempt <= least(event_id % 5 + 1, {MOST}))"


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return D.attempts(T.events(spark, d).drop("_hour"), F.pmod("event_id", F.lit(5)), MOST)


@query(f"WITH {EV} SELECT event_id, event_id % 5 = 0 AS processed FROM ev WHERE event_id % 10 >= 3")
def at_most_once(spark: SparkSession, d: str) -> DataFrame:
    lost = F.pmod("event_id", F.lit(10)) < 3
    return D.at_most_once(T.events(spark, d), lost, F.pmod("event_id", F.lit(5))).select("event_id", "processed")


@query(f"WITH {EV}, {_ATT} SELECT event_id, attempt, failed, attempt > 1 AS redelivered FROM att")
def at_least_once_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).select("event_id", "attempt", "failed", "redelivered")


@query(f"WITH {EV} SELECT event_id, {MOST} AS attempts FROM ev WHERE event_id % 5 >= {MOST}")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).filter("dead").select("event_id", F.col("attempt").alias("attempts"))


@query(f"WITH {EV}, {_ATT} SELECT event_id, min(attempt) AS applied_on FROM att WHERE NOT failed GROUP BY 1")
def idempotent_apply(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).filter(~F.col("failed")).groupBy("event_id").agg(F.min("attempt").alias("applied_on"))


@query(f"WITH {EV}, {_ATT} SELECT event_id, count(*) AS delivery_count FROM att GROUP BY 1")
def delivery_counts(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).groupBy("event_id").agg(F.count("*").alias("delivery_count"))


@query("""SELECT event_id, event_id % 4 = 0 AS has_duplicate, CASE WHEN event_id % 5 = 0 THEN 'applied' WHEN event_id % 4 = 0 THEN 'lost' ELSE 'pending' END AS outcome FROM events""")
def dedup_inflight_loss(spark: SparkSession, d: str) -> DataFrame:
    """A duplicate that comes while the first effect is under way is acknowledged; if that effect then fails, the message is lost."""
    dup, fails = F.pmod("event_id", F.lit(4)) == 0, F.pmod("event_id", F.lit(5)) != 0
    return T.events(spark, d).select("event_id", dup.alias("has_duplicate"), F.when(~fails, "applied").when(dup, "lost").otherwise("pending").alias("outcome"))


# -- pending entries


_PEL = f"""pel AS (SELECT event_id AS id, (seq % 3)::INT AS consumer, (SELECT max(ts_us) FROM log) - ts_us AS idle_us, 1 + event_id % 3 AS delivery_count, event_id % 11 = 0 AS deleted
  FROM log WHERE event_id % 5 <> 0)"""


def _pending(spark: SparkSession, d: str) -> DataFrame:
    """What was delivered and not acknowledged, of the whole log."""
    log = T.log(spark, d)
    now = log.agg(F.max("ts_us").alias("now"))
    acked = log.filter(F.pmod("event_id", F.lit(5)) == 0).select("event_id")
    left = log.join(acked, "event_id", "left_anti").join(F.broadcast(now))
    return left.select(
        F.col("event_id").alias("id"), F.pmod("seq", F.lit(3)).cast("int").alias("consumer"), (F.col("now") - F.col("ts_us")).alias("idle_us"), (1 + F.pmod("event_id", F.lit(3))).alias("delivery_count"),
        (F.pmod("event_id", F.lit(11)) == 0).alias("deleted"),
    )


@query(f"WITH {LOG}, {_PEL} SELECT consumer, count(*) AS pending, min(id) AS first_id, max(id) AS last_id FROM pel GROUP BY 1")
def pel_summary(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).groupBy("consumer").agg(F.count("*").alias("pending"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {LOG}, {_PEL} SELECT id, consumer, idle_us, delivery_count FROM pel")
def pel_entries(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("id", "consumer", "idle_us", "delivery_count")


_DAY = 86_400_000_000


@query(f"WITH {LOG}, {_PEL} SELECT id, 'rescuer' AS consumer, 0::BIGINT AS idle_us, delivery_count + 1 AS delivery_count FROM pel WHERE idle_us >= 20 * {_DAY} AND NOT deleted")
def claim_stale(spark: SparkSession, d: str) -> DataFrame:
    return D.stale_claims(_pending(spark, d), 20 * _DAY, "rescuer").filter(~F.col("deleted")).drop("deleted")


@query(f"WITH {LOG}, {_PEL} SELECT id FROM pel WHERE idle_us >= 20 * {_DAY} AND deleted")
def claim_deleted_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.stale_claims(_pending(spark, d), 20 * _DAY, "rescuer").filter("deleted").select("id")


@query(f"WITH {LOG} SELECT (seq % 4)::INT AS consumer, count(*) AS taken, count(*) FILTER (event_id % 7 <> 0) AS acked, count(*) FILTER (event_id % 7 = 0) AS pending FROM log GROUP BY 1")
def competing_consumers(spark: SparkSession, d: str) -> DataFrame:
    ok = F.pmod("event_id", F.lit(7)) != 0
    return T.log(spark, d).groupBy(F.pmod("seq", F.lit(4)).cast("int").alias("consumer")).agg(F.count("*").alias("taken"), F.count_if(ok).alias("acked"), F.count_if(~ok).alias("pending"))


@query(f"WITH {LOG} SELECT seq, event_id, (seq % 2)::INT AS consumer, CASE WHEN event_id % 3 = 0 THEN 'acked' WHEN seq <= 4000 THEN 'processing' ELSE 'queued' END AS state FROM log WHERE event_id % 3 <> 0 OR seq <= 4000")
def processing_list(spark: SparkSession, d: str) -> DataFrame:
    """Where each message of a reliable queue is after 4000 dequeues; acknowledged ones of those leave their list."""
    log = T.log(spark, d)
    state = F.when(F.pmod("event_id", F.lit(3)) == 0, "acked").when(F.col("seq") <= 4000, "processing").otherwise("queued")
    rows = log.select("seq", "event_id", F.pmod("seq", F.lit(2)).cast("int").alias("consumer"), state.alias("state"))
    return rows.filter("state <> 'acked' or seq <= 4000")


@query(f"""WITH {LOG}, p AS (SELECT seq, event_id, CASE WHEN seq <= 4000 THEN 0 ELSE 1 END AS part FROM log WHERE NOT (seq <= 4000 AND event_id % 3 = 0))
SELECT row_number() OVER (ORDER BY part, seq) AS position, event_id FROM p""")
def recover_stale_order(spark: SparkSession, d: str) -> DataFrame:
    """Unfinished messages go back to the head of the queue in their first order."""
    log = T.log(spark, d).filter(~((F.col("seq") <= 4000) & (F.pmod("event_id", F.lit(3)) == 0)))
    log = log.withColumn("_b", F.floor(F.col("seq") / 1000))
    return L.global_sequence(log, ["seq"], "_b", "position").select("position", "event_id")


# -- dead letters


def _consumed(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth message kills its consumers."""
    return D.consumed(T.events(spark, d).drop("_hour"), F.pmod("event_id", F.lit(5)), F.pmod("event_id", F.lit(20)) == 19, MOST)


def _dead(spark: SparkSession, d: str) -> DataFrame:
    rows, tries = _consumed(spark, d).filter("dead"), F.col("attempt").cast("string")
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("user")))
    error = F.when(F.col("handled"), F.concat(F.lit("handler failed on attempt "), tries)).otherwise(F.concat(F.lit("consumers died, delivery count "), tries))
    return D.dead_letter(rows, F.col("event_id"), error, F.col("attempt"), F.col("ts_us") + F.col("attempt") * 200_000, payload)


#: The consume loop step by step: each message as it stands after its n-th delivery.
_LOOP = f"""loop(event_id, n, runs, failures, outcome) AS (
  SELECT event_id, 0, 0, 0, 'pending' FROM events
  UNION ALL
  SELECT event_id, n + 1, runs + CASE WHEN event_id % 20 = 19 THEN 0 ELSE 1 END, failures + CASE WHEN event_id % 20 <> 19 AND n < event_id % 5 THEN 1 ELSE 0 END,
    CASE WHEN n + 1 > {MOST} THEN 'dead_without_handler' WHEN event_id % 20 = 19 THEN 'pending' WHEN n >= event_id % 5 THEN 'acked' WHEN n + 1 = {MOST} THEN 'dead' ELSE 'pending' END
  FROM loop WHERE outcome = 'pending'),
done AS (SELECT * FROM loop WHERE outcome <> 'pending')"""
_DLQ = f"""{_LOOP}, dlq AS (SELECT event_id::VARCHAR AS original_id, CASE outcome WHEN 'dead' THEN 'handler failed on attempt ' ELSE 'consumers died, delivery count ' END || n AS error,
  n::VARCHAR AS attempts, (ts_us + n * 200000)::VARCHAR AS failed_at, '{{"type":"' || event_type || '","user":"' || user_id || '"}}' AS payload FROM ev JOIN done USING (event_id) WHERE outcome <> 'acked')"""


@query(f"WITH RECURSIVE {EV}, {_DLQ} SELECT * FROM dlq")
def dlq_entries(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d)


@query(f"""WITH RECURSIVE {_LOOP} SELECT count(*) FILTER (outcome = 'acked') AS succeeded, sum(failures)::BIGINT AS failed, count(*) FILTER (outcome <> 'acked') AS dead_lettered FROM done""")
def dlq_consume_stats(spark: SparkSession, d: str) -> DataFrame:
    """A delivery that the handler never saw is no success and no failure, but a dead letter."""
    ok = F.col("handled") & ~F.col("failed")
    return _consumed(spark, d).agg(F.count_if(ok).alias("succeeded"), F.count_if("failed").alias("failed"), F.count_if("dead").alias("dead_lettered"))


@query(f"WITH RECURSIVE {_LOOP} SELECT event_id, n::BIGINT AS attempts, runs::BIGINT AS handler_runs, outcome FROM done")
def dlq_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each message: deliveries, runs of the handler, and how it ended."""
    last = F.max_by(F.struct("dead", "handled"), "attempt").alias("last")
    per = _consumed(spark, d).groupBy("event_id").agg(F.count("*").alias("attempts"), F.count_if("handled").alias("handler_runs"), last)
    outcome = F.when(~F.col("last.dead"), "acked").when(F.col("last.handled"), "dead").otherwise("dead_without_handler")
    return per.select("event_id", "attempts", "handler_runs", outcome.alias("outcome"))


@query(f"""WITH RECURSIVE {EV}, {_DLQ} SELECT original_id, payload, row_number() OVER (ORDER BY failed_at::BIGINT, original_id::BIGINT) AS replay_no FROM dlq
ORDER BY failed_at::BIGINT, original_id::BIGINT LIMIT 200""")
def dlq_replay(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 200 dead letters, back with their own fields under new numbers."""
    order = [F.col("failed_at").cast("bigint"), F.col("original_id").cast("bigint")]
    top = _dead(spark, d).orderBy(*order).limit(200)
    return top.select("original_id", "payload", F.row_number().over(W.orderBy(*order)).cast("bigint").alias("replay_no"))


# -- retries


@query(f"""WITH {EV} SELECT event_id, r.run::INT AS run, ts_us + r.run * 500000 AS due_us, event_id % 5 > 2 AS goes_to_dlq FROM ev, (SELECT unnest([0, 1, 2]) AS run) r WHERE r.run <= least(event_id % 5, 2)""")
def retry_ttl_timeline(spark: SparkSession, d: str) -> DataFrame:
    runs = D.schedule(T.events(spark, d), F.col("ts_us"), F.pmod("event_id", F.lit(5)), 2, F.col("run") * 500_000)
    return runs.select("event_id", "run", F.col("due").alias("due_us"), (F.pmod("event_id", F.lit(5)) > 2).alias("goes_to_dlq"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'reject' ELSE 'nack' END AS action, event_id % 5 AS requeues,
  CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE 0 END AS delivery_count, event_id % 5 + 1 AS acquired_count FROM events""")
def reject_vs_nack_counts(spark: SparkSession, d: str) -> DataFrame:
    n, rejects = F.pmod("event_id", F.lit(5)), F.pmod("event_id", F.lit(2)) == 0
    return T.events(spark, d).select(
        "event_id", F.when(rejects, "reject").otherwise("nack").alias("action"), n.alias("requeues"), F.when(rejects, n).otherwise(F.lit(0).cast("bigint")).alias("delivery_count"), (n + 1).alias("acquired_count")
    )


@query(f"""WITH {EV} SELECT event_id, (r.run + 1)::INT AS delivery, ts_us + r.run * 1000000 AS due_us FROM ev, (SELECT unnest([0, 1, 2]) AS run) r WHERE r.run <= least(event_id % 5, {MOST} - 1)""")
def ack_wait_redelivery(spark: SparkSession, d: str) -> DataFrame:
    runs = D.schedule(T.events(spark, d), F.col("ts_us"), F.pmod("event_id", F.lit(5)), MOST - 1, F.col("run") * 1_000_000)
    return runs.select("event_id", (F.col("run") + 1).alias("delivery"), F.col("due").alias("due_us"))


@query(f"WITH {LOG} SELECT 'EVENTS' AS stream, 'worker' AS consumer, seq AS stream_seq, {MOST} AS deliveries, ts_us + {MOST} * 1000000 AS advised_us FROM log WHERE event_id % 5 >= {MOST}")
def max_deliver_advisory(spark: SparkSession, d: str) -> DataFrame:
    dead = T.log(spark, d).filter(D.is_dead(F.pmod("event_id", F.lit(5)), MOST))
    return dead.select(F.lit("EVENTS").alias("stream"), F.lit("worker").alias("consumer"), F.col("seq").alias("stream_seq"), F.lit(MOST).alias("deliveries"), (F.col("ts_us") + MOST * 1_000_000).alias("advised_us"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END AS attempts FROM events")
def xdeath_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Death records: some rejections and expiries on the work queue, some on others; none for every third message."""
    n = F.pmod("event_id", F.lit(5))

    def death(queue: str, reason: str, count) -> F.Column:  # noqa: ANN001
        return F.struct(F.lit(queue).alias("queue"), F.lit(reason).alias("reason"), F.lit(count).cast("bigint").alias("count") if isinstance(count, int) else count.cast("bigint").alias("count"))

    even = F.when(F.pmod("event_id", F.lit(2)) == 0, 1).otherwise(0)
    deaths = F.array(death("work", "rejected", n), death("retry", "expired", 9), death("work", "expired", 4), death("work", "rejected", even))
    rows = T.events(spark, d).select("event_id", F.when(F.pmod("event_id", F.lit(3)) != 0, deaths).alias("x_death"))
    return rows.select("event_id", D.xdeath_attempts(F.col("x_death"), "work").alias("attempts"))


@query("""WITH d AS (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 4 = 0)
SELECT event_id, count(*) AS deliveries, 1 AS applied FROM d GROUP BY 1""")
def redelivery_deduped(spark: SparkSession, d: str) -> DataFrame:
    """A crash after the effect and before the commit: delivered again; the mark of the first delivery lets only it apply."""
    marked = F.min("delivery").over(W.partitionBy("event_id"))
    rows = T.redelivered(T.events(spark, d).select("event_id")).withColumn("applies", F.col("delivery") == marked)
    return rows.groupBy("event_id").agg(F.count("*").alias("deliveries"), F.count_if("applies").cast("int").alias("applied"))


@query(f"""WITH {LOG}, {_ATT.replace("FROM ev", "FROM (SELECT event_id, seq FROM log) ev")}
SELECT row_number() OVER (ORDER BY attempt, seq) AS position, event_id, attempt FROM att""")
def redelivery_tail_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of all deliveries of a waiting queue: what fails goes behind all that waits, so round follows round."""
    rows = D.attempts(T.log(spark, d).select("event_id", "seq"), F.pmod("event_id", F.lit(5)), MOST)
    rows = rows.withColumn("_b", F.struct("attempt", F.floor(F.col("seq") / 1000)))
    return L.global_sequence(rows, ["attempt", "seq"], "_b", "position").select("position", "event_id", "attempt")


@query(f"""WITH {LOG}, acks AS (SELECT seq, event_id, 1 AS ack FROM log WHERE event_id % 5 = 0 UNION ALL SELECT seq, event_id, 2 FROM log WHERE event_id % 10 = 0 UNION ALL SELECT -seq, -event_id, 1 FROM log WHERE event_id % 50 = 0)
SELECT event_id, ack, CASE WHEN ack = 1 AND seq > 0 THEN 1 ELSE 0 END AS removed FROM acks""")
def ack_removes_once(spark: SparkSession, d: str) -> DataFrame:
    """What each acknowledgement answers: 1 for a pending entry, 0 for one acknowledged before and for one that was never delivered."""
    log = T.log(spark, d).select("seq", "event_id")
    five, ten, fifty = (log.filter(F.pmod("event_id", F.lit(n)) == 0) for n in (5, 10, 50))
    acks = five.withColumn("ack", F.lit(1)).unionByName(ten.withColumn("ack", F.lit(2))).unionByName(fifty.select(-F.col("seq"), -F.col("event_id"), F.lit(1)).toDF("seq", "event_id", "ack"))
    pending = log.select("seq", F.lit(True).alias("pending"))
    first = F.row_number().over(W.partitionBy("seq").orderBy("ack")) == 1
    found = acks.join(pending, "seq", "left").withColumn("removed", (first & F.col("pending").isNotNull()).cast("int"))
    return found.select("event_id", "ack", "removed")


@query(f"""WITH {EV} SELECT event_id, user_id AS queue, max(ts_us + (event_id % 4) * {3600 * 10**6}) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS leaves_us FROM ev""")
def ttl_head_of_line(spark: SparkSession, d: str) -> DataFrame:
    """A message whose time is up leaves only from the head of its queue, so it waits for longer times before it: a running maximum."""
    due = F.col("ts_us") + F.pmod("event_id", F.lit(4)) * 3_600_000_000
    before = W.partitionBy("user_id").orderBy("ts_us", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return T.events(spark, d).select("event_id", F.col("user_id").alias("queue"), F.max(due).over(before).alias("leaves_us"))


# -- jobs


_JOBS = "(SELECT unnest([0, 1, 2, 3]) AS run) r WHERE r.run <= least(event_id % 5, 2)"


@query(f"""WITH {EV} SELECT event_id, (r.run + 1)::INT AS attempt, ts_us + (1000000 * (pow(2, r.run) - 1))::BIGINT AS due_us, CASE WHEN event_id % 13 = 0 THEN 'undecodable' WHEN r.run < event_id % 5 THEN 'failed' ELSE 'completed' END AS status
FROM ev, {_JOBS} AND (event_id % 13 <> 0 OR r.run = 0)""")
def job_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("event_id", (F.col("run") + 1).alias("attempt"), F.col("due").alias("due_us"), "status")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Three attempts, waits of 1, 2 ... seconds; a payload that can't be decoded is archived on sight."""
    fails, bad = F.pmod("event_id", F.lit(5)), F.pmod("event_id", F.lit(13)) == 0
    runs = D.schedule(T.events(spark, d), F.col("ts_us"), F.when(bad, 0).otherwise(fails), 2, 1_000_000 * (F.pow(F.lit(2), F.col("run")).cast("bigint") - 1))
    return runs.withColumn("status", F.when(bad, "undecodable").when(F.col("run") < fails, "failed").otherwise("completed"))


@query(f"WITH {EV} SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 3 END AS attempts, CASE WHEN event_id % 13 = 0 THEN 'undecodable' ELSE 'failed' END AS reason FROM ev WHERE event_id % 5 >= 3 OR event_id % 13 = 0")
def job_archive(spark: SparkSession, d: str) -> DataFrame:
    last = ranking.last_per_key(_jobs(spark, d).select("event_id", "run", "status"), ["event_id"], ["run"])
    return last.filter("status <> 'completed'").select("event_id", (F.col("run") + 1).alias("attempts"), F.col("status").alias("reason"))


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id % 13 = 0 THEN 'failed' WHEN r.run < event_id % 5 THEN 'failed' ELSE 'completed' END AS status
FROM events, {_JOBS} AND (event_id % 13 <> 0 OR r.run = 0)) GROUP BY 1""")
def jobs_processed_total(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).groupBy(F.when(F.col("status") == "completed", "completed").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT event_id, ts_us AS enqueued_us, ts_us + (event_id % 4) * 1500000 AS due_us FROM ev")
def job_delayed_schedule(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", F.col("ts_us").alias("enqueued_us"), (F.col("ts_us") + F.pmod("event_id", F.lit(4)) * 1_500_000).alias("due_us"))


@query(f"WITH {EV} SELECT event_id, (ts_us + (event_id % 4) * 1500000) // 1000000 * 1000000 AS due_floor_us, (ts_us + (event_id % 4) * 1500000) // 1000 * 1000 AS due_ms_us FROM ev")
def schedule_floor_seconds(spark: SparkSession, d: str) -> DataFrame:
    due = F.col("ts_us") + F.pmod("event_id", F.lit(4)) * 1_500_000
    return T.events(spark, d).select("event_id", (due - F.pmod(due, F.lit(1_000_000))).alias("due_floor_us"), (due - F.pmod(due, F.lit(1000))).alias("due_ms_us"))
