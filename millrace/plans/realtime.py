"""Queries on rooms, subscribers and connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import folds
from millrace.operators import realtime as R
from millrace.sources import tables as T

from .registry import EV, query

_MEMBERS = """m AS (SELECT room, c.client, (room + c.client) % 4 AS joined, (room + c.client) % 4 + 2 + c.client AS left_
  FROM (SELECT DISTINCT conv_id AS room FROM conversations), (SELECT unnest([0, 1, 2]) AS client) c),
msg AS (SELECT conv_id AS room, turn, role FROM conversations)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "conversations").select(F.col("conv_id").alias("room"), "turn", "role")


def _members(spark: SparkSession, d: str) -> DataFrame:
    rooms = T.read(spark, d, "conversations").select(F.col("conv_id").alias("room")).distinct()
    m = rooms.withColumn("client", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("joined", F.pmod(F.col("room") + F.col("client"), F.lit(4)))
    return m.withColumn("left", F.col("joined") + 2 + F.col("client"))


@query(f"WITH {_MEMBERS} SELECT msg.room, turn, role, client FROM msg JOIN m ON m.room = msg.room AND joined <= turn AND turn < left_")
def room_fanout(spark: SparkSession, d: str) -> DataFrame:
    return R.fan_out(_messages(spark, d), _members(spark, d)).select("room", "turn", "role", "client")


@query(f"WITH {_MEMBERS} SELECT m.room, client, count(turn) AS missed FROM m LEFT JOIN msg ON m.room = msg.room AND turn < joined GROUP BY 1, 2")
def late_subscriber_misses(spark: SparkSession, d: str) -> DataFrame:
    return R.missed_by_late(_messages(spark, d), _members(spark, d))


@query(f"WITH {_MEMBERS} SELECT room, count(*) AS clients FROM m WHERE joined <= 3 AND 3 < left_ GROUP BY 1")
def room_client_counts(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).filter("joined <= 3 and 3 < left").groupBy("room").agg(F.count("*").alias("clients"))


@query(f"""WITH {_MEMBERS}, c AS (SELECT room, joined AS "at", 1 AS kind, client FROM m UNION ALL SELECT room, left_, 0, client FROM m),
n AS (SELECT *, sum(CASE kind WHEN 1 THEN 1 ELSE -1 END) OVER (PARTITION BY room ORDER BY "at", kind, client ROWS UNBOUNDED PRECEDING) AS members FROM c)
SELECT room, "at", CASE kind WHEN 1 THEN 'subscribe' ELSE 'unsubscribe' END AS action, client FROM n WHERE (kind = 1 AND members = 1) OR (kind = 0 AND members = 0)""")
def room_refcount_transitions(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    changes = m.select("room", F.col("joined").alias("at"), F.lit(1).alias("kind"), "client").unionByName(m.select("room", F.col("left").alias("at"), F.lit(0).alias("kind"), "client"))
    return R.refcount_transitions(changes).select("room", "at", "action", "client")


@query(f"""WITH {EV}, s AS (SELECT user_id, user_id % 5 AS channel, min(ts_us) AS begins, max(ts_us) AS ends FROM ev GROUP BY 1)
SELECT event_id AS message, event_id % 5 AS channel, (SELECT count(*) FROM s WHERE s.channel = ev.event_id % 5 AND begins <= ts_us AND ts_us < ends) AS receivers FROM ev WHERE event_type = 'purchase'""")
def pubsub_receiver_count(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    subs = e.groupBy("user_id").agg(F.min("ts_us").alias("begins"), F.max("ts_us").alias("ends")).withColumn("channel", F.pmod("user_id", F.lit(5)))
    said = e.filter("event_type = 'purchase'").select(F.pmod("event_id", F.lit(5)).alias("channel"), F.col("ts_us").alias("ts"), F.col("event_id").alias("message"))
    return R.receiver_counts(said, subs)


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, event_id, event_id % 5 AS queued, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS rn FROM ev),
r(user_id, rn, backlog, gone, event_id) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, FALSE, NULL::BIGINT FROM n
  UNION ALL
  SELECT n.user_id, n.rn, CASE WHEN r.gone THEN r.backlog ELSE greatest(0, r.backlog - 2) + n.queued END, r.gone OR greatest(0, r.backlog - 2) + n.queued > 16, n.event_id
  FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT user_id AS client, min(rn) AS dropped_after, any_value(backlog)::BIGINT AS backlog FROM r WHERE gone GROUP BY 1""")
def slow_client_drops(spark: SparkSession, d: str) -> DataFrame:
    """Clients whose queue passes 16 messages: after how many sends, and with what backlog."""
    e = T.events(spark, d).select("event_id", "ts_us", F.col("user_id").alias("client"), F.pmod("event_id", F.lit(5)).alias("queued"), F.lit(2).alias("drained"))
    return folds.client_drops(e, ["client"], ["ts_us", "event_id"], "queued", "drained", 16)


@query(f"""WITH {EV}, g AS (SELECT user_id, event_id, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) AS gap FROM ev)
SELECT user_id, event_id, gap FROM g WHERE gap > 86400000000""")
def heartbeat_timeouts(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select(F.col("user_id").alias("key"), "event_id", "ts_us")
    return R.heartbeat_gaps(e, 86_400_000_000).select(F.col("key").alias("user_id"), "event_id", "gap")


@query("SELECT lower(event_type) || '.events' AS subject, event_id, user_id AS body FROM events")
def core_publish(spark: SparkSession, d: str) -> DataFrame:
    """What a publisher that asks for no receipt knows after its flush: what it sent. Who got it is in ``pubsub_receiver_count``."""
    return T.events(spark, d).select(scalars.subject_of(F.col("event_type")).alias("subject"), "event_id", F.col("user_id").alias("body"))
