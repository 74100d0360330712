"""Rooms, subscribers and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fan_out(messages: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each message and member of its room who is there then: ``joined <= turn < left``. Joined by room; rooms are small."""
    return messages.join(members, "room").filter("joined <= turn and turn < left")


def missed_by_late(messages: DataFrame, members: DataFrame) -> DataFrame:
    """How many messages of their room each member came too late for."""
    early = messages.join(members, "room").filter("turn < joined")
    counts = early.groupBy("room", "client").agg(F.count("*").alias("missed"))
    return members.select("room", "client").join(counts, ["room", "client"], "left").select("room", "client", F.coalesce("missed", F.lit(0)).alias("missed"))


def receiver_counts(messages: DataFrame, subscriptions: DataFrame, bucket: int = 3_600_000_000) -> DataFrame:
    """Active subscriptions of each message's channel when it is published: ``begins <= ts < ends``. 0 means that it is lost.

    No join of the two: beginnings and ends are +1 and -1 in one stream with the messages, and a running sum counts. It runs within
    ``bucket`` micros of a channel, on top of what the buckets before it leave; only the table of buckets is summed up in order, so
    no task holds a whole channel. Null channels are one channel.
    """
    change = subscriptions.select("channel", F.explode(F.array(F.struct(F.col("begins").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("ends").alias("ts"), F.lit(-1).alias("d")))).alias("c"))
    change = change.select("channel", "c.ts", "c.d", F.lit(0).alias("late"), F.lit(None).cast("bigint").alias("message"))
    said = messages.select("channel", "ts", F.lit(0).alias("d"), F.lit(1).alias("late"), F.col("message"))
    # Channel and bucket as one struct, which is never null itself and equal where both have nulls.
    rows = change.unionByName(said).withColumn("_at", F.struct("channel", F.floor(F.col("ts") / bucket).alias("_bucket")))
    before = W.partitionBy("_at.channel").orderBy("_at._bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("_at").agg(F.sum("d").alias("_d")).select("_at", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("_at").orderBy("ts", "late").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = rows.withColumn("_within", F.sum("d").over(within)).filter("message is not null").join(starts, "_at")
    return counted.select("message", "channel", (F.col("_before") + F.col("_within")).alias("receivers"))


def refcount_transitions(changes: DataFrame) -> DataFrame:
    """Where a room's members come to one from none (subscribe) or to none (unsubscribe). ``changes``: room, at, kind (0 leaves, 1 joins), client."""
    order = W.partitionBy("room").orderBy("at", "kind", "client").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = changes.withColumn("members", F.sum(F.when(F.col("kind") == 1, 1).otherwise(-1)).over(order))
    action = F.when((F.col("kind") == 1) & (F.col("members") == 1), "subscribe").when((F.col("kind") == 0) & (F.col("members") == 0), "unsubscribe")
    return n.withColumn("action", action).filter("action is not null")


def heartbeat_gaps(beats: DataFrame, timeout: int, key: str = "key", at: str = "ts_us") -> DataFrame:
    """Beats that come later than ``timeout`` after the one before: the connection is taken for dead in between."""
    order = W.partitionBy(key).orderBy(at)
    return beats.withColumn("gap", F.col(at) - F.lag(at).over(order)).filter(F.col("gap") > timeout)
