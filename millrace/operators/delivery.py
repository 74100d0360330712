"""Delivery semantics as data: each attempt of a message is a row, so outcomes are filters and counts.

``fails`` is the number of attempts on which a message's handler fails; attempt a fails iff a <= fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deliveries(fails: Column, most: int) -> Column:
    """How often a message is delivered: once more than it fails, ``most`` times at most."""
    return F.least(fails + 1, F.lit(most))


def is_dead(fails: Column, most: int) -> Column:
    return fails >= most


def attempts(messages: DataFrame, fails: Column, most: int) -> DataFrame:
    """A row per delivery with ``attempt`` from 1, ``failed``, ``redelivered`` and ``dead`` (the last failed)."""
    rows = messages.withColumn("_fails", fails.cast("int")).withColumn("attempt", F.explode(F.sequence(F.lit(1), deliveries(F.col("_fails"), most))))
    failed = F.col("attempt") <= F.col("_fails")
    return rows.select(*messages.columns, "attempt", failed.alias("failed"), (F.col("attempt") > 1).alias("redelivered"), (failed & (F.col("attempt") == most)).alias("dead"))


def consumed(messages: DataFrame, fails: Column, dies: Column, most: int) -> DataFrame:
    """A row per delivery with ``attempt``, whether the handler ran to a result (``handled``), ``failed`` and ``dead``.

    Where ``dies``, each consumer dies before it reports, so the message is claimed again; the delivery above ``most`` goes to the dead
    letters without a run of the handler. Others run as in ``attempts``.
    """
    alive = attempts(messages.filter(~F.coalesce(dies, F.lit(False))), fails, most).drop("redelivered").withColumn("handled", F.lit(True))
    lost = messages.filter(dies).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most + 1))))
    lost = lost.withColumns({"failed": F.lit(False), "dead": F.col("attempt") > most, "handled": F.lit(False)})
    return alive.unionByName(lost)


def at_most_once(messages: DataFrame, lost: Column, fails: Column) -> DataFrame:
    """One delivery each; what is lost or fails is gone."""
    return messages.filter(~lost).withColumn("processed", fails == 0)


def schedule(messages: DataFrame, start: Column, fails: Column, retries: int, delay: Column) -> DataFrame:
    """Runs 0 to the smaller of ``fails`` and ``retries``, run k due at start + delay, where ``delay`` may use column ``run``."""
    rows = messages.withColumn("run", F.explode(F.sequence(F.lit(0), F.least(fails.cast("int"), F.lit(retries)))))
    return rows.withColumn("due", start + delay)


def dead_letter(rows: DataFrame, i: Column, error: Column, tries: Column, failed_at: Column, payload: Column) -> DataFrame:
    """The five fields of a dead letter, all text."""
    return rows.select(
        i.cast("string").alias("original_id"), error.alias("error"), tries.cast("string").alias("attempts"), failed_at.cast("string").alias("failed_at"), payload.alias("payload")
    )


def stale_claims(pending: DataFrame, min_idle: int, claimer: str) -> DataFrame:
    """Pending entries idle long enough, after they move to ``claimer``: one delivery more, no idle time. Ids that left the log are told apart."""
    stale = pending.filter(F.col("idle_us") >= min_idle)
    return stale.select("id", F.lit(claimer).alias("consumer"), F.lit(0).cast("bigint").alias("idle_us"), (F.col("delivery_count") + 1).alias("delivery_count"), "deleted")


def xdeath_attempts(x_death: Column, queue: str) -> Column:
    """Attempts on a queue that a message's death records tell: the sum of counts of rejections there."""
    mine = F.filter(x_death, lambda d: (d["queue"] == queue) & (d["reason"] == "rejected"))
    return F.coalesce(F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, d: a + d["count"]), F.lit(0).cast("bigint"))
