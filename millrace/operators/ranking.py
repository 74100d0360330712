"""Leaderboards, last values and caches by recency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; an aggregate that combines before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_last")).select(*keys, "_last.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*").select(*df.columns)


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """Each board's n best members by score, ties by member downwards; none for n <= 0."""
    if n <= 0:
        return scores.limit(0).withColumn("rank", F.lit(0))
    order = W.partitionBy("board").orderBy(F.desc("score"), F.desc("member"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def check_top(n: int = 10) -> int:
    if not 1 <= n <= 1000:
        raise ValueError("n must be from 1 to 1000")
    return n


def lru_survivors(accesses: DataFrame, capacity: int, key: str = "key", at: str = "seq") -> DataFrame:
    """The keys that an exact least-recently-used cache of the capacity holds at the end, most recent first."""
    last = accesses.groupBy(key).agg(F.max(at).alias("last_access"))
    return last.orderBy(F.desc("last_access")).limit(capacity)


def refused(accesses: DataFrame, capacity: int, policy: str, key: str = "key", at: str = "seq") -> DataFrame:
    """``key, rejected``: how often a store of ``capacity`` keys, none with a time to live, refuses each key.

    ``allkeys-`` policies make room and refuse nothing. ``noeviction``, and ``volatile-`` policies without a key that they may evict,
    keep the first keys and refuse the rest each time.
    """
    first = accesses.groupBy(key).agg(F.min(at).alias("_first"), F.count("*").alias("rejected"))
    if policy.startswith("allkeys-"):
        return first.limit(0).select(key, "rejected")
    if policy != "noeviction" and not policy.startswith("volatile-"):
        raise ValueError("no such policy")
    held = first.orderBy("_first").limit(capacity).select(key)
    return first.join(F.broadcast(held), key, "left_anti").select(key, "rejected")
