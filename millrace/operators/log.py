"""Append logs: numbering, offsets, bounds, replay, lag and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keyed_sequence(df: DataFrame, keys: list[str], order: list[str], bucket: str, name: str) -> DataFrame:
    """Numbers the rows of each key from 1 by ``order``, without sorting a whole key in one task.

    ``bucket`` must not fall as ``order`` rises (a truncated time, for one). Rows are numbered within key and bucket, and each bucket
    starts after those before it; only the table of bucket sizes is summed up in order. Null keys are one key; nulls of ``bucket`` and
    ``order`` come last, as they do in the SQL twins. No row is lost.
    """
    # Key and bucket as one struct, which is never null itself and equal where both have nulls.
    rows = df.withColumn("_at", F.struct(*keys, F.col(bucket).alias("_bucket")))
    sizes = rows.groupBy("_at").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(F.col("_at")[k] for k in keys)).orderBy(F.asc_nulls_last(F.col("_at._bucket"))).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy("_at").orderBy(*(F.asc_nulls_last(c) for c in order))))
    return rows.join(starts, "_at").withColumn(name, F.col("_rn") + F.col("_before")).drop("_at", "_rn", "_before")


def global_sequence(df: DataFrame, order: list[str], bucket: str, name: str) -> DataFrame:
    """Numbers all rows from 1 by ``order``; see ``keyed_sequence``."""
    return keyed_sequence(df.withColumn("_all", F.lit(0)), ["_all"], order, bucket, name).drop("_all")


def partition_bounds(log: DataFrame) -> DataFrame:
    """First and next offset of each partition."""
    return log.groupBy("partition_id").agg(F.min("log_offset").alias("first_offset"), (F.max("log_offset") + 1).alias("next_offset"))


def up_to(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """The records below the bounds; what is appended after they were taken is not read."""
    return log.join(F.broadcast(bounds.select("partition_id", "next_offset")), "partition_id").filter("log_offset < next_offset").drop("next_offset")


def seek(log: DataFrame, partition: int, first: int) -> DataFrame:
    return log.filter((F.col("partition_id") == partition) & (F.col("log_offset") >= first))


def resume(log: DataFrame, committed: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """From each partition's committed offset on (its first if none), up to the offset in ``last``, that record included."""
    out = log.join(F.broadcast(committed.select("partition_id", "committed")), "partition_id", "left").filter("log_offset >= coalesce(committed, 0)").drop("committed")
    if last is not None:
        out = out.join(F.broadcast(last.select("partition_id", "last_offset")), "partition_id").filter("log_offset <= last_offset").drop("last_offset")
    return out


def consumer_lag(bounds: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag of each partition: what lies between the committed offset, at least the first, and the next. No commit means the first."""
    joined = bounds.join(F.broadcast(committed.select("partition_id", "committed")), "partition_id", "left")
    at = F.greatest(F.coalesce("committed", F.lit(-1).cast("bigint")), "first_offset")
    return joined.select("partition_id", F.greatest(F.lit(0).cast("bigint"), F.col("next_offset") - at).alias("lag"))


def first_sequence_at(log: DataFrame, ts_us: int) -> DataFrame:
    """One row ``start_seq``: the first sequence number at or after a time, the one after the last if there is none."""
    found = log.agg(F.min(F.when(F.col("ts_us") >= ts_us, F.col("seq"))).alias("s"), F.coalesce(F.max("seq"), F.lit(0)).alias("m"))
    return found.select(F.coalesce("s", F.col("m") + 1).alias("start_seq"))


def replay_from(log: DataFrame, start: DataFrame) -> DataFrame:
    """All records from a resolved start on, whatever their times."""
    return log.join(F.broadcast(start)).filter("seq >= start_seq").drop("start_seq")


def midpoint(older: Column, newer: Column) -> Column:
    """A start time between two records: the older one plus half the gap, rounded up."""
    return older + F.floor((newer - older + 1) / 2).cast("bigint")


def round_robin(seq: Column, partitions: int) -> Column:
    return F.pmod(seq - 1, F.lit(partitions)).cast("int")


def assignment(partition: Column, members: int) -> Column:
    """The member that owns a partition; members beyond the number of partitions own none."""
    return F.pmod(partition, F.lit(members)).cast("int")


def seed(spark: SparkSession, prefix: str, n: int, size: int, batch: int = 50) -> DataFrame:
    """``n`` keys with values of ``size`` bytes, and the batch that writes each."""
    at = spark.range(n)
    return at.select(F.concat(F.lit(f"{prefix}:"), "id").alias("key"), F.repeat(F.lit("x"), size).alias("value"), F.floor(F.col("id") / batch).cast("bigint").alias("batch_no"))


def pages(keys: DataFrame, group: str, size: int) -> DataFrame:
    """``deleted``, ``pages`` and ``last_page``: the rows of each group, the full and part pages that they fill, and the last one's rows."""
    n = F.col("deleted")
    out = keys.groupBy(group).agg(F.count("*").alias("deleted"))
    return out.withColumns({"pages": F.ceil(n / size).cast("bigint"), "last_page": (n - 1) % size + 1})
