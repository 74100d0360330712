"""Input tables and their reading as message envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.log import global_sequence, keyed_sequence


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hour(ts: Column) -> Column:
    """The bucket by which logs are numbered in parallel."""
    return F.date_trunc("hour", ts.cast("timestamp"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id, ts_us, user_id, event_type, value, props`` and the time bucket ``_hour``."""
    e = read(spark, folder, "events")
    return e.select("event_id", micros(F.col("ts")).alias("ts_us"), "user_id", "event_type", "value", "props", hour(F.col("ts")).alias("_hour"))


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The events as one log: ``seq`` from 1 by (ts, event_id)."""
    return global_sequence(events(spark, folder), ["ts_us", "event_id"], "_hour", "seq").drop("_hour")


def partitioned_log(spark: SparkSession, folder: str, partitions: int = 3) -> DataFrame:
    """The events as a partitioned log: ``partition_id`` by key, ``log_offset`` from 0 in each partition."""
    e = events(spark, folder).withColumn("partition_id", F.pmod("user_id", F.lit(partitions)).cast("int"))
    e = keyed_sequence(e, ["partition_id"], ["ts_us", "event_id"], "_hour", "log_offset").drop("_hour")
    return e.withColumn("log_offset", F.col("log_offset") - 1).withColumn("key", F.col("user_id").cast("string"))


def redelivered(df: DataFrame, every: int = 4) -> DataFrame:
    """Adds a second delivery of each event whose id is divisible by ``every``; ``delivery`` tells them apart."""
    again = df.filter(F.pmod("event_id", F.lit(every)) == 0).withColumn("delivery", F.lit(2))
    return df.withColumn("delivery", F.lit(1)).unionByName(again)


def order_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as requests to the order service: ``order_id, amount, sku, quantity``."""
    o = read(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.pmod("o_orderkey", F.lit(100)).alias("sku"), (1 + F.pmod("o_orderkey", F.lit(5))).cast("int").alias("quantity")
    )


def stock(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "part")
    return p.filter("p_partkey < 100").select(F.col("p_partkey").alias("sku"), F.col("p_size").alias("stock"))
