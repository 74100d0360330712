"""Structured Streaming forms of the batch operators: same rules, state kept between micro-batches.

Event times arrive as TIMESTAMP_NTZ in the tables; watermarks need TIMESTAMP, so ``with_event_time`` casts in the session's zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int = 1) -> DataFrame:
    """A table's folder or file as a stream. ``files_per_batch`` bounds what one micro-batch admits."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_event_time(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Adds ``ts_us`` and a watermark on ``event_time``."""
    e = events.withColumn("event_time", F.col("ts").cast("timestamp")).drop("ts")
    return e.withColumn("ts_us", F.unix_micros("event_time")).withWatermark("event_time", lateness)


def _fold(events: DataFrame, keys: list[str], rows: str, output: str, state: str, start: tuple, remembers: int, step: Callable[[tuple, tuple], tuple[tuple, tuple]]) -> DataFrame:
    """Folds each key's ``rows (ts_us, event_id, ...)`` in order of time over its state, across micro-batches.

    A row waits until the watermark has passed its time, so what comes in a later micro-batch than a later row is folded in its place.
    Rows that come behind the watermark are left out, as in Spark's own windows. A key is forgotten ``remembers`` micros after its last
    row, when no answer depends on it any more.
    """
    said, fields = [c.split()[0] for c in output.split(", ")], [c.split()[0] for c in rows.split(", ")]
    held_rows = ", ".join(c.replace(" ", ":", 1) for c in rows.split(", "))

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *now, last, waiting = held.get if held.exists else (*start, 0, [])
        upto = held.getCurrentWatermarkMs() * 1000
        came = [tuple(None if pd.isna(v) else v for v in r) for df in frames for r in df[fields].itertuples(index=False)]
        waiting = sorted([tuple(r) for r in waiting] + [r for r in came if r[0] > upto], key=lambda r: r[:2])
        ready, waiting = [r for r in waiting if r[0] <= upto], [r for r in waiting if r[0] > upto]
        now, out = tuple(now), []
        for row in ready:
            now, answer = step(now, row)
            last = row[0]
            out.append((*key, *answer))
        wake = waiting[0][0] if waiting else last + remembers
        if not waiting and wake <= upto:
            held.remove()
        else:
            held.update((*now, last, waiting))
            held.setTimeoutTimestamp(max(-(-wake // 1000), upto // 1000) + 1)
        yield pd.DataFrame(out, columns=said)

    shape = f"{state}, last bigint, waiting array<struct<{held_rows}>>"
    return events.groupBy(*keys).applyInPandasWithState(run, output, shape, "append", GroupStateTimeout.EventTimeTimeout)


def dedup_ttl(events: DataFrame, ttl: int) -> DataFrame:
    """``message_id, event_id, result``: applied unless an applied one of the id is younger than ``ttl`` micros.

    ``events`` has message_id, event_id, ts_us, fails and a watermark. An id keeps one number and the rows the watermark has not passed.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (applied,), (ts_us, event_id, fails) = state, row
        if applied >= 0 and ts_us - applied < ttl:
            return state, (event_id, "duplicate")
        if fails:
            return state, (event_id, "failed")
        return (ts_us,), (event_id, "applied")

    return _fold(events, ["message_id"], "ts_us bigint, event_id bigint, fails boolean", "message_id string, event_id bigint, result string", "applied bigint", (-1,), ttl, step)


def rate_limit(events: DataFrame, limit: int, window: int) -> DataFrame:
    """``user_id, event_id, admitted``: the sliding-window log.

    ``events`` has user_id, event_id, ts_us and a watermark. A user keeps the times of ``limit`` requests at most, and the rows the
    watermark has not passed.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (times,), (ts_us, event_id) = state, row
        live = [t for t in times if t > ts_us - window]
        admitted = len(live) < limit
        return (live + [ts_us] if admitted else live,), (event_id, admitted)

    return _fold(events, ["user_id"], "ts_us bigint, event_id bigint", "user_id bigint, event_id bigint, admitted boolean", "live array<bigint>", ([],), window, step)


def dedup_within_watermark(events: DataFrame) -> DataFrame:
    """Spark's own deduplication with bounded state: repeats of an event id that come within the watermark are dropped."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by type in windows of event time; late rows beyond the watermark are dropped."""
    return events.groupBy(F.window("event_time", width, slide or width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("event_time", gap), "user_id").agg(F.count("*").alias("n"))


def append_once(path: str, key: tuple[str, ...], look_back: int | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that may see a batch again: each batch is its own folder, overwritten if repeated, and rows whose
    key an earlier batch wrote are left out.

    Earlier means the ``look_back`` epochs before this one, all of them if None: a source that repeats a row only within so many
    micro-batches needs no longer look.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
        first = 0 if look_back is None else epoch - look_back
        before = [f"{path}/{n}" for n in done if n.startswith("epoch=") and first <= int(n.split("=")[1]) < epoch]
        rows = batch.dropDuplicates(list(key))
        if before:
            rows = rows.join(spark.read.parquet(*before).select(*key), list(key), "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def split_dead(path: str, alive: Callable[[DataFrame], DataFrame], dead: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink with a side output: what is alive and what is dead go to folders of their own, by batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        alive(batch).write.mode("overwrite").parquet(f"{path}/main/epoch={epoch}")
        dead(batch).write.mode("overwrite").parquet(f"{path}/dlq/epoch={epoch}")

    return write
