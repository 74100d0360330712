"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` gives the same rows on the same tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.strip()
        return f

    return add


#: The events as one log and as a log of three partitions.
LOG = """log AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props,
  row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)"""
PLOG = """plog AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props, (user_id % 3)::INT AS partition_id,
  row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS log_offset, user_id::VARCHAR AS key FROM events)"""
EV = "ev AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events)"
