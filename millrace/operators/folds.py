"""Decisions that depend on earlier decisions: limiters, deduplication with expiry, locks, caches, stock, queues.

No window frame expresses these, as what counts is what was admitted, not what came. Rows are sorted by key and order inside their
partition and folded one after another with a small state, so a key of any length takes no more memory than its state. A key's fold
is one pass in one task, as its decisions are in order; different keys run in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import first_per_key

#: Called for each key; gives a function from a row's values to the values of the new columns.
Fold = Callable[[], Callable[..., tuple]]
#: What a fold can answer with.
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def quiet_parts(df: DataFrame, keys: list[str], order: list[str], at: str, quiet: int, name: str = "_part") -> DataFrame:
    """Numbers the parts of each key between pauses of ``quiet`` or more in the time ``at``: a running sum, without Python."""
    w = W.partitionBy(*keys).orderBy(*order)
    pause = F.coalesce((F.col(at) - F.lag(at).over(w) >= quiet).cast("int"), F.lit(0))
    return df.withColumn(name, pause).withColumn(name, F.sum(name).over(w.rowsBetween(W.unboundedPreceding, 0)))


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], fold: Fold, new: str, quiet: tuple[str, int] | None = None) -> DataFrame:
    """Adds columns ``new`` (a DDL list): for the rows of each key in order, what the key's fold answers to ``inputs``.

    ``order`` must be total within a key. Null keys are a key. ``quiet`` names a time column and how long a pause is after which the
    fold knows nothing more of the key: the parts of a key between such pauses are then folded in parallel.
    """
    if quiet is not None:
        parts = quiet_parts(df, keys, order, *quiet)
        return ordered_fold(parts, [*keys, "_part"], order, inputs, fold, new).drop("_part")
    fields = [c.split() for c in new.split(",")]
    parts = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = None
        step: Callable[..., tuple] | None = None
        for batch in batches:
            out = []
            key_rows = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, values in zip(key_rows, zip(*(batch.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if step is None or key != last:
                    last, step = key, fold()
                out.append(step(*values))
            more = [pa.array([row[k] for row in out], _ARROW[kind]) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(name for name, _ in fields)])

    return parts.mapInArrow(run, schema)


def sliding_window(limit: int, window: int) -> Fold:
    """Admits if fewer than ``limit`` admitted requests are younger than ``window``. Rejected requests leave no trace."""

    def fold() -> Callable[[int], tuple]:
        live: deque[int] = deque()

        def step(ts: int) -> tuple:
            while live and live[0] <= ts - window:
                live.popleft()
            if len(live) >= limit:
                return (False,)
            live.append(ts)
            return (True,)

        return step

    return fold


def fixed_window(limit: int, window: int) -> Fold:
    """Admits the first ``limit`` requests of each window of the clock."""

    def fold() -> Callable[[int], tuple]:
        at, n = None, 0

        def step(ts: int) -> tuple:
            nonlocal at, n
            if ts // window != at:
                at, n = ts // window, 0
            n += 1
            return (n <= limit,)

        return step

    return fold


def expiring_once(ttl: int) -> Fold:
    """Applies unless an applied one is younger than ``ttl``. A failed effect gives its mark back. Inputs: time, whether it fails."""

    def fold() -> Callable[[int, bool], tuple]:
        applied = None

        def step(ts: int, fails: bool) -> tuple:
            nonlocal applied
            if applied is not None and ts - applied < ttl:
                return ("duplicate",)
            if fails:
                return ("failed",)
            applied = ts
            return ("applied",)

        return step

    return fold


def lock(ttl: int) -> Fold:
    """Inputs: time, operation (``acquire`` or ``release``), token. Only the holder's token releases; an expired lock is free."""

    def fold() -> Callable[[int, str, int], tuple]:
        holder, since, fence = None, 0, 0

        def step(ts: int, op: str, token: int) -> tuple:
            nonlocal holder, since, fence
            if holder is not None and ts - since >= ttl:
                holder = None
            if op == "release":
                if holder is not None and holder == token:
                    holder = None
                    return ("released", fence)
                return ("not_owner", fence)
            if holder is not None:
                return ("busy", fence)
            holder, since, fence = token, ts, fence + 1
            return ("granted", fence)

        return step

    return fold


def held_locks(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], ttl: int) -> DataFrame:
    """Adds ``result`` and ``fence`` of ``lock(ttl)``; ``inputs`` as there. No lock outlives a pause of ``ttl``, so the parts of a key between
    such pauses are folded in parallel, each with fences from 0, to which the grants of the parts before are added.
    """
    done = ordered_fold(quiet_parts(df, keys, order, inputs[0], ttl), [*keys, "_part"], order, inputs, lock(ttl), "result string, fence bigint")
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    grants = done.groupBy(*keys, "_part").agg(F.count_if(F.col("result") == "granted").alias("_n"))
    grants = grants.select(F.struct(*keys, "_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = done.withColumn("_at", F.struct(*keys, "_part")).join(grants, "_at")
    return rows.withColumn("fence", F.col("fence") + F.col("_before")).drop("_at", "_part", "_before")


def cache_aside(ttl: int) -> Fold:
    """Inputs: time, whether the loader fails. A hit until ``ttl`` after a load; a failed load is not kept."""

    def fold() -> Callable[[int, bool], tuple]:
        loaded = None

        def step(ts: int, fails: bool) -> tuple:
            nonlocal loaded
            if loaded is not None and ts - loaded < ttl:
                return ("hit",)
            if fails:
                loaded = None
                return ("error",)
            loaded = ts
            return ("load",)

        return step

    return fold


def singleflight(flight: int) -> Fold:
    """Callers that come while a load is on its way share it. Answers the time at which the shared load began."""

    def fold() -> Callable[[int], tuple]:
        began = None

        def step(ts: int) -> tuple:
            nonlocal began
            if began is None or ts - began >= flight:
                began = ts
            return (began,)

        return step

    return fold


def reservations() -> Fold:
    """Inputs: stock at first, quantity, whether payment fails. A reservation of a failed payment is released before the next order."""

    def fold() -> Callable[[int, int, bool], tuple]:
        left = None

        def step(stock: int | None, quantity: int, fails: bool) -> tuple:
            nonlocal left
            if left is None:
                left = 0 if stock is None or stock != stock else int(stock)
            if quantity > left:
                return ("rejected", left)
            if fails:
                return ("released", left)
            left -= quantity
            return ("reserved", left)

        return step

    return fold


def bounded_queue(capacity: int) -> Fold:
    """Inputs: ``put`` or ``take``. Occupancy never passes the capacity; a put that finds it full waits for the next take."""

    def fold() -> Callable[[str], tuple]:
        size = waiting = 0

        def step(op: str) -> tuple:
            nonlocal size, waiting
            if op == "put":
                if size < capacity:
                    size += 1
                else:
                    waiting += 1
            elif size:
                size -= 1
                if waiting:
                    waiting -= 1
                    size += 1
            return (size, waiting)

        return step

    return fold


def reflected(df: DataFrame, keys: list[str], order: list[str], step: Column, name: str) -> DataFrame:
    """A sum that never falls below 0, as a column ``name``: the running sum less its least value so far. Windows, no fold."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    walk = df.withColumn(name, F.sum(step).over(w))
    return walk.withColumn(name, F.col(name) - F.least(F.lit(0), F.min(name).over(w)))


def queue_occupancy(df: DataFrame, keys: list[str], order: list[str], put: Column, capacity: int) -> DataFrame:
    """Adds ``size`` and ``waiting`` after each put or take. Occupancy never passes the capacity; a put that finds it full waits for the next take.

    What is held and what waits is one number that a put raises, a take lowers, and that stops at 0.
    """
    held = reflected(df, keys, order, F.when(put, 1).otherwise(-1), "_held")
    size = F.least(F.col("_held"), F.lit(capacity))
    return held.withColumns({"size": size.cast("bigint"), "waiting": (F.col("_held") - size).cast("bigint")}).drop("_held")


def fair_dispatch(service: tuple[int, ...], prefetch: int = 1) -> Fold:
    """Each message goes to the worker that is free first (the first of equals), each with ``prefetch`` messages at a time in hand."""

    def fold() -> Callable[[int], tuple]:
        slots = [(0, w, s) for w in range(len(service)) for s in range(prefetch)]

        def step(_: int) -> tuple:
            at = min(range(len(slots)), key=lambda i: slots[i])
            free, w, s = slots[at]
            slots[at] = (free + service[w], w, s)
            return (w, free + service[w])

        return step

    return fold


def client_drops(df: DataFrame, keys: list[str], order: list[str], queued: str, drained: str, limit: int) -> DataFrame:
    """The first row of each key at which the backlog passes the limit, with ``backlog`` and its number ``dropped_after``.

    Before each row's messages are queued, those drained since go, down to an empty queue at most: a sum that stops at 0.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    step = F.coalesce(F.lag(queued).over(w), F.lit(0)) - F.col(drained)
    rows = df.withColumns({"_step": step, "dropped_after": F.row_number().over(w).cast("bigint")})
    rows = reflected(rows, keys, order, F.col("_step"), "_left").withColumn("backlog", (F.col("_left") + F.col(queued)).cast("bigint"))
    return first_per_key(rows.filter(F.col("backlog") > limit).select(*keys, "dropped_after", "backlog"), keys, ["dropped_after"])


def slow_client(limit: int) -> Fold:
    """Inputs: messages queued, messages drained since. Drops the client once its backlog passes the limit."""

    def fold() -> Callable[[int, int], tuple]:
        backlog, gone = 0, False

        def step(queued: int, drained: int) -> tuple:
            nonlocal backlog, gone
            if gone:
                return (backlog, True)
            backlog = max(0, backlog - drained) + queued
            gone = backlog > limit
            return (backlog, gone)

        return step

    return fold
