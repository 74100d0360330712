"""Streaming forms give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import folds
from millrace.streaming import stateful as S

TABLES = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in four files, in the order of time."""
    at = tmp_path_factory.mktemp("stream")
    e = spark.read.parquet(f"{TABLES}/events.parquet").filter("event_id < 400")
    for k in range(4):
        e.filter(f"event_id >= {100 * k} and event_id < {100 * k + 100}").coalesce(1).write.mode("append").parquet(str(at / "events.parquet"))
    return str(at)


def collect(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def batch(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


def ended(spark, at, drop=()):
    """The events, dealt over files out of order, then one far later that lets the watermark pass them all."""
    e = spark.read.parquet(f"{TABLES}/events.parquet").filter("event_id < 400")
    late = e.agg(F.max("ts")).first()[0]
    for k in range(4):
        e.filter(f"event_id % 4 = {k}").coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
    end = e.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "user_id": F.lit(-1).cast("bigint"), "ts": F.lit(late) + F.expr("interval 401 days")})
    end.coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
    return S.with_event_time(S.event_stream(spark, str(at)), "400 days")


def answers(df, name):
    return {(r.event_id, r[name]) for r in df.collect() if r.event_id >= 0}


def test_rate_limit(spark, folder, tmp_path):
    stream = ended(spark, tmp_path / "in").select("user_id", "event_id", "ts_us", "event_time")
    got = collect(S.rate_limit(stream, 2, 24 * HOUR), "limited", tmp_path)
    want = folds.ordered_fold(batch(spark, folder).select("user_id", "event_id", "ts_us"), ["user_id"], ["ts_us", "event_id"], ["ts_us"], folds.sliding_window(2, 24 * HOUR), "admitted boolean")
    assert answers(got, "admitted") == answers(want, "admitted")


def test_dedup_ttl(spark, folder, tmp_path):
    def shaped(e, *more):
        return e.select(F.concat_ws(":", "event_type", "user_id").alias("message_id"), "event_id", "ts_us", (F.pmod("event_id", F.lit(7)) == 0).alias("fails"), *more)

    got = collect(S.dedup_ttl(shaped(ended(spark, tmp_path / "in"), "event_time"), 48 * HOUR), "deduped", tmp_path)
    want = folds.ordered_fold(shaped(batch(spark, folder)), ["message_id"], ["ts_us", "event_id"], ["ts_us", "fails"], folds.expiring_once(48 * HOUR), "result string")
    assert answers(got, "result") == answers(want, "result")


def test_windows_and_sessions(spark, folder, tmp_path):
    stream = S.with_event_time(S.event_stream(spark, folder))
    got = collect(S.windowed_counts(stream, "1 day"), "windows", tmp_path, "complete")
    want = batch(spark, folder).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert {(r.window.start, r.event_type, r.n) for r in got.collect()} == {(r.window.start, r.event_type, r["count"]) for r in want.collect()}
    assert collect(S.sessions(stream), "sessions", tmp_path, "complete").agg(F.sum("n")).first()[0] == 400


def test_replayed_batches_change_nothing(spark, folder, tmp_path):
    e = batch(spark, folder).select("event_id", "event_type")
    write = S.append_once(str(tmp_path / "out"), ("event_id",))
    write(e.filter("event_id < 200").union(e.filter("event_id < 50")), 0)
    write(e.filter("event_id >= 100"), 1)
    write(e.filter("event_id >= 100"), 1)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(400))


def test_replays_within_the_look_back(spark, folder, tmp_path):
    e = batch(spark, folder).select("event_id", "event_type").filter("event_id < 20")
    write = S.append_once(str(tmp_path / "near"), ("event_id",), look_back=1)
    for epoch in (0, 1, 2):
        write(e, epoch)
    counts = [spark.read.parquet(str(tmp_path / f"near/epoch={k}")).count() for k in range(3)]
    assert counts == [20, 0, 20]


def test_stream_resumes_where_it_stopped(spark, folder, tmp_path):
    def once():
        stream = S.event_stream(spark, folder)
        q = stream.writeStream.foreachBatch(S.append_once(str(tmp_path / "sink"), ("event_id",))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    once()
    n = spark.read.parquet(str(tmp_path / "sink")).count()
    once()
    assert n == 400 and spark.read.parquet(str(tmp_path / "sink")).count() == 400


def test_dead_letters_go_to_the_side(spark, folder, tmp_path):
    sink = S.split_dead(str(tmp_path / "s"), lambda b: b.filter("event_id % 5 < 3"), lambda b: b.filter("event_id % 5 >= 3"))
    q = S.event_stream(spark, folder).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s/dlq")).count() == 160 and spark.read.parquet(str(tmp_path / "s/main")).count() == 240
