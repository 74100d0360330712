"""Logs, deliveries, folds, orders, rooms on the small cases that define them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import delivery, folds, log, orders, ranking, realtime, routing
from millrace.plans import QUERIES


def run(fold, rows):
    step = fold()
    return [step(*r)[0] for r in rows]


# -- logs


def small_log(spark, n=12, keys=6):
    rows = [(k, k % 3, k // 3, f"event-{k}", k % keys) for k in range(n)]
    return spark.createDataFrame(rows, "seq bigint, partition_id int, log_offset bigint, value string, key int")


def test_keyed_sequence_is_row_number(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(3), rnd.randrange(40)) for k in range(300)] + [(900, None, 5)]
    df = spark.createDataFrame(rows, "id int, key int, ts int").withColumn("b", F.floor(F.col("ts") / 7))
    got = {r.id: r.n for r in log.keyed_sequence(df.filter("key is not null"), ["key"], ["ts", "id"], "b", "n").collect()}
    for k in range(3):
        order = sorted((t, i) for i, x, t in rows if x == k)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    assert log.global_sequence(df.limit(0), ["ts", "id"], "b", "n").count() == 0


def test_bounds_replay_and_lag(spark):
    records = small_log(spark)
    bounds = log.partition_bounds(records)
    assert {(r.partition_id, r.first_offset, r.next_offset) for r in bounds.collect()} == {(p, 0, 4) for p in range(3)}
    assert log.up_to(records.unionByName(records.withColumn("log_offset", F.col("log_offset") + 4)), bounds).count() == 12
    assert {r.log_offset for r in log.seek(records, 1, 2).collect()} == {2, 3}
    committed = spark.createDataFrame([(0, 4), (1, -1)], "partition_id int, committed bigint")
    assert {(r.partition_id, r.lag) for r in log.consumer_lag(bounds, committed).collect()} == {(0, 0), (1, 4), (2, 4)}
    assert log.consumer_lag(bounds, committed.limit(0)).agg(F.sum("lag")).first()[0] == 12
    assert log.partition_bounds(records.limit(0)).count() == 0


def test_resume_and_commit_order(spark):
    two = spark.createDataFrame([(0, 0, "M1"), (0, 1, "M2")], "partition_id int, log_offset bigint, value string")
    at = lambda c: spark.createDataFrame([(0, c)], "partition_id int, committed bigint")
    assert sorted(r.value for r in log.resume(two, at(0)).collect()) == ["M1", "M2"]
    assert [r.value for r in log.resume(two, at(1)).collect()] == ["M2"]
    last = spark.createDataFrame([(0, 0)], "partition_id int, last_offset bigint")
    assert [r.value for r in log.resume(two, at(0).limit(0), last).collect()] == ["M1"]


def test_start_times(spark):
    rows = [(s, 1000 * s + (1_000_000 if s > 5 else 0)) for s in range(1, 11)]
    records = spark.createDataFrame(rows, "seq bigint, ts_us bigint")
    start = log.first_sequence_at(records, 500_000)
    assert log.replay_from(records, start).count() == 5
    end = log.first_sequence_at(records, 10**12)
    assert log.replay_from(records, end).count() == 0
    later = records.unionByName(spark.createDataFrame([(11, 7)], "seq bigint, ts_us bigint"))
    assert [r.seq for r in log.replay_from(later, end).collect()] == [11]
    assert spark.range(1).select(log.midpoint(F.lit(10), F.lit(13))).first()[0] == 12


def test_assignment(spark):
    p = spark.range(3).select(F.col("id").alias("p"))
    sizes = p.groupBy(log.assignment(F.col("p"), 4).alias("m")).count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 1, 1]
    assert {r[0] for r in p.select(log.assignment(F.col("p"), 1)).collect()} == {0}
    assert {r[0] for r in p.select(log.round_robin(F.col("p") + 1, 3)).collect()} == {0, 1, 2}


# -- deliveries


def test_attempts(spark):
    m = spark.createDataFrame([("ok", 0), ("once", 1), ("poison", 9)], "id string, fails int")
    got = delivery.attempts(m, F.col("fails"), 3).orderBy("id", "attempt").collect()
    assert [(r.id, r.attempt, r.failed, r.dead) for r in got if r.id == "poison"] == [("poison", 1, True, False), ("poison", 2, True, False), ("poison", 3, True, True)]
    assert [(r.attempt, r.failed, r.redelivered) for r in got if r.id == "once"] == [(1, True, False), (2, False, True)]
    assert sum(r.failed for r in got) == 4
    amo = delivery.at_most_once(m, F.col("id") == "once", F.col("fails")).collect()
    assert {(r.id, r.processed) for r in amo} == {("ok", True), ("poison", False)}


def test_retry_schedule(spark):
    m = spark.createDataFrame([("a", 5, 100)], "id string, fails int, t bigint")
    runs = delivery.schedule(m, F.col("t"), F.col("fails"), 2, F.col("run") * 500).collect()
    assert [(r.run, r.due) for r in runs] == [(0, 100), (1, 600), (2, 1100)]


def test_claims(spark):
    p = spark.createDataFrame([(1, "c1", 500, 1, False), (2, "c1", 10, 1, False), (3, "c2", 900, 4, True)], "id int, consumer string, idle_us bigint, delivery_count bigint, deleted boolean")
    got = {r.id: (r.consumer, r.delivery_count, r.idle_us, r.deleted) for r in delivery.stale_claims(p, 400, "me").collect()}
    assert got == {1: ("me", 2, 0, False), 3: ("me", 5, 0, True)}


def test_xdeath(spark):
    rows = [(1, [("work", "rejected", 2), ("retry", "expired", 5), ("work", "expired", 9), ("work", "rejected", 1)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, d array<struct<queue:string,reason:string,count:bigint>>")
    assert [r[0] for r in df.select(delivery.xdeath_attempts(F.col("d"), "work")).collect()] == [3, 0, 0]


# -- folds


def test_sliding_window_keeps_no_trace_of_rejections():
    assert run(folds.sliding_window(3, 1000), [(t,) for t in (0, 1, 2, 3, 999, 1000)]) == [True, True, True, False, False, True]
    assert run(folds.sliding_window(1, 10), [(t,) for t in (0, 5, 9, 10, 11)]) == [True, False, False, True, False]
    assert run(folds.sliding_window(0, 10), [(1,)]) == [False]
    assert sum(run(folds.sliding_window(10, 10), [(1,)] * 50)) == 10


def test_dedup_lock_cache():
    assert run(folds.expiring_once(10), [(0, True), (1, False), (5, False), (11, False)]) == ["failed", "applied", "duplicate", "applied"]
    ops = [(0, "acquire", 1), (1, "acquire", 2), (2, "release", 2), (3, "release", 1), (4, "acquire", 2), (500, "acquire", 3), (504, "acquire", 3)]
    assert run(folds.lock(500), ops) == ["granted", "busy", "not_owner", "released", "granted", "busy", "granted"]
    assert run(folds.cache_aside(10), [(0, True), (1, False), (5, True), (11, False)]) == ["error", "load", "hit", "load"]
    assert run(folds.singleflight(10), [(0,), (9,), (10,)]) == [0, 0, 10]


def test_queue_and_dispatch():
    assert [folds.bounded_queue(1)()("take"), *map(folds.bounded_queue(1)(), ["put", "put", "take", "take"])] == [(0, 0), (1, 0), (1, 1), (1, 0), (0, 0)]
    step = folds.fair_dispatch((9, 1))()
    workers = [step(0)[0] for _ in range(10)]
    assert (workers.count(0), workers.count(1)) == (1, 9)
    step = folds.slow_client(16)()
    assert [step(5, 2)[1] for _ in range(6)] == [False] * 4 + [True, True]


def test_ordered_fold_over_many_keys(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice(("a", "b", None)), rnd.randrange(500)) for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, key string, ts bigint")
    got = {r.id: r.ok for r in folds.ordered_fold(df, ["key"], ["ts", "id"], ["ts"], folds.sliding_window(2, 50), "ok boolean").collect()}
    for key in ("a", "b", None):
        mine = sorted((t, i) for i, k, t in rows if k == key)
        assert [got[i] for _, i in mine] == run(folds.sliding_window(2, 50), [(t,) for t, _ in mine])
    assert folds.ordered_fold(df.limit(0), ["key"], ["ts", "id"], ["ts"], folds.fixed_window(2, 50), "ok boolean").count() == 0


# -- orders


@pytest.mark.parametrize(
    ("stock", "amount", "want", "trail", "other", "events"),
    [
        (10, 25.5, ("reserved", "charged", "paid", 8), "placed paid", "placed paid", 3),
        (10, 5000.0, ("released", "failed", "cancelled", 10), "placed payment_failed cancelled", "placed payment_failed cancelled", 4),
        (1, 25.5, ("rejected", "charged", "cancelled", 1), "placed paid cancelled", "placed cancelled", 3),
        (1, 5000.0, ("rejected", "failed", "cancelled", 1), "placed payment_failed cancelled", "placed cancelled", 3),
    ],
)
def test_order_outcomes(spark, stock, amount, want, trail, other, events):
    o = spark.createDataFrame([(1, amount, 7, 2)], "order_id bigint, amount double, sku bigint, quantity int")
    s = orders.settle(o, spark.createDataFrame([(7, stock)], "sku bigint, stock int"), 1000)
    r, p = F.col("reservation"), F.col("payment")
    got = s.select(r, p, orders.final_status(r, p), "stock_left", orders.status_trail(r, p), orders.status_trail(r, p, False), orders.order_events(r, p)).first()
    assert tuple(got)[:4] == want and got[4] == trail.split() and got[5] == other.split() and len(got[6]) == events


def test_unknown_sku_has_no_stock(spark):
    o = spark.createDataFrame([(1, 5.0, 7, 2), (2, 5.0, None, 1)], "order_id bigint, amount double, sku bigint, quantity int")
    got = orders.settle(o, spark.createDataFrame([], "sku bigint, stock int"), 1000).collect()
    assert {r.reservation for r in got} == {"rejected"} and len(got) == 2


def test_saga_compensates_backwards(spark):
    steps = [("a", False, False), ("b", False, True), ("c", True, False), ("d", False, False)]
    rows = [(steps,), ([s for s in steps if s[0] != "c"],), ([("x", True, True)],), ([],)]
    df = spark.createDataFrame(rows, "s array<struct<name:string,run_fails:boolean,compensate_fails:boolean>>")
    got = [r[0] for r in df.select(orders.saga(F.col("s"))).collect()]
    assert [(g.status, g.ran, g.compensated, g.failed_compensations) for g in got] == [
        ("compensation_failed", ["a", "b"], ["a"], ["b"]), ("completed", ["a", "b", "d"], [], []), ("compensated", [], [], []), ("completed", [], [], []),
    ]


def test_relay_order(spark):
    rank = F.col("id") + 1
    got = spark.range(4).select("id", orders.relay_interleaving(rank, 2).alias("late")).orderBy("late", "id").collect()
    assert [r.id + 1 for r in got] == [3, 4, 1, 2]


# -- ranking and rooms


def test_leaderboard(spark):
    s = spark.createDataFrame([("b", "ann", 5.0, 1), ("b", "bob", 5.0, 1), ("b", "ann", 3.0, 2), ("b", "cid", 9.0, 1), ("b", "dan", 5.0, 1)], "board string, member string, score double, seq int")
    now = ranking.last_per_key(s, ["board", "member"], ["seq"]).drop("seq")
    assert [(r.member, r.score) for r in ranking.top_n(now, 3).orderBy("rank").collect()] == [("cid", 9.0), ("dan", 5.0), ("bob", 5.0)]
    assert ranking.top_n(now, 0).count() == 0 and ranking.top_n(now, -1).count() == 0 and ranking.top_n(now, 99).count() == 4
    with pytest.raises(ValueError):
        ranking.check_top(1001)
    first = ranking.first_per_key(s, ["board", "member"], ["seq"]).filter("member = 'ann'").first()
    assert first.score == 5.0


def test_lru(spark):
    a = spark.createDataFrame([(k, i) for i, k in enumerate("abcabda")], "key string, seq int")
    assert [r.key for r in ranking.lru_survivors(a, 2).collect()] == ["a", "d"]


def test_rooms(spark):
    said = spark.createDataFrame([("r", t) for t in range(4)], "room string, turn bigint")
    m = spark.createDataFrame([("r", 1, 0, 2), ("r", 2, 2, 9), ("q", 3, 0, 9)], "room string, client int, joined bigint, left bigint")
    assert sorted((r.turn, r.client) for r in realtime.fan_out(said, m).collect()) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert {(r.client, r.missed) for r in realtime.missed_by_late(said, m).collect()} == {(1, 0), (2, 2), (3, 0)}
    changes = spark.createDataFrame([("r", 0, 1, 1), ("r", 2, 0, 1), ("r", 2, 1, 2), ("r", 3, 1, 3), ("r", 4, 0, 2), ("r", 5, 0, 3)], "room string, at bigint, kind int, client int")
    assert [(r.at, r.action) for r in realtime.refcount_transitions(changes).orderBy("at", "kind").collect()] == [(0, "subscribe"), (2, "unsubscribe"), (2, "subscribe"), (5, "unsubscribe")]


def test_receivers_without_a_join(spark):
    rnd = random.Random(3)
    subs = [(rnd.randrange(2), b := rnd.randrange(50), b + rnd.randrange(1, 20)) for _ in range(40)]
    said = [(rnd.randrange(2), rnd.randrange(60), k) for k in range(60)]
    got = realtime.receiver_counts(spark.createDataFrame(said, "channel int, ts bigint, message bigint"), spark.createDataFrame(subs, "channel int, begins bigint, ends bigint"))
    assert {r.message: r.receivers for r in got.collect()} == {m: sum(c == x and b <= t < e for x, b, e in subs) for c, t, m in said}


def test_heartbeats(spark):
    b = spark.createDataFrame([("a", 0), ("a", 50), ("a", 151), ("b", 0)], "key string, ts_us bigint")
    assert [(r.key, r.gap) for r in realtime.heartbeat_gaps(b, 100).collect()] == [("a", 101)]


def test_pending_entries_are_of_the_whole_log(spark, tmp_path):
    """Delivered minus acknowledged, by hand, on a log of more than 5000 entries."""
    n, day = 18_000, 86_400_000_000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * (30 * day // n)).alias("ts"),
        F.lit(1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    left = [i for i in range(n) if i % 5]
    idle = {i: (n - 1 - i) * (30 * day // n) for i in left}
    got = {r.id: r for r in QUERIES["pel_entries"](spark, str(tmp_path)).collect()}
    assert sorted(got) == left
    assert all((r.consumer, r.idle_us, r.delivery_count) == ((i + 1) % 3, idle[i], 1 + i % 3) for i, r in got.items())
    want = {c: [i for i in left if (i + 1) % 3 == c] for c in range(3)}
    assert {r.consumer: (r.pending, r.first_id, r.last_id) for r in QUERIES["pel_summary"](spark, str(tmp_path)).collect()} == {c: (len(x), x[0], x[-1]) for c, x in want.items()}
    # Idle for 20 days of 30: the first third of the log, which goes past entry 5000.
    stale = [i for i in left if idle[i] >= 20 * day]
    assert sorted(r.id for r in QUERIES["claim_stale"](spark, str(tmp_path)).collect()) == [i for i in stale if i % 11]
    assert sorted(r.id for r in QUERIES["claim_deleted_ids"](spark, str(tmp_path)).collect()) == [i for i in stale if i % 11 == 0]


# -- nulls, patterns, over-delivered messages


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_numbering_loses_no_row(spark, broadcast):
    """Null keys are one key, null times come last."""
    rnd = random.Random(2)
    rows = [(k, rnd.choice((None, 1, 2)), rnd.choice((None, *range(30)))) for k in range(200)] + [(900, None, None), (901, 7, None), (902, None, 3)]
    df = spark.createDataFrame(rows, "id int, key int, ts int").withColumn("b", F.floor(F.col("ts") / 7))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {r.id: r.n for r in log.keyed_sequence(df, ["key"], ["ts", "id"], "b", "n").collect()}
        whole = {r.id: r.n for r in log.global_sequence(df, ["ts", "id"], "b", "n").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    last = lambda x: (x[2] is None, x[2] or 0, x[0])
    for key in (None, 1, 2, 7):
        assert [got[i] for i, *_ in sorted((x for x in rows if x[1] == key), key=last)] == list(range(1, sum(x[1] == key for x in rows) + 1))
    assert [whole[i] for i, *_ in sorted(rows, key=last)] == list(range(1, len(rows) + 1))


def words_match(pattern, words):
    """Word by word: ``*`` takes one, ``#`` none or more."""
    if not pattern:
        return not words
    if pattern[0] == "#":
        return any(words_match(pattern[1:], words[k:]) for k in range(len(words) + 1))
    return bool(words) and pattern[0] in ("*", words[0]) and words_match(pattern[1:], words[1:])


def test_topic_patterns_word_by_word():
    rnd = random.Random(3)
    for _ in range(4000):
        pattern = rnd.choices(["#", "*", "a", "b", "#"], k=rnd.randint(1, 5))
        words = rnd.choices(["a", "b", "c"], k=rnd.randint(1, 5))
        got = re.search(routing.topic_regex(".".join(pattern)).replace(r"\z", r"\Z"), ".".join(words)) is not None
        assert got == words_match(pattern, words), (pattern, words)


def test_over_delivered_messages_skip_the_handler(spark):
    messages = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 5, False), (4, 5, None)], "id int, fails int, dies boolean")
    rows = delivery.consumed(messages, F.col("fails"), F.col("dies"), 1).collect()
    assert sorted((r.id, r.attempt, r.handled, r.failed, r.dead) for r in rows) == [
        (1, 1, False, False, False), (1, 2, False, False, True), (2, 1, True, False, False), (3, 1, True, True, True), (4, 1, True, True, True),
    ]


# -- folds in parts, and without Python


def timed(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice((None, 1, 2, 3)), rnd.randrange(3000), rnd.choice(("acquire", "release", "acquire")), rnd.randrange(3), rnd.random() < 0.3) for k in range(n)]
    return spark.createDataFrame(rows, "id int, key int, at bigint, op string, token bigint, fails boolean")


@pytest.mark.parametrize("fold, inputs, new, quiet", [(folds.sliding_window(2, 20), ["at"], "x boolean", 20), (folds.expiring_once(25), ["at", "fails"], "x string", 25), (folds.cache_aside(15), ["at", "fails"], "x string", 15), (folds.singleflight(30), ["at"], "x bigint", 30)])
def test_folds_in_parts_are_the_whole(spark, fold, inputs, new, quiet):
    df = timed(spark, 4)
    whole = {r.id: r.x for r in folds.ordered_fold(df, ["key"], ["at", "id"], inputs, fold, new).collect()}
    parts = folds.ordered_fold(df, ["key"], ["at", "id"], inputs, fold, new, ("at", quiet))
    assert parts.columns == [*df.columns, "x"] and {r.id: r.x for r in parts.collect()} == whole
    assert folds.quiet_parts(df, ["key"], ["at", "id"], "at", quiet).select("key", "_part").distinct().count() > 20


def test_locks_in_parts_keep_their_fences(spark):
    df = timed(spark, 5)
    whole = {r.id: (r.result, r.fence) for r in folds.ordered_fold(df, ["key"], ["at", "id"], ["at", "op", "token"], folds.lock(40), "result string, fence bigint").collect()}
    assert {r.id: (r.result, r.fence) for r in folds.held_locks(df, ["key"], ["at", "id"], ["at", "op", "token"], 40).collect()} == whole


def test_queues_by_windows_are_the_folds(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.choice((None, 1, 2)), rnd.choice(("put", "put", "take")), rnd.randrange(6), rnd.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, key int, op string, queued int, drained int")
    want = {r.id: (r.size, r.waiting) for r in folds.ordered_fold(df, ["key"], ["id"], ["op"], folds.bounded_queue(3), "size bigint, waiting bigint").collect()}
    assert {r.id: (r.size, r.waiting) for r in folds.queue_occupancy(df, ["key"], ["id"], F.col("op") == "put", 3).collect()} == want
    drops = {}
    for key in (None, 1, 2):
        step = folds.slow_client(12)()
        for n, r in enumerate((r for r in rows if r[1] == key), 1):
            backlog, gone = step(r[3], r[4])
            if gone:
                drops.setdefault(key, (n, backlog))
    got = {r.key: (r.dropped_after, r.backlog) for r in folds.client_drops(df, ["key"], ["id"], "queued", "drained", 12).collect()}
    assert got == drops and drops


def test_refused_keys_by_policy(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4), ("c", 5)], "key string, seq bigint")
    refused = lambda p: {(r.key, r.rejected) for r in ranking.refused(seen, 2, p).collect()}
    assert refused("noeviction") == refused("volatile-ttl") == {("c", 2)} and refused("allkeys-lru") == set()
    with pytest.raises(ValueError):
        ranking.refused(seen, 2, "other")


def test_seed_and_pages(spark):
    rows = log.seed(spark, "k", 101, 8).collect()
    assert len(rows) == 101 and rows[100].batch_no == 2 and rows[0].value == "x" * 8
    pages = log.pages(log.seed(spark, "k", 1000, 1), "value", 500).first()
    assert (pages.deleted, pages.pages, pages.last_page) == (1000, 2, 500)


def test_receivers_across_buckets(spark):
    rnd = random.Random(3)
    subs = [(rnd.choice((None, 1, 2)), b := rnd.randrange(100), b + rnd.randrange(60)) for _ in range(60)]
    said = [(rnd.choice((None, 1, 2, 3)), rnd.randrange(170), k) for k in range(120)]
    got = realtime.receiver_counts(spark.createDataFrame(said, "channel int, ts bigint, message bigint"), spark.createDataFrame(subs, "channel int, begins bigint, ends bigint"), bucket=10)
    want = {m: sum(c == x and b <= t < e for x, b, e in subs) for c, t, m in said}
    assert {r.message: r.receivers for r in got.collect()} == want
