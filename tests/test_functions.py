"""Hashes, patterns, back-off and checks against known values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, scalars
from millrace.operators import routing, validate


def values(spark, rows, *columns, schema="k string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], schema).select(*columns).collect()]


def crc(data):
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x1021 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def test_crc_and_slots(spark):
    keys = ["123456789", "", "foo", "{user1000}.following", "user1000", "foo{}{bar}", "{bar}", "é{日}x", "a{b", "}a{b}"]
    got = values(spark, keys, hashing.crc16(F.encode("k", "UTF-8")), hashing.hash_slot(F.col("k")))
    assert got[0] == (0x31C3, 12739)
    assert [g[0] for g in got] == [crc(k.encode()) for k in keys]
    assert got[3][1] == got[4][1] and got[5][1] != got[6][1] and got[9][1] == crc(b"b") % 16384


def test_hash_tags(spark):
    cases = {"{a}b": "a", "x{a}{b}": "a", "{}a": "{}a", "foo{}{bar}": "foo{}{bar}", "{{a}}": "{a", "a{b": "a{b", "": ""}
    assert [g[0] for g in values(spark, list(cases), hashing.hash_tag(F.col("k")))] == list(cases.values())


def murmur(data):
    m, h = 0x5BD1E995, (0x9747B28C ^ len(data)) & 0xFFFFFFFF
    for i in range(0, len(data) // 4 * 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & 0xFFFFFFFF
        k = (k ^ k >> 24) * m & 0xFFFFFFFF
        h = (h * m ^ k) & 0xFFFFFFFF
    rest = data[len(data) // 4 * 4 :]
    if rest:
        h = (h ^ int.from_bytes(rest, "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_murmur2(spark):
    rnd = random.Random(1)
    keys = ["alice", "bob", "carol", "dave", "erin", "", "é日🙂"] + ["".join(rnd.choices("abcXYZ09é", k=rnd.randint(1, 30))) for _ in range(60)]
    got = values(spark, keys, hashing.murmur2(F.encode("k", "UTF-8")), hashing.murmur2_partition(F.col("k"), 3))
    assert [g[0] for g in got] == [murmur(k.encode()) for k in keys]
    assert [g[1] for g in got[:5]] == [0, 0, 2, 1, 2]


def test_backoff(spark):
    got = values(spark, list(range(9)) + [1100], scalars.backoff_bound(F.col("k"), 100, 1_000_000), scalars.backoff_delay(F.col("k"), F.lit(0.5), 100, 1_000_000), schema="k int")
    want = [min(1_000_000.0, 100.0 * 2**k) for k in range(9)] + [1_000_000.0]
    assert got == [(w, w / 2) for w in want]
    assert values(spark, [0], scalars.backoff_delay(F.col("k"), F.lit(1.0), 100, 1000), scalars.backoff_delay(F.col("k"), F.lit(0.0), 100, 1000), schema="k int") == [(None, 0.0)]
    assert values(spark, [3], scalars.retry_delay(1000, F.col("k")), schema="k int") == [(8000,)]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("orders.*.created", ["orders.eu.created"], ["orders.created", "orders.eu.vn.created"]),
        ("orders.#", ["orders", "orders.eu", "orders.eu.vn.created"], ["payments.created", "ordersx", "orderx.eu"]),
        ("#.created", ["created", "a.created", "a.b.created"], ["a.created.b", "acreated"]),
        ("#", ["", "a", "a.b"], []),
        ("a.#.b", ["a.b", "a.x.b", "a.x.y.b"], ["a.xb", "ab", "a.b.c"]),
        ("*", ["a"], ["a.b"]),
        ("a+.b", ["a+.b"], ["aa.b"]),
    ],
)
def test_topics(pattern, yes, no):
    rx = re.compile(routing.topic_regex(pattern).replace(r"\z", r"\Z"))
    assert all(rx.match(k) for k in yes) and not any(rx.match(k) for k in no)


def test_route_gives_a_queue_a_message_once(spark):
    m = spark.createDataFrame([(1, "a.b"), (2, "x")], "id int, routing_key string")
    got = routing.route(m, {"a.*": "q1", "a.#": "q1", "#.b": "q2"})
    assert sorted((r.id, r.queue) for r in got.collect()) == [(1, "q1"), (1, "q2")]


def test_unroutable(spark):
    m = spark.createDataFrame([("payments.refund", True), ("payments.refund", False), ("orders.eu.created", True)], "routing_key string, mandatory boolean")
    got = routing.unroutable(m, ["orders.eu.created"]).collect()
    assert sorted((r.outcome, r.reply_code) for r in got) == sorted([("returned", 312), ("dropped", None)], key=str) or {(r.outcome, r.reply_code) for r in got} == {("returned", 312), ("dropped", None)}


def test_globs():
    for glob, text, want in (("a*", "abc", True), ("a?c", "abc", True), ("[ab]x", "bx", True), (r"a\*", "a*", True), (r"a\*", "ab", False), ("a.c", "abc", False)):
        assert bool(re.match(scalars.glob_regex(glob).replace(r"\z", r"\Z"), text)) is want


def test_placed(spark):
    data = ['{"amount":1,"quantity":%s}' % q for q in ("2", "2.0", "2e0", "1.5", "2147483648", "null", '"5"', "0", "2147483647")]
    data += ['{"quantity":2}', '{"amount":null,"quantity":2}', '{"amount":"5","quantity":2}', "not json", None, "[]"]
    got = [g[0] for g in values(spark, data, validate.placed_quantity(F.col("k")))]
    assert got == [2, 2, 2, None, None, None, None, None, 2147483647] + [None] * 6


def test_events_and_chat(spark):
    good = '{"eventId":"1","type":"T","orderId":"o","data":{}}'
    bad = ['{"eventId":1,"type":"T","orderId":"o","data":{}}', '{"eventId":"1","type":"","orderId":"o","data":{}}', '{"eventId":"1","type":"T","orderId":"o","data":[]}', "null", "{", None]
    assert [g[0] for g in values(spark, [good, *bad], validate.parse_event(F.col("k")))] == ["ok"] + ["poison"] * 6
    chat = ['{"text":"hi"}', '{"text":""}', '{"text":1}', "x", '{"text":"%s"}' % ("y" * 5000)]
    assert [g[0] for g in values(spark, chat, validate.chat_code(F.col("k")))] == [None, 1003, 1003, 1003, 1009]


def test_sku_length_counts_code_points(spark):
    rows = [("a", 1.0, "🙂" * 64, None), ("a", 1.0, "🙂" * 65, 1), ("a/b", 1.0, "s", 1), (None, 0.0, "s", 1), ("a", 1.0, "s", 1_000_001)]
    df = spark.createDataFrame(rows, "i string, a double, s string, q int")
    got = df.select(validate.order_request_error(*map(F.col, "iasq")).alias("e")).collect()
    assert [r.e for r in got] == [None, "sku", "id", "amount", "quantity"]


def test_rfc3339(spark):
    ns = [0, 1, 999_999_999, 1_704_067_200_120_000_000, -1, -86_400_000_000_001, 4_102_444_799_999_999_999]
    text = ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00.000000001Z", "1970-01-01T00:00:00.999999999Z", "2024-01-01T00:00:00.12Z", "1969-12-31T23:59:59.999999999Z", "1969-12-30T23:59:59.999999999Z", "2099-12-31T23:59:59.999999999Z"]
    got = spark.createDataFrame([(x,) for x in ns], "ns bigint").select(scalars.rfc3339_nanos(F.col("ns")).alias("t")).withColumn("back", scalars.parse_rfc3339(F.col("t"))).collect()
    assert [r.t for r in got] == text and [r.back for r in got] == ns
    odd = ["2024-01-01T02:00:00+02:00", "2023-12-31T22:30:00.5-01:30", "2024-01-01", "2024-01-01T24:00:00Z", "2024-13-01T00:00:00Z", "2024-01-01T00:00:00.1234567891Z", "2024-01-01T00:00:00", "", None]
    back = spark.createDataFrame([(x,) for x in odd], "t string").select(scalars.parse_rfc3339(F.col("t")).alias("n")).collect()
    assert [r.n for r in back] == [1_704_067_200_000_000_000, 1_704_067_200_500_000_000, *[None] * 7]
