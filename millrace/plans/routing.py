"""Queries on routing, parsing and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import routing as R
from millrace.operators import validate as V
from millrace.operators.log import keyed_sequence
from millrace.sources import tables as T

from .registry import EV, query

_KEY_SQL = """CASE event_id % 4 WHEN 0 THEN 'orders' WHEN 1 THEN 'orders.' || event_type WHEN 2 THEN 'orders.' || event_type || '.created'
  ELSE 'payments.' || event_type || '.' || (user_id % 3) || '.created' END"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    m, t = F.pmod("event_id", F.lit(4)), F.col("event_type")
    key = F.when(m == 0, F.lit("orders")).when(m == 1, F.concat(F.lit("orders."), t)).when(m == 2, F.concat(F.lit("orders."), t, F.lit(".created")))
    key = key.otherwise(F.concat(F.lit("payments."), t, F.lit("."), F.pmod("user_id", F.lit(3)).cast("string"), F.lit(".created")))
    return T.events(spark, d).select("event_id", key.alias("routing_key"), (F.pmod("event_id", F.lit(8)) < 4).alias("mandatory"))


@query(f"SELECT event_id, {_KEY_SQL} AS routing_key FROM events WHERE regexp_full_match({_KEY_SQL}, 'orders\\.[^.]+\\.created')")
def topic_route_star(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).filter(R.topic_matches(F.col("routing_key"), "orders.*.created")).select("event_id", "routing_key")


@query(f"SELECT event_id, {_KEY_SQL} AS routing_key FROM events WHERE {_KEY_SQL} = 'orders' OR starts_with({_KEY_SQL}, 'orders.')")
def topic_route_hash(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).filter(R.topic_matches(F.col("routing_key"), "orders.#")).select("event_id", "routing_key")


@query(f"SELECT event_id, {_KEY_SQL} AS routing_key FROM events WHERE {_KEY_SQL} = 'created' OR ends_with({_KEY_SQL}, '.created')")
def topic_route_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Two marks for any number of words, one after the other, are one."""
    return _keyed(spark, d).filter(R.topic_matches(F.col("routing_key"), "#.#.created")).select("event_id", "routing_key")


_BINDINGS = {"orders.#": "orders", "orders.*": "orders", "*.*.created": "created", "#.2.created": "created", "payments.#": "billing"}
_BOUND_SQL = f"""k AS (SELECT event_id, ts, {_KEY_SQL} AS routing_key FROM events),
bound AS (SELECT q.queue, k.* FROM k JOIN (VALUES ('orders'), ('created'), ('billing')) q(queue) ON CASE q.queue WHEN 'orders' THEN split_part(routing_key, '.', 1) = 'orders'
  WHEN 'billing' THEN split_part(routing_key, '.', 1) = 'payments' ELSE split_part(routing_key, '.', -1) = 'created' AND (len(string_split(routing_key, '.')) = 3 OR split_part(routing_key, '.', -2) = '2') END)"""


@query(f"WITH {_BOUND_SQL} SELECT queue, event_id, routing_key FROM bound")
def topic_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Messages against a table of bindings; a queue with two bindings that match gets a message once."""
    return R.route(_keyed(spark, d).select("event_id", "routing_key"), _BINDINGS).select("queue", "event_id", "routing_key")


@query(f"WITH {_BOUND_SQL} SELECT queue, row_number() OVER (PARTITION BY queue ORDER BY ts, event_id) AS position, routing_key FROM bound")
def drain_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The routing keys that emptying each queue returns, in order."""
    times = T.events(spark, d).select("event_id", "ts_us", "_hour")
    bound = R.route(_keyed(spark, d).join(times, "event_id"), _BINDINGS)
    return keyed_sequence(bound, ["queue"], ["ts_us", "event_id"], "_hour", "position").select("queue", "position", "routing_key")


@query(f"""WITH k AS (SELECT event_id, {_KEY_SQL} AS routing_key, event_id % 8 < 4 AS mandatory FROM events)
SELECT event_id, routing_key, CASE WHEN mandatory THEN 'returned' ELSE 'dropped' END AS outcome, CASE WHEN mandatory THEN 312 END AS reply_code
FROM k WHERE NOT (regexp_full_match(routing_key, 'orders\\.[^.]+\\.created') OR regexp_full_match(routing_key, '.*\\.1\\.created'))""")
def unroutable_messages(spark: SparkSession, d: str) -> DataFrame:
    out = R.unroutable(_keyed(spark, d), ["orders.*.created", "#.1.created"])
    return out.select("event_id", "routing_key", "outcome", "reply_code")


@query("""SELECT queue, event_id, event_type AS routing_key FROM events
JOIN (VALUES ('click', 'activity'), ('view', 'activity'), ('view', 'audit'), ('purchase', 'billing')) b(event_type, queue) USING (event_type)""")
def direct_route(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("click", "activity"), ("view", "activity"), ("view", "audit"), ("purchase", "billing")]
    bindings = spark.createDataFrame(pairs, "routing_key string, queue string")
    return R.direct(T.events(spark, d).select("event_id", F.col("event_type").alias("routing_key")), bindings).select("queue", "event_id", "routing_key")


#: One good form and six bad ones.
_RAW_SQL = """CASE event_id % 7 WHEN 0 THEN '{"eventId":"' || event_id || '","type":"Ord' WHEN 1 THEN 'null' WHEN 2 THEN '{"eventId":"' || event_id || '","type":"","orderId":"o","data":{}}'
  WHEN 3 THEN '{"eventId":"' || event_id || '","type":"OrderPlaced","orderId":"o","data":[1]}' WHEN 4 THEN '{"eventId":' || event_id || ',"type":"OrderPlaced","orderId":"o","data":{}}'
  ELSE '{"eventId":"' || event_id || '","type":"OrderPlaced","orderId":"' || user_id || '","data":' || props || '}' END"""
_OK_SQL = """coalesce(CASE WHEN json_valid(raw) THEN json_type(raw, '$.eventId') = 'VARCHAR' AND json_type(raw, '$.type') = 'VARCHAR' AND json_extract_string(raw, '$.type') <> ''
  AND json_type(raw, '$.orderId') = 'VARCHAR' AND json_type(raw, '$.data') = 'OBJECT' END, FALSE)"""


def _raw(i: Column, user: Column, props: Column) -> Column:
    i, user, m = i.cast("string"), user.cast("string"), F.pmod(i, F.lit(7))

    def with_id(rest: str) -> Column:
        return F.concat(F.lit('{"eventId":"'), i, F.lit(rest))

    good = F.concat(F.lit('{"eventId":"'), i, F.lit('","type":"OrderPlaced","orderId":"'), user, F.lit('","data":'), props, F.lit("}"))
    return (
        F.when(m == 0, with_id('","type":"Ord'))
        .when(m == 1, F.lit("null"))
        .when(m == 2, with_id('","type":"","orderId":"o","data":{}}'))
        .when(m == 3, with_id('","type":"OrderPlaced","orderId":"o","data":[1]}'))
        .when(m == 4, F.concat(F.lit('{"eventId":'), i, F.lit(',"type":"OrderPlaced","orderId":"o","data":{}}')))
        .otherwise(good)
    )


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", "user_id", "ts_us", _raw(F.col("event_id"), F.col("user_id"), F.col("props")).alias("raw"))


@query(f"WITH r AS (SELECT event_id, {_RAW_SQL} AS raw FROM events) SELECT event_id, CASE WHEN {_OK_SQL} THEN 'ok' ELSE 'poison' END AS result FROM r")
def parse_event_poison(spark: SparkSession, d: str) -> DataFrame:
    return raw_events(spark, d).select("event_id", V.parse_event(F.col("raw")).alias("result"))


@query(f"""WITH r AS (SELECT event_id, user_id, {_RAW_SQL} AS raw FROM events)
SELECT (user_id % 3)::INT AS partition_id, count(*) AS committed, count(*) FILTER ({_OK_SQL}) AS handled, count(*) FILTER (NOT {_OK_SQL}) AS skipped FROM r GROUP BY 1""")
def poison_skip(spark: SparkSession, d: str) -> DataFrame:
    """Poison is counted and committed like all else; it never blocks its partition."""
    r = raw_events(spark, d).withColumn("ok", V.parse_event(F.col("raw")) == "ok")
    return r.groupBy(F.pmod("user_id", F.lit(3)).cast("int").alias("partition_id")).agg(F.count("*").alias("committed"), F.count_if("ok").alias("handled"), F.count_if(~F.col("ok")).alias("skipped"))


#: Quantities and amounts as an order's data may have them.
_QUANTITY = ("2", "2.0", "2e0", "1.5", "2147483648", "null", '"5"', "0", "-3", "2147483647")
_GOOD = {"2": 2, "2.0": 2, "2e0": 2, "2147483647": 2147483647}


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE CASE event_id % 10 "
    + " ".join(f"WHEN {i} THEN {_GOOD[q]}" for i, q in enumerate(_QUANTITY) if q in _GOOD)
    + " END END AS quantity FROM events"
)
def validate_placed(spark: SparkSession, d: str) -> DataFrame:
    q = F.element_at(F.array(*map(F.lit, _QUANTITY)), F.pmod("event_id", F.lit(10)).cast("int") + 1)
    amount = F.when(F.pmod("event_id", F.lit(4)) == 1, F.lit('"amount":"5",')).otherwise(F.lit('"amount":5.5,'))
    data = F.concat(F.lit("{"), amount, F.lit('"sku":"s","quantity":'), q, F.lit("}"))
    return T.events(spark, d).select("event_id", V.placed_quantity(data).alias("quantity"))


_REQ_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '-' END || c_custkey END AS id,
  c_acctbal AS amount, repeat('🙂', (60 + c_custkey % 7)::INT) AS sku, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 1500 * 1000 END AS quantity FROM customer"""


@query(f"""WITH r AS ({_REQ_SQL})
SELECT c_custkey, CASE WHEN id IS NOT NULL AND NOT regexp_full_match(id, '[A-Za-z0-9._-]{{1,64}}') THEN 'id' WHEN amount IS NULL OR NOT amount > 0 THEN 'amount'
  WHEN NOT length(sku) BETWEEN 1 AND 64 THEN 'sku' WHEN NOT coalesce(quantity, 1) BETWEEN 1 AND 1000000 THEN 'quantity' END AS error,
  coalesce(quantity, 1)::BIGINT AS quantity FROM r""")
def validate_order_request(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    i = F.when(F.pmod(k, F.lit(5)) != 0, F.concat("c_mktsegment", F.when(F.pmod(k, F.lit(3)) == 0, "/").otherwise("-"), k.cast("string")))
    sku = F.repeat(F.lit("🙂"), (60 + F.pmod(k, F.lit(7))).cast("int"))
    quantity = F.when(F.pmod(k, F.lit(4)) != 0, F.pmod(k, F.lit(1500)) * 1000)
    r = T.read(spark, d, "customer").select("c_custkey", i.alias("id"), F.col("c_acctbal").alias("amount"), sku.alias("sku"), quantity.alias("quantity"))
    error = V.order_request_error(F.col("id"), F.col("amount"), F.col("sku"), F.col("quantity"))
    return r.select("c_custkey", error.alias("error"), F.coalesce("quantity", F.lit(1)).cast("bigint").alias("quantity"))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE replace(p_name, ' ', '-') END || CASE p_partkey % 50 WHEN 1 THEN repeat('x', 64) ELSE '' END AS room FROM part)
SELECT p_partkey, room, regexp_full_match(room, '[A-Za-z0-9._-]{1,64}') AS valid FROM r""")
def validate_room_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    room = F.when(F.pmod(k, F.lit(3)) == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    room = F.concat(room, F.when(F.pmod(k, F.lit(50)) == 1, "x" * 64).otherwise(""))
    return T.read(spark, d, "part").select("p_partkey", room.alias("room")).withColumn("valid", F.col("room").rlike(V.NAME))


@query("""WITH p AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{"text":"' || conv_id || '"}' WHEN 1 THEN '{"text":""}' WHEN 2 THEN '{"text":' || turn || '}' ELSE '{"text":"' || repeat('y', 4090) || '"}' END AS payload FROM conversations)
SELECT conv_id, turn, CASE WHEN strlen(payload) > 4096 THEN 1009 WHEN json_type(payload, '$.text') = 'VARCHAR' AND json_extract_string(payload, '$.text') <> '' THEN NULL ELSE 1003 END AS close_code FROM p""")
def chat_parse_codes(spark: SparkSession, d: str) -> DataFrame:
    m = F.pmod("turn", F.lit(4))
    payload = F.when(m == 0, F.concat(F.lit('{"text":"'), F.col("conv_id").cast("string"), F.lit('"}'))).when(m == 1, F.lit('{"text":""}'))
    payload = payload.when(m == 2, F.concat(F.lit('{"text":'), F.col("turn").cast("string"), F.lit("}"))).otherwise(F.lit('{"text":"' + "y" * 4090 + '"}'))
    return T.read(spark, d, "conversations").select("conv_id", "turn", V.chat_code(payload).alias("close_code"))


@query("""SELECT doc_id, strlen(text) AS bytes, strlen(text) > 4096 AS over_message_limit, strlen(text) > 65536 AS over_body_limit,
  CASE WHEN strlen(text) > 65536 THEN 413 WHEN strlen(text) > 4096 THEN 1009 END AS code FROM documents WHERE strlen(text) > 4096""")
def oversize_messages(spark: SparkSession, d: str) -> DataFrame:
    b = F.octet_length("text").cast("bigint")
    rows = T.read(spark, d, "documents").select("doc_id", b.alias("bytes")).filter("bytes > 4096")
    code = F.when(F.col("bytes") > 65536, 413).when(F.col("bytes") > 4096, 1009)
    return rows.select("doc_id", "bytes", (F.col("bytes") > 4096).alias("over_message_limit"), (F.col("bytes") > 65536).alias("over_body_limit"), code.alias("code"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """``consumer, result``: what two consumers make of the redelivered events. Duplicates are told after poison and before what is ignored."""
    rows = T.redelivered(raw_events(spark, d)).withColumn("consumer", F.explode(F.array(F.lit("inventory"), F.lit("payment"))))
    ignored = (F.col("consumer") == "payment") & (F.pmod("event_id", F.lit(5)) == 0)
    result = F.when(V.parse_event(F.col("raw")) == "poison", "poison").when(F.col("delivery") > 1, "duplicate").when(ignored, "ignored").otherwise("applied")
    return rows.select("consumer", result.alias("result"))


_RESULTS_SQL = f"""WITH d AS (SELECT event_id, user_id, props, 1 AS delivery FROM events UNION ALL SELECT event_id, user_id, props, 2 FROM events WHERE event_id % 4 = 0),
r AS (SELECT event_id, delivery, {_RAW_SQL} AS raw FROM d),
res AS (SELECT c.consumer, CASE WHEN NOT {_OK_SQL} THEN 'poison' WHEN delivery > 1 THEN 'duplicate' WHEN c.consumer = 'payment' AND event_id % 5 = 0 THEN 'ignored' ELSE 'applied' END AS result
  FROM r, (VALUES ('inventory'), ('payment')) c(consumer))"""


@query(f"{_RESULTS_SQL} SELECT consumer, result, count(*) AS n FROM res GROUP BY ALL")
def consumer_result_counts(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("consumer", "result").agg(F.count("*").alias("n"))


@query(f"""{_RESULTS_SQL}, n AS (SELECT consumer, result, count(*) AS n FROM res GROUP BY ALL)
SELECT c.consumer, l.result, coalesce(n, 0) AS n FROM (VALUES ('inventory'), ('payment'), ('notification')) c(consumer), (VALUES ('applied'), ('duplicate'), ('ignored'), ('poison')) l(result)
LEFT JOIN n ON n.consumer = c.consumer AND n.result = l.result""")
def metrics_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([(c, r) for c in ("inventory", "payment", "notification") for r in ("applied", "duplicate", "ignored", "poison")], "consumer string, result string")
    counts = results(spark, d).groupBy("consumer", "result").agg(F.count("*").alias("n"))
    return labels.join(counts, ["consumer", "result"], "left").select("consumer", "result", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {EV}, d AS (SELECT event_id, ts_us FROM ev UNION ALL SELECT event_id, ts_us FROM ev WHERE event_id % 4 = 0) SELECT DISTINCT event_id, ts_us FROM d")
def idempotent_distinct(spark: SparkSession, d: str) -> DataFrame:
    return T.redelivered(T.events(spark, d)).select("event_id", "ts_us").dropDuplicates(["event_id"])
