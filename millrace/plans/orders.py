"""Queries on orders: outbox, stock, payments, states, sagas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import log as L
from millrace.operators import orders as O
from millrace.sources import tables as T

from .registry import query

LIMIT = 250_000

_SETTLED = f"""n AS (SELECT o_orderkey AS order_id, o_totalprice AS amount, o_orderkey % 100 AS sku, (1 + o_orderkey % 5)::INT AS quantity,
  row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) AS rn FROM orders),
r(sku, rn, stock_left, order_id, quantity, payment, reservation) AS (
  SELECT s.sku, 0::BIGINT, coalesce(p_size, 0)::BIGINT, NULL::BIGINT, NULL::INT, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT sku FROM n) s LEFT JOIN part ON p_partkey = s.sku
  UNION ALL
  SELECT sku, rn, CASE WHEN res = 'reserved' THEN stock_left - quantity ELSE stock_left END, order_id, quantity, pay, res
  FROM (SELECT n.sku, n.rn, r.stock_left, n.order_id, n.quantity, CASE WHEN n.amount > {LIMIT} THEN 'failed' ELSE 'charged' END AS pay,
    CASE WHEN n.quantity > r.stock_left THEN 'rejected' WHEN n.amount > {LIMIT} THEN 'released' ELSE 'reserved' END AS res FROM r JOIN n ON n.sku = r.sku AND n.rn = r.rn + 1)),
settled AS (SELECT *, CASE WHEN reservation = 'reserved' AND payment = 'charged' THEN 'paid' ELSE 'cancelled' END AS status FROM r WHERE rn > 0)"""


def _settled(spark: SparkSession, d: str) -> DataFrame:
    return O.settle(T.order_requests(spark, d), T.stock(spark, d), LIMIT)


@query(f"SELECT CASE WHEN o_totalprice > {LIMIT} THEN 'failed' ELSE 'charged' END AS status, count(*) AS n FROM orders GROUP BY 1")
def payment_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return T.order_requests(spark, d).groupBy(O.payment_status(F.col("amount"), LIMIT).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_SETTLED} SELECT order_id, sku, quantity, reservation, stock_left FROM settled")
def stock_reservation(spark: SparkSession, d: str) -> DataFrame:
    return _settled(spark, d).select("order_id", "sku", "quantity", "reservation", "stock_left")


@query(f"WITH RECURSIVE {_SETTLED} SELECT order_id, sku, quantity FROM settled WHERE reservation = 'released'")
def saga_release(spark: SparkSession, d: str) -> DataFrame:
    return _settled(spark, d).filter("reservation = 'released'").select("order_id", "sku", "quantity")


@query(f"WITH RECURSIVE {_SETTLED} SELECT order_id, reservation, payment, status FROM settled")
def order_final_status(spark: SparkSession, d: str) -> DataFrame:
    status = O.final_status(F.col("reservation"), F.col("payment"))
    return _settled(spark, d).select("order_id", "reservation", "payment", status.alias("status"))


@query(f"""WITH RECURSIVE {_SETTLED} SELECT order_id,
  CASE WHEN status = 'paid' THEN 'placed,paid' WHEN payment = 'charged' THEN 'placed,paid,cancelled' ELSE 'placed,payment_failed,cancelled' END AS trail,
  CASE WHEN status = 'paid' THEN 'placed,paid' WHEN reservation = 'rejected' THEN 'placed,cancelled' ELSE 'placed,payment_failed,cancelled' END AS trail_stock_first FROM settled""")
def order_status_trail(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("reservation"), F.col("payment")
    return _settled(spark, d).select("order_id", F.array_join(O.status_trail(s, p), ",").alias("trail"), F.array_join(O.status_trail(s, p, False), ",").alias("trail_stock_first"))


@query(f"""WITH RECURSIVE {_SETTLED} SELECT status, reservation, payment, 3 + CASE WHEN reservation = 'released' THEN 1 ELSE 0 END AS events, count(*) AS orders FROM settled GROUP BY ALL""")
def events_per_order(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("reservation"), F.col("payment")
    rows = _settled(spark, d).select(O.final_status(s, p).alias("status"), "reservation", "payment", F.size(O.order_events(s, p)).alias("events"))
    return rows.groupBy("status", "reservation", "payment", "events").agg(F.count("*").alias("orders"))


@query("""SELECT o_orderkey AS order_id, 'placed' AS status, 'placed' AS history, 'OrderPlaced' AS event_type, 'evt-' || o_orderkey AS event_id,
  '{"sku":"' || o_orderkey % 100 || '","quantity":' || (1 + o_orderkey % 5) || '}' AS data FROM orders""")
def place_order_events(spark: SparkSession, d: str) -> DataFrame:
    """One projection gives the order, its first history row and its outbox event."""
    o = T.order_requests(spark, d)
    data = F.to_json(F.struct(F.col("sku").cast("string").alias("sku"), "quantity"))
    return o.select("order_id", F.lit("placed").alias("status"), F.lit("placed").alias("history"), F.lit("OrderPlaced").alias("event_type"), F.concat(F.lit("evt-"), F.col("order_id").cast("string")).alias("event_id"), data.alias("data"))


# -- outbox


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("aggregate_id"), (F.col("o_orderstatus") == "F").alias("published"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    pending = _outbox(spark, d).filter("not published").withColumn("_b", F.floor(F.col("id") / 10_000))
    return L.global_sequence(pending, ["id"], "_b", "rank").drop("_b")


_PENDING = "p AS (SELECT o_orderkey AS id, o_custkey AS aggregate_id, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'F')"


@query(f"WITH {_PENDING} SELECT id, aggregate_id FROM p WHERE rank <= 100")
def outbox_pending_batch(spark: SparkSession, d: str) -> DataFrame:
    return _outbox(spark, d).filter("not published").orderBy("id").limit(100).select("id", "aggregate_id")


@query("SELECT count(*) AS unpublished FROM orders WHERE o_orderstatus <> 'F'")
def outbox_unpublished_count(spark: SparkSession, d: str) -> DataFrame:
    return _outbox(spark, d).agg(F.count_if(~F.col("published")).alias("unpublished"))


@query(f"WITH {_PENDING} SELECT o_orderstatus = 'F' OR coalesce(rank <= 1000, FALSE) AS published, count(*) AS n FROM orders LEFT JOIN p ON id = o_orderkey GROUP BY 1")
def outbox_mark_published(spark: SparkSession, d: str) -> DataFrame:
    box = _outbox(spark, d)
    batch = box.filter("not published").orderBy("id").limit(1000).select("id", F.lit(True).alias("_sent"))
    marked = box.join(F.broadcast(batch), "id", "left").select((F.col("published") | F.coalesce("_sent", F.lit(False))).alias("published"))
    return marked.groupBy("published").agg(F.count("*").alias("n"))


@query(f"WITH {_PENDING} SELECT (rank - 1) // 100 AS batch_no, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM p GROUP BY 1")
def outbox_relay_batches(spark: SparkSession, d: str) -> DataFrame:
    return O.batches(_ranked(spark, d), "rank", 100).groupBy("batch_no").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"""WITH {_PENDING}, b AS (SELECT (rank - 1) // 100 AS batch_no, count(*) AS n, bool_or(id % 997 = 0) AS fails, coalesce(min(rank) FILTER (id % 997 = 0) - min(rank), 0) AS before FROM p GROUP BY 1)
SELECT batch_no, CASE WHEN fails THEN 0 ELSE n END AS marked_first_time, CASE WHEN fails THEN before + n ELSE n END AS deliveries FROM b""")
def outbox_batch_rollback(spark: SparkSession, d: str) -> DataFrame:
    """A batch whose publishing fails at one event marks nothing; what was sent before that event is sent again."""
    b = O.batches(_ranked(spark, d), "rank", 100).withColumn("bad", F.pmod("id", F.lit(997)) == 0)
    per = b.groupBy("batch_no").agg(F.count("*").alias("n"), F.bool_or("bad").alias("fails"), F.coalesce(F.min(F.when(F.col("bad"), F.col("rank"))) - F.min("rank"), F.lit(0)).alias("before"))
    return per.select("batch_no", F.when(F.col("fails"), F.lit(0).cast("bigint")).otherwise(F.col("n")).alias("marked_first_time"), F.when(F.col("fails"), F.col("before") + F.col("n")).otherwise(F.col("n")).alias("deliveries"))


@query(f"WITH {_PENDING} SELECT id, (rank - 1) // 4 AS round, CASE (rank - 1) % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 2 END AS publish_no FROM p")
def relay_interleaving(spark: SparkSession, d: str) -> DataFrame:
    """Relay A holds two rows locked, relay B takes the next two: published in the order 3, 4, 1, 2 of each four."""
    within = F.pmod(F.col("rank") - 1, F.lit(4)) + 1
    late = O.relay_interleaving(within, 2)
    number = F.when(late == 1, within + 2).otherwise(within - 2)
    return _ranked(spark, d).select("id", F.floor((F.col("rank") - 1) / 4).cast("bigint").alias("round"), number.cast("int").alias("publish_no"))


# -- sagas


def _steps(i: Column) -> Column:
    def step(k: int, name: str) -> Column:
        return F.struct(F.lit(name).alias("name"), (F.pmod(i, F.lit(6)) == k).alias("run_fails"), (F.pmod(i, F.lit(7)) == k).alias("compensate_fails"))

    return F.array(*(step(k, n) for k, n in enumerate(("reserve", "charge", "ship", "notify"))))


_SAGA = """s AS (SELECT o_orderkey AS saga_id, ['reserve', 'charge', 'ship', 'notify'] AS names, CASE WHEN o_orderkey % 6 < 4 THEN o_orderkey % 6 END AS f, o_orderkey % 7 AS c FROM orders),
t AS (SELECT saga_id, f, c, CASE WHEN f IS NULL THEN names ELSE names[1 : f] END AS ran FROM s)"""


def _sagas(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "orders").select(F.col("o_orderkey").alias("saga_id"), O.saga(_steps(F.col("o_orderkey"))).alias("s"))


@query(f"""WITH {_SAGA} SELECT saga_id, CASE WHEN f IS NULL THEN 'completed' WHEN c < f THEN 'compensation_failed' ELSE 'compensated' END AS status, len(ran)::INT AS ran FROM t""")
def saga_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _sagas(spark, d).select("saga_id", F.col("s.status").alias("status"), F.size("s.ran").alias("ran"))


@query(f"""WITH {_SAGA} SELECT saga_id, array_to_string(list_reverse([x for x, i in ran if i - 1 <> c]), ',') AS compensated,
  CASE WHEN c < f THEN ran[c + 1] ELSE '' END AS failed_compensations FROM t WHERE f IS NOT NULL""")
def saga_compensation_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _sagas(spark, d).filter("s.status <> 'completed'")
    return rows.select("saga_id", F.array_join("s.compensated", ",").alias("compensated"), F.array_join("s.failed_compensations", ",").alias("failed_compensations"))
