"""Queries on logs: reading, offsets, replay, numbering, assignment, hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing, scalars
from millrace.operators import log as L
from millrace.operators import ranking
from millrace.sources import tables as T

from .registry import EV, LOG, PLOG, query



def _committed(bounds: DataFrame) -> DataFrame:
    """Commits for the example group: half-way in partition 0, before the first record in partition 1, none in partition 2."""
    at = F.when(F.col("partition_id") == 0, F.floor(F.col("next_offset") / 2).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return bounds.filter("partition_id < 2").select("partition_id", at.alias("committed"))


@query(f"WITH {PLOG} SELECT partition_id, log_offset, key, event_type AS value FROM plog")
def log_full_scan(spark: SparkSession, d: str) -> DataFrame:
    log = T.partitioned_log(spark, d)
    return L.up_to(log, L.partition_bounds(log)).select("partition_id", "log_offset", "key", F.col("event_type").alias("value"))


@query(f"WITH {PLOG} SELECT partition_id, log_offset, key, event_id FROM plog WHERE partition_id = 1 AND log_offset >= 1000")
def log_partition_seek(spark: SparkSession, d: str) -> DataFrame:
    return L.seek(T.partitioned_log(spark, d), 1, 1000).select("partition_id", "log_offset", "key", "event_id")


@query(f"WITH {PLOG} SELECT partition_id, min(log_offset) AS first_offset, max(log_offset) + 1 AS next_offset FROM plog GROUP BY partition_id")
def partition_bounds(spark: SparkSession, d: str) -> DataFrame:
    return L.partition_bounds(T.partitioned_log(spark, d))


@query(f"""WITH {PLOG} SELECT g.group_id, partition_id, count(*) AS n, min(log_offset) AS first_offset, max(log_offset) AS last_offset,
  sum(log_offset * (event_id % 1000))::BIGINT AS checksum FROM plog, (VALUES ('group-a'), ('group-b')) g(group_id) GROUP BY ALL""")
def replay_from_beginning(spark: SparkSession, d: str) -> DataFrame:
    log = T.partitioned_log(spark, d)
    per = log.groupBy("partition_id").agg(
        F.count("*").alias("n"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"), F.sum(F.col("log_offset") * F.pmod("event_id", F.lit(1000))).alias("checksum")
    )
    return per.withColumn("group_id", F.explode(F.array(F.lit("group-a"), F.lit("group-b"))))


@query(f"""WITH {PLOG}, b AS (SELECT partition_id, max(log_offset) FILTER (event_type = 'purchase') AS last_offset, (max(log_offset) + 1) // 2 AS half FROM plog GROUP BY 1)
SELECT p.partition_id, log_offset, event_id FROM plog p JOIN b USING (partition_id)
WHERE log_offset <= last_offset AND log_offset >= CASE partition_id WHEN 0 THEN half ELSE 0 END""")
def resume_until(spark: SparkSession, d: str) -> DataFrame:
    log = T.partitioned_log(spark, d)
    last = log.filter("event_type = 'purchase'").groupBy("partition_id").agg(F.max("log_offset").alias("last_offset"))
    return L.resume(log, _committed(L.partition_bounds(log)), last).select("partition_id", "log_offset", "event_id")


@query(f"WITH {LOG} SELECT seq, event_id FROM log")
def replay_deliver_all(spark: SparkSession, d: str) -> DataFrame:
    return T.log(spark, d).select("seq", "event_id")


_MID = 1_705_276_800_000_000  # 2024-01-15 00:00:00


@query(f"""WITH {LOG}, s AS (SELECT min(seq) AS start_seq FROM log WHERE ts_us >= {_MID})
SELECT seq, event_id, (SELECT count(*) FROM log, s WHERE seq >= start_seq) AS pending_at_start FROM log, s WHERE seq >= start_seq""")
def replay_by_start_time(spark: SparkSession, d: str) -> DataFrame:
    """The log is numbered once: a record's number and that of the first to come tell how many there are."""
    log = T.log(spark, d).select("seq", "event_id", "ts_us")
    ends = log.agg(F.min(F.when(F.col("ts_us") >= _MID, F.col("seq"))).alias("start_seq"), F.max("seq").alias("last_seq"))
    got = log.join(F.broadcast(ends)).filter("seq >= start_seq")
    return got.select("seq", "event_id", (F.col("last_seq") - F.col("start_seq") + 1).alias("pending_at_start"))


@query(f"""WITH {LOG}, m AS (SELECT max(seq) AS m FROM log),
late AS (SELECT m + row_number() OVER (ORDER BY event_id) AS seq, event_id FROM log, m WHERE event_id % 100 = 0)
SELECT seq, event_id, ts_us < {_MID} AS before_start_time FROM late JOIN log USING (event_id) WHERE late.seq > (SELECT m FROM m)""".replace("SELECT seq, event_id, ts_us", "SELECT late.seq AS seq, event_id, ts_us"))
def replay_start_after_end(spark: SparkSession, d: str) -> DataFrame:
    """A start time past the end: records appended later come, even those with earlier times."""
    log = T.log(spark, d)
    start = L.first_sequence_at(log, 4_102_444_800_000_000)
    late = log.filter(F.pmod("event_id", F.lit(100)) == 0).withColumn("_b", F.floor(F.col("event_id") / 10_000))
    late = L.global_sequence(late.drop("seq"), ["event_id"], "_b", "n").drop("_b")
    end = log.agg(F.max("seq").alias("m"))
    appended = late.join(F.broadcast(end)).withColumn("seq", F.col("n") + F.col("m"))
    both = log.select("seq", "event_id", "ts_us").unionByName(appended.select("seq", "event_id", "ts_us"))
    return L.replay_from(both, start).select("seq", "event_id", (F.col("ts_us") < _MID).alias("before_start_time"))


@query(f"""WITH {LOG}, n AS (SELECT seq, ts_us, lead(ts_us) OVER (ORDER BY seq) AS nxt FROM log)
SELECT seq, ts_us + (nxt - ts_us + 1) // 2 AS start_us FROM n WHERE ts_us < nxt""")
def start_time_between(spark: SparkSession, d: str) -> DataFrame:
    log = T.log(spark, d)
    nxt = log.select((F.col("seq") - 1).alias("seq"), F.col("ts_us").alias("nxt"))
    return log.join(nxt, "seq").filter("ts_us < nxt").select("seq", L.midpoint(F.col("ts_us"), F.col("nxt")).alias("start_us"))


@query(f"WITH {LOG} SELECT seq, event_id FROM log WHERE seq > 2000 ORDER BY seq LIMIT 100")
def group_read_new(spark: SparkSession, d: str) -> DataFrame:
    return T.log(spark, d).filter("seq > 2000").orderBy("seq").limit(100).select("seq", "event_id")


@query(f"WITH {LOG} SELECT (seq - 1) // 64 AS batch_no, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY 1")
def pull_fetch_batches(spark: SparkSession, d: str) -> DataFrame:
    b = F.floor((F.col("seq") - 1) / 64).cast("bigint").alias("batch_no")
    return T.log(spark, d).groupBy(b).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(r"""SELECT source || ':' || doc_id AS key, strlen(text) AS bytes FROM documents
WHERE regexp_full_match(source || ':' || doc_id, 'src1.*') AND strlen(text) >= 4096""")
def find_big_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents").select(F.concat_ws(":", "source", "doc_id").alias("key"), F.octet_length("text").cast("bigint").alias("bytes"))
    return docs.filter(F.col("key").rlike(scalars.glob_regex("src1*")) & (F.col("bytes") >= 4096)).orderBy(F.desc("bytes"), "key")


@query("SELECT 'src2:' || doc_id AS key FROM documents WHERE FALSE UNION ALL SELECT source || ':' || doc_id FROM documents WHERE NOT starts_with(source || ':' || doc_id, 'src1')")
def delete_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    keys = T.read(spark, d, "documents").select(F.concat_ws(":", "source", "doc_id").alias("key"))
    return keys.filter(~F.startswith(F.col("key"), F.lit("src1")))


@query(r"""WITH k AS (SELECT p_partkey, p_brand || CASE p_partkey % 5 WHEN 0 THEN '*' WHEN 1 THEN '?' WHEN 2 THEN '[a]' WHEN 3 THEN '\' ELSE '' END || p_partkey AS key FROM part)
SELECT p_partkey, key, regexp_replace(key, '([\\*?\[\]])', '\\\1', 'g') AS pattern, TRUE AS matches_itself FROM k""")
def glob_escape_match(spark: SparkSession, d: str) -> DataFrame:
    m = F.pmod("p_partkey", F.lit(5))
    mark = F.when(m == 0, "*").when(m == 1, "?").when(m == 2, "[a]").when(m == 3, "\\").otherwise("")
    k = T.read(spark, d, "part").select("p_partkey", F.concat("p_brand", mark, F.col("p_partkey").cast("string")).alias("key"))
    k = k.withColumn("pattern", scalars.glob_escape(F.col("key")))
    return k.withColumn("matches_itself", scalars.glob_matches_literal(F.col("key"), F.col("pattern")))


# -- writes


@query(f"WITH {PLOG} SELECT event_id, partition_id, log_offset FROM plog")
def log_append_offsets(spark: SparkSession, d: str) -> DataFrame:
    return T.partitioned_log(spark, d).select("event_id", "partition_id", "log_offset")


@query(f"WITH {LOG} SELECT event_id, ((seq - 1) % 3)::INT AS partition_id FROM log")
def round_robin_partition(spark: SparkSession, d: str) -> DataFrame:
    return T.log(spark, d).select("event_id", L.round_robin(F.col("seq"), 3).alias("partition_id"))


@query(f"WITH {EV} SELECT event_id, (event_id % 4)::INT AS partition_id, event_type AS value FROM ev")
def explicit_partition(spark: SparkSession, d: str) -> DataFrame:
    key = F.pmod("event_id", F.lit(4)).cast("string")
    return T.events(spark, d).select("event_id", key.cast("int").alias("partition_id"), F.col("event_type").alias("value"))


@query(f"WITH {LOG} SELECT event_id, seq FROM log")
def stream_sequence(spark: SparkSession, d: str) -> DataFrame:
    return T.log(spark, d).select("event_id", "seq")


@query("SELECT user_id, count(*) AS sequential_trips, (count(*) + 31) // 32 AS pipelined_trips FROM events GROUP BY 1")
def pipeline_batches(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return T.events(spark, d).groupBy("user_id").agg(n.alias("sequential_trips"), F.floor((n + 31) / 32).cast("bigint").alias("pipelined_trips"))


@query(f"WITH {EV} SELECT user_id, event_id, event_type, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, event_id DESC) = 1")
def upsert_last_write(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select("user_id", "ts_us", "event_id", "event_type", "value")
    return ranking.last_per_key(e, ["user_id"], ["ts_us", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""WITH d AS (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 4 = 0)
SELECT c.consumer, count(DISTINCT event_id) AS first_times, count(*) - count(DISTINCT event_id) AS duplicates
FROM d, (VALUES ('inventory'), ('payment')) c(consumer) GROUP BY 1""")
def inbox_first_time(spark: SparkSession, d: str) -> DataFrame:
    rows = T.redelivered(T.events(spark, d)).withColumn("consumer", F.explode(F.array(F.lit("inventory"), F.lit("payment"))))
    per = rows.groupBy("consumer", "event_id").agg(F.count("*").alias("n"))
    return per.groupBy("consumer").agg(F.count("*").alias("first_times"), F.sum(F.col("n") - 1).alias("duplicates"))


# -- lag, order, assignment


@query(f"""WITH {PLOG}, b AS (SELECT partition_id, min(log_offset) AS first_offset, max(log_offset) + 1 AS next_offset FROM plog GROUP BY 1)
SELECT partition_id, next_offset - CASE partition_id WHEN 0 THEN next_offset // 2 ELSE first_offset END AS lag,
  (SELECT sum(next_offset - CASE partition_id WHEN 0 THEN next_offset // 2 ELSE first_offset END) FROM b)::BIGINT AS group_lag FROM b""")
def consumer_lag(spark: SparkSession, d: str) -> DataFrame:
    bounds = L.partition_bounds(T.partitioned_log(spark, d))
    lag = L.consumer_lag(bounds, _committed(bounds))
    return lag.join(F.broadcast(lag.agg(F.sum("lag").alias("group_lag"))))


@query(f"""WITH {PLOG}, n AS (SELECT partition_id, key, ts_us, event_id, lag(event_id) OVER (PARTITION BY key ORDER BY log_offset) AS prev_id,
  lag(ts_us) OVER (PARTITION BY key ORDER BY log_offset) AS prev_ts FROM plog)
SELECT partition_id, key, count(*) AS n, bool_and(prev_ts IS NULL OR prev_ts < ts_us OR (prev_ts = ts_us AND prev_id < event_id)) AS in_order FROM n GROUP BY 1, 2""")
def order_within_partition(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("partition_id", "key").orderBy("log_offset")
    here, before = F.struct("ts_us", "event_id"), F.lag(F.struct("ts_us", "event_id")).over(w)
    ok = T.partitioned_log(spark, d).withColumn("ok", F.coalesce(before < here, F.lit(True)))
    return ok.groupBy("partition_id", "key").agg(F.count("*").alias("n"), F.every("ok").alias("in_order"))


@query(f"WITH {PLOG} SELECT partition_id, event_id, log_offset + 1 AS position FROM plog")
def fifo_order(spark: SparkSession, d: str) -> DataFrame:
    return T.partitioned_log(spark, d).select("partition_id", "event_id", (F.col("log_offset") + 1).alias("position"))


_PARTS = "(SELECT DISTINCT (user_id % 3)::INT AS partition_id FROM events)"


@query(f"SELECT m.members, partition_id, (partition_id % m.members)::INT AS member FROM {_PARTS} p, (VALUES (2), (4)) m(members)")
def group_assignment(spark: SparkSession, d: str) -> DataFrame:
    p = T.events(spark, d).select(F.pmod("user_id", F.lit(3)).cast("int").alias("partition_id")).distinct()
    p = p.withColumn("members", F.explode(F.array(F.lit(2), F.lit(4))))
    return p.select("members", "partition_id", F.pmod("partition_id", "members").cast("int").alias("member"))


@query(f"SELECT partition_id, (partition_id % 2)::INT AS before, (partition_id % 1)::INT AS after FROM {_PARTS} p")
def rebalance_after_leave(spark: SparkSession, d: str) -> DataFrame:
    p = T.events(spark, d).select(F.pmod("user_id", F.lit(3)).cast("int").alias("partition_id")).distinct()
    return p.select("partition_id", L.assignment(F.col("partition_id"), 2).alias("before"), L.assignment(F.col("partition_id"), 1).alias("after"))


@query(f"SELECT m.members, count(*) AS owned, count(*) = count(DISTINCT partition_id) AS disjoint FROM {_PARTS} p, (VALUES (2), (4)) m(members) GROUP BY 1")
def assignment_cover(spark: SparkSession, d: str) -> DataFrame:
    a = group_assignment(spark, d)
    return a.groupBy("members").agg(F.count("*").alias("owned"), (F.count("*") == F.count_distinct("partition_id")).alias("disjoint"))


@query(f"WITH {LOG} SELECT event_id, (seq % 4)::INT AS consumer FROM log")
def group_exclusive_delivery(spark: SparkSession, d: str) -> DataFrame:
    return T.log(spark, d).select("event_id", F.pmod("seq", F.lit(4)).cast("int").alias("consumer"))


@query("""SELECT 'queue_group' AS mode, count(*) AS deliveries, count(DISTINCT event_id) AS messages FROM events
UNION ALL SELECT 'broadcast', count(*) * 3, count(DISTINCT event_id) FROM events""")
def queue_group_vs_broadcast(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select("event_id")
    group = e.withColumn("mode", F.lit("queue_group"))
    every = e.withColumn("_sub", F.explode(F.sequence(F.lit(0), F.lit(2)))).drop("_sub").withColumn("mode", F.lit("broadcast"))
    return group.unionByName(every).groupBy("mode").agg(F.count("*").alias("deliveries"), F.count_distinct("event_id").alias("messages"))


@query(f"WITH {LOG} SELECT (seq % 4)::INT AS worker, count(*) AS n FROM log GROUP BY 1")
def worker_distribution(spark: SparkSession, d: str) -> DataFrame:
    return T.log(spark, d).groupBy(F.pmod("seq", F.lit(4)).cast("int").alias("worker")).agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT m.members, range AS member FROM (VALUES (2), (4)) m(members), range(4) WHERE range < m.members)
SELECT members, member::INT AS member, count(partition_id) AS owned FROM g LEFT JOIN {_PARTS} p ON partition_id % members = member GROUP BY 1, 2""")
def group_member_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many partitions each member owns; members beyond the number of partitions own none."""
    members = spark.createDataFrame([(n, k) for n in (2, 4) for k in range(n)], "members int, member int")
    return members.join(group_assignment(spark, d), ["members", "member"], "left").groupBy("members", "member").agg(F.count("partition_id").alias("owned"))


@query(f"""WITH {LOG} SELECT 'g1' AS "group", 1 AS attempt, TRUE AS created, 0 AS start_after, count(*) AS to_read FROM log
UNION ALL SELECT 'g1', 2, FALSE, 0, count(*) FROM log UNION ALL SELECT 'g2', 1, TRUE, max(seq), 0 FROM log UNION ALL SELECT 'g2', 2, FALSE, max(seq), 0 FROM log""")
def group_create(spark: SparkSession, d: str) -> DataFrame:
    """Groups created twice, from the beginning and from the end; the second time changes nothing, wherever it would begin."""
    asked = spark.createDataFrame([("g1", 1, "0"), ("g1", 2, "$"), ("g2", 1, "$"), ("g2", 2, "0")], "group string, attempt int, start string")
    log = T.log(spark, d)
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("end"), F.count("*").alias("n"))
    first = ranking.first_per_key(asked, ["group"], ["attempt"]).select("group", F.col("attempt").alias("_first"), F.col("start").alias("_start"))
    rows = asked.join(F.broadcast(first), "group").crossJoin(F.broadcast(end))
    after = F.when(F.col("_start") == "$", F.col("end")).otherwise(F.lit(0)).cast("bigint")
    return rows.select("group", "attempt", (F.col("attempt") == F.col("_first")).alias("created"), after.alias("start_after"), (F.col("n") - after).alias("to_read"))


#: Sequence numbers asked for: some that are there, and two that no log has.
_POINTS = (-1, 1, 2, 77, 500, 999, 10**15)


@query(f"WITH {LOG} SELECT p.seq, ts_us AS stored_us, ts_us IS NOT NULL AS found FROM (SELECT unnest({list(_POINTS)}) AS seq) p LEFT JOIN log USING (seq)")
def stored_time_by_seq(spark: SparkSession, d: str) -> DataFrame:
    """Point reads of the time at which a message was stored."""
    asked = spark.createDataFrame([(x,) for x in _POINTS], "seq bigint")
    found = T.log(spark, d).filter(F.col("seq").isin(*_POINTS)).select("seq", F.col("ts_us").alias("stored_us"))
    return asked.join(found, "seq", "left").withColumn("found", F.col("stored_us").isNotNull())


@query("SELECT 'seed:' || range AS key, repeat('x', 64) AS value, range // 50 AS batch_no FROM range(1234)")
def seed_keys(spark: SparkSession, d: str) -> DataFrame:
    return L.seed(spark, "seed", 1234, 64)


@query("""SELECT source || ':*' AS pattern, count(*) AS deleted, ((count(*) + 499) // 500)::BIGINT AS pages, (count(*) - 1) % 500 + 1 AS last_page FROM documents GROUP BY 1""")
def delete_by_prefix_pages(spark: SparkSession, d: str) -> DataFrame:
    """What deleting each prefix deletes, in how many pages of 500 keys, and how many are in the last."""
    keys = T.read(spark, d, "documents").select(F.concat_ws(":", "source", "doc_id").alias("key"), F.concat(F.col("source"), F.lit(":*")).alias("pattern"))
    return L.pages(keys, "pattern", 500)


# -- commits


def _commit_log(spark: SparkSession, d: str) -> DataFrame:
    """The two last records of each partition: the first of them was being handled when the consumer died."""
    log = T.partitioned_log(spark, d)
    bounds = L.partition_bounds(log)
    return log.join(F.broadcast(bounds), "partition_id").filter("log_offset >= next_offset - 2")


@query(f"""WITH {PLOG}, n AS (SELECT *, max(log_offset) OVER (PARTITION BY partition_id) AS m FROM plog)
SELECT partition_id, log_offset, event_id FROM n WHERE log_offset >= m - 1""")
def commit_after_process(spark: SparkSession, d: str) -> DataFrame:
    """The commit comes after the work: the record is handled again, then the next."""
    rows = _commit_log(spark, d)
    committed = rows.groupBy("partition_id").agg(F.min("log_offset").alias("committed"))
    return L.resume(rows, committed).select("partition_id", "log_offset", "event_id")


@query(f"""WITH {PLOG}, n AS (SELECT *, max(log_offset) OVER (PARTITION BY partition_id) AS m FROM plog)
SELECT partition_id, log_offset, event_id FROM n WHERE log_offset > m - 1""")
def commit_before_process(spark: SparkSession, d: str) -> DataFrame:
    """The commit comes before the work: the record is lost, only the next is handled."""
    rows = _commit_log(spark, d)
    committed = rows.groupBy("partition_id").agg((F.min("log_offset") + 1).alias("committed"))
    return L.resume(rows, committed).select("partition_id", "log_offset", "event_id")


@query(f"""WITH {LOG}, m AS (SELECT max(seq) // 2 AS c FROM log)
SELECT CASE WHEN seq <= c THEN 'before' ELSE 'after' END AS session, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM log, m GROUP BY 1""")
def durable_resume(spark: SparkSession, d: str) -> DataFrame:
    log = T.log(spark, d)
    cursor = log.agg(F.floor(F.max("seq") / 2).cast("bigint").alias("c"))
    session = F.when(F.col("seq") <= F.col("c"), "before").otherwise("after").alias("session")
    return log.join(F.broadcast(cursor)).groupBy(session).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# -- hashing, names, back-off


@query(r"""WITH RECURSIVE k AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '{' || c_mktsegment || '}.' || c_custkey
  WHEN 2 THEN 'foo{}{' || c_custkey || '}' ELSE 'a{' || c_custkey || '}b{x}' END AS key FROM customer),
h AS (SELECT c_custkey, key, coalesce(nullif(regexp_extract(key, '^[^{]*\{([^}]+)\}', 1), ''), key) AS tag FROM k)
SELECT c_custkey, key, tag FROM h""")
def hash_tag(spark: SparkSession, d: str) -> DataFrame:
    return _slot_keys(spark, d).select("c_custkey", "key", hashing.hash_tag(F.col("key")).alias("tag"))


def _slot_keys(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey").cast("string")
    m = F.pmod("c_custkey", F.lit(4))
    key = F.when(m == 0, F.col("c_name")).when(m == 1, F.concat(F.lit("{"), "c_mktsegment", F.lit("}."), i)).when(m == 2, F.concat(F.lit("foo{}{"), i, F.lit("}")))
    return T.read(spark, d, "customer").select("c_custkey", key.otherwise(F.concat(F.lit("a{"), i, F.lit("}b{x}"))).alias("key"))


@query(r"""WITH RECURSIVE k AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '{' || c_mktsegment || '}.' || c_custkey
  WHEN 2 THEN 'foo{}{' || c_custkey || '}' ELSE 'a{' || c_custkey || '}b{x}' END AS key FROM customer),
h AS (SELECT DISTINCT coalesce(nullif(regexp_extract(key, '^[^{]*\{([^}]+)\}', 1), ''), key) AS tag FROM k),
r(tag, bit, crc) AS (
  SELECT tag, 0, 0::BIGINT FROM h
  UNION ALL
  SELECT tag, bit + 1, CASE WHEN x & 32768 <> 0 THEN xor(x << 1, 4129) & 65535 ELSE (x << 1) & 65535 END
  FROM (SELECT tag, bit, CASE WHEN bit % 8 = 0 THEN xor(crc, ascii(substr(tag, bit // 8 + 1, 1))::BIGINT << 8) ELSE crc END AS x FROM r WHERE bit < 8 * length(tag)))
SELECT c_custkey, key, (crc % 16384)::INT AS slot FROM k JOIN r
ON r.tag = coalesce(nullif(regexp_extract(key, '^[^{]*\{([^}]+)\}', 1), ''), key) AND r.bit = 8 * length(r.tag)""")
def hash_slot(spark: SparkSession, d: str) -> DataFrame:
    return _slot_keys(spark, d).select("c_custkey", "key", hashing.hash_slot(F.col("key")).alias("slot"))


@query(r"""WITH RECURSIVE k AS (SELECT DISTINCT c_name AS key, encode(c_name) AS b, length(c_name) AS n FROM customer),
w(key, n, i, h) AS (
  SELECT key, n, 0, xor(2538058380, n)::HUGEINT FROM k
  UNION ALL
  SELECT key, n, i + 1, xor(((h * 1540483477) % 4294967296)::BIGINT, ((xor(v, v >> 24)::HUGEINT * 1540483477) % 4294967296)::BIGINT)::HUGEINT
  FROM (SELECT key, n, i, h, ((kk::HUGEINT * 1540483477) % 4294967296)::BIGINT AS v
    FROM (SELECT key, n, i, h, ascii(substr(key, 4*i+1, 1))::BIGINT + (ascii(substr(key, 4*i+2, 1))::BIGINT << 8) + (ascii(substr(key, 4*i+3, 1))::BIGINT << 16) + (ascii(substr(key, 4*i+4, 1))::BIGINT << 24) AS kk
      FROM w WHERE i < n // 4))),
t AS (SELECT key, n, h::BIGINT AS h FROM w WHERE i = n // 4),
u AS (SELECT key, CASE WHEN n % 4 = 0 THEN h ELSE ((xor(xor(xor(h, CASE WHEN n % 4 = 3 THEN ascii(substr(key, n, 1))::BIGINT << 16 ELSE 0 END),
  CASE WHEN n % 4 >= 2 THEN ascii(substr(key, n - n % 4 + 2, 1))::BIGINT << 8 ELSE 0 END), ascii(substr(key, n - n % 4 + 1, 1))::BIGINT)::HUGEINT * 1540483477) % 4294967296)::BIGINT END AS h FROM t),
f AS (SELECT key, ((xor(h, h >> 13)::HUGEINT * 1540483477) % 4294967296)::BIGINT AS h FROM u)
SELECT key, ((xor(h, h >> 15) & 2147483647) % 12)::INT AS partition_id FROM f""")
def murmur2_partition(spark: SparkSession, d: str) -> DataFrame:
    keys = T.read(spark, d, "customer").select(F.col("c_name").alias("key")).distinct()
    return keys.select("key", hashing.murmur2_partition(F.col("key"), 12).alias("partition_id"))


@query("SELECT event_id, (event_id % 40)::INT AS attempt, least(1000000.0::DOUBLE, 100.0 * pow(2.0, event_id % 40)) AS bound_ms FROM events")
def backoff_bound(spark: SparkSession, d: str) -> DataFrame:
    a = F.pmod("event_id", F.lit(40)).cast("int")
    return T.events(spark, d).select("event_id", a.alias("attempt"), scalars.backoff_bound(a, 100, 1_000_000).alias("bound_ms"))


@query("""SELECT event_id, (event_id % 9)::INT AS attempt, ((event_id % 128) / 128.0)::DOUBLE * least(1000000.0::DOUBLE, 100.0 * pow(2.0, event_id % 9)) AS delay_ms FROM events""")
def backoff_full_jitter(spark: SparkSession, d: str) -> DataFrame:
    a, r = F.pmod("event_id", F.lit(9)).cast("int"), F.pmod("event_id", F.lit(128)) / 128.0
    return T.events(spark, d).select("event_id", a.alias("attempt"), scalars.backoff_delay(a, r, 100, 1_000_000).alias("delay_ms"))


@query("SELECT event_id, n.retries::INT AS retries, (1000 * pow(2, n.retries))::BIGINT AS delay_ms FROM events, (SELECT unnest(range(0, 5)) AS retries) n WHERE n.retries <= event_id % 5")
def retry_exponential_schedule(spark: SparkSession, d: str) -> DataFrame:
    n = T.events(spark, d).select("event_id", F.explode(F.sequence(F.lit(0), F.pmod("event_id", F.lit(5)).cast("int"))).alias("retries"))
    return n.withColumn("delay_ms", scalars.retry_delay(1000, F.col("retries")))


@query("""SELECT event_id, 'dedup:' || event_id AS dedup_key, 'room:' || user_id AS room_channel, 'leaderboard:' || event_type AS leaderboard_key,
  event_type || ':processing:' || (event_id % 4) AS processing_key, lower(event_type) || '.events' AS subject FROM events""")
def key_builders(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return T.events(spark, d).select(
        "event_id", scalars.dedup_key(c("event_id")).alias("dedup_key"), scalars.room_channel(c("user_id")).alias("room_channel"), scalars.leaderboard_key(c("event_type")).alias("leaderboard_key"),
        scalars.processing_key(c("event_type"), F.pmod("event_id", F.lit(4))).alias("processing_key"), scalars.subject_of(c("event_type")).alias("subject"),
    )


@query("SELECT event_id, event_id::VARCHAR AS event_key, event_type AS type, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes written as JSON and read back."""
    e = T.events(spark, d)
    raw = F.to_json(F.struct(F.col("event_id").cast("string").alias("eventId"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("orderId"), F.col("props").alias("data")))
    back = F.from_json(raw, "eventId string, type string, orderId string, data string")
    got = e.select("event_id", back.alias("x"))
    return got.select("event_id", F.col("x.eventId").alias("event_key"), F.col("x.type").alias("type"), F.get_json_object("x.data", "$.k").cast("bigint").alias("k"))


@query(f"""WITH {EV}, n AS (SELECT event_id, ts_us * 1000 + event_id % 1000 AS ns FROM ev)
SELECT event_id, rtrim(rtrim(strftime(make_timestamp_ns(ns), '%Y-%m-%dT%H:%M:%S.%n'), '0'), '.') || 'Z' AS text, ns AS parsed_ns FROM n""")
def rfc3339_times(spark: SparkSession, d: str) -> DataFrame:
    """Times with nanoseconds as text, and that text read back."""
    text = T.events(spark, d).select("event_id", scalars.rfc3339_nanos(F.col("ts_us") * 1000 + F.pmod("event_id", F.lit(1000))).alias("text"))
    return text.withColumn("parsed_ns", scalars.parse_rfc3339(F.col("text")))
