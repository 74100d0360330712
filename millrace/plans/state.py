"""Queries whose decisions depend on earlier decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import folds, ranking
from millrace.sources import tables as T

from .registry import EV, LOG, query

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _numbered(key: str, more: str = "") -> str:
    """The events of each key in order, numbered, for a recursive query."""
    return f"n AS (SELECT {key} AS key, ts_us, event_id{more}, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, event_id) AS rn FROM ev)"


def _keyed(spark: SparkSession, d: str, inputs: dict[str, F.Column], key: F.Column | None = None) -> DataFrame:
    return T.events(spark, d).select("event_id", "ts_us", (F.col("user_id") if key is None else key).alias("key"), *(c.alias(k) for k, c in inputs.items() if k != "ts_us"))


def _fold(spark: SparkSession, d: str, fold: folds.Fold, inputs: dict[str, F.Column], new: str, key: F.Column | None = None, quiet: int | None = None) -> DataFrame:
    e = _keyed(spark, d, inputs, key)
    return folds.ordered_fold(e, ["key"], ["ts_us", "event_id"], list(inputs), fold, new, quiet and ("ts_us", quiet))


@query(f"""WITH RECURSIVE {EV}, {_numbered('user_id')},
r(key, rn, live, event_id, admitted) AS (
  SELECT DISTINCT key, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BOOLEAN FROM n
  UNION ALL
  SELECT key, rn, CASE WHEN len(l) < 3 THEN list_append(l, ts_us) ELSE l END, event_id, len(l) < 3
  FROM (SELECT n.key, n.rn, n.ts_us, n.event_id, list_filter(r.live, lambda x: x > n.ts_us - {DAY}) AS l FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1))
SELECT event_id, key AS user_id, admitted FROM r WHERE rn > 0""")
def rate_limit_sliding_log(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, folds.sliding_window(3, DAY), {"ts_us": F.col("ts_us")}, "admitted boolean", quiet=DAY).select("event_id", F.col("key").alias("user_id"), "admitted")


@query(f"""WITH {EV} SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts_us // {DAY} ORDER BY ts_us, event_id) <= 3 AS admitted FROM ev""")
def fixed_window_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Independent windows need no fold: a rank in each window says it."""
    day = F.floor(F.col("ts_us") / DAY)
    rank = F.row_number().over(W.partitionBy("user_id", day).orderBy("ts_us", "event_id"))
    return T.events(spark, d).select("event_id", "user_id", (rank <= 3).alias("admitted"))


_TTL_KEY = "(event_type || ':' || user_id)"


@query(f"""WITH RECURSIVE {EV}, {_numbered(_TTL_KEY)},
r(key, rn, applied, event_id, result) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM n
  UNION ALL
  SELECT key, rn, CASE WHEN res = 'applied' THEN ts_us ELSE applied END, event_id, res
  FROM (SELECT n.key, n.rn, n.ts_us, n.event_id, r.applied,
    CASE WHEN r.applied IS NOT NULL AND n.ts_us - r.applied < 2 * {DAY} THEN 'duplicate' WHEN n.event_id % 7 = 0 THEN 'failed' ELSE 'applied' END AS res FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1))
SELECT event_id, key AS message_id, result FROM r WHERE rn > 0""")
def dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(":", "event_type", "user_id")
    out = _fold(spark, d, folds.expiring_once(2 * DAY), {"ts_us": F.col("ts_us"), "fails": F.pmod("event_id", F.lit(7)) == 0}, "result string", key, 2 * DAY)
    return out.select("event_id", F.col("key").alias("message_id"), "result")


_LOCK_SQL = f"""WITH RECURSIVE {EV}, {_numbered('user_id', ", CASE event_type WHEN 'click' THEN 'release' ELSE 'acquire' END AS op, event_id % 3 AS token")},
r(key, rn, holder, since, fence, event_id, op, result) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM n
  UNION ALL
  SELECT key, rn, CASE res WHEN 'granted' THEN token WHEN 'released' THEN NULL ELSE h END, CASE res WHEN 'granted' THEN ts_us ELSE since END,
    fence + CASE res WHEN 'granted' THEN 1 ELSE 0 END, event_id, op, res
  FROM (SELECT *, CASE WHEN op = 'release' THEN CASE WHEN h = token THEN 'released' ELSE 'not_owner' END WHEN h IS NOT NULL THEN 'busy' ELSE 'granted' END AS res
    FROM (SELECT n.key, n.rn, n.ts_us, n.event_id, n.op, n.token, r.since, r.fence, CASE WHEN n.ts_us - r.since >= {DAY} THEN NULL ELSE r.holder END AS h
      FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1)))"""


def _lock(spark: SparkSession, d: str) -> DataFrame:
    inputs = {"ts_us": F.col("ts_us"), "op": F.when(F.col("event_type") == "click", "release").otherwise("acquire"), "token": F.pmod("event_id", F.lit(3))}
    return folds.held_locks(_keyed(spark, d, inputs), ["key"], ["ts_us", "event_id"], list(inputs), DAY)


@query(f"{_LOCK_SQL} SELECT event_id, key AS user_id, result, fence FROM r WHERE op = 'acquire'")
def lock_grants(spark: SparkSession, d: str) -> DataFrame:
    return _lock(spark, d).filter("op = 'acquire'").select("event_id", F.col("key").alias("user_id"), "result", "fence")


@query(f"{_LOCK_SQL} SELECT event_id, key AS user_id, result FROM r WHERE op = 'release'")
def lock_release_by_token(spark: SparkSession, d: str) -> DataFrame:
    return _lock(spark, d).filter("op = 'release'").select("event_id", F.col("key").alias("user_id"), "result")


@query(f"""WITH {EV}, f AS (SELECT event_id, user_id, event_id * 7 % 100 AS fence, max(event_id * 7 % 100) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM ev)
SELECT event_id, user_id, fence, most IS NULL OR fence >= most AS accepted FROM f""")
def fencing_token_writes(spark: SparkSession, d: str) -> DataFrame:
    """What is refused is below the maximum already, so the maximum of all before is that of the accepted before."""
    before = W.partitionBy("user_id").orderBy("ts_us", "event_id").rowsBetween(W.unboundedPreceding, -1)
    e = T.events(spark, d).select("event_id", "user_id", "ts_us", F.pmod(F.col("event_id") * 7, F.lit(100)).alias("fence"))
    return e.select("event_id", "user_id", "fence", F.coalesce(F.col("fence") >= F.max("fence").over(before), F.lit(True)).alias("accepted"))


_CACHE_KEY = "(event_type || ':' || user_id % 20)"


@query(f"""WITH RECURSIVE {EV}, {_numbered(_CACHE_KEY)},
r(key, rn, loaded, event_id, result) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM n
  UNION ALL
  SELECT key, rn, CASE res WHEN 'load' THEN ts_us WHEN 'error' THEN NULL ELSE loaded END, event_id, res
  FROM (SELECT n.key, n.rn, n.ts_us, n.event_id, r.loaded,
    CASE WHEN r.loaded IS NOT NULL AND n.ts_us - r.loaded < {DAY} THEN 'hit' WHEN n.event_id % 9 = 0 THEN 'error' ELSE 'load' END AS res FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1))
SELECT event_id, key AS cache_key, result FROM r WHERE rn > 0""")
def cache_aside_hits(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.col("event_type"), F.lit(":"), F.pmod("user_id", F.lit(20)).cast("string"))
    out = _fold(spark, d, folds.cache_aside(DAY), {"ts_us": F.col("ts_us"), "fails": F.pmod("event_id", F.lit(9)) == 0}, "result string", key, DAY)
    return out.select("event_id", F.col("key").alias("cache_key"), "result")


@query(f"""WITH RECURSIVE {EV}, {_numbered('user_id')},
r(key, rn, began, event_id) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM n
  UNION ALL
  SELECT n.key, n.rn, CASE WHEN r.began IS NULL OR n.ts_us - r.began >= 12 * {HOUR} THEN n.ts_us ELSE r.began END, n.event_id FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1)
SELECT key AS user_id, began AS load_us, count(*) AS callers FROM r WHERE rn > 0 GROUP BY 1, 2""")
def singleflight_loads(spark: SparkSession, d: str) -> DataFrame:
    out = _fold(spark, d, folds.singleflight(12 * HOUR), {"ts_us": F.col("ts_us")}, "load_us bigint", quiet=12 * HOUR)
    return out.groupBy(F.col("key").alias("user_id"), "load_us").agg(F.count("*").alias("callers"))


@query(f"""WITH RECURSIVE {EV}, {_numbered('user_id', ", CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS put")},
r(key, rn, size, waiting, event_id) AS (
  SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM n
  UNION ALL
  SELECT n.key, n.rn, CASE WHEN put = 1 THEN least(r.size + 1, 3) WHEN r.size > 0 AND r.waiting = 0 THEN r.size - 1 ELSE r.size END,
    CASE WHEN put = 1 AND r.size = 3 THEN r.waiting + 1 WHEN put = 0 AND r.waiting > 0 THEN r.waiting - 1 ELSE r.waiting END, n.event_id FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1)
SELECT event_id, key AS queue, size, waiting FROM r WHERE rn > 0""")
def bounded_queue_occupancy(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select("event_id", "ts_us", F.col("user_id").alias("queue"), "event_type")
    out = folds.queue_occupancy(e, ["queue"], ["ts_us", "event_id"], F.col("event_type").isin("click", "view", "purchase"), 3)
    return out.select("event_id", "queue", "size", "waiting")


@query(f"""WITH RECURSIVE {EV}, {_numbered('user_id')},
r(key, rn, f0, f1, event_id, worker, done) AS (
  SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::INT, NULL::BIGINT FROM n
  UNION ALL
  SELECT n.key, n.rn, CASE WHEN f0 <= f1 THEN f0 + 9 ELSE f0 END, CASE WHEN f0 <= f1 THEN f1 ELSE f1 + 1 END, n.event_id,
    CASE WHEN f0 <= f1 THEN 0 ELSE 1 END, CASE WHEN f0 <= f1 THEN f0 + 9 ELSE f1 + 1 END FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1)
SELECT key AS queue, worker, count(*) AS n, max(done) AS finished FROM r WHERE rn > 0 GROUP BY 1, 2""")
def fair_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """A worker that takes 9 units and one that takes 1, one message in hand each."""
    out = _fold(spark, d, folds.fair_dispatch((9, 1)), {"ts_us": F.col("ts_us")}, "worker int, done bigint")
    return out.groupBy(F.col("key").alias("queue"), "worker").agg(F.count("*").alias("n"), F.max("done").alias("finished"))


@query("SELECT user_id AS counter, count(*) AS callers, least(count(*), 60) AS succeeded, greatest(60 - count(*), 0) AS final_value FROM events GROUP BY 1")
def decr_if_positive(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return T.events(spark, d).groupBy(F.col("user_id").alias("counter")).agg(
        n.alias("callers"), F.least(n, F.lit(60).cast("bigint")).alias("succeeded"), F.greatest(60 - n, F.lit(0).cast("bigint")).alias("final_value")
    )


@query(f"WITH {LOG} SELECT user_id AS key, max(seq) AS last_access FROM log GROUP BY 1 ORDER BY 2 DESC LIMIT 50")
def lru_survivors(spark: SparkSession, d: str) -> DataFrame:
    return ranking.lru_survivors(T.log(spark, d).select(F.col("user_id").alias("key"), "seq"), 50)


@query(f"""WITH {LOG}, f AS (SELECT user_id, min(seq) AS first_seq, count(*) AS n FROM log GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY first_seq) AS rk FROM f)
SELECT user_id AS key, n AS rejected FROM k WHERE rk > 50""")
def noeviction_rejections(spark: SparkSession, d: str) -> DataFrame:
    """A full store takes no new keys: all but the 50 first are refused, each time."""
    return ranking.refused(T.log(spark, d).select(F.col("user_id").alias("key"), "seq"), 50, "noeviction")


@query(f"""WITH {LOG}, f AS (SELECT user_id, min(seq) AS first_seq, count(*) AS n FROM log GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY first_seq) AS rk FROM f)
SELECT p.policy, user_id AS key, CASE WHEN p.policy <> 'allkeys-lru' THEN n ELSE 0 END AS rejected FROM k, (VALUES ('noeviction'), ('volatile-lru'), ('allkeys-lru')) p(policy) WHERE rk > 50 AND p.policy <> 'allkeys-lru'""")
def eviction_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Writes that a full store refuses by policy, where no key has a time to live: a policy that may evict only such keys evicts none."""
    log = T.log(spark, d).select(F.col("user_id").alias("key"), "seq")
    per = [ranking.refused(log, 50, p).select(F.lit(p).alias("policy"), "key", "rejected") for p in ("noeviction", "volatile-lru", "allkeys-lru")]
    return per[0].unionByName(per[1]).unionByName(per[2])


# -- leaderboards


_SCORES = """s AS (SELECT c_mktsegment AS board, c_name AS member, c_acctbal AS score, 1 AS seq FROM customer
  UNION ALL SELECT c_mktsegment, c_name, c_acctbal + 100, 2 FROM customer WHERE c_custkey % 3 = 0),
cur AS (SELECT board, member, score FROM s QUALIFY row_number() OVER (PARTITION BY board, member ORDER BY seq DESC) = 1)"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    """Scores are set, not added: the last one stands."""
    c = T.read(spark, d, "customer")
    base = c.select(F.col("c_mktsegment").alias("board"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"), F.lit(1).alias("seq"))
    later = c.filter("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("board"), F.col("c_name").alias("member"), (F.col("c_acctbal") + 100).alias("score"), F.lit(2).alias("seq"))
    return ranking.last_per_key(base.unionByName(later), ["board", "member"], ["seq"]).select("board", "member", "score")


@query(f"WITH {_SCORES} SELECT board, member, score FROM cur")
def leaderboard_current(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d)


@query(f"WITH {_SCORES} SELECT board, member, score, row_number() OVER (PARTITION BY board ORDER BY score DESC, member DESC)::INT AS rank FROM cur QUALIFY rank <= 10")
def leaderboard_top_n(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(_current(spark, d), ranking.check_top(10))


@query(f"WITH {_SCORES} SELECT board, member, score, 0 AS rank FROM cur LIMIT 0")
def leaderboard_top_zero(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(_current(spark, d), 0)


@query(f"WITH {EV} SELECT user_id, event_type, max_by(event_id, (ts_us, event_id)) AS event_id FROM ev GROUP BY 1, 2")
def log_compaction(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each key stays."""
    e = T.events(spark, d).select("user_id", "event_type", "ts_us", "event_id")
    return ranking.last_per_key(e, ["user_id", "event_type"], ["ts_us", "event_id"]).drop("ts_us")
