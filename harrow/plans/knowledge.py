"""Queries over outcomes. Events stand in for fetches: the user is the domain, errors fail, the value is the response time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.operators import caches as H
from harrow.operators import knowledge as K
from harrow.plans.registry import doubles, query
from harrow.session import table

NOW = "TIMESTAMP '2024-03-01 00:00:00'"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 60).cast("string"), F.lit(".example.com")).alias("domain"), "ts", "event_id", (F.col("event_id") % 7 != 0).alias("success"),
        F.floor(F.col("value") * 10).cast("double").alias("response_ms"), F.when(F.col("event_id") % 41 == 0, 429).otherwise(200).alias("http_status"),
        F.when(F.col("event_id") % 29 == 0, F.col("event_type")).alias("antibot_system"), F.when(F.col("event_id") % 37 == 0, "hcaptcha").alias("captcha_type"), (F.col("event_id") % 3 + 1).cast("int").alias("level"),
        ((F.col("event_id") % 7 == 0) & (F.col("event_id") % 2 == 0)).alias("blocked"), (F.col("event_id") % 11 == 0).alias("proxy_used"),
    )


O = """SELECT 'h' || (user_id % 60) || '.example.com' AS domain, ts, event_id, event_id % 7 <> 0 AS success, CAST(floor(value * 10) AS DOUBLE) AS response_ms,
CASE WHEN event_id % 41 = 0 THEN 429 ELSE 200 END AS http_status, CASE WHEN event_id % 29 = 0 THEN event_type END AS antibot_system,
CASE WHEN event_id % 37 = 0 THEN 'hcaptcha' END AS captcha_type, CAST(event_id % 3 + 1 AS INT) AS level, event_id % 14 = 0 AS blocked, event_id % 11 = 0 AS proxy_used FROM events"""
STATE = f"""SELECT domain, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS fail_count,
list_reduce(list(response_ms ORDER BY ts, event_id), lambda acc, x: CASE WHEN acc = 0 THEN floor(x + 0.5) ELSE floor(acc * (1 - 0.3) + x * 0.3 + 0.5) END) AS avg_response_time_ms,
CAST(list_reduce(list_concat([CASE WHEN first(http_status ORDER BY ts, event_id) = 429 THEN 30 ELSE 60 END], list(CASE WHEN http_status = 429 THEN 1 ELSE 0 END ORDER BY ts, event_id)[2:]),
 lambda acc, x: CASE WHEN x = 1 THEN greatest(10, CAST(floor(acc * 0.7) AS INT)) ELSE acc END) AS INT) AS safe_rate_limit,
arg_max(antibot_system, (ts, event_id)) FILTER (antibot_system IS NOT NULL) AS antibot_system, arg_max(captcha_type, (ts, event_id)) FILTER (captcha_type IS NOT NULL) AS captcha_type, max(ts) AS last_updated,
first(proxy_used AND success ORDER BY ts, event_id) OR coalesce(bool_or(blocked AND NOT proxy_used AND before < 0), false) AS needs_proxy
FROM (SELECT *, sum(CASE WHEN success THEN 1 ELSE -1 END) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({O})) GROUP BY domain"""
BEST = f"SELECT domain, arg_max(level, (rate, -level)) AS level, max(rate) AS rate FROM (SELECT domain, level, count(*) FILTER (success) / count(*) AS rate FROM ({O}) GROUP BY domain, level) GROUP BY domain"


@query(STATE)
def a01_outcome_fold(spark: SparkSession, d: str) -> DataFrame:
    return K.fold(outcomes(spark, d), "domain", ["ts", "event_id"])


@query(BEST)
def a02_best_level(spark: SparkSession, d: str) -> DataFrame:
    return K.best_level(K.level_stats(outcomes(spark, d), "domain"), "domain")


@query(doubles(f"SELECT domain, CASE WHEN epoch({NOW}) - epoch(max(ts)) > 7 * 86400 THEN 0.5 ELSE 1.0 END AS weight FROM ({O}) GROUP BY domain", "weight"))
def a03_decay(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).groupBy("domain").agg(F.max("ts").alias("last")).select("domain", K.decay(F.col("last"), F.expr(NOW)).alias("weight"))


PREDICT = f"""SELECT domain, start_level, CASE WHEN total < 1 THEN 0.0 ELSE floor(c * 100 + 0.5) / 100 END AS confidence, total >= 1 AND (needs_proxy OR bad > good) AS proxy, CASE WHEN total < 1 THEN 0.0 ELSE avg_response_time_ms END AS expected_ms,
CASE WHEN total < 1 THEN 'no data' ELSE CASE WHEN antibot_system IS NULL THEN '' ELSE antibot_system || ', ' END || 'L' || level || ', ' || CAST(floor(r * 100 + 0.5) AS BIGINT) || '% success' END AS reason
FROM (SELECT *, CASE WHEN total < 1 THEN 1 ELSE level END AS start_level, CASE WHEN good >= 3 AND r >= 0.8 THEN least(0.5 + r * 0.5, 1.0) WHEN total >= 3 THEN 0.3 + r * 0.3 ELSE 0.1 + total / 3 * 0.2 END AS c
FROM (SELECT *, good + bad AS total, good / (good + bad) AS r FROM (SELECT s.*, b.level, success_count * w AS good, fail_count * w AS bad FROM
(SELECT *, CASE WHEN epoch({NOW}) - epoch(last_updated) > 7 * 86400 THEN 0.5 ELSE 1.0 END AS w FROM ({STATE})) s JOIN ({BEST}) b USING (domain))))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d)
    known = K.fold(o, "domain", ["ts", "event_id"]).join(K.best_level(K.level_stats(o, "domain"), "domain"), "domain")
    return K.predict(known, F.expr(NOW))


@query(PREDICT)
def a04_predict(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("domain", "start_level", "confidence", "proxy", "expected_ms", "reason")


@query(f"""WITH p AS (SELECT domain, start_level, confidence FROM ({PREDICT})),
a AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'h' || (user_id % 90) || '.example.com' ELSE 'sub.h' || (user_id % 90) || '.example.com' END AS domain FROM events)
SELECT a.domain, coalesce(o.start_level, u.start_level) AS start_level, coalesce(o.confidence, floor(u.confidence * 50 + 0.5) / 100) AS confidence, o.confidence IS NULL AND u.confidence IS NOT NULL AS inherited
FROM a LEFT JOIN p o ON o.domain = a.domain LEFT JOIN p u ON u.domain = regexp_replace(a.domain, '^[^.]*\\.', '')""")
def a05_parent_domain(spark: SparkSession, d: str) -> DataFrame:
    from harrow.functions import url as U

    host = F.concat(F.when(F.col("user_id") % 2 == 0, "h").otherwise("sub.h"), (F.col("user_id") % 90).cast("string"), F.lit(".example.com"))
    asked = table(spark, d, "events").select(host.alias("domain")).distinct()
    return K.with_parent(asked, predictions(spark, d), U.parent_domain(F.col("domain")))


@query(f"SELECT antibot_system, count(DISTINCT domain) AS domains, string_agg(DISTINCT domain, ',' ORDER BY domain) AS names FROM ({O}) WHERE antibot_system IS NOT NULL GROUP BY antibot_system")
def a06_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d).where("antibot_system is not null")
    return o.groupBy("antibot_system").agg(F.count_distinct("domain").alias("domains"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("names"))


@query("""SELECT o_orderkey, o_orderdate AS last_updated FROM orders WHERE epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate) <= 30 * 86400 * 40 ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""")
def a07_prune(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("last_updated"))
    return K.prune(known, "o_orderkey", F.expr("TIMESTAMP '1998-08-02'"), 500, 1200)


@query(f"""SELECT domain, success_count + fail_count AS requests, printf('%.1f%%', success_count / (success_count + fail_count) * 100) AS success_rate, avg_response_time_ms FROM ({STATE})
WHERE contains(domain, '1') AND success_count + fail_count >= 5 ORDER BY success_count + fail_count DESC, domain LIMIT 20""")
def a08_report(spark: SparkSession, d: str) -> DataFrame:
    k = K.fold(outcomes(spark, d), "domain", ["ts", "event_id"]).withColumn("requests", F.col("success_count") + F.col("fail_count"))
    k = k.where(F.col("domain").contains("1") & (F.col("requests") >= 5))
    return k.select("domain", "requests", F.concat(X.fixed(F.col("success_count") / F.col("requests") * 100, 1), F.lit("%")).alias("success_rate"), "avg_response_time_ms").orderBy(F.col("requests").desc(), "domain").limit(20)


BREAK = """SELECT user_id, event_id, epoch(ts) AS t, event_id % 4 = 0 AS good FROM events"""
FSM = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ({BREAK})),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 'closed' AS state, 0 AS bad, 0 AS probes, CAST(0 AS DOUBLE) AS since, 0 AS opened FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, k, CASE WHEN trips THEN 'open' WHEN heals THEN 'closed' ELSE st END, CASE WHEN good THEN CASE WHEN st <> 'half-open' OR heals THEN 0 ELSE bad END WHEN st = 'half-open' THEN 5 ELSE bad + 1 END,
CASE WHEN good AND st = 'half-open' THEN tried + 1 WHEN trips THEN 0 ELSE tried END, CASE WHEN trips THEN t ELSE since END, opened + CASE WHEN trips AND st <> 'open' THEN 1 ELSE 0 END
FROM (SELECT *, NOT good AND (st = 'half-open' OR bad + 1 >= 5) AS trips, good AND st = 'half-open' AND tried + 1 >= 3 AS heals
FROM (SELECT *, CASE WHEN state = 'open' AND st = 'half-open' THEN 0 ELSE probes END AS tried
FROM (SELECT r.user_id, e.k, r.state, r.bad, r.probes, r.since, r.opened, e.t, e.good, CASE WHEN r.state = 'open' AND e.t - r.since >= 60 THEN 'half-open' ELSE r.state END AS st FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))))"""


def breakers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), (F.col("event_id") % 4 == 0).alias("good"))
    return K.breakers(e.withColumn("at", F.col("t")), "user_id", ["t", "event_id"], "at", "good")


@query(f"{FSM} SELECT user_id, arg_max(state, k) AS state, arg_max(bad, k) AS failures, arg_max(opened, k) AS opened FROM r GROUP BY user_id")
def a09_circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return breakers(spark, d)


@query(f"{FSM.replace('user_id', 'event_type')} SELECT event_type, arg_max(state, k) AS state, arg_max(bad, k) AS failures, arg_max(opened, k) AS opened FROM r GROUP BY event_type")
def a09_busy_breakers(spark: SparkSession, d: str) -> DataFrame:
    """A few keys with all events, each key's in chunks."""
    e = table(spark, d, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), (F.col("event_id") % 4 == 0).alias("good"))
    return K.breakers(e.withColumn("at", F.col("t")), "event_type", ["t", "event_id"], "at", "good", per_chunk=400)


@query(f"{FSM} SELECT user_id % 20 AS host, count(*) FILTER (state = 'open') AS open_circuits, count(*) FILTER (state = 'open') >= 3 AS blocked FROM (SELECT user_id, arg_max(state, k) AS state FROM r GROUP BY user_id) GROUP BY user_id % 20")
def a10_domain_circuit(spark: SparkSession, d: str) -> DataFrame:
    b = breakers(spark, d).groupBy((F.col("user_id") % 20).alias("host")).agg(F.count_if(F.col("state") == "open").alias("open_circuits"))
    return b.withColumn("blocked", F.col("open_circuits") >= 3)


@query("SELECT event_id, CASE WHEN value * 500 > 0 THEN least(greatest(value * 500 * 3, 30000.0), 300000.0) ELSE 30000.0 END AS timeout_ms FROM events")
def a11_adaptive_timeout(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", K.adaptive_timeout(F.col("value") * 500).alias("timeout_ms"))


@query("""SELECT event_id, CAST(floor(60000.0 / 7 + 0.5) AS BIGINT) AS delay_ms, greatest(0.0, coalesce(floor(60000.0 / 7 + 0.5) - (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id)) * 1000, 0.0)) AS wait_ms FROM events""")
def a12_throttle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return K.throttle(e, "user_id", ["t", "event_id"], "t", F.lit(7)).select("event_id", "delay_ms", "wait_ms")


@query(doubles("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 5000.0 ELSE 0.0 END AS least, least(30000.0, 1000.0 * pow(2.0, event_id % 8)) + CASE WHEN event_id % 3 = 0 THEN 15000.0 ELSE 0.0 END AS most FROM events", "least", "most"))
def a13_backoff_bounds(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = K.backoff_bounds(F.col("event_id") % 8, F.when(F.col("event_id") % 3 == 0, 429).otherwise(500))
    return table(spark, d, "events").select("event_id", lo.alias("least"), hi.alias("most"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 OR event_id % 4 >= 2 THEN 3 WHEN event_id % 4 = 1 THEN [2, 2, 3, 3][event_id % 7 % 4 + 1] ELSE [1, 1, 2, 3][event_id % 7 % 4 + 1] END AS INT) AS level FROM events")
def a14_retry_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", K.retry_level(F.col("event_id") % 4, F.when(F.col("event_id") % 5 == 0, "x"), (F.col("event_id") % 7 % 4).cast("int")).alias("level"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, epoch(max(ts) OVER ()) - epoch(ts) AS age FROM events) WHERE r <= 3 AND age <= 86400 * 10")
def a16_recent_entries(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of three entries a key with a ten-day life would hold."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.col("ts").cast("timestamp").cast("double").alias("t"))
    newest = e.agg(F.max("t").alias("newest"))
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("r <= 3")
    return ranked.join(F.broadcast(newest)).where("newest - t <= 86400 * 10").select("user_id", "event_id")


HELD = """SELECT user_id % 20 AS g, event_type || user_id % 7 AS k, event_id, epoch(ts) AS t, event_id % 3 <> 0 AS stored FROM events"""


def uses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    key = F.concat("event_type", (F.col("user_id") % 7).cast("string"))
    return e.select((F.col("user_id") % 20).alias("g"), key.alias("k"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), (F.col("event_id") % 3 != 0).alias("stored"))


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, event_id) AS i FROM ({HELD})),
p AS (SELECT a.event_id, a.g, a.i, a.t, max(b.i) AS prev_i, arg_max(b.t, b.i) AS prev_t FROM e a LEFT JOIN e b ON b.g = a.g AND b.k = a.k AND b.stored AND b.i < a.i GROUP BY ALL),
n AS (SELECT p.event_id, count(DISTINCT c.k) AS between_ FROM p LEFT JOIN e c ON c.g = p.g AND c.stored AND c.i > p.prev_i AND c.i < p.i GROUP BY p.event_id)
SELECT event_id, coalesce(prev_i IS NOT NULL AND between_ < 6 AND t - prev_t <= 43200, false) AS hit FROM p JOIN n USING (event_id)""")
def a16_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Every lookup in stores of six entries and half a day, which two of three events write: fewer than six other keys were written since."""
    return H.lookups(uses(spark, d), "g", "k", ["t", "event_id"], "t", 6, 43200.0, "stored", per_chunk=200).select("event_id", "hit")


@query(f"""SELECT g, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t DESC, event_id DESC) AS r FROM (SELECT g, k, max(t) AS t, arg_max(event_id, (t, event_id)) AS event_id FROM ({HELD}) WHERE stored GROUP BY g, k)) WHERE r <= 6""")
def a16_contents(spark: SparkSession, d: str) -> DataFrame:
    return H.contents(uses(spark, d).where("stored"), "g", "k", ["t", "event_id"], 6).select("g", "k", "event_id")


@query("SELECT c_custkey, count(*) >= 15 AS stale, bool_or(o_orderkey % 4 <> 0) AS valid FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a17_session_state(spark: SparkSession, d: str) -> DataFrame:
    from harrow.operators import cookies

    c = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 4 != 0, 2000).otherwise(500).alias("expires"))
    c = c.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return c.groupBy("c_custkey").agg((F.count(F.lit(1)) >= 15).alias("stale"), F.bool_or(cookies.alive(1000)).alias("valid"))
