"""Streaming queries, drained over the event file; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.plans.registry import query
from harrow.streaming import streams as S


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def st1_window_counts(spark: SparkSession, d: str) -> DataFrame:
    out = S.drained(S.window_counts(S.events(spark, d)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def st2_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = S.drained(S.sessions(S.events(spark, d)), "complete")
    return out.select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("""SELECT user_id, event_id, changed, checks, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY user_id ORDER BY checks) AS BIGINT) AS changes FROM
(SELECT user_id, event_id, coalesce(lag(event_type) OVER w <> event_type, false) AS changed, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS checks FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def st3_watch_state(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.watched(S.events(spark, d)))


@query("SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda acc, x: acc * 0.7 + x * 0.3), 6) AS avg FROM events GROUP BY user_id")
def st4_outcome_state(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.folded(S.events(spark, d))).select("user_id", "n", F.round("avg", 6).alias("avg"))


@query("""SELECT user_id, event_id, coalesce(t - last_value(CASE WHEN stored THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 172800, false) AS hit
FROM (SELECT user_id, event_id, epoch(ts) AS t, event_id % 3 <> 0 AS stored FROM events)""")
def st5_store_with_a_life(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).select("user_id", "event_id", F.col("ts").cast("double").alias("t"), (F.col("event_id") % 3 != 0).alias("stored"))
    return S.drained(S.stored(e, 172800.0))


@query("""SELECT user_id, event_id, CAST(count(*) FILTER (event_id % 2 = 0) OVER w AS BIGINT) AS sent, CAST(count(*) FILTER (event_id % 2 = 1) OVER w AS BIGINT) AS received FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7""")
def s15_capped_messages(spark: SparkSession, d: str) -> DataFrame:
    """The first seven messages of each capture, as they come."""
    e = S.events(spark, d).select("user_id", "event_id", F.col("ts").cast("double").alias("t"), F.when(F.col("event_id") % 2 == 0, "sent").otherwise("received").alias("direction"))
    return S.drained(S.capped(e, 7))
