"""Queries over request and message logs; events stand in for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import network as N
from harrow.plans.registry import query
from harrow.session import table

TAILS = ("/api/items?a=1&b=2", "/static/app.js", "/v2/users", "/graphql", "/page", "/x?u=google-analytics.com")
LOG_SQL = """SELECT event_id, ts, event_type, user_id, 'https://h' || (user_id % 30) || '.example' || ['/api/items?a=1&b=2', '/static/app.js', '/v2/users', '/graphql', '/page', '/x?u=google-analytics.com'][event_id % 6 + 1] AS url,
CASE WHEN event_id % 5 = 0 THEN 'application/json' ELSE 'text/html' END AS content_type FROM events"""
API_SQL = f"SELECT * FROM ({LOG_SQL}) WHERE NOT regexp_matches(url, '{N.STATIC}') AND NOT contains(url, 'google-analytics.com') AND (content_type = 'application/json' OR contains(url, 'graphql') OR regexp_matches(url, '(?i)/api/|/v\\d+/'))"


def log(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select(
        "event_id", "ts", "event_type", "user_id", F.concat(F.lit("https://h"), (F.col("user_id") % 30).cast("string"), F.lit(".example"), tail).alias("url"),
        F.when(F.col("event_id") % 5 == 0, "application/json").otherwise("text/html").alias("content_type"),
    )


@query(f"SELECT event_id FROM ({API_SQL})")
def n01_api_calls(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).where(N.is_api(F.col("url"), F.col("content_type"))).select("event_id")


@query(f"SELECT event_id, contains(url, 'graphql') OR event_id % 4 = 0 AS graphql FROM ({LOG_SQL})")
def n02_graphql(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("CASE event_id % 4 WHEN 0 THEN '{\"query\": \"{ a }\"}' WHEN 1 THEN '{\"query\": 5x' WHEN 2 THEN '{}' END")
    return log(spark, d).select("event_id", N.is_graphql(F.col("url"), body).alias("graphql"))


@query(f"SELECT event_type, url, min(event_id) AS event_id FROM ({API_SQL}) GROUP BY event_type, url")
def n03_distinct_calls(spark: SparkSession, d: str) -> DataFrame:
    api = log(spark, d).where(N.is_api(F.col("url"), F.col("content_type"))).select("event_type", "url", "event_id")
    return N.first_of_each(api, ["event_type", "url"], ["event_id"])


@query("SELECT user_id, 't' || user_id AS token, CASE WHEN user_id % 3 = 1 THEN 'Bearer ' || user_id END AS signed, CAST(CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS INT) AS kept FROM (SELECT DISTINCT user_id FROM events)")
def n04_headers(spark: SparkSession, d: str) -> DataFrame:
    h = F.create_map(F.lit("Sec-Fetch-Mode"), F.lit("x"), F.lit("HOST"), F.lit("y"), F.lit("X-Token"), F.concat(F.lit("t"), F.col("user_id").cast("string")), F.when(F.col("user_id") % 3 == 0, "Accept-Language").when(F.col("user_id") % 3 == 1, "Authorization").otherwise("Sec-Fetch-Dest"), F.concat(F.lit("Bearer "), F.col("user_id").cast("string")))
    one = table(spark, d, "events").select("user_id").distinct().select("user_id", N.useful_headers(h).alias("h"))
    return one.select("user_id", F.element_at("h", F.lit("X-Token")).alias("token"), F.try_element_at("h", F.lit("Authorization")).alias("signed"), F.size("h").alias("kept"))


@query(f"SELECT event_id, CASE WHEN contains(url, '?a=') THEN '1' END AS a, substr(props, 1, 500) AS preview FROM ({LOG_SQL}) JOIN (SELECT event_id, props FROM events) USING (event_id)")
def n05_params_and_preview(spark: SparkSession, d: str) -> DataFrame:
    l = log(spark, d).join(table(spark, d, "events").select("event_id", "props"), "event_id")
    return l.select("event_id", F.try_element_at(N.query_params(F.col("url")), F.lit("a")).alias("a"), F.substring("props", 1, 500).alias("preview"))


PAIRED = """WITH RECURSIVE e AS (SELECT {url} AS url, event_id AS id, epoch(ts) AS t, event_id % 2 = 0 AS req FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY t, NOT req, id) AS i FROM e),
q AS (SELECT url, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS waiting, false AS hit FROM (SELECT DISTINCT url FROM e)
UNION ALL SELECT q.url, o.i, CASE WHEN req THEN waiting + 1 ELSE greatest(waiting - 1, 0) END, NOT req AND waiting > 0 FROM q JOIN o ON o.url = q.url AND o.i = q.i + 1),
a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY i) AS k FROM o WHERE req), b AS (SELECT o.*, row_number() OVER (PARTITION BY o.url ORDER BY o.i) AS k FROM o JOIN q USING (url, i) WHERE hit)
SELECT a.url, a.id AS request, b.id AS response, b.t - a.t AS duration FROM a LEFT JOIN b USING (url, k)"""


@query(PAIRED.format(url="user_id % 30"))
def s14_request_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 30).alias("url"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return N.pair_requests(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "url", "t")


@query(PAIRED.format(url="event_type"))
def s14_busy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A few URLs with all requests, each URL's log in chunks."""
    e = table(spark, d, "events").select(F.col("event_type").alias("url"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return N.pair_requests(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "url", "t", per_chunk=500)


@query("""SELECT c.user_id, coalesce(sent, 0) AS sent, coalesce(received, 0) AS received FROM (SELECT DISTINCT user_id FROM events) c LEFT JOIN
(SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS sent, count(*) FILTER (event_id % 2 = 1) AS received FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 500) GROUP BY user_id) USING (user_id)""")
def r04_socket_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 2 == 0, "sent").otherwise("received").alias("direction"))
    return N.socket_summary(m, "user_id", ["ts", "event_id"], 500)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 'raw ' || event_id END AS raw FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, 'raw ' || event_id FROM events WHERE event_id % 3 = 0")
def r05_payloads(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("raw "), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    v = table(spark, d, "events").select("event_id", N.payload(text).alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.try_variant_get("v", "$.raw", "string").alias("raw"))
