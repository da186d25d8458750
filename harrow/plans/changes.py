"""Queries over snapshots. Documents stand in for snapshots: those with the same id by 50 are one URL's, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import changes as C
from harrow.operators import lookups as J
from harrow.plans.registry import query
from harrow.session import table

PAIRS = "SELECT a.doc_id, a.text AS before, b.text AS after FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"
LINES = "string_split(before, chr(10)) AS x, string_split(after, chr(10)) AS y"
DIFF = f"SELECT doc_id, before, after, x, y, list_filter(x, lambda l: NOT list_contains(y, l)) AS r, list_filter(y, lambda l: NOT list_contains(x, l)) AS a FROM (SELECT *, {LINES} FROM ({PAIRS}))"
PCT = "CASE WHEN before = '' THEN 100.0 ELSE (len(r) + len(a)) / (2.0 * greatest(len(x), len(y), 1)) * 100 END"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return docs.select("doc_id", F.col("text").alias("before")).join(after, "doc_id")


def sets(spark: SparkSession, d: str) -> DataFrame:
    return C.line_sets(pairs(spark, d), "doc_id", "before", "after")


SNAPS = "SELECT user_id AS url, event_id, ts, event_type AS body FROM events"
WATCH = f"""SELECT url, event_id, body, sha256(body) AS hash, lag(body) OVER w IS NULL AS first_run, coalesce(lag(body) OVER w <> body, false) AS changed, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS checks FROM ({SNAPS}) WINDOW w AS (PARTITION BY url ORDER BY ts, event_id)"""


@query("SELECT doc_id, sha256(text) AS hash, sha256(substr(text, 1, 100)) AS head_hash FROM documents")
def c02_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.content_hash(F.col("text")).alias("hash"), C.content_hash(F.substring("text", 1, 100)).alias("head_hash"))


@query(f"""SELECT event_id, hash, first_run, changed, checks, CAST(sum(CAST(changed AS INT)) OVER w AS BIGINT) AS changes, max(CASE WHEN changed THEN checks END) OVER w AS last_changed
FROM ({WATCH}) WINDOW w AS (PARTITION BY url ORDER BY checks ROWS UNBOUNDED PRECEDING)""")
def c03_watch(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "events").select(F.col("user_id").alias("url"), "event_id", "ts", F.col("event_type").alias("body"))
    out = C.watch(snaps, "url", ["ts", "event_id"], "body")
    return out.select("event_id", "hash", "first_run", "changed", "checks", "changes", F.col("last_changed.checks").alias("last_changed"))


@query(f"""SELECT doc_id, CASE WHEN len(l) > 200 THEN array_to_string(l[1:200], chr(10)) || chr(10) || '... ' || (len(l) - 200) || ' more' ELSE array_to_string(l, chr(10)) END AS diff
FROM (SELECT doc_id, list_concat(list_transform(r, lambda s: '- ' || s), list_transform(a, lambda s: '+ ' || s)) AS l FROM ({DIFF}))""")
def c04_line_diff(spark: SparkSession, d: str) -> DataFrame:
    return sets(spark, d).select("doc_id", C.unified(F.col("removed"), F.col("added")).alias("diff"))


@query(f"SELECT doc_id, array_to_string(r, chr(10)) AS removed, array_to_string(a, chr(10)) AS added, CAST(len(r) AS INT) AS n_removed, CAST(len(a) AS INT) AS n_added FROM ({DIFF})")
def c05_line_sets(spark: SparkSession, d: str) -> DataFrame:
    return sets(spark, d).select("doc_id", *[F.array_join(c, "\n").alias(c) for c in ("removed", "added")], *[F.size(c).alias(f"n_{c}") for c in ("removed", "added")])


@query(f"SELECT doc_id, {PCT} AS pct FROM ({DIFF})")
def c06_change_percent(spark: SparkSession, d: str) -> DataFrame:
    return sets(spark, d).select("doc_id", C.change_percent().cast("double").alias("pct"))


def topic_changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    changed = pairs(spark, d).select("doc_id", (F.col("before") != F.col("after")).alias("changed")).join(sets(spark, d), "doc_id")
    changes = changed.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "changed", C.change_percent().cast("double").alias("pct"))
    topics = table(spark, d, "documents").select(
        F.col("lang").alias("topic"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("lang") == "de", 99.0).alias("min_change_pct")
    )
    return changes, topics


TOPIC = f"""SELECT d.lang AS topic, 'u' || d.doc_id AS url, CASE WHEN d.lang = 'de' THEN 99.0 ELSE 95.0 END AS least, c.changed, c.pct
FROM documents d LEFT JOIN (SELECT doc_id, before <> after AS changed, {PCT} AS pct FROM ({DIFF})) c USING (doc_id)"""


@query(f"SELECT topic, count(*) AS urls_checked, count(*) FILTER (changed AND pct >= least) AS meaningful FROM ({TOPIC}) GROUP BY topic")
def c07_digest(spark: SparkSession, d: str) -> DataFrame:
    return C.digest(*topic_changes(spark, d), 95.0)


@query(f"SELECT topic, '## ' || topic || chr(10) || string_agg('- ' || url || ' (' || printf('%.1f', pct) || '%)', chr(10) ORDER BY '- ' || url || ' (' || printf('%.1f', pct) || '%)') AS markdown FROM ({TOPIC}) WHERE changed AND pct >= least GROUP BY topic")
def k09_digest_markdown(spark: SparkSession, d: str) -> DataFrame:
    return C.digest_markdown(*topic_changes(spark, d), 95.0)


@query("""SELECT p_partkey, CAST(p_partkey % 4 + 1 AS BIGINT) AS additions, CAST(p_partkey % 3 AS BIGINT) AS deletions, CAST(3 AS BIGINT) AS unchanged,
array_to_string(list_concat(['  head'], list_transform(range(0, p_partkey % 3), lambda i: '- old ' || i), list_transform(range(0, p_partkey % 4), lambda i: '+ new ' || i || p_size), ['  ' || p_name || p_partkey, '  tail', '+ end']), chr(10)) AS diff FROM part""")
def c08_edit_script(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.col("p_partkey").cast("string"))
    numbered = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n), f)
    old = numbered(F.col("p_partkey") % 3, lambda i: F.concat(F.lit("old "), i.cast("string")))
    new = numbered(F.col("p_partkey") % 4, lambda i: F.concat(F.lit("new "), i.cast("string"), F.col("p_size").cast("string")))
    before = F.concat_ws("\n", F.lit("head"), old, name, F.lit("tail"))
    after = F.concat_ws("\n", F.lit("head"), new, name, F.lit("tail"), F.lit("end"))
    out = C.line_diff(table(spark, d, "part").select("p_partkey", before.alias("b"), after.alias("a")), "p_partkey", "b", "a")
    return out


@query("""SELECT l_orderkey, count(*) AS pixels, count(*) FILTER (abs(l_quantity - l_linenumber * 10) > 30) AS different, count(*) FILTER (abs(l_quantity - l_linenumber * 10) > 30) / count(*) * 100 AS mismatch_pct,
count(*) FILTER (abs(l_quantity - l_linenumber * 10) > 30) / count(*) * 100 <= 1 AS match FROM lineitem GROUP BY l_orderkey""")
def h35_pixel_diff(spark: SparkSession, d: str) -> DataFrame:
    px = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("r1"), (F.col("l_linenumber") * 10.0).alias("r2"), *[F.lit(0.0).alias(x) for x in ("g1", "g2", "b1", "b2")]
    )
    return C.pixel_diff(px, "l_orderkey")


@query(f"""SELECT url, '{{"event":"watch.change","url":' || url || ',"previous_hash":"' || sha256(was) || '","current_hash":"' || hash || '","detected_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","diff":null}}' AS payload
FROM (SELECT url, ts, sha256(body) AS hash, body, lag(body) OVER (PARTITION BY url ORDER BY ts, event_id) AS was FROM ({SNAPS})) WHERE was <> body""")
def k12_change_payloads(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "events").select(F.col("user_id").alias("url"), "event_id", "ts", F.col("event_type").alias("body"))
    return C.change_payloads(C.watch(snaps, "url", ["ts", "event_id"], "body"), "url", "ts")


@query("""WITH f AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE event_id % 2 = 0), s AS (SELECT user_id, event_id AS snap, epoch(ts) AS t, event_type AS body FROM events WHERE event_id % 2 = 1),
u AS (SELECT user_id, t, max(snap) AS snap FROM s GROUP BY user_id, t)
SELECT f.event_id, CASE WHEN f.t - u.t <= 86400 THEN u.snap END AS snap, CASE WHEN f.t - u.t <= 86400 THEN s.body END AS body FROM f ASOF LEFT JOIN u ON f.user_id = u.user_id AND f.t >= u.t LEFT JOIN s USING (snap)""")
def c09_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The latest snapshot of another feed at the time of each fetch, at most a day old."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    snaps = e.where("event_id % 2 = 1").select("user_id", "t", F.col("event_id").alias("snap"), F.col("event_type").alias("body"))
    return J.as_of(e.where("event_id % 2 = 0").select("event_id", "user_id", "t"), snaps, "user_id", "t", ["snap", "body"], ["snap"], 86400.0, per_chunk=50).select("event_id", "snap", "body")
