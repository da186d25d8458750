"""Queries over creators' records; the trade tables stand in for profiles, posts and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import social as S
from harrow.operators import creators as R
from harrow.plans.registry import doubles, query
from harrow.session import table


@query(doubles("SELECT p_partkey, [p_size * 1000.0, floor(p_size * 1.5 * 1000000 + 0.5), 1000.0 + p_size, NULL, 3000000.0][p_partkey % 5 + 1] AS n FROM part", "n"))
def p01_compact_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    text = F.element_at(F.array(F.concat(s.cast("string"), F.lit("K")), F.concat((s * 1.5).cast("string"), F.lit(" m views")), F.concat(F.lit("1,"), F.lpad(s.cast("string"), 3, "0"), F.lit("+")), F.lit("n/a"), F.lit("3 months")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.compact_number(text).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 1700000000000 - p_size * [3600000, 604800000, 2592000000][p_partkey % 4 + 1] END AS at FROM part")
def p02_relative_times(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in (" hours ago", " Weeks ago", " month ago", " soon")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.relative_time(F.concat(F.col("p_size").cast("string"), tail), F.lit(1700000000000)).alias("at"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 1 THEN 1000 + p_size ELSE p_size * 1000 END::BIGINT AS n FROM part")
def p03_followers(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('has ', p_size, 'K Followers, 3 posts') WHEN 1 THEN concat('1,', lpad(p_size, 3, '0'), ' followers') ELSE 'nobody' END")
    return table(spark, d, "part").select("p_partkey", S.followers(text).alias("n"))


@query("SELECT s_suppkey, 'shop_' || s_suppkey || ',other.' || s_suppkey AS handles FROM supplier")
def p04_handles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("My big picture. IG: @Shop_"), k, F.lit(" and https://instagram.com/other."), k, F.lit(" insta shop_"), k)
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(S.handles(text), ",").alias("handles"))


@query("SELECT s_suppkey, 'a.' || s_suppkey || '@mail.example' AS email, CASE WHEN s_suppkey % 2 = 0 THEN 'https://site.example/' || s_suppkey END AS website, s_suppkey % 3 = 0 AS business, s_suppkey % 3 < 2 AS collab FROM supplier")
def p05_contacts(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("""concat('Mail a.', s_suppkey, '@mail.example or https://www.youtube.com/c ', if(s_suppkey % 2 = 0, concat('https://site.example/', s_suppkey), ''),
        CASE s_suppkey % 3 WHEN 0 THEN ' sponsor me' WHEN 1 THEN ' brand deals' ELSE '' END)""")
    return table(spark, d, "supplier").select("s_suppkey", S.contact(text).alias("c")).select("s_suppkey", "c.*")


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 37 / 60) AS BIGINT) || ':' || lpad(CAST(CAST(l_quantity * 37 AS BIGINT) % 60 AS VARCHAR), 2, '0') AS shown FROM lineitem")
def p10_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.seconds_text(F.col("l_quantity") * 37).alias("shown"))


@query("SELECT s_suppkey, CAST(unnest([0, 65, 3600 + s_suppkey % 60]) AS INT) AS seconds, unnest(['Intro', 'Part one', s_name]) AS title FROM supplier")
def p09_chapters(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("About\n0:00 Intro\n 1:05 - Part one\n1:00:"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 2, "0"), F.lit(" "), F.col("s_name"), F.lit("\nend"))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(S.chapters(text)).alias("c")).select("s_suppkey", "c.*")


ENGAGE = "SELECT o_orderkey, sum(l_quantity) AS likes, sum(l_extendedprice) AS views FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


@query("""SELECT c_custkey, round(avg(o_totalprice + o_orderkey % 10) / greatest(c_acctbal, 1) * 100, 4) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) JOIN customer ON c_custkey = o_custkey
WHERE r <= 3 GROUP BY c_custkey, c_acctbal""")
def p13_recent_engagement(spark: SparkSession, d: str) -> DataFrame:
    """The mean of likes and comments over the last three posts, against followers."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    last = table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("o_custkey").agg(F.avg(F.col("o_totalprice") + F.col("o_orderkey") % 10).alias("m"))
    return last.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.round(F.col("m") / F.greatest("c_acctbal", F.lit(1.0)) * 100, 4).alias("rate"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 8000 AND c_nationkey > 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def p14_discover(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal between 1000 and 8000 and c_nationkey > 3").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER w AS k, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, min(k) AS stop FROM (SELECT user_id, g, k, row_number() OVER (PARTITION BY user_id, g ORDER BY k) AS len FROM e WHERE bad) WHERE len = 2 GROUP BY user_id)
SELECT e.user_id, count(*) AS taken FROM e LEFT JOIN s USING (user_id) WHERE s.stop IS NULL OR e.k <= s.stop GROUP BY e.user_id""")
def p15_stop_after_failures(spark: SparkSession, d: str) -> DataFrame:
    """How many entries are taken before two failures in a row end a run."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", (F.col("event_type") == "error").alias("bad"), F.row_number().over(w).alias("k"), F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)).over(w).alias("g"))
    run = e.withColumn("len", F.when(F.col("bad"), F.row_number().over(Window.partitionBy("user_id", "g", "bad").orderBy("k"))))
    stop = F.min(F.when(F.col("len") == 2, F.col("k"))).over(Window.partitionBy("user_id"))
    return run.withColumn("stop", stop).where("stop is null or k <= stop").groupBy("user_id").agg(F.count(F.lit(1)).alias("taken"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN likes / views * 100 WHEN 1 THEN likes / 1000.0 * 100 WHEN 2 THEN views / 1000.0 * 100 ELSE 0.0 END AS rate FROM ({ENGAGE})")
def p16_engagement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.sum("l_quantity").alias("likes"), F.sum("l_extendedprice").alias("views"))
    k = F.col("o_orderkey") % 4
    return e.select("o_orderkey", S.engagement(F.when(k.isin(0, 2), F.col("views")), F.when(k.isin(0, 1), F.col("likes")), F.when(k < 3, 1000.0)).alias("rate"))


PROFILE = """SELECT c_custkey, abs(c_acctbal) * 10 AS subscribers, CASE WHEN c_custkey % 3 = 0 THEN 5000.0 END AS ig_followers, CAST(c_custkey % 11 AS DOUBLE) AS engagement_rate, CAST(c_custkey % 101 AS DOUBLE) AS niche_match_pct,
c_custkey % 4 AS platform_count, ['weekly', 'biweekly', 'monthly', 'inactive'][c_custkey % 4 + 1] AS posting_frequency, CASE WHEN c_custkey % 5 = 0 THEN 'x' END AS email, CASE WHEN c_custkey % 7 = 0 THEN 'y' END AS website, c_custkey % 2 = 0 AS business, c_custkey % 3 = 0 AS collab FROM customer"""
RAW = """CASE WHEN subscribers + coalesce(ig_followers, 0) >= 100000 THEN 10 WHEN subscribers + coalesce(ig_followers, 0) >= 10000 THEN 25 WHEN subscribers + coalesce(ig_followers, 0) >= 1000 THEN 15 ELSE 5 END AS audience_size,
CASE WHEN engagement_rate > 8 THEN 20 WHEN engagement_rate > 5 THEN 16 WHEN engagement_rate > 3 THEN 12 WHEN engagement_rate > 1 THEN 8 ELSE 4 END AS engagement_rate, floor(niche_match_pct / 100 * 15 + 0.5) AS niche_relevance,
CASE WHEN platform_count >= 3 THEN 15 WHEN platform_count >= 2 THEN 10 ELSE 5 END AS multi_platform, floor(CASE WHEN niche_match_pct = 0 THEN 50 ELSE niche_match_pct END / 100 * 10 + 0.5) AS consistency,
CASE posting_frequency WHEN 'weekly' THEN 8 WHEN 'biweekly' THEN 5 WHEN 'monthly' THEN 3 ELSE 0 END AS frequency, CASE WHEN email IS NOT NULL THEN 5 WHEN website IS NOT NULL THEN 3 WHEN business THEN 2 ELSE 0 END AS contact,
CAST(collab AS INT) + CAST(business AS INT) AS collab_signals"""
SCORES = f"SELECT c_custkey, {', '.join('CAST(floor((' + ' + '.join(f'{n} / {float(S.MOST[n])} * {w}' for n, w in ws.items()) + f') / {sum(ws.values())} * 100 + 0.5) AS BIGINT) AS {k}' for k, ws in S.WEIGHTS.items())} FROM (SELECT c_custkey, {RAW} FROM ({PROFILE}))"
TIER = "CASE CAST(reach >= 60 AS INT) + CAST(conversion >= 60 AS INT) + CAST(partnership >= 60 AS INT) WHEN 3 THEN 'GOLDEN' WHEN 2 THEN 'SILVER' WHEN 1 THEN 'BRONZE' ELSE 'UNRANKED' END"


def profiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    freq = F.element_at(F.array(*[F.lit(x) for x in ("weekly", "biweekly", "monthly", "inactive")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", (F.abs("c_acctbal") * 10).alias("subscribers"), F.when(k % 3 == 0, 5000.0).alias("ig_followers"), (k % 11).cast("double").alias("engagement_rate"), (k % 101).cast("double").alias("niche_match_pct"),
        (k % 4).alias("platform_count"), freq.alias("posting_frequency"), F.when(k % 5 == 0, "x").alias("email"), F.when(k % 7 == 0, "y").alias("website"), (k % 2 == 0).alias("business"), (k % 3 == 0).alias("collab"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("c_custkey", *[S.score(k).alias(k) for k in S.WEIGHTS])


@query(f"SELECT c_custkey, {RAW.replace('floor(', 'CAST(floor(').replace('+ 0.5) AS', '+ 0.5) AS BIGINT) AS')} FROM ({PROFILE})")
def p17_criteria(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("c_custkey", *[S.criterion(c).alias(c) for c in S.MOST])


@query(SCORES)
def p18_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)


@query(f"SELECT c_custkey, {TIER} AS tier FROM ({SCORES})")
def p19_tiers(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("c_custkey", S.tier([F.col(k) for k in S.WEIGHTS], 60).alias("tier"))


@query("SELECT n_nationkey, ['weekly', 'biweekly', 'monthly', 'inactive'][n_nationkey % 4 + 1] AS frequency FROM nation")
def p20_frequency(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    p = F.when(k == 0, arr("2 days ago", "1 Hour ago", "3 weeks ago")).when(k == 1, arr("1 week ago", "2 days ago")).when(k == 2, arr("2 months ago")).otherwise(arr().cast("array<string>"))
    return table(spark, d, "nation").select("n_nationkey", S.frequency(p).alias("frequency"))


TITLED = "SELECT doc_id, string_split(text, chr(10)) AS t FROM documents"
FIRST5 = "len(list_filter(t[1:5], lambda x: contains(lower(x), 'the') OR contains(lower(x), 'and')))"


@query(f"""SELECT doc_id, CASE WHEN h >= 4 OR (n <= 3 AND h = n) THEN 'SPECIALIST' WHEN h >= ceil(n * 0.5) THEN 'MIXED' ELSE 'GENERALIST' END AS depth, CAST(floor((CAST(contains(a, 'the') AS INT) + CAST(contains(a, 'and') AS INT) + CAST(contains(a, 'xyzzy') AS INT)) / 3 * 100 + 0.5) AS BIGINT) AS match_pct
FROM (SELECT doc_id, {FIRST5} AS h, len(t[1:5]) AS n, lower(array_to_string(t, ' ')) AS a FROM ({TITLED}))""")
def p21_niche(spark: SparkSession, d: str) -> DataFrame:
    t = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", S.niche_depth(t, ["the", "AND"]).alias("depth"), S.niche_match(t, ["the", "and", "xyzzy"]).alias("match_pct"))


CONSISTENT = """SELECT l_suppkey, CAST(CASE WHEN count(*) < 2 THEN 50 WHEN avg(l_quantity) = 0 THEN 0 ELSE floor(greatest(0.0, least(100.0, (1 - stddev_pop(l_quantity) / avg(l_quantity) / 2) * 100)) + 0.5) END AS BIGINT) AS consistency FROM lineitem GROUP BY l_suppkey"""


@query(CONSISTENT)
def p22_view_consistency(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return g.select("l_suppkey", S.view_consistency(F.col("n"), F.col("m"), F.col("s")).cast("long").alias("consistency"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_discount >= 0.08 THEN 25 WHEN l_discount >= 0.05 THEN 20 WHEN l_discount >= 0.03 THEN 15 WHEN l_discount >= 0.01 THEN 8 ELSE 0 END
+ CASE WHEN l_tax * 8 >= 0.5 THEN 25 WHEN l_tax * 8 >= 0.3 THEN 20 WHEN l_tax * 8 >= 0.15 THEN 15 WHEN l_tax * 8 >= 0.05 THEN 8 ELSE 0 END + CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 15 ELSE 0 END + floor(l_quantity / 100 * 20 + 0.5) AS BIGINT) AS score FROM lineitem""")
def p23_content_score(spark: SparkSession, d: str) -> DataFrame:
    depth = F.when(F.col("l_returnflag") == "A", "SPECIALIST").when(F.col("l_returnflag") == "N", "MIXED").otherwise("GENERALIST")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.content_score(F.col("l_discount"), F.col("l_tax") * 8, depth, F.col("l_quantity")).cast("long").alias("score"))


@query(f"SELECT tier, count(*) AS n, max(reach) AS best FROM (SELECT *, {TIER} AS tier FROM ({SCORES})) GROUP BY tier")
def p26_tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("tier", S.tier([F.col(k) for k in S.WEIGHTS], 60)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("best"))


@query("""WITH u AS (SELECT s_suppkey % 40 AS channel, s_name AS name, 1 AS src, s_suppkey AS k FROM supplier UNION ALL SELECT c_custkey % 70, c_name, 2, c_custkey FROM customer),
f AS (SELECT channel, arg_min(name, (src, k)) AS name, min((src, k)) AS place FROM u GROUP BY channel ORDER BY place, channel LIMIT 50)
SELECT channel, name, n, CASE WHEN n >= 1 THEN 'known' ELSE 'new' END AS state FROM f LEFT JOIN (SELECT p_size AS channel, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY p_size) USING (channel)""")
def p25_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Sources united, one row a channel (the first name wins), capped, then enriched."""
    a = table(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("channel"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    b = table(spark, d, "customer").select((F.col("c_custkey") % 70).alias("channel"), F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    facts = table(spark, d, "part").where("p_size % 3 = 0").groupBy(F.col("p_size").cast("long").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.lit("x").alias("name"))
    found = R.enriched(R.discovered([a, b], "channel", "name", "k", 50), facts, "channel")
    return found.select("channel", "name", "n", F.when(F.col("n") >= 1, "known").otherwise("new").alias("state"))


SCOUTED = """SELECT c_custkey AS handle, c_name AS name, least(100, a) AS reach, least(100, b) AS conversion, least(100, c) AS partnership, subscribers, ig_followers, niche_depth, views_per_sub, likes_per_view, view_consistency, email, collab, business FROM
(SELECT *, CASE WHEN round(likes_per_view, 3) >= 0.08 THEN 25 WHEN round(likes_per_view, 3) >= 0.05 THEN 20 WHEN round(likes_per_view, 3) >= 0.03 THEN 15 WHEN round(likes_per_view, 3) >= 0.01 THEN 8 ELSE 0 END
+ CASE WHEN views_per_sub >= 0.5 THEN 25 WHEN views_per_sub >= 0.3 THEN 20 WHEN views_per_sub >= 0.15 THEN 15 WHEN views_per_sub >= 0.05 THEN 8 ELSE 0 END + CASE niche_depth WHEN 'SPECIALIST' THEN 30 ELSE 15 END + CAST(floor(view_consistency / 100 * 20 + 0.5) AS BIGINT) AS a,
CASE WHEN email IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN collab THEN 20 ELSE 0 END + CASE WHEN business THEN 15 ELSE 0 END + CASE c_custkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END + CASE WHEN ig_followers > 0 THEN 15 ELSE 0 END AS b,
CASE WHEN subscribers >= 10000 THEN 25 WHEN subscribers >= 1000 THEN 15 ELSE 5 END + CASE WHEN ig_followers > 0 THEN 20 ELSE 0 END + CASE WHEN views_per_sub >= 0.15 THEN 25 WHEN views_per_sub >= 0.05 THEN 15 ELSE 0 END + CAST(floor(view_consistency / 100 * 30 + 0.5) AS BIGINT) AS c
FROM (SELECT c_custkey, c_name, c_custkey * 40 AS subscribers, CASE WHEN c_custkey % 3 = 0 THEN 5000 + c_custkey END AS ig_followers, ['SPECIALIST', 'MIXED', 'GENERALIST'][c_nationkey % 3 + 1] AS niche_depth, c_custkey % 70 / 100 AS views_per_sub,
c_custkey % 11 / 100 AS likes_per_view, c_custkey % 101 AS view_consistency, CASE WHEN c_custkey % 5 = 0 THEN 'm' || c_custkey END AS email, c_custkey % 2 = 0 AS collab, c_custkey % 6 = 0 AS business FROM customer)
WHERE subscribers BETWEEN 500 AND 50000 AND niche_depth <> 'GENERALIST')"""
SCOUT_TIER = "CASE CAST(reach >= 50 AS INT) + CAST(conversion >= 50 AS INT) + CAST(partnership >= 50 AS INT) WHEN 3 THEN 'GOLDEN' WHEN 2 THEN 'SILVER' WHEN 1 THEN 'BRONZE' ELSE 'UNRANKED' END"


def scouted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (n % len(x) + 1).cast("int"))
    channels = table(spark, d, "customer").select(
        k.alias("handle"), F.col("c_name").alias("name"), (k * 40).alias("subscribers"), F.when(k % 3 == 0, k + 5000).alias("ig_followers"), pick(F.col("c_nationkey"), "SPECIALIST", "MIXED", "GENERALIST").alias("niche_depth"),
        (k % 70 / 100).alias("views_per_sub"), (k % 11 / 100).alias("likes_per_view"), (k % 101).alias("view_consistency"), F.when(k % 5 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("email"), (k % 2 == 0).alias("collab"),
        (k % 6 == 0).alias("business"), pick(k, "weekly", "biweekly", "monthly", "inactive").alias("posting_frequency"),
    )
    return R.scouted(channels, 500, 50_000, 50)


@query(f"SELECT handle, reach, conversion, partnership, {SCOUT_TIER} AS tier FROM ({SCOUTED})")
def p24_scout(spark: SparkSession, d: str) -> DataFrame:
    return scouted(spark, d).select("handle", "reach", "conversion", "partnership", "tier")


def reported(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rate = F.when(F.col("handle") % 4 != 0, F.col("handle") % 10 + 0.75)
    return scouted(spark, d).withColumn("engagement_rate", rate).withColumn("youtube_url", F.concat(F.lit("https://v.example/"), F.col("handle").cast("string"))).withColumn("instagram_url", none).withColumn("website", none)


@query(f"""SELECT handle, concat_ws(',', handle, name, {SCOUT_TIER}, reach, conversion, partnership, subscribers, coalesce(CAST(ig_followers AS VARCHAR), ''), CASE WHEN handle % 4 <> 0 THEN (handle % 10) || '.8' ELSE '' END, niche_depth,
CASE WHEN views_per_sub = 0 THEN '0' ELSE CAST(views_per_sub AS VARCHAR) END, CASE WHEN likes_per_view = 0 THEN '0' ELSE CAST(likes_per_view AS VARCHAR) END, view_consistency, 'https://v.example/' || handle, '', coalesce(email, '')) AS line FROM ({SCOUTED})""")
def k10_report_csv(spark: SparkSession, d: str) -> DataFrame:
    return R.report_csv(reported(spark, d))


@query(f"""SELECT handle, '| ' || concat_ws(' | ', CASE tier WHEN 'GOLDEN' THEN '🥇' WHEN 'SILVER' THEN '🥈' WHEN 'BRONZE' THEN '🥉' ELSE '⬜' END || ' ' || tier, handle, CASE WHEN subscribers >= 1000 THEN printf('%.1fK', subscribers / 1000.0) ELSE CAST(subscribers AS VARCHAR) END,
CASE WHEN ig_followers IS NULL THEN '-' ELSE printf('%.1fK', round(ig_followers / 1000.0 + 1e-9, 1)) END, CASE WHEN handle % 4 <> 0 THEN (handle % 10) || '.8%' ELSE '-' END, niche_depth, printf('%.2f', views_per_sub), printf('%.3f', likes_per_view),
view_consistency, reach, conversion, partnership, CASE WHEN email IS NOT NULL THEN '📧' WHEN business THEN '💼' ELSE '-' END) || ' |' AS line FROM (SELECT *, {SCOUT_TIER} AS tier FROM ({SCOUTED}))""")
def k10_report_markdown(spark: SparkSession, d: str) -> DataFrame:
    return R.report_markdown(reported(spark, d))


@query(f"SELECT count(*) AS total_found, {', '.join(f'count(*) FILTER (tier = {t!r}) AS {t.lower()}' for t in R.TIERS)} FROM (SELECT {SCOUT_TIER} AS tier FROM ({SCOUTED}))")
def k10_tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.tier_counts(scouted(spark, d))
