"""Queries over pages: classification, text, structure by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.functions import url as U
from harrow.operators import classify as C
from harrow.operators import graph as G
from harrow.plans.registry import doubles, names, query
from harrow.plans.urls import HOST, NORMAL, PATH, SCHEME
from harrow.session import table, written

TRIM = r"'^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$'"


def sql_text(html: str) -> str:
    body = f"CASE WHEN regexp_matches({html}, '{X.BODY}') THEN regexp_extract({html}, '{X.BODY}', 1) ELSE {html} END"
    for p in (X.SCRIPT, X.STYLE, X.TAG):
        body = f"regexp_replace({body}, '{p}', '', 'g')"
    return f"regexp_replace({body}, {TRIM}, '', 'g')"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


TITLE = "regexp_extract(html, '(?i)<title[^>]*>(.*?)</title>', 1)"
SMALL = "length(t) < 5000"
BLOCK_SQL = f"""CASE WHEN status IN (403, 429, 503) THEN p OR ({SMALL} AND (c OR f))
WHEN length(t) > 5000 AND links > 10 THEN false WHEN c THEN true WHEN {SMALL} AND f AND (p OR length(t) < 1000) THEN true
ELSE regexp_matches(html, '(?i)<title[^>]*>.*?</title>') AND length(t) < 50 AND status >= 400 END"""
FACTS = f"""SELECT page_id, html, status, t, len(regexp_extract_all(html, '(?i)<a\\s')) AS links, {sql_any('html', C.SCRIPTS)} OR h AS p,
regexp_matches({TITLE}, '(?i){'|'.join(C.TITLES)}') AS c, {sql_any('lower(t)', C.BLOCKED)} AS f FROM
(SELECT *, {sql_text('html')} AS t, page_id % 7 = 0 AS h, CASE page_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS status FROM
(SELECT page_id, url, @HTML@ AS html FROM pages))"""
PLANTED = "CASE WHEN page_id % 11 = 0 THEN replace(html, '</title>', ' - Just a Moment</title>') WHEN page_id % 13 = 0 THEN '<title>x</title><body>Please enable cookies</body>' ELSE html END"


def planted(spark: SparkSession, d: str) -> DataFrame:
    """The pages with statuses, headers and phrases put into some of them."""
    return table(spark, d, "pages").select(
        "page_id", "url", F.expr(PLANTED).alias("html"),
        F.expr("CASE page_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END").alias("status"),
        F.when(F.col("page_id") % 7 == 0, F.create_map(F.lit("cf-ray"), F.lit("1"))).otherwise(F.create_map(F.lit("server"), F.lit("cloudflare"))).alias("headers"),
        F.when(F.col("page_id") % 3 == 0, F.array(F.lit("cf_clearance"), F.lit("_px3"))).otherwise(F.array(F.lit("sid"))).alias("cookies"),
    )


@query(f"SELECT page_id, {BLOCK_SQL} AS blocked FROM ({FACTS.replace('@HTML@', PLANTED)})")
def b01_blocked(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("page_id", C.is_blocked(F.col("html"), F.col("status"), F.col("headers")).alias("blocked"))


@query(f"SELECT page_id, {sql_any('lower(html)', C.CAPTCHA)} AS captcha FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN html || '<div class=\"G-reCAPTCHA\">' ELSE html END AS html FROM pages)")
def b02_captcha_page(spark: SparkSession, d: str) -> DataFrame:
    html = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit('<div class="G-reCAPTCHA">'))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", C.is_captcha(html).alias("captcha"))


@query(f"""SELECT page_id, (regexp_matches(html, '{X.BODY}') AND length(regexp_replace(regexp_replace(regexp_extract(html, '{X.BODY}', 1), '{X.SCRIPT}', '', 'g'), {TRIM}, '', 'g')) < 100)
OR {sql_any('html', C.SHELLS)} AS needs_scripts FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<body> <script>' || html || '</script> </body>' WHEN 1 THEN html || '<div id="app"></div>' ELSE html END AS html FROM pages)""")
def b03_needs_scripts(spark: SparkSession, d: str) -> DataFrame:
    html = F.expr("CASE page_id % 3 WHEN 0 THEN concat('<body> <script>', html, '</script> </body>') WHEN 1 THEN concat(html, '<div id=\"app\"></div>') ELSE html END")
    return table(spark, d, "pages").select("page_id", html.alias("html")).select("page_id", C.needs_scripts(F.col("html")).alias("needs_scripts"))


@query(doubles("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cloudflare' WHEN page_id % 7 = 0 OR page_id % 7 <> 0 THEN 'cloudflare' END AS system,
CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 7 = 0 THEN 1.0 ELSE 1.0 END ELSE CASE WHEN page_id % 7 = 0 THEN 0.3 ELSE 0.2 END END AS confidence, 3 AS level,
CASE WHEN page_id % 3 = 0 THEN 'cf_clearance cookie,cf_ cookie prefix,' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN 'cf-ray header' ELSE 'server: cloudflare' END AS signals FROM pages""", "confidence"))
def b04_protection(spark: SparkSession, d: str) -> DataFrame:
    out = C.protection(planted(spark, d), "page_id", "html", "headers", "cookies")
    return out.withColumn("signals", F.array_join("signals", ","))


@query("SELECT c_custkey, 'sid' || c_custkey || ',theme' AS names FROM customer")
def b05_cookie_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" sid"), F.col("c_custkey").cast("string"), F.lit(" =x; Path=/")), F.lit("theme=dark=2"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(C.cookie_names(raw), ",").alias("names"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, 'n' || o_orderkey % 3 AS name, '.shop' || o_custkey % 5 || '.example' AS domain, o_orderkey % 4 <> 0 AS alive FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY domain, name ORDER BY o_orderkey DESC) AS r FROM c)
SELECT name, domain, o_orderkey AS value FROM l WHERE r = 1 AND alive AND ('www.shop1.example' LIKE '%' || domain OR '.www.shop1.example' = domain)""")
def b06_cookie_match(spark: SparkSession, d: str) -> DataFrame:
    from harrow.operators import cookies

    c = table(spark, d, "orders").select(
        F.concat(F.lit("n"), (F.col("o_orderkey") % 3).cast("string")).alias("name"), F.concat(F.lit(".shop"), (F.col("o_custkey") % 5).cast("string"), F.lit(".example")).alias("domain"),
        F.lit("/").alias("path"), F.when(F.col("o_orderkey") % 4 != 0, 2000).otherwise(500).cast("long").alias("expires"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("seq"),
    )
    return cookies.sent(cookies.jar(c), "www.shop1.example", "/a", 1000).select("name", "domain", "value")


@query("""SELECT p_partkey, ['turnstile', 'hcaptcha', 'recaptcha_v2', 'recaptcha_v3', 'recaptcha_v3', NULL, NULL][p_partkey % 7 + 1] AS kind,
CASE p_partkey % 7 WHEN 0 THEN 'k' || p_partkey WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '-0000-4000-8000-00000000000a' WHEN 2 THEN lpad(CAST(p_partkey AS VARCHAR), 40, 'x') WHEN 3 THEN lpad(CAST(p_partkey AS VARCHAR), 40, 'x')
WHEN 4 THEN lpad(CAST(p_partkey AS VARCHAR), 40, 'x') END AS sitekey, CASE p_partkey % 7 WHEN 3 THEN 'login' WHEN 4 THEN 'verify' END AS action, CASE WHEN p_partkey % 7 = 3 THEN true END AS enterprise, CASE WHEN p_partkey % 7 = 2 THEN 's' || p_size END AS s FROM part""")
def b07_captcha_kind(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    long, uuid = F.lpad(k, 40, "x"), F.concat(F.lpad(k, 8, "0"), F.lit("-0000-4000-8000-00000000000a"))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    forms = [
        cat('<div class="a cf-turnstile" data-sitekey="k', k, '"></div>'), cat("<script>hcaptcha.render(box, {size: 1, 'sitekey': '", uuid, "'})</script>"),
        cat('<div class="g-recaptcha" data-s="s', F.col("p_size").cast("string"), '" data-sitekey="', long, '"></div>'),
        cat('<iframe src="/recaptcha/enterprise/anchor?ar=1&k=', long, "\"></iframe><script>grecaptcha.enterprise.execute('x', {action: 'login'}); grecaptcha.execute</script>"),
        cat('<script src="/recaptcha/api.js?render=', long, '"></script>'), cat('<div class="g-recaptcha" data-sitekey="short', k, '"></div>'), F.lit('<div data-sitekey="k">'),
    ]
    html = F.element_at(F.array(*forms), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.captcha(html).alias("c")).select("p_partkey", "c.*")


@query(f"SELECT count(*) AS n FROM pages WHERE {sql_any('lower(html)', C.CAPTCHA)}")
def b08_captcha_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(C.is_captcha(F.col("html"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(html, '(?i)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def h06_page_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.title(F.col("html")).alias("title"), F.regexp_extract("html", '(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"))


LINKS = f"""SELECT page_id, url, min(pos) AS pos, target FROM (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, {SCHEME} || '://' || {HOST} || unnest(h) AS target
FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)) GROUP BY page_id, url, target"""


@query(f"SELECT page_id, pos, target FROM ({LINKS})")
def h08_links(spark: SparkSession, d: str) -> DataFrame:
    return G.links(table(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "target")


@query(f"SELECT page_id, {NORMAL} AS url, {TITLE} AS title, length({sql_text('html')}) AS n_text, md5({sql_text('html')}) AS text_md5 FROM pages")
def h09_scrape(spark: SparkSession, d: str) -> DataFrame:
    t = X.body_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("url"), X.title(F.col("html")).alias("title"), F.length(t).cast("long").alias("n_text"), F.md5(t).alias("text_md5"))


SANE = "html"
for _p, _r in ((X.TAG, ""),):
    SANE = f"regexp_replace({SANE}, '{_p}', '{_r}', 'g')"
for _e, _c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    SANE = f"replace({SANE}, '{_e}', '{_c}')"
SANE = f"regexp_replace(regexp_replace({SANE}, '\\s+', ' ', 'g'), {TRIM}, '', 'g')"


@query(f"SELECT page_id, md5({SANE}) AS text_md5 FROM pages")
def h23_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.sanitize(F.col("html"))).alias("text_md5"))


@query(f"SELECT page_id, length({sql_text('html')}) AS n, md5({sql_text('html')}) AS text_md5 FROM pages")
def h24_body_text(spark: SparkSession, d: str) -> DataFrame:
    t = X.body_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("text_md5"))


@query(f"SELECT page_id, md5(substr(regexp_replace(regexp_replace(regexp_replace(substr(html, 1, 500000), '{X.TAG}', ' ', 'g'), '\\s+', ' ', 'g'), {TRIM}, '', 'g'), 1, 120000)) AS text_md5 FROM pages")
def h25_crude_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.crude(F.col("html"))).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS text FROM documents")
def h29_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text"), 2000, "...").alias("text"))


@query("SELECT page_id, regexp_matches(url, '(?i)\\.json(\\?|$)|^https?://api\\.|[?&]format=json') AS is_json FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://api.') WHEN 1 THEN url || '?format=json' ELSE url END AS url FROM pages)")
def s10_json_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.expr("CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://api.') WHEN 1 THEN concat(url, '?format=json') ELSE url END")
    return table(spark, d, "pages").select("page_id", u.rlike(r"(?i)\.json(\?|$)|^https?://api\.|[?&]format=json").alias("is_json"))


def sql_score(url: str, depth: str) -> str:
    path = PATH.replace("url,", f"{url},")
    n = f"len(list_filter(string_split({path}, '/'), lambda x: x <> ''))"
    return (
        f"100 - 20 * ({depth}) + CASE WHEN regexp_matches({path}, '{G.either(G.CONTENT)}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches({path}, '{G.either(G.LOW_VALUE)}') THEN 40 ELSE 0 END"
        f" + CASE WHEN {n} <= 2 THEN 10 WHEN {n} >= 5 THEN -10 ELSE 0 END"
    )


@query(f"""SELECT page_id, target, {sql_score('target', 'page_id % 4')} AS score FROM (SELECT page_id, {SCHEME} || '://' || {HOST} || ['/blog/2024/01/x', '/tag/a/b/c/d', '/', '/feed', '/docs/a/login'][page_id % 5 + 1] AS target FROM pages)""")
def g01_score_urls(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/blog/2024/01/x", "/tag/a/b/c/d", "/", "/feed", "/docs/a/login")]), (F.col("page_id") % 5 + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.concat(U.origin(F.col("url")), tail).alias("target"))
    return p.select("page_id", "target", G.score(F.col("target"), F.col("page_id") % 4, F.lit("")).alias("score"))


@query(f"""WITH s AS (SELECT DISTINCT {NORMAL} AS url FROM pages),
l AS (SELECT DISTINCT target AS url FROM ({LINKS}))
SELECT url, min(rank) AS rank FROM (SELECT url, 0 AS rank FROM s UNION ALL SELECT url, 1 AS rank FROM l) GROUP BY url""")
def g04_site_map(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    first = p.select(U.normalize(F.col("url")).alias("url"), F.lit(0).alias("rank"))
    return first.unionByName(G.links(p).select(F.col("target").alias("url"), F.lit(1).alias("rank"))).groupBy("url").agg(F.min("rank").alias("rank"))


@query(f"SELECT host, seg, count(*) AS n FROM (SELECT {HOST} AS host, coalesce(list_filter(string_split({PATH}, '/'), lambda x: x <> '')[1], '') AS seg FROM pages) GROUP BY ROLLUP (host, seg)")
def g05_host_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(U.host(u).alias("host"), F.coalesce(F.get(U.segments(u), F.lit(0)), F.lit("")).alias("seg")).rollup("host", "seg").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type, day)")
def g05_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Users by kind and day, and by kind over all days, from distinct users that are stored and merged without the events."""
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    stored = written(G.distinct_values(e, ["event_type", "day"], "user_id"), "distinct")
    return G.rollup_distinct(stored, ["event_type", "day"], "user_id").withColumnRenamed("distinct", "users")


@query(f"""SELECT p.page_id, {NORMAL} AS url, {TITLE} AS title, length(t) AS n_text, CAST(coalesce(n, 0) AS BIGINT) AS n_links, {BLOCK_SQL.replace('status', '200')} AS blocked, {sql_score('url', '0')} AS score
FROM (SELECT *, len(regexp_extract_all(html, '(?i)<a\\s')) AS links, {sql_any('html', C.SCRIPTS)} AS p, regexp_matches({TITLE}, '(?i){'|'.join(C.TITLES)}') AS c, {sql_any('lower(t)', C.BLOCKED)} AS f FROM (SELECT *, {sql_text('html')} AS t FROM pages)) p
LEFT JOIN (SELECT page_id, count(*) AS n FROM ({LINKS}) GROUP BY page_id) l ON l.page_id = p.page_id""")
def page_report(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: one row per page with its normal URL, title, text size, links, blocked flag and crawl score."""
    p = table(spark, d, "pages")
    u, h = F.col("url"), F.col("html")
    targets = F.size(F.array_distinct(F.filter(F.regexp_extract_all(h, F.lit(G.ANCHOR), F.lit(1)), lambda x: ~x.rlike("^(#|javascript:|mailto:)"))))
    return p.select(
        "page_id", U.normalize(u).alias("url"), X.title(h).alias("title"), F.length(X.body_text(h)).cast("long").alias("n_text"), targets.cast("long").alias("n_links"),
        C.is_blocked(h, F.lit(200), F.create_map().cast("map<string,string>")).alias("blocked"), G.score(u, F.lit(0), F.lit("")).alias("score"),
    )
