"""URL queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import url as U
from harrow.operators import lookups as J
from harrow.plans.registry import names, query
from harrow.session import table

P = U.PARTS.replace("'", "''")
TRACKED = names(U.TRACKING)


def sql_part(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{P}', {k})"


HOST, SCHEME, PATH, QUERY = (f"lower({sql_part('url', 2)})", f"lower({sql_part('url', 1)})", sql_part("url", 4), sql_part("url", 5))
NORMAL = (
    f"{SCHEME} || '://' || regexp_replace({HOST}, '^www\\.', '') || CASE WHEN regexp_replace({PATH}, '/{{2,}}', '/', 'g') = '/' THEN '/' "
    f"ELSE regexp_replace(regexp_replace({PATH}, '/{{2,}}', '/', 'g'), '/$', '') END || "
    f"CASE WHEN len(list_filter(string_split({QUERY}, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({TRACKED}))) > 0 THEN '?' || "
    f"array_to_string(list_sort(list_filter(string_split({QUERY}, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({TRACKED}))), '&') ELSE '' END"
)


@query(f"SELECT page_id, {NORMAL} AS normalized FROM pages")
def u01_normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query(f"SELECT page_id, regexp_matches(url, '{P}') AS valid, regexp_matches(substr(url, 5), '{P}') AS valid_cut FROM pages")
def u02_valid_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.is_valid(F.col("url")).alias("valid"), U.is_valid(F.substring("url", 5, 10000)).alias("valid_cut"))


@query(f"""WITH p AS (SELECT page_id, {SCHEME} || '://' || {HOST} AS o FROM pages)
SELECT a.page_id, a.o = coalesce(b.o, '') AS same FROM p a LEFT JOIN p b ON b.page_id = a.page_id + 1""")
def u03_same_origin(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    other = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return p.join(other, "page_id", "left").select("page_id", U.same_origin(F.col("url"), F.col("next_url")).alias("same"))


@query(f"SELECT page_id, {SCHEME} || '://' || {HOST} AS base_url, {HOST} AS domain FROM pages")
def u04_base_and_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.origin(F.col("url")).alias("base_url"), U.domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, len(list_filter(string_split({QUERY}, '&'), lambda x: lower(split_part(x, '=', 1)) IN ({TRACKED}))) > 0 AS tracked FROM pages")
def u05_tracking_params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.has_tracking(F.col("url")).alias("tracked"))


@query(f"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, {SCHEME} || '://' || {HOST} || href AS target, count(*) AS n FROM h GROUP BY ALL""")
def u06_resolve(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.select("page_id", "href", U.resolve(F.col("href"), F.col("url")).alias("target")).groupBy("page_id", "href", "target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, 'name=' || replace(replace(c_name, '#', '%23'), ' ', '+') || '&segment=' || c_mktsegment AS query_string FROM customer")
def u07_query_string(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("name", "c_name"), ("segment", "c_mktsegment"))])
    return table(spark, d, "customer").select("c_custkey", U.query_string(pairs).alias("query_string"))


@query(f"SELECT page_id, {HOST} || '/' || array_to_string(list_filter(string_split({PATH}, '/'), lambda x: x <> '')[1:2], '/') AS circuit FROM pages")
def u08_circuit_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.circuit_key(F.col("url")).alias("circuit"))


@query(f"SELECT page_id, CASE WHEN len(string_split({HOST}, '.')) > 2 THEN regexp_replace({HOST}, '^[^.]*\\.', '') END AS parent FROM pages")
def u09_parent_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.parent_domain(U.host(F.col("url"))).alias("parent"))


@query(f"SELECT page_id, ({HOST} = 'example.com' OR {HOST} LIKE '%.example.com' OR {HOST} = 'therha.example.net') AS allowed FROM pages")
def u10_allow_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.allowed(U.host(F.col("url")), ["*.example.com", "therha.example.net"]).alias("allowed"))


@query(f"""WITH h AS (SELECT page_id, {HOST} AS h, url FROM pages), r AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN '*.' || regexp_replace(h, '^[^.]*\\.', '') WHEN page_id % 3 = 1 THEN upper(h) ELSE 'x.' || h END AS p FROM h WHERE page_id % 5 = 0)
SELECT page_id, bool_or(coalesce(lower(p) = h OR (p LIKE '*.%' AND (h = substr(p, 3) OR ends_with(h, substr(p, 2)))), false)) AS allowed FROM h LEFT JOIN r ON true GROUP BY page_id""")
def u10_rules(spark: SparkSession, d: str) -> DataFrame:
    """Hosts against a table of rules, which some pages' hosts make."""
    h = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("h"))
    k = F.col("page_id") % 3
    rules = h.where("page_id % 5 = 0").select(F.when(k == 0, F.concat(F.lit("*."), F.regexp_replace("h", r"^[^.]*\.", ""))).when(k == 1, F.upper("h")).otherwise(F.concat(F.lit("x."), "h")).alias("pattern"))
    return J.allowed_by(h, "h", rules).select("page_id", "allowed")


@query(f"""WITH h AS (SELECT page_id, {HOST} AS h, {PATH} AS p FROM pages), r AS (SELECT DISTINCT h, substr(p, 1, CAST(1 + page_id % 9 AS BIGINT)) AS p, page_id % 2 = 0 AS a FROM h WHERE page_id % 4 = 0)
SELECT page_id, coalesce(arg_max(a, (len(r.p), a)) FILTER (r.p IS NOT NULL), true) AS allowed FROM h LEFT JOIN r ON r.h = h.h AND starts_with(h.p, r.p) GROUP BY page_id""")
def u10_path_rules(spark: SparkSession, d: str) -> DataFrame:
    """Paths against a table of rules by host, which some pages' paths make: the longest decides."""
    h = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("h"), U.path(F.col("url")).alias("p"))
    rules = h.where("page_id % 4 = 0").select(F.col("h").alias("host"), F.expr("substr(p, 1, cast(1 + page_id % 9 as int))").alias("path"), (F.col("page_id") % 2 == 0).alias("allow")).distinct()
    return J.path_rules(h, "h", "p", rules).select("page_id", "allowed")


SHAPES = ("https://www.youtube.com/watch?v=abc", "https://youtu.be/abc", "https://m.tiktok.com/@a/1", "https://a.example/x/y.MP4", "https://a.example/y.html", "no url")


@query(f"SELECT n_nationkey, ['youtube', 'youtube', 'tiktok', 'direct-media', 'webpage', 'webpage'][n_nationkey % 6 + 1] AS kind FROM nation")
def u11_url_type(spark: SparkSession, d: str) -> DataFrame:
    url = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), F.col("n_nationkey") % 6 + 1)
    return table(spark, d, "nation").select("n_nationkey", U.kind(url).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE lpad(CAST(p_partkey AS VARCHAR), 11, 'x') END AS video_id FROM part")
def u12_video_id(spark: SparkSession, d: str) -> DataFrame:
    key = F.lpad(F.col("p_partkey").cast("string"), 11, "x")
    forms = F.element_at(F.array(F.concat(F.lit("youtu.be/"), key), F.concat(F.lit("https://www.youtube.com/shorts/"), key, F.lit("/x")), F.concat(F.lit("https://youtube.com/watch?a=1&v="), key), F.lit("https://youtube.com/")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", U.video_id(forms).alias("video_id"))


@query("SELECT DISTINCT lower(replace(s_name, '#', '_')) AS handle FROM supplier")
def u13_profile_handles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    urls = s.select(F.concat(F.lit("https://www.instagram.com/"), F.replace(F.col("s_name"), F.lit("#"), F.lit("_")), F.lit("/?hl=en")).alias("url"))
    urls = urls.unionByName(urls).unionByName(s.select(F.lit("https://instagram.com/explore/").alias("url")))
    return urls.select(U.profile_handle(F.col("url")).alias("handle")).where("handle is not null").distinct()


@query("SELECT doc_id, CASE WHEN s = '' THEN 'topic' ELSE s END AS slug, h AS hash FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS s, substr(sha1(text), 1, 16) AS h FROM documents)")
def u14_slug_and_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", U.slug(F.col("text")).alias("slug"), U.url_hash(F.col("text")).alias("hash"))


@query("""SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9._-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 200) AS file_name,
CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', n / 1024) WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576) ELSE printf('%.1fGB', n / 1073741824) END AS size
FROM (SELECT doc_id, text, n_chars * 7 AS n FROM documents)""")
def k13_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", U.file_name(F.col("text")).alias("file_name"), U.file_size(F.col("n_chars") * 7).alias("size"))


@query(f"""SELECT page_id, {SCHEME} || '://' || regexp_replace({HOST}, '^www\\.', '') || ['/a/c', '/d', '/', '/f', '/g/h'][page_id % 5 + 1] AS normalized, {SCHEME} || '://' || {HOST} || ['/b/x', '/x', '/b/y/?q=../z', '/w/', '/b/.x'][page_id % 5 + 1] AS target FROM pages""")
def u15_dot_segments(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("page_id") % 5 + 1).cast("int"))
    own = F.concat(U.origin(F.col("url")), pick("/a/./b/../c", "/../../d", "/e/..", "/f/.", "/g/h"))
    target = U.resolve(pick("x", "../x", "./y/z/..?q=../z", "/v/../w/.", ".x"), F.concat(U.origin(F.col("url")), F.lit("/b/index.html?a=1")))
    return table(spark, d, "pages").select("page_id", U.normalize(own).alias("normalized"), target.alias("target"))
