"""Queries over layouts, accessibility trees, sinks and stored JSON records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import records as R
from harrow.functions import tables as T
from harrow.operators import commits as V
from harrow.operators import layout as L
from harrow.operators import listings as P
from harrow.operators import sinks as K
from harrow.plans.registry import doubles, query
from harrow.plans.roundtrip import cat
from harrow.session import passing, shared_dir, table
from harrow.sources import logs as Q


@query("""SELECT user_id, line, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS text FROM (SELECT *, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS line FROM
(SELECT *, coalesce(lag(event_type = 'error') OVER w OR abs(value - lag(value) OVER w) > 20, false) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY user_id, line""")
def h30_lines(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("s"), "value", (F.col("event_type") == "error").alias("eol"))
    return L.lines(one, "user_id", "event_id", "s", "value", "eol", 20.0)


ROWED = "SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_type = 'error' THEN 3 ELSE 2 END AS n FROM events"


@query(f"""WITH c AS (SELECT *, CAST(sum(CAST(n < 2 OR p IS NULL OR p <> n AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ({ROWED})))
SELECT user_id, run AS "table", event_id, CAST(n AS INT) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS size FROM c WHERE n >= 2) WHERE size >= 2""")
def h31_tables(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE WHEN event_id % 4 = 0 THEN 'single line' WHEN event_type = 'error' THEN concat('a b   ', event_id, '\\tx') ELSE concat(event_id, '    y') END")
    t = L.tables(table(spark, d, "events").select("user_id", "event_id", text.alias("t")), "user_id", "event_id", "t")
    return t.select("user_id", "table", "event_id", F.size("cells").alias("n"))


@query(f"""WITH c AS (SELECT *, CAST(sum(CAST(n < 2 OR p IS NULL OR p <> n AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ({ROWED})))
SELECT user_id, run AS "table", event_id, CAST(n AS INT) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS size FROM c WHERE n >= 2) WHERE size >= 2""")
def h31_table_function(spark: SparkSession, d: str) -> DataFrame:
    """The same by a table function from SQL: one pass over each page's rows, no windows."""
    text = F.expr("CASE WHEN event_id % 4 = 0 THEN 'single line' WHEN event_type = 'error' THEN concat('a b   ', event_id, '\\tx') ELSE concat(event_id, '    y') END")
    rows = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("line"), text.alias("text"))
    T.register(spark)
    found = spark.sql("SELECT * FROM text_tables(TABLE({rows}) PARTITION BY page ORDER BY line)", rows=rows)
    return found.select(F.col("page").alias("user_id"), "table", F.col("line").alias("event_id"), F.size("cells").alias("n"))


@query(f"""SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, length(regexp_replace(t, '{L.ODD}', '', 'g')) / n * least(1.0, n / 50.0)) END AS confidence
FROM (SELECT *, length(t) + length(regexp_replace(t, '{L.WIDE}', '', 'g')) AS n FROM (SELECT doc_id, regexp_replace(text, '{L.ENDS}', '', 'g') AS t FROM documents))""")
def h32_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", L.confidence(F.col("text")).alias("confidence"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Every region's nations as lines of a tree, of every shape that a line can have."""
    name = F.substring("n_name", 1, 1)
    role = F.element_at(F.array(*[F.lit(x) for x in ("button", "link", "heading", "generic", "navigation", "main", "code", "listitem")]), F.col("n_nationkey") % 8 + 1)
    shape = F.col("n_nationkey") % 6
    line = F.when(shape == 0, cat("- text:  ", F.col("n_name"), " ")).when(shape == 1, cat("- ", role, ":")).when(shape == 2, cat("- ", F.col("n_name"), " and, more:")).when(shape == 3, "no dash").otherwise(cat("- ", role, ' "', name, '" [x=1]'))
    line = cat(F.repeat(F.lit("  "), (F.col("n_nationkey") % 3).cast("int")), line)
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return t


TREE = """SELECT n_regionkey, line, CAST(2 * (k % 3) AS INT) AS indent, CASE k % 6 WHEN 0 THEN 'text' WHEN 2 THEN 'text' ELSE r END AS role,
CASE k % 6 WHEN 0 THEN n_name WHEN 1 THEN '' WHEN 2 THEN n_name || ' and, more' ELSE substr(n_name, 1, 1) END AS name, CASE WHEN k % 6 > 3 THEN '[x=1]' ELSE '' END AS attributes, k
FROM (SELECT *, n_nationkey AS k, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS line, ['button', 'link', 'heading', 'generic', 'navigation', 'main', 'code', 'listitem'][n_nationkey % 8 + 1] AS r FROM nation) WHERE k % 6 <> 3"""
REFS = f"""SELECT n_regionkey, line, role, name, 'e' || row_number() OVER (PARTITION BY n_regionkey ORDER BY line) AS ref, CAST(CASE WHEN count(*) OVER (PARTITION BY n_regionkey, role, name) > 1
THEN row_number() OVER (PARTITION BY n_regionkey, role, name ORDER BY line) - 1 END AS INT) AS nth, indent, attributes FROM ({TREE})"""


@query(f"SELECT n_regionkey, line, indent, role, name, attributes FROM ({TREE})")
def h26_tree_lines(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).select("n_regionkey", F.inline(L.tree_lines(F.col("text")))).drop("raw")


@query(f"""SELECT n_regionkey, line, role, name, ref, nth, 'getByRole(''' || role || '''' || CASE WHEN name = '' THEN '' ELSE ', {{ name: ''' || name || ''', exact: true }}' END || ')' || coalesce('.nth(' || nth || ')', '') AS selector
FROM ({REFS} WHERE role NOT IN ('generic', 'main', 'listitem', 'text'))""")
def h27_references(spark: SparkSession, d: str) -> DataFrame:
    lines = tree(spark, d).select("n_regionkey", F.inline(L.tree_lines(F.col("text"))))
    return L.references(lines, "n_regionkey", "line")


@query(f"""SELECT n_regionkey, line, repeat(' ', indent) || '- ' || role || CASE WHEN name = '' THEN '' ELSE ' "' || name || '"' END || ' [ref=' || ref || ']' || CASE WHEN attributes = '' THEN '' ELSE ' ' || attributes END AS text FROM ({REFS} WHERE role IN ('button', 'link'))
UNION ALL SELECT n_regionkey, line, repeat(' ', indent) || CASE k % 6 WHEN 0 THEN '- text:  ' || name || ' ' WHEN 1 THEN '- ' || role || ':' WHEN 2 THEN '- ' || name || ':' ELSE '- ' || role || ' "' || name || '" [x=1]' END
FROM ({TREE}) WHERE role NOT IN ('button', 'link', 'generic', 'main') UNION ALL SELECT n_regionkey, line, repeat(' ', 2 * CAST(n_nationkey % 3 AS INT)) || 'no dash' FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS line FROM nation) WHERE n_nationkey % 6 = 3""")
def h27_compact_tree(spark: SparkSession, d: str) -> DataFrame:
    return L.annotated(tree(spark, d), "n_regionkey", "text")


@query("SELECT n_nationkey, '<boundary:a' || n_nationkey || '>' || chr(10) || n_name || chr(10) || '</boundary:a' || n_nationkey || '>' AS text FROM nation")
def h28_boundary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", K.wrapped(F.col("n_name"), cat("a", F.col("n_nationkey").cast("string"))).alias("text"))


@query("SELECT count(*) AS markers, max(16) AS size FROM nation")
def h28_markers(spark: SparkSession, d: str) -> DataFrame:
    """Every row's marker is another one."""
    m = table(spark, d, "nation").select(K.random_marker().alias("m"))
    return m.agg(F.count_distinct("m").alias("markers"), F.max(F.length("m")).alias("size"))


@query("SELECT c_custkey, c_name AS first FROM customer")
def k01_row_array(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.struct(F.col("c_name").alias("n")))
    odd = F.array(F.struct(F.lit("no").alias("n")))
    j = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.lit(1).alias("results"), rows.alias("items")))).when(F.col("c_custkey") % 3 == 1, F.to_json(F.struct(odd.alias("aa"), rows.alias("results"), F.array(F.lit(1)).alias("items"))))
    j = F.coalesce(j, F.to_json(F.struct(F.lit(2).alias("total"), rows.alias("zz"), odd.alias("aa"))))  # no known key: the first that holds an array, in the order of the text
    return table(spark, d, "customer").select("c_custkey", K.row_array(j).alias("a")).select("c_custkey", F.get_json_object("a", "$[0].n").alias("first"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def k03_json_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.json_lines(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("""SELECT doc_id || ',' || CASE WHEN regexp_matches(t, '[,"\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ',' || lang AS line FROM (SELECT doc_id, text AS t, lang FROM documents)""")
def k04_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.csv_lines(table(spark, d, "documents").select("doc_id", F.col("text").alias("t"), "lang"))


@query("SELECT o_custkey, 'id,status' || chr(10) || string_agg(o_orderkey || ',' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS csv FROM orders GROUP BY o_custkey")
def k05_grouped_csv(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("o_orderkey", cat(F.col("o_orderkey").cast("string"), ",", F.col("o_orderstatus")).alias("l"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(cat("id,status\n", F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n")).alias("csv"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'md' END, CASE WHEN doc_id % 3 = 1 THEN lang END, '{"doc_id":' || doc_id || '}') AS shown FROM documents""")
def k06_markdown_or_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(k == 0, "md"), F.when(k == 1, F.col("lang")), F.to_json(F.struct("doc_id"))).alias("shown"))


@query("""SELECT 'N' || n_nationkey AS "Job ID", n_name AS "Status", done || '/' || total AS "URLs", CASE WHEN total > 0 THEN CAST(floor(done / total * 100 + 0.5) AS BIGINT) ELSE 0 END || '%' AS "Progress"
FROM (SELECT n_nationkey, n_name, count(c_custkey) AS total, count(*) FILTER (c_acctbal > 3000) AS done FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name)""")
def k07_table_cells(spark: SparkSession, d: str) -> DataFrame:
    n = F.broadcast(table(spark, d, "nation"))
    j = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy("n_nationkey", F.col("n_name").alias("status"))
    j = j.agg(F.count("c_custkey").alias("urls_total"), F.count_if(F.col("c_acctbal") > 6000).alias("urls_completed"), F.count_if((F.col("c_acctbal") > 3000) & (F.col("c_acctbal") <= 6000)).alias("urls_failed"))
    return P.jobs(j.withColumn("id", cat("N", F.col("n_nationkey").cast("string"))))


@query("""SELECT p_name AS "Name", CASE WHEN p_partkey % 3 = 0 THEN 'extract' ELSE p_brand END || CASE WHEN p_size > 25 THEN ' (built-in)' ELSE '' END AS "Type", 'https://s.example/' || p_partkey AS "URL",
CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type || ', ' || p_brand END AS "Fields", '2024-05-0' || (p_partkey % 9 + 1) AS "Created" FROM part""")
def k07_skill_cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(
        F.col("p_name").alias("name"), F.when(k % 3 != 0, F.col("p_brand")).alias("tool"), (F.col("p_size") > 25).alias("builtin"), cat("https://s.example/", k.cast("string")).alias("url"),
        F.when(k % 4 != 0, F.array("p_type", "p_brand")).alias("fields"), cat("2024-05-0", (k % 9 + 1).cast("string"), "T01:02:03Z").alias("created_at"),
    )
    return P.skills(s)


@query("""SELECT s_name AS "Domain", 'L' || CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey % 4 ELSE 1 END AS "Level", '0%' AS "Success%", CAST(s_suppkey AS VARCHAR) AS "Reqs", '60' AS "Rate/RPM",
CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE 'wall' || s_nationkey END AS "AntiBot", '' AS "Updated" FROM supplier""")
def k07_domain_cells(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    s = table(spark, d, "supplier").select(
        F.col("s_name").alias("domain"), F.when(k % 2 == 0, F.col("s_nationkey") % 4).alias("optimal_level"), none.alias("success_rate"), k.alias("requests"), none.alias("rate_limit_rpm"),
        F.when(k % 3 != 0, cat("wall", F.col("s_nationkey").cast("string"))).alias("antibot"), none.alias("last_updated"),
    )
    return P.domains(s)


@query("""SELECT CAST(r AS VARCHAR) AS "#", substr(text, 1, 50) AS "Title", 'doc:' || doc_id AS "URL" FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 20""")
def k07_result_cells(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")))
    return P.found(r.select("r", F.lit(None).cast("string").alias("title"), F.col("text").alias("name"), F.lit(None).cast("string").alias("url"), cat("doc:", F.col("doc_id").cast("string")).alias("source")), "r")


@query("""SELECT '{' || chr(10) || '  "n_nationkey": ' || n_nationkey || ',' || chr(10) || '  "n_name": "a\\" : ' || n_name || '",' || chr(10) || '  "in": {' || chr(10) || '    "n_regionkey": ' || n_regionkey || ',' || chr(10) || '    "none": null' || chr(10) || '  }' || chr(10) || '}' AS text FROM nation""")
def k02_pretty_json(spark: SparkSession, d: str) -> DataFrame:
    inner = F.struct("n_regionkey", F.lit(None).cast("string").alias("none"))
    return K.pretty_json(table(spark, d, "nation").select("n_nationkey", cat('a" : ', F.col("n_name")).alias("n_name"), inner.alias("in")))


def nested(path: str, value) -> Column:
    """A struct in a struct, along a dotted path."""
    for name in reversed(path.split(".")):
        value = F.struct(value.alias(name))
    return value


def simple(c) -> Column:
    return F.struct(c.alias("simpleText"))


def run_of(*fields) -> Column:
    return F.struct(F.array(F.struct(*fields)).alias("runs"))


@query(doubles("""SELECT p_brand, 'v' || p_partkey AS id, p_name AS title, 'https://www.youtube.com/watch?v=v' || p_partkey AS url, 'big' || p_size AS thumbnail, p_size * 1000.0 AS views, 'by ' || p_brand AS author,
CASE WHEN p_partkey % 2 = 0 THEN 'https://www.youtube.com/@' || p_size END AS author_url, p_size || ' days ago' AS published
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 7""", "views"))
def p06_video_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first seven videos of a brand's search page; its other entries are adverts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    at = F.when(k % 2 == 0, nested("browseEndpoint.canonicalBaseUrl", cat("/@", size)))
    views = cat(size, "K views")
    v = F.struct(
        cat("v", k.cast("string")).alias("videoId"), run_of(F.col("p_name").alias("text")).alias("title"), nested("thumbnails", F.array(*[F.struct(cat(x, size).alias("url")) for x in ("small", "big")])).alias("thumbnail"),
        simple(F.when(k % 3 != 0, views).otherwise("")).alias("viewCountText"), simple(views).alias("shortViewCountText"), run_of(cat("by ", F.col("p_brand")).alias("text"), at.alias("navigationEndpoint")).alias("ownerText"),
        simple(cat(size, " days ago")).alias("publishedTimeText"),
    )
    entry = F.struct(F.lit(None).cast("string").alias("advert"), v.alias("videoRenderer"))
    advert = F.struct(F.lit("x").alias("advert"), F.lit(None).alias("videoRenderer"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"])
    made = table(spark, d, "part").groupBy("p_brand").agg(listed.alias("l")).select("p_brand", F.concat(F.array(advert), "l").alias("l"))
    half = F.floor(F.size("l") / 2).cast("int")
    parts = [nested("itemSectionRenderer.contents", x) for x in (F.slice("l", F.lit(1), half), F.slice("l", half + 1, F.size("l")))]
    j = F.to_json(nested("contents.twoColumnSearchResultsRenderer.primaryContents.sectionListRenderer.contents", F.array(*parts)))
    return made.select("p_brand", F.inline(R.search_videos(j, 7))).drop("duration")


@query(doubles("""SELECT s_suppkey, 'w' || s_suppkey AS id, s_name || ' live' AS title, 1000.0 + s_nationkey AS views, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey * 1000.0 + 1000 END AS likes, s_name AS author,
substr(repeat('About ' || s_name || '. ', 200), 1, 2000) AS description, CASE s_suppkey % 3 WHEN 0 THEN 'en.vtt' WHEN 1 THEN 'de.vtt' END AS captions,
CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS channel, CASE WHEN s_suppkey % 2 = 0 THEN (s_nationkey + 1) * 100000.0 END AS subscribers, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 4 = 0 END AS verified FROM supplier""", "views", "likes", "subscribers"))
def p07_video_details(spark: SparkSession, d: str) -> DataFrame:
    k, n, name = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_name")
    button = nested("segmentedLikeDislikeButtonViewModel.likeButtonViewModel.likeButtonViewModel.toggleButtonViewModel.toggleButtonViewModel.defaultButtonViewModel.buttonViewModel.title", F.when(k % 2 == 0, cat((n + 1).cast("string"), "K")).otherwise(""))
    primary = F.struct(
        F.struct(F.array(F.struct(name.alias("text")), F.struct(F.lit(" live").alias("text"))).alias("runs")).alias("title"),
        nested("videoViewCountRenderer.viewCount.simpleText", cat("1,0", F.lpad(n.cast("string"), 2, "0"), " views")).alias("viewCount"), nested("menuRenderer.topLevelButtons", F.array(button)).alias("videoActions"),
    )
    secondary = F.struct(nested("videoOwnerRenderer.title", run_of(name.alias("text"))).alias("owner"), nested("content", F.repeat(cat("About ", name, ". "), F.lit(200))).alias("attributedDescription"))
    contents = F.array(F.to_json(F.struct(primary.alias("videoPrimaryInfoRenderer"))), F.lit('{"x":1}'), F.to_json(F.struct(secondary.alias("videoSecondaryInfoRenderer"))))
    watch = cat('{"currentVideoEndpoint":{"watchEndpoint":{"videoId":"w', k.cast("string"), '"}},"contents":{"twoColumnWatchNextResults":{"results":{"results":{"contents":[', F.array_join(contents, ","), "]}}}}}")
    tracks = F.when(k % 3 == 0, F.expr("array(struct('de' as languageCode, 'de.vtt' as baseUrl), struct('en' as languageCode, 'en.vtt' as baseUrl))")).when(k % 3 == 1, F.expr("array(struct('de' as languageCode, 'de.vtt' as baseUrl))"))
    said = cat(((n + 1) / 10).cast("string"), "M subscribers")
    rows = F.array(F.struct(F.array(nested("text.content", F.lit("@x"))).alias("metadataParts")), F.struct(F.array(nested("text.content", said)).alias("metadataParts")))
    old = F.struct(F.struct(F.when(k % 4 == 0, said).alias("simpleText")).alias("subscriberCountText"), F.when(k % 4 == 0, F.array(nested("metadataBadgeRenderer.style", F.lit("BADGE_VERIFIED")))).alias("badges"))
    head = F.struct(old.alias("c4TabbedHeaderRenderer"), nested("content.pageHeaderViewModel.metadata.contentMetadataViewModel.metadataRows", rows).alias("pageHeaderRenderer"))
    page = F.to_json(F.struct(head.alias("header"), nested("channelMetadataRenderer.title", F.when(k % 2 == 0, name)).alias("metadata")))
    page = F.when(k % 2 == 0, page).otherwise("{}")
    t = table(spark, d, "supplier").select(k, R.video(watch).alias("v"), R.captions_url(F.to_json(nested("captions.playerCaptionsTracklistRenderer.captionTracks", tracks))).alias("captions"), R.channel(page).alias("c"))
    return t.select("s_suppkey", *[f"v.{c}" for c in ("id", "title", "views", "likes", "author", "description")], "captions", F.col("c.name").alias("channel"), "c.subscribers", "c.verified")


@query(doubles("SELECT s_suppkey, unnest([0.5, 7.25]) AS start, unnest(['It''s', s_name || ' & co']) AS text FROM supplier", "start"))
def p08_timed_text(spark: SparkSession, d: str) -> DataFrame:
    from harrow.functions import text as X

    xml = cat('<transcript><text start="0.5" dur="1">It&#39;s</text><text start="7.25" dur="1">', F.col("s_name"), " &amp; co</text></transcript>")
    p = r'<text start="([^"]*)"[^>]*>(.*?)</text>'
    z = F.arrays_zip(F.regexp_extract_all(xml, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(xml, F.lit(p), F.lit(2)).alias("b"))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(z).alias("z")).select("s_suppkey", F.col("z.a").cast("double").alias("start"), X.sanitize(F.col("z.b")).alias("text"))


@query("""SELECT o_custkey, title, n, c AS comment, CASE WHEN c % 5 = 0 THEN '[deleted]' ELSE 'u' || c END AS author, CASE WHEN c % 7 = 0 THEN 0 ELSE c END AS score,
CASE WHEN c % 2 = 0 THEN 'b ' || c ELSE 'plain' END AS text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS published, CAST(c % 3 AS INT) AS replies_count
FROM (SELECT o_custkey, o_orderkey AS c, o_orderdate, 'Thread ' || o_custkey AS title, o_custkey * 2 AS n FROM orders WHERE o_orderkey % 3 <> 0)""")
def p11_forum_comments(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as a thread: entries that are no comments are left out."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    replies = F.when(k % 3 == 0, F.lit(None)).otherwise(nested("data.children", F.array_repeat(F.lit(1), (k % 3).cast("int"))))
    data = F.struct(
        none.alias("id"), k.cast("string").alias("name"), F.when(k % 5 != 0, cat("u", k.cast("string"))).alias("author"), F.when(k % 7 != 0, k).alias("score"), F.col("o_orderdate").cast("timestamp").cast("long").alias("created_utc"),
        F.when(k % 2 == 0, cat("<p>b  ", k.cast("string"), "</p>")).alias("body_html"), F.lit("plain").alias("body"), replies.alias("replies"),
    )
    child = F.struct(F.when(k % 3 == 0, "more").otherwise("t1").alias("kind"), data.alias("data"))
    post = cat('[{"data":{"children":[{"kind":"t3","data":{"title":"Thread ', F.col("o_custkey").cast("string"), '","num_comments":', (F.col("o_custkey") * 2).cast("string"), "}}]}},")
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(post, F.to_json(nested("data.children", F.collect_list(child))), F.lit("]")).alias("j"))
    t = t.select("o_custkey", R.thread_post(F.col("j")).alias("p"), F.explode(R.thread_comments(F.col("j"), 1 << 30)).alias("c"))
    comment = F.col("c.id").cast("long").alias("comment")
    return t.select("o_custkey", "p.title", F.col("p.comments_count").alias("n"), comment, "c.author", "c.score", "c.text", "c.published", "c.replies_count")


@query("""SELECT c_custkey, c_name AS name, CAST(c_nationkey * 1000 AS DOUBLE) AS followers, 12.0::DOUBLE AS following, CAST(c_custkey AS DOUBLE) AS posts_count, 'I sell ' || c_mktsegment AS description, c_custkey % 2 = 0 AS verified,
c_custkey % 3 = 0 AS business FROM customer WHERE c_custkey % 4 <> 0 AND c_nationkey > 0""")
def p12_profile_meta(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    said = cat(F.col("c_nationkey").cast("string"), "K Followers, 12 Following, ", k.cast("string"), " Posts - I sell ", F.col("c_mktsegment"), " See Instagram photos and videos from ", F.col("c_name"), " (@x)")
    html = cat("<title>", F.col("c_name"), " (@x) • Instagram photos</title>", '<meta property="og:description" content="', F.when(k % 4 == 0, "private").otherwise(said), '">',
               F.when(k % 2 == 0, '"is_verified":true').otherwise(""), F.when(k % 3 == 0, '"is_professional_account":true').otherwise(""))
    p = table(spark, d, "customer").where("c_nationkey > 0").select(k, R.photo_profile_of_page(html, F.lit("x")).alias("p")).where("p is not null")
    return p.select("c_custkey", *[f"p.{c}" for c in ("name", "followers", "following", "posts_count", "description", "verified")], F.col("p.is_business").alias("business"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'u' || c_custkey ELSE c_name END AS name, c_nationkey * 100 AS followers, least(n, 3) AS posts,
CASE WHEN c_nationkey > 0 AND n > 0 THEN floor(coalesce(s, 0) / least(n, 3) / (c_nationkey * 100) * 10000 + 0.5) / 100 ELSE 0 END::DOUBLE AS engagement_rate, c_custkey % 2 = 0 AS business
FROM (SELECT c_custkey, c_name, c_nationkey, count(o_orderkey) AS n, sum(CASE WHEN r <= 3 THEN o_orderkey % 100 + 7 END) AS s
FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ON o_custkey = c_custkey GROUP BY ALL) WHERE c_custkey % 7 <> 0""")
def p12_profile_records(spark: SparkSession, d: str) -> DataFrame:
    """Profiles as the API gives them, the orders as posts; private ones have no row."""
    k = F.col("c_custkey")
    node = nested("node", F.struct(F.col("o_orderkey").cast("string").alias("id"), nested("count", F.col("o_orderkey") % 100).alias("edge_liked_by"), nested("count", F.lit(7)).alias("edge_media_to_comment")))
    posts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", node.alias("e")))), lambda x: x["e"]).alias("edges"))
    user = F.struct(
        F.when(k % 5 != 0, F.col("c_name")).alias("full_name"), (k % 7 == 0).alias("is_private"), nested("count", F.col("c_nationkey") * 100).alias("edge_followed_by"),
        nested("edges", F.col("edges")).alias("edge_owner_to_timeline_media"), (k % 2 == 0).alias("is_professional_account"),
    )
    p = table(spark, d, "customer").join(posts, "c_custkey", "left").select(k, R.photo_profile(F.to_json(user), cat("u", k.cast("string"))).alias("p")).where("p is not null")
    return p.select("c_custkey", "p.name", "p.followers", F.size("p.recent_posts").alias("posts"), "p.engagement_rate", F.col("p.is_business").alias("business"))


@query(doubles("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size * 1000.0 END AS views, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size * 1000.0 END AS score,
CASE WHEN p_partkey % 2 = 0 THEN 'n' || p_size ELSE 'u' || p_size END AS name, p_size * 1000.0 AS subscribers, p_partkey % 2 = 0 AS verified, CASE WHEN p_partkey % 4 = 3 THEN 0.0 ELSE p_size * 1000.0 END AS followers FROM part""", "views", "score", "subscribers", "followers"))
def p27_normalise_records(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    n = F.element_at(F.array(cat('"', size, 'K"'), cat(size, "000"), cat('"', size, ',000"'), F.lit('"many"')), (k % 4 + 1).cast("int"))
    title = F.to_json(F.struct(F.when(k % 5 != 0, F.col("p_name")).alias("title"), F.when(k % 2 == 0, cat("n", size)).alias("name"), cat("u", size).alias("username"), (k % 2 == 0).alias("verified")))
    j = F.concat(F.substring(title, 1, F.length(title) - 1), *[F.lit(x) if isinstance(x, str) else x for x in (',"views":', n, ',"score":', n, ',"followers":', n, ',"subscribers":"', size, 'K"}')])
    kinds = {"v": "video", "o": "post", "p": "profile", "i": "photos"}
    r = table(spark, d, "part").select("p_partkey", j.alias("j")).select("p_partkey", *[R.normalised(F.col("j"), kind).alias(a) for a, kind in kinds.items()])
    return r.select("p_partkey", "v.title", "v.views", "o.score", "p.name", "p.subscribers", "p.verified", "i.followers")


@query("SELECT n_nationkey, n_name || '!' AS n_name FROM nation")
def k11_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of a table, of which readers see the second."""
    n, root = table(spark, d, "nation").select("n_nationkey", "n_name"), passing(spark, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")
    K.write_snapshot(n, root, 9)
    K.write_snapshot(n.select("n_nationkey", cat(F.col("n_name"), "!").alias("n_name")), root, 10)
    return K.read_snapshot(spark, root)


@query("SELECT n_nationkey, n_name || '!?' AS n_name FROM nation")
def k11_commits(spark: SparkSession, d: str) -> DataFrame:
    """Two changes of a state table, each of the version before it."""
    n, root = table(spark, d, "nation").select("n_nationkey", "n_name"), passing(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    V.commit(n, root, 0)
    for mark in "!?":
        V.update(spark, root, lambda old, mark=mark: old.withColumn("n_name", cat(F.col("n_name"), mark)))
    return V.read(spark, root)


@query("SELECT event_id, 'https://h' || (user_id % 30) || '.example/' || event_type AS url, event_id % 5 * 100 AS status FROM events WHERE event_type = 'error' AND event_id % 5 > 1")
def s12_request_log(spark: SparkSession, d: str) -> DataFrame:
    """Events written as log lines and read back by the source, which tests the method as it reads."""
    Q.register(spark)
    path = passing(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}")
    url = cat("https://h", (F.col("user_id") % 30).cast("string"), ".example/", F.col("event_type"))
    e = table(spark, d, "events").select(url.alias("url"), F.col("event_type").alias("method"), (F.col("event_id") % 5 * 100).alias("status"), F.col("event_id").cast("double").alias("ts"))
    e.select(F.to_json(F.struct("*")).alias("value")).write.option("lineSep", "\n").format("text").save(f"{path}/raw")
    return log_of(spark, path).where("method = 'error' and status > 100").select(F.col("ts").cast("long").alias("event_id"), "url", "status")


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """The source reads files by their ending; Spark's text files have another one."""
    return spark.read.format("request_log").option("ending", ".txt").load(f"{path}/raw")
