"""Faults that a review found at size: exact counts, repeated URLs, rounding, uneven tasks, pages that hold a table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.plans import registry

registry.load()


def same_as_sql(spark, folder, name):
    """The query's rows over the tables in ``folder`` are its SQL's."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.name[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    got = con.execute(registry.SQL[name])
    columns = [x[0] for x in got.description]
    rows = registry.QUERIES[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, got.fetchall()))
    return len(rows)


def test_distinct_users_are_exact_beyond_a_sketch(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 3)").alias("ts"), (F.xxhash64("id") % 40_000).alias("user_id"), F.lit("view").alias("event_type"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    assert same_as_sql(spark, tmp_path, "g05_sketches") == 5


def test_a_url_that_is_done_leaves_other_rows_of_it(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (3, "a"), (4, "a"), (5, "b"), (7, None), (9, None), (11, "c"), (None, "d")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert same_as_sql(spark, tmp_path, "j01_pending") == 4


def test_decimals_are_those_of_printf(spark):
    from harrow.functions import text as X

    values = [k / 1024 * 7 for k in range(3000)] + [k / 20 for k in range(2001)] + [100 * k / 257 for k in range(300)] + [0.0, 8.6e9 + 0.25]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed(F.col("v"), 1).alias("one"), X.fixed(F.col("v"), 2).alias("two")).collect()
    assert [(r.one, r.two) for r in rows] == [("%.1f" % r.v, "%.2f" % r.v) for r in rows]


def test_digest_rounds_as_its_sql(spark, tmp_path):
    lines = lambda n, mark: "\n".join(f"{mark if k < n else ''}{k}" for k in range(400))
    texts = [lines(0, "x") if k % 2 else lines(390 + k // 2, f"n{k} ") for k in range(20)]
    spark.createDataFrame([(k, x, "en") for k, x in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert same_as_sql(spark, tmp_path, "k09_digest_markdown") == 1


def test_file_sizes_round_as_their_sql(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") + 1).alias("doc_id"), F.concat(F.lit("a/b c"), F.col("id")).alias("text"), (F.col("id") * 64).alias("n_chars"))
    rows.unionByName(rows.select("doc_id", "text", (F.col("n_chars") * 1024 * 32).alias("n_chars"))).write.parquet(str(tmp_path / "documents.parquet"))
    assert same_as_sql(spark, tmp_path, "k13_file_names") == 6000


@pytest.mark.parametrize("name", ["h04_meta_tags", "h07_structured_data", "h03_json_ld", "h05_microdata", "h14_gate", "j06_seo_page_audit"])
def test_pages_of_small_rows_are_many_tasks(spark, tmp_path, name):
    part = spark.range(6000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n & "), F.col("id")).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert same_as_sql(spark, tmp_path, name) == 6000


def cards(spark, path, n):
    """Parts of two brands, the last of a page among others of the next, the second brand's all far apart."""
    key = F.when(F.col("id") % 2 == 0, F.col("id") * 20).otherwise(F.col("id") * 6000)
    part = spark.range(n).select(key.alias("p_partkey"), F.concat(F.lit("n & "), F.col("id")).alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 2).alias("p_brand"), F.lit("LARGE").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.5).alias("p_retailprice"))
    part.write.parquet(f"{path}/part.parquet")


def test_no_page_of_a_listing_holds_the_table(spark, tmp_path):
    from harrow.plans import roundtrip

    cards(spark, tmp_path, 2000)
    pages = roundtrip.listing(spark, str(tmp_path)).select(F.length("html").alias("n"))
    assert pages.agg(F.max("n")).first()[0] < 100_000


def test_patterns_of_pages_are_those_of_one_page(spark):
    from harrow.markup import frames as M

    card = lambda k: f"<div class=c><h2><a href=/{k}>t</a></h2>" + ("<p>s</p>" if k % 3 != 1 else "<b>s</b>") + "</div><i class='a b'>x</i>" + ("<em class=e><time>1</time></em>" if k > 9 else "")
    pages = [("".join(card(k) for k in range(a, b)), a) for a, b in ((0, 1), (1, 2), (2, 9), (9, 10), (10, 14))]
    whole = M.with_patterns(spark.createDataFrame([("".join(h for h, _ in pages),)], "html string")).first().patterns
    split = M.listing_patterns(spark.createDataFrame([(1, a, h) for h, a in pages], "key int, page long, html string"), ["key"], "page").first().patterns
    assert len(whole) == 2 and split == whole


@pytest.mark.parametrize("name", ["h18_preview", "h16_patterns", "h17_pagination"])
def test_pages_of_a_listing_give_what_one_page_gave(spark, tmp_path, name):
    cards(spark, tmp_path, 2000)
    assert same_as_sql(spark, tmp_path, name) in (2, 6)


def test_pages_that_links_follow_are_parsed_once(spark, tmp_path):
    orders = spark.range(40_001).select(F.col("id").alias("o_orderkey"), (F.col("id") % 4001).alias("o_custkey"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    plan = registry.QUERIES["h13_paginated"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # the pages were read before the links were followed, not again for each of them
    assert same_as_sql(spark, tmp_path, "h13_paginated") == 24_006


PAGE = (
    "<html lang=en><title>a &amp; b<i></title><meta name=description content='d'><meta property=og:title content=o><meta name=twitter:card content=c><link rel=canonical href=/c>"
    "<script type='application/ld+json'>[{\"a\": 1}, 2]</script><script>x</script><div itemscope itemtype=T><b itemprop=n>v</b><i itemscope itemprop=m>w</i>"
)


@pytest.mark.parametrize("page", [PAGE, PAGE[:-40], "", "<", "<meta name=og:x content=''><html>"])
def test_parts_of_structured_data_are_those_of_the_whole(page):
    from harrow.markup import read

    whole = read.structured(page)
    assert list(whole) == ["json_ld", "open_graph", "twitter_cards", "microdata", "meta"]
    assert all(read.structured(page, [k]) == {k: v} for k, v in whole.items())


@pytest.mark.parametrize(("name", "parts"), [("h07_structured_data", ("json_ld", "meta")), ("h03_json_ld", ("json_ld",)), ("h05_microdata", ("microdata",)), ("h04_meta_tags", ("open_graph", "twitter_cards"))])
def test_only_the_parts_that_are_asked_for_are_read(spark, tmp_path, monkeypatch, name, parts):
    from harrow.markup import frames as M

    part = spark.range(300).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n & "), F.col("id")).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    made, real = [], M.with_structured
    monkeypatch.setattr(M, "with_structured", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    assert same_as_sql(spark, tmp_path, name) == 300
    assert made[0].columns == ["p_partkey", "data"]  # pages do not come back from the reader
    assert tuple(made[0].schema["data"].dataType.names) == parts
