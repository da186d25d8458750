"""Records, reports and small rules on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from harrow.functions import expr as E
from harrow.functions import records as R
from harrow.operators import changes, classify, creators, sinks


def read(spark, value, f):
    """``f`` of a text, of null and of what is no JSON."""
    rows = [(value if isinstance(value, str) else json.dumps(value),), (None,), ("no json",)]
    return [r["v"] for r in spark.createDataFrame(rows, "j string").select(f(F.col("j")).alias("v")).collect()]


def test_search_videos_of_all_sections(spark):
    v = {"videoRenderer": {"videoId": "a", "title": {"runs": [{"text": "T"}]}, "thumbnail": {"thumbnails": [{"url": "1"}, {"url": "2"}]}, "shortViewCountText": {"simpleText": "1.5K views"}}}
    sections = [{"itemSectionRenderer": {"contents": [{"advert": 1}, v]}}, {"other": 1}, {"itemSectionRenderer": {"contents": [v, v]}}]
    data = {"contents": {"twoColumnSearchResultsRenderer": {"primaryContents": {"sectionListRenderer": {"contents": sections}}}}}
    found, none, bad = read(spark, data, lambda j: R.search_videos(j, 2))
    assert none == bad == [] and len(found) == 2
    assert found[0].views == 1500 and found[0].thumbnail == "2" and found[0].author == "" and found[0].author_url is None


def test_channel_and_captions(spark):
    assert read(spark, {"header": {}}, R.channel) == [None] * 3
    row = read(spark, {"metadata": {"channelMetadataRenderer": {"title": "C", "description": "d" * 1500}}}, R.channel)[0]
    assert row.name == "C" and len(row.description) == 1000 and row.subscribers is None and row.verified is False
    tracks = {"captions": {"playerCaptionsTracklistRenderer": {"captionTracks": [{"languageCode": "de", "baseUrl": "d"}]}}}
    assert read(spark, tracks, R.captions_url) == ["d", None, None]


def test_thread(spark):
    post = {"id": "p", "permalink": "/r/x/p/", "created_utc": 1700000000, "thumbnail": "self", "replies": ""}
    comments = [{"kind": "t1", "data": {"name": "n", "body_html": "<p>a &amp; b</p>", "replies": {"data": {"children": [{}, {}]}}}}, {"kind": "more"}, {"kind": "t1", "data": {"id": "i", "body": "B", "replies": ""}}]
    data = [{"data": {"children": [{"kind": "t3", "data": post}]}}, {"data": {"children": comments}}]
    p = read(spark, data, R.thread_post)[0]
    assert (p.url, p.author, p.published, p.thumbnail) == ("https://www.reddit.com/r/x/p/", "[deleted]", "2023-11-14T22:13:20.000Z", None)
    assert [(c.id, c.text, c.replies_count) for c in read(spark, data, R.thread_comments)[0]] == [("n", "a & b", 2), ("i", "B", 0)]
    assert read(spark, [], R.thread_post) == [None] * 3


def test_photo_profiles(spark):
    of = lambda j: R.photo_profile(j, F.lit("me"))
    edges = [{"node": {"shortcode": "s", "edge_liked_by": {"count": 10}, "edge_media_to_comment": {"count": 5}}}, {"node": None}, {"node": {"id": "2"}}, {"node": {"id": "4"}}]
    p = read(spark, {"edge_followed_by": {"count": 1000}, "edge_owner_to_timeline_media": {"count": 9, "edges": edges}}, of)[0]
    assert (p.name, p.engagement_rate, [x.id for x in p.recent_posts]) == ("me", 0.75, ["s", "2"])
    assert read(spark, {"is_private": True}, of) == [None] * 3
    assert read(spark, {}, of)[0].engagement_rate == 0
    assert read(spark, '<meta name="description" content="only words">', lambda h: R.photo_profile_of_page(h, F.lit("me"))) == [None] * 3


def test_normalised_numbers(spark):
    of = lambda kind: (lambda j: R.normalised(j, kind))
    assert [r and (r.views, r.likes) for r in read(spark, {"views": "1.2K", "likes": 0}, of("video"))] == [(1200, 0), None, None]
    assert read(spark, {"score": "5", "likes": 3}, of("comment"))[0].score == 3
    assert read(spark, {"score": "5"}, of("comment"))[0].score == 5
    assert read(spark, {"text": "x"}, of("comment"))[0].id == read(spark, {"text": "x"}, of("comment"))[0].id != ""
    assert read(spark, {"subscribers": "", "followers": "3K"}, of("profile"))[0].subscribers == 3000
    assert read(spark, {"username": "u", "followers": "none"}, of("photos"))[0].followers == 0


@pytest.fixture(scope="module")
def profiles(spark):
    form = "handle string, name string, tier string, reach int, conversion int, partnership int, subscribers long, ig_followers long, engagement_rate double, niche_depth string, views_per_sub double, likes_per_view double, view_consistency int, youtube_url string, instagram_url string, email string, website string, business boolean"
    rows = [
        ("b", "B", "SILVER", 60, 60, 10, 1500, None, 0.0, "MIXED", 0.5, None, 50, "y", None, None, None, True),
        ("a", "A", "SILVER", 60, 60, 40, 0, 2_000_000, 2.26, None, None, 0.01, None, None, "i", None, "w", False),
        ("c", "C", "GOLDEN", 60, 60, 60, 999, None, None, "SPECIALIST", 1.0, 0.0, 0, None, None, "e", "w", True),
    ]
    return spark.createDataFrame(rows, form)


def test_report_order_and_cells(profiles):
    csv = [r["line"] for r in creators.report_csv(profiles).collect()]
    assert csv == ["c,C,GOLDEN,60,60,60,999,,,SPECIALIST,1,0,0,,,e", "a,A,SILVER,60,60,40,,2000000,2.3,,,0.01,,,i,", "b,B,SILVER,60,60,10,1500,,0.0,MIXED,0.5,,50,y,,"]
    shown = [r["line"] for r in creators.report_markdown(profiles).collect()]
    assert shown[1] == "| 🥈 SILVER | a | - | 2.0M | 2.3% | - | - | 0.010 | - | 60 | 60 | 40 | 🌐 |"
    assert shown[2] == "| 🥈 SILVER | b | 1.5K | - | - | MIXED | 0.50 | - | 50 | 60 | 60 | 10 | 💼 |"
    assert creators.tier_counts(profiles).first().asDict() == {"total_found": 3, "golden": 1, "silver": 2, "bronze": 0, "unranked": 0}


def test_scout_gates(spark):
    form = "id string, subscribers long, niche_depth string, likes_per_view double, views_per_sub double, view_consistency int, email string, collab boolean, business boolean, posting_frequency string, ig_followers long"
    rows = [("in", 20_000, "SPECIALIST", 0.1, 0.6, 100, "e", True, True, "weekly", 10), ("general", 20_000, "GENERALIST", 0.1, 0.6, 100, "e", True, True, "weekly", 10), ("small", None, "MIXED", 0.1, 0.6, 100, None, None, None, None, None)]
    out = {r["id"]: r for r in creators.scouted(spark.createDataFrame(rows, form), 0, 50_000, 60).collect()}
    assert set(out) == {"in", "small"}
    assert [out["in"][c] for c in ("reach", "conversion", "partnership", "tier")] == [100, 100, 100, "GOLDEN"]
    assert [out["small"][c] for c in ("conversion", "partnership")] == [0, 60]


def test_templates(spark):
    text = "{{input: a }} {{input:b}} {{input:c}} {{env:HOME}} {{computed:year}} {{computed:else}}"
    row = spark.createDataFrame([(text,)], "t string").select(
        E.template(F.col("t"), F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2")), E.computed_values(F.lit("2024-03-01 00:30:00").cast("timestamp"))).alias("v"),
        E.computed_values(F.lit("2024-03-01 00:30:00").cast("timestamp")).alias("c"),
    )
    v, c = row.first()
    assert v == "1 2 {{input:c}} {{env:HOME}} 2024 {{computed:else}}"
    assert c["date_yesterday"] == "2024-02-29" and c["timestamp_iso"] == "2024-03-01T00:30:00.000Z" and len(c["random_string"]) == 8 and len(c) == 10


def test_captcha_needs_a_key(spark):
    key = "k" * 40
    pages = ['<div class="cf-turnstile">', "<div data-sitekey='x' class='cf-turnstile'>", f'{{"sitekey": "{key}"}} "size":"invisible"', None, ""]
    got = [r["c"] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(classify.captcha(F.col("h")).alias("c")).collect()]
    assert [(c.kind, c.sitekey, c.action) for c in got] == [(None, None, None), ("turnstile", "x", None), ("recaptcha_v3", key, "verify"), (None, None, None), (None, None, None)]


def test_payloads_and_pretty_json(spark):
    rows = spark.sql("SELECT 'u' AS url, timestamp'2024-01-01' + make_interval(0, 0, 0, id) AS ts, if(id < 2, 'a', 'b') AS body FROM range(3)")
    got = [json.loads(r["payload"]) for r in changes.change_payloads(changes.watch(rows, "url", ["ts"], "body"), "url", "ts").collect()]
    assert len(got) == 1 and got[0]["event"] == "watch.change" and got[0]["previous_hash"] != got[0]["current_hash"] and got[0]["diff"] is None
    value = {"a": 'x" : y\\', "b": None, "c": {"d": 1}}
    made = spark.createDataFrame([(value["a"], None, (1,))], "a string, b string, c struct<d:int>")
    assert sinks.pretty_json(made).first()["text"] == json.dumps(value, indent=2)


def test_discovered_first_name_wins(spark):
    a = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "id int, name string, at int")
    b = spark.createDataFrame([(2, "late", 0), (3, "c", 0), (None, "n", 5)], "id int, name string, at int")
    assert [tuple(r) for r in creators.discovered([a, b], "id", "name", "at", 3).collect()] == [(2, "b"), (1, "a"), (3, "c")]


def test_extracted_keeps_errors_to_their_text(spark):
    from harrow.operators import recipes

    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return ['{"n": %d}' % len(x) if x != "words" else "none" for x in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "words"), (5, "x" * 99), (6, "")], "id int, t string").repartition(1)
    got = {r["id"]: r["extracted"] for r in recipes.extracted(rows, "t", model, "n int", most=10).collect()}
    assert (got[1].value.n, got[1].error) == (3, None) and got[2].error == "ValueError: no" and got[3] is None
    assert got[4].error == "no JSON in the answer" and (got[5].value.n, got[5].truncated) == (10, True) and got[6].value.n == 0


def test_seo_audit_of_empty_pages(spark):
    from harrow.operators import recipes

    rows = spark.createDataFrame([("a", ""), ("b", None), ("c", "<title>x")], "url string, html string")
    got = {r["url"]: r for r in recipes.seo_page_audit(rows).collect()}
    assert len(got) == 3 and got["a"].title is None and got["b"].h1 is None and got["c"].title == "x"


def test_snapshot_without_a_mark_is_not_seen(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, root)
    for v in (9, 10):
        sinks.write_snapshot(spark.range(v), root, v)
    assert sinks.read_snapshot(spark, root).count() == 10
    (tmp_path / "state" / "v=10" / "_SUCCESS").unlink()
    assert sinks.read_snapshot(spark, root).count() == 9
