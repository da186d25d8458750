"""Stored JSON of video, forum and photo sites as records. Column -> Column.

A path that a text lacks gives null, or the default named; a text that is no JSON gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import social as S
from harrow.functions import text as X

# The paths that the sites' answers have, hosts, and lengths that are kept.
RUNS = "struct<runs:array<struct<text:string>>>"
SIMPLE = "struct<simpleText:string>"
OWNER = "struct<runs:array<struct<text:string,navigationEndpoint:struct<browseEndpoint:struct<canonicalBaseUrl:string>>>>>"
VIDEO = (
    f"struct<videoId:string,title:{RUNS},thumbnail:struct<thumbnails:array<struct<url:string>>>,lengthText:{SIMPLE},viewCountText:{SIMPLE},"
    f"shortViewCountText:{SIMPLE},ownerText:{OWNER},publishedTimeText:{SIMPLE}>"
)
SEARCH = (
    "contents struct<twoColumnSearchResultsRenderer:struct<primaryContents:struct<sectionListRenderer:struct<contents:"
    f"array<struct<itemSectionRenderer:struct<contents:array<struct<videoRenderer:{VIDEO}>>>>>>>>>"
)
BUTTON = (
    "struct<segmentedLikeDislikeButtonViewModel:struct<likeButtonViewModel:struct<likeButtonViewModel:struct<toggleButtonViewModel:struct<"
    "toggleButtonViewModel:struct<defaultButtonViewModel:struct<buttonViewModel:struct<title:string>>>>>>>>"
)
PRIMARY = (
    f"struct<title:{RUNS},viewCount:struct<videoViewCountRenderer:struct<viewCount:{SIMPLE}>>,dateText:{SIMPLE},"
    f"videoActions:struct<menuRenderer:struct<topLevelButtons:array<{BUTTON}>>>>"
)
SECONDARY = (
    f"struct<owner:struct<videoOwnerRenderer:struct<title:{RUNS},navigationEndpoint:struct<browseEndpoint:struct<canonicalBaseUrl:string>>>>,"
    "attributedDescription:struct<content:string>>"
)
WATCH = (
    "currentVideoEndpoint struct<watchEndpoint:struct<videoId:string>>, contents struct<twoColumnWatchNextResults:struct<results:struct<results:struct<contents:"
    f"array<struct<videoPrimaryInfoRenderer:{PRIMARY},videoSecondaryInfoRenderer:{SECONDARY}>>>>>>"
)
CHANNEL = (
    f"header struct<c4TabbedHeaderRenderer:struct<subscriberCountText:{SIMPLE},badges:array<struct<metadataBadgeRenderer:struct<style:string>>>>,"
    "pageHeaderRenderer:struct<content:struct<pageHeaderViewModel:struct<metadata:struct<contentMetadataViewModel:struct<metadataRows:"
    "array<struct<metadataParts:array<struct<text:struct<content:string>>>>>>>>>>>, "
    "metadata struct<channelMetadataRenderer:struct<title:string,channelUrl:string,description:string,avatar:struct<thumbnails:array<struct<url:string>>>>>"
)
CAPTIONS = "captions struct<playerCaptionsTracklistRenderer:struct<captionTracks:array<struct<languageCode:string,baseUrl:string>>>>"
POST = (
    "struct<id:string,name:string,title:string,permalink:string,author:string,score:bigint,num_comments:bigint,created_utc:double,subreddit:string,selftext:string,"
    "thumbnail:string,is_video:boolean,link_flair_text:string,body_html:string,body:string,replies:string>"
)
LISTINGS = f"array<struct<data:struct<children:array<struct<kind:string,data:{POST}>>>>>"
ABOUT = (
    "data struct<display_name:string,public_description:string,description:string,subscribers:bigint,icon_img:string,community_icon:string,created_utc:double>"
)
COUNT = "struct<count:bigint>"
NODE = (
    f"struct<id:string,shortcode:string,edge_liked_by:{COUNT},edge_media_preview_like:{COUNT},edge_media_to_comment:{COUNT},"
    "edge_media_to_caption:struct<edges:array<struct<node:struct<text:string>>>>,taken_at_timestamp:bigint,is_video:boolean>"
)
USER = (
    f"full_name string, biography string, is_private boolean, is_verified boolean, is_business_account boolean, is_professional_account boolean, business_email string, "
    f"profile_pic_url string, profile_pic_url_hd string, follower_count bigint, following_count bigint, media_count bigint, edge_followed_by {COUNT}, edge_follow {COUNT}, "
    f"edge_owner_to_timeline_media struct<count:bigint,edges:array<struct<node:{NODE}>>>"
)
VIDEOS_AT, FORUM_AT, PHOTOS_AT = "https://www.youtube.com", "https://www.reddit.com", "https://www.instagram.com"
LONG, MEDIUM, SHORT, RECENT = 2000, 1000, 500, 3
NO_PICTURE = ("self", "default")


def filled(c: Column) -> Column:
    """A text, null where it is empty."""
    return F.when(c != "", c)


def either(*cs: Column) -> Column:
    """The first text that is not empty, or an empty one."""
    return F.coalesce(*[filled(c) for c in cs], F.lit(""))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def last(array: Column) -> Column:
    return first(F.slice(array, -1, 1))


def below(host: str, path: Column) -> Column:
    return F.concat(F.lit(host), filled(path))


def watched(video_id: Column) -> Column:
    return F.concat(F.lit(f"{VIDEOS_AT}/watch?v="), F.coalesce(video_id, F.lit("")))


def instant(seconds: Column) -> Column:
    """Seconds of the epoch as a UTC text with milliseconds; 0 is no time."""
    at = F.to_utc_timestamp(F.timestamp_millis((seconds * 1000).cast("long")), F.current_timezone())
    return F.when(seconds != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def search_videos(json: Column, most: int = 20) -> Column:
    """The videos of a search page's data, in order, ``most`` at most: the rows of all sections."""
    sections = F.from_json(json, SEARCH)["contents"]["twoColumnSearchResultsRenderer"]["primaryContents"]["sectionListRenderer"]["contents"]
    items = F.flatten(F.filter(F.transform(sections, lambda s: s["itemSectionRenderer"]["contents"]), lambda x: x.isNotNull()))
    found = F.slice(F.filter(items, lambda i: i["videoRenderer"].isNotNull()), 1, most)

    def row(i: Column) -> Column:
        v = i["videoRenderer"]
        owner = first(v["ownerText"]["runs"])
        return F.struct(
            F.coalesce(v["videoId"], F.lit("")).alias("id"), F.coalesce(first(v["title"]["runs"])["text"], F.lit("")).alias("title"), watched(v["videoId"]).alias("url"),
            last(v["thumbnail"]["thumbnails"])["url"].alias("thumbnail"), v["lengthText"]["simpleText"].alias("duration"),
            S.compact_number(either(v["viewCountText"]["simpleText"], v["shortViewCountText"]["simpleText"])).alias("views"),
            F.coalesce(owner["text"], F.lit("")).alias("author"), below(VIDEOS_AT, owner["navigationEndpoint"]["browseEndpoint"]["canonicalBaseUrl"]).alias("author_url"),
            v["publishedTimeText"]["simpleText"].alias("published"),
        )

    return F.coalesce(F.transform(found, row), F.transform(F.filter(F.array(F.from_json(F.lit("{}"), f"videoRenderer {VIDEO}")), lambda _: F.lit(False)), row))


def video(json: Column) -> Column:
    """The video that a watch page's data tells of; null without the page's contents."""
    return X.once(F.from_json(json, WATCH), _video)


def _video(j: Column) -> Column:
    parts = j["contents"]["twoColumnWatchNextResults"]["results"]["results"]["contents"]
    p = first(F.filter(parts, lambda c: c["videoPrimaryInfoRenderer"].isNotNull()))["videoPrimaryInfoRenderer"]
    s = first(F.filter(parts, lambda c: c["videoSecondaryInfoRenderer"].isNotNull()))["videoSecondaryInfoRenderer"]
    owner, id_ = s["owner"]["videoOwnerRenderer"], j["currentVideoEndpoint"]["watchEndpoint"]["videoId"]
    model = lambda b: b["segmentedLikeDislikeButtonViewModel"]["likeButtonViewModel"]["likeButtonViewModel"]
    likes = F.transform(
        p["videoActions"]["menuRenderer"]["topLevelButtons"], lambda b: model(b)["toggleButtonViewModel"]["toggleButtonViewModel"]["defaultButtonViewModel"]["buttonViewModel"]["title"]
    )
    likes = first(F.filter(likes, lambda t: t != ""))
    row = F.struct(
        F.coalesce(id_, F.lit("")).alias("id"), F.coalesce(F.array_join(F.transform(p["title"]["runs"], lambda r: r["text"]), ""), F.lit("")).alias("title"),
        watched(id_).alias("url"), S.compact_number(p["viewCount"]["videoViewCountRenderer"]["viewCount"]["simpleText"]).alias("views"), S.compact_number(likes).alias("likes"),
        F.coalesce(first(owner["title"]["runs"])["text"], F.lit("")).alias("author"),
        below(VIDEOS_AT, owner["navigationEndpoint"]["browseEndpoint"]["canonicalBaseUrl"]).alias("author_url"), p["dateText"]["simpleText"].alias("published"),
        F.substring(F.coalesce(s["attributedDescription"]["content"], F.lit("")), 1, LONG).alias("description"),
    )
    return F.when(parts.isNotNull(), row)


def channel(json: Column) -> Column:
    """The channel that a channel page's data tells of; null without its metadata."""
    return X.once(F.from_json(json, CHANNEL), _channel)


def _channel(j: Column) -> Column:
    old, m = j["header"]["c4TabbedHeaderRenderer"], j["metadata"]["channelMetadataRenderer"]
    rows = j["header"]["pageHeaderRenderer"]["content"]["pageHeaderViewModel"]["metadata"]["contentMetadataViewModel"]["metadataRows"]
    texts = F.flatten(F.filter(F.transform(rows, lambda r: F.transform(r["metadataParts"], lambda p: p["text"]["content"])), lambda x: x.isNotNull()))
    subscribers = F.coalesce(filled(old["subscriberCountText"]["simpleText"]), first(F.filter(texts, lambda t: t.contains("subscriber"))))
    row = F.struct(
        F.coalesce(m["title"], F.lit("")).alias("name"), F.coalesce(m["channelUrl"], F.lit("")).alias("url"), F.substring(F.coalesce(m["description"], F.lit("")), 1, MEDIUM).alias("description"),
        S.compact_number(subscribers).alias("subscribers"), last(m["avatar"]["thumbnails"])["url"].alias("avatar"),
        F.coalesce(F.exists(old["badges"], lambda b: F.coalesce(b["metadataBadgeRenderer"]["style"].contains("VERIFIED"), F.lit(False))), F.lit(False)).alias("verified"),
    )
    return F.when(m.isNotNull(), row)


def captions_url(json: Column) -> Column:
    """Where a video's captions are: the English ones, or else the first."""
    tracks = F.from_json(json, CAPTIONS)["captions"]["playerCaptionsTracklistRenderer"]["captionTracks"]
    return filled(F.coalesce(first(F.filter(tracks, lambda t: t["languageCode"] == "en")), first(tracks))["baseUrl"])


def post_row(d: Column) -> Column:
    picture = filled(d["thumbnail"])
    return F.struct(
        either(d["id"], d["name"]).alias("id"), F.coalesce(d["title"], F.lit("")).alias("title"), F.coalesce(below(FORUM_AT, d["permalink"]), F.lit("")).alias("url"),
        F.coalesce(filled(d["author"]), F.lit("[deleted]")).alias("author"), F.coalesce(d["score"], F.lit(0)).alias("score"), F.coalesce(d["num_comments"], F.lit(0)).alias("comments_count"),
        instant(d["created_utc"]).alias("published"), filled(d["subreddit"]).alias("subreddit"), F.substring(filled(d["selftext"]), 1, LONG).alias("text"),
        F.when(~picture.isin(*NO_PICTURE), picture).alias("thumbnail"), F.coalesce(d["is_video"], F.lit(False)).alias("is_video"), filled(d["link_flair_text"]).alias("flair"),
    )


def comment_row(d: Column) -> Column:
    return F.struct(
        either(d["id"], d["name"]).alias("id"), F.coalesce(filled(d["author"]), F.lit("[deleted]")).alias("author"),
        either(X.sanitize(F.coalesce(d["body_html"], F.lit(""))), d["body"]).alias("text"), F.coalesce(d["score"], F.lit(0)).alias("score"), instant(d["created_utc"]).alias("published"),
        F.coalesce(F.json_array_length(F.get_json_object(d["replies"], "$.data.children")), F.lit(0)).alias("replies_count"),
    )


def thread_post(json: Column) -> Column:
    """The post of a thread's two listings; null without one."""
    d = first(first(F.from_json(json, LISTINGS))["data"]["children"])["data"]
    return X.once(d, lambda x: F.when(x.isNotNull(), post_row(x)))


def thread_comments(json: Column, most: int = 25) -> Column:
    """The comments of a thread's second listing: entries of kind t1 only, ``most`` at most."""
    children = F.get(F.from_json(json, LISTINGS), F.lit(1))["data"]["children"]
    return F.slice(F.transform(F.filter(children, lambda c: c["kind"] == "t1"), lambda c: comment_row(c["data"])), 1, most)


def forum(json: Column, name: Column) -> Column:
    """What a forum's description tells; null without data. ``name``: the forum's, where the text lacks it."""
    return X.once(F.from_json(json, ABOUT)["data"], lambda d: F.when(d.isNotNull(), F.struct(
        F.coalesce(filled(d["display_name"]), name).alias("name"), F.concat(F.lit(f"{FORUM_AT}/r/"), F.coalesce(filled(d["display_name"]), name)).alias("url"),
        F.substring(either(d["public_description"], d["description"]), 1, MEDIUM).alias("description"), d["subscribers"].alias("subscribers"),
        F.coalesce(filled(d["icon_img"]), filled(F.split(d["community_icon"], "\\?")[0])).alias("avatar"), instant(d["created_utc"]).alias("created"),
    )))


def recent_posts(edges: Column) -> Column:
    """The first three entries of a photo profile's posts; entries without a node are left out."""

    def row(e: Column) -> Column:
        n = e["node"]
        return F.struct(
            either(n["id"], n["shortcode"]).alias("id"), F.coalesce(F.concat(F.lit(f"{PHOTOS_AT}/p/"), filled(n["shortcode"]), F.lit("/")), F.lit("")).alias("url"),
            F.coalesce(n["edge_liked_by"]["count"], n["edge_media_preview_like"]["count"], F.lit(0)).alias("likes"), F.coalesce(n["edge_media_to_comment"]["count"], F.lit(0)).alias("comments"),
            F.substring(X.sanitize(F.coalesce(first(n["edge_media_to_caption"]["edges"])["node"]["text"], F.lit(""))), 1, SHORT).alias("caption"),
            F.coalesce(instant(n["taken_at_timestamp"]), F.lit("")).alias("timestamp"), F.coalesce(n["is_video"], F.lit(False)).alias("is_video"),
        )

    return F.transform(F.filter(F.slice(edges, 1, RECENT), lambda e: e["node"].isNotNull()), row)


def post_engagement(followers: Column, posts: Column) -> Column:
    """Mean of likes and comments a post, as a percentage of the followers, to two places; 0 without either."""
    total = F.aggregate(posts, F.lit(0).cast("long"), lambda acc, p: acc + p["likes"] + p["comments"])
    rate = S.rounded(total / F.size(posts) / followers * 10000) / 100
    return F.when((followers > 0) & (F.size(posts) > 0), rate).otherwise(0.0)


def photo_profile(json: Column, username: Column) -> Column:
    """A photo site's profile from its API or its page's data; null for a private one or a text that is no JSON."""
    return F.when(F.try_parse_json(json).isNotNull(), X.once(F.from_json(json, USER), lambda u: _photo_profile(u, username)))


def _photo_profile(u: Column, username: Column) -> Column:
    followers = F.coalesce(u["edge_followed_by"]["count"], u["follower_count"], F.lit(0))
    posts = F.coalesce(recent_posts(u["edge_owner_to_timeline_media"]["edges"]), recent_posts(F.from_json(F.lit("[]"), f"array<struct<node:{NODE}>>")))
    row = F.struct(
        F.coalesce(filled(u["full_name"]), username).alias("name"), username.alias("username"), F.concat(F.lit(f"{PHOTOS_AT}/"), username, F.lit("/")).alias("url"),
        F.substring(F.coalesce(u["biography"], F.lit("")), 1, MEDIUM).alias("description"), F.coalesce(filled(u["profile_pic_url_hd"]), u["profile_pic_url"]).alias("avatar"),
        F.coalesce(u["is_verified"], F.lit(False)).alias("verified"), followers.alias("followers"), F.coalesce(u["edge_follow"]["count"], u["following_count"], F.lit(0)).alias("following"),
        F.coalesce(u["edge_owner_to_timeline_media"]["count"], u["media_count"], F.lit(0)).alias("posts_count"),
        F.coalesce(u["is_business_account"], u["is_professional_account"], F.lit(False)).alias("is_business"), filled(u["business_email"]).alias("business_email"),
        post_engagement(followers, posts).alias("engagement_rate"), posts.alias("recent_posts"),
    )
    return F.when(~F.coalesce(u["is_private"], F.lit(False)), row)


def photo_profile_of_page(html: Column, username: Column) -> Column:
    """A photo site's profile from a page's description and title; null where it names no followers."""
    described = [F.regexp_extract(html, p, 1) for p in (r'(?i)og:description[^>]*content="([^"]+)"', r"(?i)og:description[^>]*content='([^']+)'", r'(?i)<meta\s+name="description"\s+content="([^"]+)"')]
    return X.once(either(*described), lambda t: _of_page(html, t, username))


def _of_page(html: Column, text: Column, username: Column) -> Column:
    number = lambda what: F.coalesce(S.compact_number(F.regexp_extract(text, rf"(?i)([\d,.]+[KMB]?)\s*{what}", 1)), F.lit(0.0))
    heading = X.trim(F.regexp_replace(F.regexp_extract(html, r"<title>\s*([^<]+)", 1), r"(?i)\s*[•·|]\s*Instagram.*", ""))
    heading = F.when(F.instr(heading, "(@") > 1, X.trim(F.substring_index(heading, "(@", 1))).otherwise(heading)
    bio = F.regexp_replace(F.regexp_extract(text, r"(?i)Posts\s*[-–]\s*(.+)", 1), r"(?i)See Instagram photos and videos from .+$", "")
    bio = X.sanitize(X.trim(F.regexp_replace(X.trim(bio), r"\(@?[\w.]+\)\s*$", "")))
    flag = lambda *keys: X.contains_any(html, [f'"{k}":true' for k in keys])
    row = F.struct(
        F.coalesce(filled(heading), username).alias("name"), username.alias("username"), F.substring(bio, 1, MEDIUM).alias("description"), number("Followers").alias("followers"),
        number("Following").alias("following"), number("Posts").alias("posts_count"), flag("is_verified").alias("verified"),
        flag("is_business_account", "is_professional_account").alias("is_business"),
    )
    return F.when(text.rlike(r"(?i)[\d,.]+[KMB]?\s*Followers"), row)


def _field(v: Column, path: str) -> tuple[Column, Column, Column]:
    """A field of a variant as a text; as a number, a text by its compact form; and as a number only where it is one."""
    text = F.try_variant_get(v, f"$.{path}", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    proper = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{path}", "double"))
    return text, F.coalesce(proper, S.compact_number(text)), proper


def normalised(json: Column, kind: str) -> Column:
    """A record that a model read off a page, with its types put right; null for a text that is no JSON.

    ``kind``: video, post, comment, profile or photos. Numbers may come as numbers or as texts ("1.2K"); a comment without an id gets one from its text, so that a task run
    again gives the same.
    """
    return X.once(F.try_parse_json(json), lambda v: F.when(v.isNotNull(), _normalised(v, json, kind)))


def _normalised(v: Column, json: Column, kind: str) -> Column:
    text, number = (lambda p: _field(v, p)[0]), (lambda p: _field(v, p)[1])
    flag = lambda p: F.coalesce(F.try_variant_get(v, f"$.{p}", "boolean"), F.lit(False))
    full = lambda *ps: either(*[text(p) for p in ps])
    if kind == "video":
        return F.struct(*[full(p).alias(p) for p in ("id", "title", "url", "author")], *[text(p).alias(p) for p in ("thumbnail", "duration", "author_url", "published")],
                        number("views").alias("views"), number("likes").alias("likes"), F.substring(text("description"), 1, LONG).alias("description"))
    if kind == "post":
        return F.struct(*[full(p).alias(p) for p in ("id", "title", "url", "author")], *[text(p).alias(p) for p in ("published", "subreddit", "text", "flair")],
                        number("score").alias("score"), number("comments_count").alias("comments_count"))
    if kind == "comment":
        proper, given = (lambda p: _field(v, p)[2]), filled(text("score"))
        score = F.coalesce(proper("score"), proper("likes"), F.when(given.isNotNull(), number("score")).otherwise(number("likes")))
        id_ = F.coalesce(filled(text("id")), F.concat(F.lit("comment-"), F.substring(F.sha2(json, 256), 1, 6)))
        return F.struct(id_.alias("id"), full("author").alias("author"), full("text").alias("text"), score.alias("score"), text("published").alias("published"))
    if kind == "profile":
        subscribers = F.when(F.coalesce(filled(text("subscribers")), F.lit("0")) != "0", number("subscribers")).otherwise(number("followers"))
        return F.struct(full("name", "username").alias("name"), full("url").alias("url"), F.substring(text("description"), 1, MEDIUM).alias("description"), subscribers.alias("subscribers"),
                        text("avatar").alias("avatar"), flag("verified").alias("verified"), number("video_count").alias("video_count"), text("created").alias("created"))
    page = F.concat(F.lit(f"{PHOTOS_AT}/"), filled(text("username")), F.lit("/"))
    count = lambda p: F.coalesce(number(p), F.lit(0.0))
    return F.struct(full("full_name", "username").alias("name"), full("username").alias("username"), F.coalesce(filled(text("url")), page, F.lit("")).alias("url"),
                    F.substring(text("bio"), 1, MEDIUM).alias("description"), flag("is_verified").alias("verified"), *[count(p).alias(p) for p in ("followers", "following", "posts_count")],
                    flag("is_business").alias("is_business"), filled(text("business_email")).alias("business_email"), F.lit(0.0).alias("engagement_rate"))
