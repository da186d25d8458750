"""URL functions, Column -> Column. All are built-in expressions, so they stay in generated code and push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import text as X

# Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref",
    "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "hsa_cam", "hsa_grp", "hsa_mt", "hsa_src", "hsa_ad", "hsa_acc", "hsa_net", "hsa_ver",
    "hsa_la", "hsa_ol", "hsa_kw", "mc_cid", "mc_eid", "s_kwcid", "ef_id", "ref", "_ref", "ref_", "source", "click_id", "campaign_id", "_ga", "_gl",
    "_hsenc", "_hsmi", "_openstat", "yclid", "wickedid",
)
# File endings of media, and first path parts that are no profiles.
MEDIA = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".avif", ".mp4", ".webm", ".mov", ".avi", ".mkv", ".mp3", ".wav", ".ogg", ".flac")
NO_PROFILE = (
    "explore", "accounts", "about", "legal", "privacy", "terms", "developer", "reels", "stories", "p", "reel", "tv", "direct", "directory", "web",
    "challenge", "emails", "session", "nametag", "lite", "ar", "creators", "branded_content", "shopping",
)

#: scheme, host, port, path, query of an absolute URL
PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def port(url: Column) -> Column:
    """The port that is not the scheme's own, else ''."""
    p = part(url, 3)
    own = F.when(scheme(url) == "https", "443").when(scheme(url) == "http", "80").otherwise("")
    return F.when(p == own, "").otherwise(p)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what would leave the root stays at it."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    closed = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), closed)).otherwise(path)


def path(url: Column) -> Column:
    p = part(url, 4)
    return F.when(p == "", "/").otherwise(without_dots(p))


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(PARTS), F.lit(False))


def with_scheme(url: Column) -> Column:
    trimmed = F.trim(url)
    return F.when(trimmed.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), trimmed).when(trimmed.startswith("//"), F.concat(F.lit("https:"), trimmed)).otherwise(F.concat(F.lit("https://"), trimmed))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no user, www., own port, dot segments, fragment, tracking parameters or closing slash; parameters sorted."""
    u = with_scheme(url)
    p = F.regexp_replace(without_dots(part(u, 4)), "/{2,}", "/")
    shown = F.when(p == "/", "/").otherwise(F.regexp_replace(p, "/$", ""))
    params = F.array_sort(F.filter(F.split(part(u, 5), "&"), lambda x: (x != "") & ~F.split(x, "=")[0].isin(*TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    at = F.when(port(u) != "", F.concat(F.lit(":"), port(u))).otherwise("")
    return F.when(u.rlike(PARTS), F.concat(scheme(u), F.lit("://"), F.regexp_replace(host(u), r"^www\.", ""), at, shown, query))


def origin(url: Column) -> Column:
    """scheme://host[:port], null for what is no URL."""
    return F.when(is_valid(url), F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise("")))


def domain(url: Column) -> Column:
    """The host; the string itself where there is none."""
    return F.when(is_valid(url), host(url)).otherwise(url)


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def has_tracking(url: Column) -> Column:
    return is_valid(url) & F.exists(F.split(part(url, 5), "&"), lambda x: F.lower(F.split(x, "=")[0]).isin(*TRACKING))


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for ``href``, without dot segments in its path."""
    root = origin(base)
    folder = F.regexp_replace(path(base), "[^/]*$", "")

    def flat(target: Column) -> Column:
        return F.concat(without_dots(F.regexp_extract(target, r"^([^?#]*)", 1)), F.regexp_extract(target, r"^[^?#]*(.*)$", 1))

    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, flat(href)))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("#"), F.concat(root, path(base), href))
        .otherwise(F.concat(root, flat(F.concat(folder, href))))
    )


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def circuit_key(url: Column) -> Column:
    """Host and the first two path segments."""
    return F.concat(host(url), F.lit("/"), F.array_join(F.slice(segments(url), 1, 2), "/"))


def parent_domain(name: Column) -> Column:
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) > 2, F.regexp_replace(name, r"^[^.]*\.", ""))


def allowed(name: Column, patterns: list[str]) -> Column:
    """The host is one of ``patterns``, or under one that starts with ``*.`` (or is its suffix)."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | ((name == p[2:]) | name.endswith(p[1:]) if p.startswith("*.") else name == p)
    return hit


def kind(url: Column) -> Column:
    h, ending = host(url), F.lower(F.regexp_extract(part(url, 4), r"(\.[^./]+)$", 1))
    return (
        F.when(~is_valid(url), "webpage").when(h.contains("youtube.com") | h.contains("youtu.be"), "youtube").when(h.contains("tiktok.com"), "tiktok")
        .when(ending.isin(*MEDIA), "direct-media").otherwise("webpage")
    )


def video_id(text: Column) -> Column:
    u = F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))
    bare = F.when(text.rlike("^[A-Za-z0-9_-]{11}$"), text)
    found = (
        F.when(host(u).contains("youtu.be"), F.substring(part(u, 4), 2, 1000))
        .when(part(u, 4).startswith("/shorts/"), F.get(F.split(part(u, 4), "/"), F.lit(2)))
        .when(F.regexp_extract(part(u, 5), "(?:^|&)v=([^&]*)", 1) != "", F.regexp_extract(part(u, 5), "(?:^|&)v=([^&]*)", 1))
    )
    return F.coalesce(F.when(is_valid(u), found), bare)


def profile_handle(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"instagram\.com/([a-zA-Z0-9_.]{1,30})/?(?:\?|$|#|/)", 1))
    return F.when((found != "") & ~found.isin(*NO_PROFILE), found)


def slug(text: Column, size: int = 40) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)
    return F.when(made == "", "topic").otherwise(made)


def url_hash(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def query_string(pairs: Column) -> Column:
    """An array of (key, value) structs as a query string."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")


def file_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9._-]", "-"), "-+", "-"), "^-|-$", ""), 1, 200)


def file_size(n: Column) -> Column:
    steps = (("B", 1), ("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30))
    out = F.concat(X.fixed(n / steps[3][1], 1), F.lit("GB"))
    out = F.when(n < 1 << 30, F.concat(X.fixed(n / steps[2][1], 1), F.lit("MB"))).otherwise(out)
    out = F.when(n < 1 << 20, F.concat(X.fixed(n / steps[1][1], 1), F.lit("KB"))).otherwise(out)
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit("B"))).otherwise(out)
