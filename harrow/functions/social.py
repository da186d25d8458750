"""Numbers, times and scores of creators' records. Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of a unit, multipliers of a suffix, weights of the three scores, greatest raw points.
UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000, "year": 31_536_000_000}
SUFFIXES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
WEIGHTS = {
    "reach": {"audience_size": 25, "engagement_rate": 20, "niche_relevance": 15, "multi_platform": 15, "consistency": 10, "frequency": 8, "contact": 5, "collab_signals": 2},
    "conversion": {"engagement_rate": 30, "niche_relevance": 25, "consistency": 15, "contact": 10, "collab_signals": 8, "frequency": 5, "audience_size": 5, "multi_platform": 2},
    "partnership": {"niche_relevance": 20, "engagement_rate": 20, "contact": 15, "collab_signals": 15, "consistency": 12, "frequency": 8, "audience_size": 5, "multi_platform": 5},
}
MOST = {"audience_size": 25, "engagement_rate": 20, "niche_relevance": 15, "multi_platform": 15, "consistency": 10, "frequency": 8, "contact": 5, "collab_signals": 2}
SOCIAL_HOSTS = ("youtube", "instagram", "twitter", "facebook", "tiktok")


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def compact_number(text: Column) -> Column:
    """"1.2M" -> 1200000.0; a suffix counts by its first letter; 0 and what is no number give null."""
    clean = F.regexp_replace(text, r"[,\s+]", "")
    n = F.regexp_extract(clean, r"^([\d.]+)\s*[KMBTkmbt]", 1)
    suffix = F.upper(F.regexp_extract(clean, r"^[\d.]+\s*([KMBTkmbt])", 1))
    plain = F.regexp_extract(clean, r"^(-?\d*\.?\d+)", 1).try_cast("double")
    return F.when(n != "", rounded(F.regexp_extract(n, r"^(\d*\.?\d*)", 1).try_cast("double") * lookup(SUFFIXES, suffix)).cast("double")).otherwise(F.when(plain != 0, plain))


def relative_time(text: Column, now: Column) -> Column:
    """Epoch milliseconds of "3 hours ago" before ``now`` (epoch ms)."""
    pattern = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
    n, unit = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(n != "", now - n.try_cast("long") * lookup(UNITS, unit))


def followers(snippet: Column) -> Column:
    pattern = r"(?i)([\d,.]+)\s*([KMB])?\s*followers"
    n, suffix = F.regexp_extract(snippet, pattern, 1), F.upper(F.regexp_extract(snippet, pattern, 2))
    return F.when(n != "", rounded(F.replace(n, F.lit(","), F.lit("")).try_cast("double") * F.coalesce(lookup(SUFFIXES, suffix), F.lit(1.0))))


def handles(text: Column) -> Column:
    first = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:instagram|ig|insta)\b[:\s]*@?(\w[\w.]{2,29})"), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(r"(?i)instagram\.com/(\w[\w.]{2,29})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(first, second), F.lower), lambda h: ~h.isin("com", "www")))


def contact(text: Column) -> Column:
    """(email, website, business, collab); websites on the social hosts themselves don't count."""
    links = F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s\"'<>]+)"), F.lit(1))
    own = F.filter(links, lambda u: ~F.lower(u).rlike(rf"^https?://(?:www\.)?(?:{'|'.join(SOCIAL_HOSTS)})\.com"))
    email = F.regexp_extract(text, r"[\w.+-]+@[\w-]+\.[\w.]+", 0)
    return F.struct(
        F.when(email != "", email).alias("email"), F.get(own, F.lit(0)).alias("website"), text.rlike("(?i)business|collab|partner|sponsor|inquir").alias("business"),
        text.rlike("(?i)collab|partner|sponsor|brand|work with").alias("collab"),
    )


def engagement(views: Column, likes: Column, subscribers: Column) -> Column:
    v, l = F.coalesce(views, F.lit(0.0)), F.coalesce(likes, F.lit(0.0))
    return F.when(F.coalesce(subscribers, F.lit(0.0)) == 0, 0.0).when((l != 0) & (v != 0), l / v * 100).when(l != 0, l / subscribers * 100).when(v != 0, v / subscribers * 100).otherwise(0.0)


def criterion(name: str) -> Column:
    """Raw points of a criterion from a profile's columns."""
    c, zero = F.col, F.lit(0.0)
    if name == "audience_size":
        n = F.coalesce(c("subscribers"), zero) + F.coalesce(c("ig_followers"), zero)
        return F.when(n >= 100_000, 10).when(n >= 10_000, 25).when(n >= 1_000, 15).otherwise(5)
    if name == "engagement_rate":
        e = F.coalesce(c("engagement_rate"), zero)
        return F.when(e > 8, 20).when(e > 5, 16).when(e > 3, 12).when(e > 1, 8).otherwise(4)
    if name == "niche_relevance":
        return rounded(F.coalesce(c("niche_match_pct"), zero) / 100 * 15)
    if name == "multi_platform":
        return F.when(c("platform_count") >= 3, 15).when(c("platform_count") >= 2, 10).otherwise(5)
    if name == "consistency":
        return rounded(F.when(F.coalesce(c("niche_match_pct"), zero) == 0, 50.0).otherwise(c("niche_match_pct")) / 100 * 10)
    if name == "frequency":
        return F.when(c("posting_frequency") == "weekly", 8).when(c("posting_frequency") == "biweekly", 5).when(c("posting_frequency") == "monthly", 3).otherwise(0)
    if name == "contact":
        return F.when(c("email").isNotNull(), 5).when(c("website").isNotNull(), 3).when(c("business"), 2).otherwise(0)
    return F.when(c("collab"), 1).otherwise(0) + F.when(c("business"), 1).otherwise(0)


def score(kind: str) -> Column:
    weights = WEIGHTS[kind]
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + criterion(name) / F.lit(float(MOST[name])) * w
    return rounded(total / sum(weights.values()) * 100)


def tier(scores: list[Column], threshold: float) -> Column:
    n = sum(F.when(s >= threshold, 1).otherwise(0) for s in scores)
    return F.when(n >= 3, "GOLDEN").when(n >= 2, "SILVER").when(n >= 1, "BRONZE").otherwise("UNRANKED")


def frequency(published: Column) -> Column:
    """From the "N units ago" texts of the last videos."""
    recent = F.exists(published, lambda p: F.lower(p).rlike("day|hour|minute"))
    weekly = F.exists(published, lambda p: F.lower(p).contains("week"))
    return F.when(F.size(published) == 0, "inactive").when(recent & (F.size(published) >= 3), "weekly").when(weekly, "biweekly").otherwise("monthly")


def niche_depth(titles: Column, words: list[str]) -> Column:
    first = F.slice(titles, 1, 5)
    hit = F.size(F.filter(first, lambda t: F.lower(t).rlike("|".join(f"\\Q{w.lower()}\\E" for w in words))))
    n = F.size(first)
    return F.when(n == 0, "GENERALIST").when((hit >= 4) | ((n <= 3) & (hit == n)), "SPECIALIST").when(hit >= F.ceil(n * 0.5), "MIXED").otherwise("GENERALIST")


def niche_match(texts: Column, words: list[str]) -> Column:
    every = F.lower(F.array_join(texts, " "))
    n = sum(F.when(every.contains(w.lower()), 1).otherwise(0) for w in words)
    return F.when(F.size(texts) == 0, 50).otherwise(rounded(n / len(words) * 100))


def view_consistency(n: Column, mean: Column, deviation: Column) -> Column:
    """100 for equal views, 0 where they vary by twice their mean (population deviation)."""
    return F.when(n < 2, 50).when(mean == 0, 0).otherwise(rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - deviation / mean / 2) * 100))))


def content_score(likes_per_view: Column, views_per_sub: Column, depth: Column, consistency: Column) -> Column:
    a = F.when(likes_per_view >= 0.08, 25).when(likes_per_view >= 0.05, 20).when(likes_per_view >= 0.03, 15).when(likes_per_view >= 0.01, 8).otherwise(0)
    b = F.when(views_per_sub >= 0.5, 25).when(views_per_sub >= 0.3, 20).when(views_per_sub >= 0.15, 15).when(views_per_sub >= 0.05, 8).otherwise(0)
    return a + b + F.when(depth == "SPECIALIST", 30).when(depth == "MIXED", 15).otherwise(0) + rounded(F.coalesce(consistency, F.lit(0)) / 100 * 20)


def partnership_ready(email: Column, collab: Column, business: Column, frequency: Column, photo_followers: Column) -> Column:
    """How ready a creator is for a partnership, 0 to 100."""
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    regular = F.when(frequency == "weekly", 20).when(frequency == "biweekly", 10).otherwise(0)
    return F.least(F.lit(100), points(email != "", 30) + points(collab, 20) + points(business, 15) + regular + points(photo_followers > 0, 15))


def reach_and_trust(subscribers: Column, platforms: Column, views_per_sub: Column, consistency: Column) -> Column:
    """Audience, platforms, and how true the views are to the audience, 0 to 100."""
    size = F.when(subscribers >= 10_000, 25).when(subscribers >= 1_000, 15).otherwise(5)
    true = F.when(views_per_sub >= 0.15, 25).when(views_per_sub >= 0.05, 15).otherwise(0)
    return F.least(F.lit(100), size + F.when(platforms >= 2, 20).otherwise(0) + true + rounded(F.coalesce(consistency, F.lit(0)) / 100 * 30))


def seconds_text(s: Column) -> Column:
    """m:ss, without hours."""
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("int").cast("string"), 2, "0"))


def chapters(text: Column) -> Column:
    """An array of (seconds, title) from lines that start with a time."""
    pattern = r"(?m)^\s*((?:\d{1,2}:)?\d{1,2}:\d{2})[ \t]+-?[ \t]*(.+?)[ \t]*$"
    times, titles = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    secs = lambda t: F.aggregate(F.split(t, ":"), F.lit(0), lambda acc, x: acc * 60 + x.cast("int"))
    return F.zip_with(times, titles, lambda t, n: F.struct(secs(t).alias("seconds"), n.alias("title")))
