"""Creators' profiles: the scout's gates and scores, and reports in order of tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import social as S

# Tiers from the best, their marks, and a report's columns.
TIERS = {"GOLDEN": "🥇", "SILVER": "🥈", "BRONZE": "🥉", "UNRANKED": "⬜"}
CSV_HEADER = (
    "handle,name,tier,reach,conversion,partnership,subscribers,ig_followers,engagement_rate,niche_depth,views_per_sub,likes_per_view,view_consistency,"
    "youtube_url,instagram_url,email"
)
MARKDOWN_HEADER = "| Tier | Handle | Subscribers | IG Followers | Engagement | Niche | V/Sub | L/View | Consist | Reach | Conv | Partner | Contact |"
MARKDOWN_RULE = "|------|--------|-------------|-------------|-----------|-------|-------|--------|---------|-------|------|---------|--------|"


def average() -> Column:
    return (F.col("reach") + F.col("conversion") + F.col("partnership")) / 3


def discovered(sources: list[DataFrame], key: str, name: str, order: str, most: int) -> DataFrame:
    """(key, name): the channels that several searches found, each once under the name that came first, the first ``most`` of them.

    A source comes before those after it; within one, ``order`` tells.
    """
    each = [s.select(key, name, F.struct(F.lit(i).alias("source"), F.col(order).alias("place")).alias("__at")) for i, s in enumerate(sources)]
    every = each[0]
    for s in each[1:]:
        every = every.unionByName(s)
    once = every.groupBy(key).agg(F.min_by(name, "__at").alias(name), F.min("__at").alias("__at"))
    return once.orderBy("__at", key).limit(most).drop("__at")


def enriched(channels: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Channels with what is known of them; what their own columns hold stays, unknown channels keep nulls."""
    return channels.join(facts.select(key, *[c for c in facts.columns if c != key and c not in channels.columns]), key, "left")


def scouted(channels: DataFrame, least: float, most: float, threshold: float) -> DataFrame:
    """Channels of a size within bounds that keep to a niche, scored by content, readiness and reach, and ranked by tier.

    Columns: subscribers, niche_depth, likes_per_view, views_per_sub, view_consistency, email, collab, business,
    posting_frequency, ig_followers (null: none found). No subscribers count as 0.
    """
    sized = channels.withColumn("subscribers", F.coalesce("subscribers", F.lit(0))).where(F.col("subscribers").between(least, most) & (F.col("niche_depth") != "GENERALIST"))
    platforms = F.when(F.col("ig_followers") > 0, 2).otherwise(1)
    thousandths = lambda c: S.rounded(F.col(c) * 1000) / 1000
    content = S.content_score(thousandths("likes_per_view"), thousandths("views_per_sub"), F.col("niche_depth"), F.col("view_consistency"))
    out = sized.withColumn("platform_count", platforms).withColumn("reach", F.least(F.lit(100), content))
    out = out.withColumn("conversion", S.partnership_ready(*[F.col(c) for c in ("email", "collab", "business", "posting_frequency", "ig_followers")]))
    out = out.withColumn("partnership", S.reach_and_trust(*[F.col(c) for c in ("subscribers", "platform_count", "views_per_sub", "view_consistency")]))
    return out.withColumn("tier", S.tier([F.col(c) for c in ("reach", "conversion", "partnership")], threshold))


def ranked(profiles: DataFrame) -> DataFrame:
    """By tier, then by the mean of the three scores, then by handle. A sort by ranges: no task holds all profiles."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return profiles.orderBy(place, average().desc(), "handle")


def _number(c: str) -> Column:
    """A number as scripts print it: whole ones without a fraction."""
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def _nonzero(c: str) -> Column:
    return F.when(F.col(c) != 0, _number(c))


def report_csv(profiles: DataFrame) -> DataFrame:
    """(handle, line) in order; the header is ``CSV_HEADER``. Cells are joined as they are, missing ones empty."""
    cells = [
        F.col("handle"), F.col("name"), F.col("tier"), *[_number(c) for c in ("reach", "conversion", "partnership")], _nonzero("subscribers"), _nonzero("ig_followers"),
        F.format_string("%.1f", F.col("engagement_rate").cast("double")), F.col("niche_depth"), *[_number(c) for c in ("views_per_sub", "likes_per_view", "view_consistency")],
        F.col("youtube_url"), F.col("instagram_url"), F.col("email"),
    ]
    cells[8] = F.when(F.col("engagement_rate").isNotNull(), cells[8])
    return ranked(profiles).select("handle", F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells]).alias("line"))


def short_number(c: Column) -> Column:
    """1234567 -> 1.2M."""
    shown = lambda unit, mark: F.concat(F.format_string("%.1f", c / unit), F.lit(mark))
    return F.when(c >= 1_000_000, shown(1e6, "M")).when(c >= 1_000, shown(1e3, "K")).otherwise(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def report_markdown(profiles: DataFrame) -> DataFrame:
    """(handle, line): a table's rows in order; its head is ``markdown_head``."""
    c = F.col
    fixed = lambda name, form: F.when(c(name).isNotNull(), F.format_string(form, c(name).cast("double")))
    badge = F.concat(S.lookup(TIERS, c("tier")), F.lit(" "), c("tier"))
    contact = F.when(c("email") != "", "📧").when(c("website") != "", "🌐").when(c("business"), "💼")
    cells = [
        badge, c("handle"), F.when(c("subscribers") != 0, short_number(c("subscribers"))), F.when(c("ig_followers") != 0, short_number(c("ig_followers"))),
        F.when(c("engagement_rate") != 0, F.concat(F.format_string("%.1f", c("engagement_rate").cast("double")), F.lit("%"))), c("niche_depth"), fixed("views_per_sub", "%.2f"),
        fixed("likes_per_view", "%.3f"), _number("view_consistency"), *[_number(s) for s in ("reach", "conversion", "partnership")], contact,
    ]
    return ranked(profiles).select("handle", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(x, F.lit("-")) for x in cells]), F.lit(" |")).alias("line"))


def markdown_head(niche: str, workflow: str, threshold: float, found: int) -> str:
    return f"# Influencer Discovery: {niche}\n\n**Workflow**: {workflow} | **Threshold**: {threshold:g} | **Found**: {found}\n\n{MARKDOWN_HEADER}\n{MARKDOWN_RULE}\n"


def tier_counts(profiles: DataFrame) -> DataFrame:
    """One row: how many were found, and of each tier."""
    return profiles.agg(F.count(F.lit(1)).alias("total_found"), *[F.count_if(F.col("tier") == t).alias(t.lower()) for t in TIERS])
