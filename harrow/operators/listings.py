"""Tables that are shown to people: one column a cell, all of them texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE, ADDRESS, SHOWN = 50, 60, 20


def _text(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default))


def jobs(df: DataFrame) -> DataFrame:
    """Job ID, Status, URLs and Progress of (id, status, urls_total, urls_completed, urls_failed); a job without URLs is at 0 %."""
    total, done = F.coalesce("urls_total", F.lit(0)), F.coalesce("urls_completed", F.lit(0)) + F.coalesce("urls_failed", F.lit(0))
    share = F.when(total > 0, F.floor(done / total * 100 + 0.5)).otherwise(0)
    return df.select(
        _text("id").alias("Job ID"), _text("status").alias("Status"), F.concat(done.cast("string"), F.lit("/"), total.cast("string")).alias("URLs"),
        F.concat(share.cast("string"), F.lit("%")).alias("Progress"),
    )


def skills(df: DataFrame) -> DataFrame:
    """Name, Type, URL, Fields and Created of (name, tool, builtin, url, fields, created_at)."""
    kind = F.concat(_text("tool", "extract"), F.when(F.coalesce("builtin", F.lit(False)), " (built-in)").otherwise(""))
    return df.select(
        _text("name").alias("Name"), kind.alias("Type"), _text("url").alias("URL"), F.coalesce(F.array_join("fields", ", "), F.lit("")).alias("Fields"),
        F.coalesce(F.substring_index("created_at", "T", 1), F.lit("")).alias("Created"),
    )


def domains(df: DataFrame) -> DataFrame:
    """Domain, Level, Success%, Reqs, Rate/RPM, AntiBot and Updated of what is known of domains."""
    return df.select(
        _text("domain").alias("Domain"), F.concat(F.lit("L"), _text("optimal_level", "1")).alias("Level"), _text("success_rate", "0%").alias("Success%"), _text("requests", "0").alias("Reqs"),
        _text("rate_limit_rpm", "60").alias("Rate/RPM"), _text("antibot", "none").alias("AntiBot"), _text("last_updated").alias("Updated"),
    )


def found(df: DataFrame, place: str) -> DataFrame:
    """#, Title and URL of the first 20 results (title, name, url, source) by ``place``, which counts from 1."""
    title, url = F.coalesce("title", "name", F.lit("")), F.coalesce("url", "source", F.lit(""))
    return df.where(F.col(place) <= SHOWN).select(F.col(place).cast("string").alias("#"), F.substring(title, 1, TITLE).alias("Title"), F.substring(url, 1, ADDRESS).alias("URL"))
