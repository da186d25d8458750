"""Cookies as rows: the last of each name and domain, and those a request would send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jar(cookies: DataFrame) -> DataFrame:
    """The last cookie (by ``seq``) of each (domain, name)."""
    rest = [c for c in cookies.columns if c not in ("domain", "name")]
    last = cookies.groupBy("domain", "name").agg(F.max_by(F.struct(*rest), "seq").alias("c"))
    return last.select("domain", "name", "c.*")


def alive(now: int):
    """Session cookies (null, -1, 0) and those that expire later, in epoch seconds."""
    return F.col("expires").isNull() | F.col("expires").isin(-1, 0) | (F.col("expires") > now)


def sent(cookies: DataFrame, host: str, path: str, now: int) -> DataFrame:
    bare = F.ltrim(F.col("domain"), F.lit("."))
    suits = (F.lit(host) == bare) | F.lit(host).endswith(F.concat(F.lit("."), bare))
    return cookies.where(suits & F.lit(path).startswith(F.col("path")) & alive(now))
