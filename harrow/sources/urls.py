"""URL lists from files and from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import text as X


def listed(lines: DataFrame, line: str = "value", out: str = "url") -> DataFrame:
    """(url): one for each line, trimmed; blank lines and comments (#) are left out."""
    return lines.select(X.trim(F.col(line)).alias(out)).where((F.col(out) != "") & ~F.col(out).startswith("#"))


def url_file(spark: SparkSession, path: str) -> DataFrame:
    """(url) of text files with a URL on each line, read in pieces by all executors."""
    return listed(spark.read.text(path))


def inline(text: Column) -> Column:
    """The URLs of a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), X.trim), lambda x: x != "")
